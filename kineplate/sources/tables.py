"""Readers and writers of index, assay, label, prediction and trace files."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable
from datetime import UTC, datetime
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schemas as S
from ..functions.columns import interval_minutes, parse_positions, rendered, truthy


def position_folder(workspace: str, pos: int) -> str:
    """Folder of a position's ROI stacks; Spark's reader reports it when it is missing."""
    return f"{workspace}/roi/Pos{pos}"


def _fail(text: str, kind: str) -> Column:
    return F.raise_error(F.lit(text)).cast(kind)


def read_index(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """One row per ROI of position indices.

    Strictly, axes must be TCZYX, ROIs and matching frame ids there; leniently,
    missing axes and counts have defaults.
    """
    raw = spark.read.schema(S.POSITION_INDEX).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if not strict:
        raw = raw.withColumns({"axisOrder": F.coalesce("axisOrder", F.lit("TCZYX")), "timeCount": F.coalesce("timeCount", F.lit(1)), "channelCount": F.coalesce("channelCount", F.lit(1)), "zCount": F.coalesce("zCount", F.lit(1))})
    times = F.coalesce("timeIndices", F.sequence(F.lit(0), F.col("timeCount") - 1))
    rois = F.col("rois")
    if strict:
        rois = F.when(F.upper("axisOrder").eqNullSafe("TCZYX"), rois).otherwise(_fail("axis order must be TCZYX", raw.schema["rois"].dataType.simpleString()))
        rois = F.when(F.coalesce(F.size("rois") > 0, F.lit(False)), rois).otherwise(_fail("a position needs ROIs", raw.schema["rois"].dataType.simpleString()))
        times = F.when(F.size(times) == F.col("timeCount"), times).otherwise(_fail("timeIndices must have timeCount entries", "array<int>"))
    rows = raw.select(F.col("position").alias("pos"), F.col("timeCount").alias("time_count"), F.col("channelCount").alias("channel_count"), F.col("zCount").alias("z_count"), times.alias("time_indices"), F.explode(rois).alias("r"))
    return rows.select("pos", F.col("r.roi").alias("roi"), F.col("r.fileName").alias("file_name"), "time_count", "channel_count", "z_count", "time_indices", F.col("r.bbox.w").alias("width"), F.col("r.bbox.h").alias("height"))


def total_frames(index: DataFrame) -> DataFrame:
    """One row (frames): ROIs times frames over all indexed positions, 0 for none."""
    return index.agg(F.coalesce(F.sum(F.col("time_count").cast("long")), F.lit(0)).alias("frames"))


def skip_missing(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """E5: index rows of wanted positions; a position without an index is left out, not an error."""
    return index.join(wanted.select("pos").distinct(), "pos", "left_semi")


def read_assay(spark: SparkSession, path: str) -> DataFrame:
    """The sample mapping with interval_minutes; an assay without samples is an error."""
    raw = spark.read.schema(S.ASSAY).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    samples = F.when(F.coalesce(F.size("samples") > 0, F.lit(False)), F.col("samples")).otherwise(_fail("an assay needs samples", raw.schema["samples"].dataType.simpleString()))
    rows = raw.select("analysis.channels.signal", "analysis.channels.segmentation", interval_minutes("interval.value", "interval.unit").alias("interval_minutes"), F.posexplode(samples).alias("sample_idx", "s"))
    return rows.select("sample_idx", F.col("s.name").alias("name"), parse_positions("s.positions").alias("positions"), "signal", "segmentation", "interval_minutes")


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows under a header; a record of another width is an error. All columns of the header are matched by name."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; doubles as their shortest text and booleans in small letters."""
    out = df.select(*(rendered(f.name).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))
    out.write.mode(mode).option("header", "true").csv(path)


def trace_files(df: DataFrame) -> DataFrame:
    """Pos and channel of rows read from Pos<n>/ch<m>.csv, by the file they came from; other files are dropped."""
    part = r"/Pos(\d+)/ch(\d+)\.csv$"
    rows = df.withColumn("_f", F.col("_metadata.file_path"))
    rows = rows.withColumn("pos", F.regexp_extract("_f", part, 1)).withColumn("channel", F.regexp_extract("_f", part, 2)).where("pos <> ''")
    return rows.withColumn("pos", F.col("pos").cast("int")).withColumn("channel", F.col("channel").cast("int")).drop("_f")


def read_traces(spark: SparkSession, workspace: str) -> DataFrame:
    """(pos, channel, roi, t, area, background, sum, corrected) of workspace/analysis/Pos*/ch*.csv."""
    return trace_files(spark.read.schema(S.FLUORESCENCE).option("header", "true").option("mode", "FAILFAST").csv(f"{workspace}/analysis/Pos*/ch*.csv"))


def read_engagement(spark: SparkSession, workspace: str) -> DataFrame:
    """Engagement rows of workspace/analysis/Pos*/engagement.csv with their position."""
    rows = spark.read.schema(S.ENGAGEMENT).option("header", "true").option("mode", "FAILFAST").csv(f"{workspace}/analysis/Pos*/engagement.csv")
    return rows.select(F.regexp_extract("_metadata.file_path", r"/Pos(\d+)/engagement\.csv$", 1).cast("int").alias("pos"), "*")


def parse_predictions(raw: DataFrame) -> DataFrame:
    """Typed predictions from text columns; bad t or crop are errors, a bad or missing pos is 0."""
    whole = lambda c: F.expr(f"CAST(CAST({c} AS double) AS int)")
    pos = F.expr("coalesce(try_cast(try_cast(pos AS double) AS int), 0)") if "pos" in raw.columns else F.lit(0)
    S.require_columns(raw, "t", "crop", "label")
    extra = F.expr("try_cast(p_dead AS double)") if "p_dead" in raw.columns else F.lit(None).cast("double")
    sample = F.coalesce(F.col("sample"), F.lit("")) if "sample" in raw.columns else F.lit("")
    return raw.select(whole("t").alias("t"), whole("crop").alias("crop"), extra.alias("p_dead"), truthy("label").alias("label"), pos.alias("pos"), sample.alias("sample"))


def read_shards(spark: SparkSession, shards: list[str], relative: str, schema: str) -> DataFrame:
    """Rows of the same CSV of several shard folders; those without it are skipped, none at all is an error."""
    found = []
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for shard in shards:
        path = hadoop(f"{shard}/{relative}")
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path):
            found.append(f"{shard}/{relative}")
    if not found:
        raise ValueError(f"no shard holds {relative}")
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(found)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Manual labels; of repeated keys the last one in the file wins."""
    raw = spark.read.schema(S.MANUAL_LABELS).option("multiLine", "true").json(path)
    order = Window.partitionBy("position", "roi_id").orderBy(F.desc("_o"))
    rows = raw.withColumn("_o", F.monotonically_increasing_id())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_o")


def upserted(labels: DataFrame, changes: DataFrame, frame_count: int, now: datetime | None = None) -> DataFrame:
    """labels with changes(position, roi_id, death_frame) put in; frames outside 0..frame_count are errors."""
    ok = F.col("death_frame").between(0, frame_count)
    stamp = (now or datetime.now(UTC)).isoformat()
    new = changes.select("position", "roi_id", F.when(ok, F.col("death_frame")).otherwise(_fail("death_frame is outside the movie", "int")).alias("death_frame"), F.lit(stamp).alias("labeled_at"), F.lit(1).alias("_n"))
    both = labels.select("position", "roi_id", "death_frame", "labeled_at", F.lit(0).alias("_n")).unionByName(new)
    # of several changes of one key the latest death frame stands, and none before any
    order = Window.partitionBy("position", "roi_id").orderBy(F.desc("_n"), F.desc("death_frame"))
    return both.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_n")


def upsert_labels(labels: DataFrame, changes: DataFrame, frame_count: int, now: datetime | None = None) -> DataFrame:
    """Labels with changes put in, sorted by key."""
    return upserted(labels, changes, frame_count, now).orderBy(F.concat("position", F.lit("/Roi"), F.col("roi_id").cast("string")))


def check_references(references: DataFrame, model: str, revision: str) -> DataFrame:
    """A reference collection(ref_idx, model, revision, label, group, vector, evaluation) as it is, or an error that says what is wrong with it."""
    size = F.size("vector")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    one = references.agg(
        F.count("*").alias("n"), F.sum(((F.col("model") != model) | (F.col("revision") != revision)).cast("int")).alias("strange"),
        F.countDistinct("ref_idx").alias("ids"), F.min("ref_idx").alias("lo"), F.max("ref_idx").alias("hi"), F.countDistinct(size).alias("sizes"), F.sum(bad.cast("int")).alias("bad"),
    ).first()
    problems = {"no reference": not one.n, "another model or revision": one.strange, "order is not 0..n-1": one.n and (one.ids != one.n or one.lo != 0 or one.hi != one.n - 1), "vectors differ in length": one.sizes and one.sizes > 1, "vectors must be finite and not zero": one.bad}
    if found := [text for text, wrong in problems.items() if wrong]:
        raise ValueError("; ".join(found))
    return references


def manifest_split(manifest: DataFrame, split: str) -> DataFrame:
    """Samples of one split of a manifest(samples array<struct<split, ...>>), one row each."""
    return manifest.select(F.explode("samples").alias("s")).where(F.col("s.split") == split).select("s.*")


def json_rows(df: DataFrame, into: str = "json") -> DataFrame:
    """One column with each row as JSON text; NaN and infinity, in arrays as well, are errors."""

    def sound(name: str, kind: T.DataType) -> Column:
        bad = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.when(F.coalesce(bad(F.col(name)), F.lit(False)), _fail("NaN and infinity are no JSON", kind.simpleString())).otherwise(F.col(name)).alias(name)
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.DoubleType, T.FloatType)):
            return F.when(F.coalesce(F.exists(name, bad), F.lit(False)), _fail("NaN and infinity are no JSON", kind.simpleString())).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return df.select(F.to_json(F.struct(*(sound(f.name, f.dataType) for f in df.schema)), {"ignoreNullFields": "false"}).alias(into))


def write_inference(df: DataFrame, path: str) -> None:
    """Inference rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_inference(spark: SparkSession, path: str) -> DataFrame:
    """S28."""
    return spark.read.schema(S.INFERENCE).json(path)


#: Rows of a sheet (limit of the format).
SHEET_ROWS = 1_048_576


def workbooks(df: DataFrame, by: str) -> DataFrame:
    """(by, content): a workbook of one sheet with a header for each value of `by`, rows in order of their columns; made where the rows are, and rows of one value must fit a sheet. Finite numbers are numbers, nulls no cell."""
    names = [c for c in df.columns if c != by]
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    if sizes.where(F.col("n") >= SHEET_ROWS).limit(1).count():
        raise ValueError("too many rows for a sheet")

    def book(table: pa.Table) -> pa.Table:
        rows = table.sort_by([(c, "ascending") for c in names]) if table.num_rows else table
        return pa.table({by: rows.column(by).slice(0, 1), "content": pa.array([_workbook(names, zip(*(rows.column(c).to_pylist() for c in names), strict=True))], pa.binary())})

    return df.groupBy(by).applyInArrow(book, f"`{by}` {df.schema[by].dataType.simpleString()}, content binary")


def _workbook(names: list[str], rows: Iterable[tuple]) -> bytes:
    cells = io.StringIO()
    cells.write('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>')

    def cell(value: object) -> str:
        if value is None or value == "":
            return "<c/>"
        if isinstance(value, bool):
            value = "true" if value else "false"
        try:
            number = float(value)
            if number - number == 0:
                return f"<c><v>{value if isinstance(value, int) else number!r}</v></c>"
        except (TypeError, ValueError):
            pass
        return f'<c t="inlineStr"><is><t>{escape(str(value))}</t></is></c>'

    cells.write("<row>" + "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in names) + "</row>")
    for row in rows:
        cells.write("<row>" + "".join(map(cell, row)) + "</row>")
    cells.write("</sheetData></worksheet>")
    parts = {
        "[Content_Types].xml": '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": '<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": cells.getvalue(),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
