"""Registered queries of sources and sinks: small files are written from the driver's tables and read back; the SQL states what they must hold from the tables alone."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import scoring as G
from ..shared import fresh_folder, put_file
from ..sources import tables as B
from ..sources import stack_source, stores, tiff
from .queries import label_rows, query, rounded, table

#: Regions are positions and their nations the ROIs of these; the number of frames follows the region.
N_SQL = "n AS (SELECT n_regionkey::INT AS pos, n_nationkey::INT AS roi, (n_regionkey + 2)::INT AS frames FROM nation)"


def nations(spark: SparkSession, sf_dir: str) -> dict[int, list[int]]:
    """The 25 nations by region."""
    out: dict[int, list[int]] = {}
    for r in table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey").collect():
        out.setdefault(int(r.n_regionkey), []).append(int(r.n_nationkey))
    return out


def workspace(spark: SparkSession, sf_dir: str) -> str:
    """An index per region, and a stack of 2 x 3 pixels with two channels per nation: pixel i of frame t and channel c holds nation + 10 t + 100 c + i."""
    folder = fresh_folder(spark)
    for pos, rois in nations(spark, sf_dir).items():
        frames = pos + 2
        index = {"position": pos, "axisOrder": "tczyx", "channelCount": 2, "timeCount": frames, "zCount": 1, "timeIndices": [5 * t for t in range(frames)], "rois": [{"roi": r, "fileName": f"Roi{r}.tif", "bbox": {"roi": r, "x": 0, "y": 0, "w": 3, "h": 2}} for r in rois]}
        put_file(spark, f"{folder}/roi/Pos{pos}/index.json", json.dumps(index).encode())
        for r in rois:
            pages = [(np.arange(6, dtype=np.uint16) + r + 10 * t + 100 * c).reshape(2, 3) for t in range(frames) for c in range(2)]
            put_file(spark, f"{folder}/roi/Pos{pos}/Roi{r}.tif", tiff.encode(pages))
    return folder


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    return B.read_index(spark, f"{folder}/roi/Pos*/index.json")


@query(f"WITH {N_SQL} SELECT pos, roi, 'Roi' || roi || '.tif' AS file_name, frames AS time_count, 2 AS channel_count, (frames - 1) * 5 AS last_frame FROM n")
def s2_index_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = index_of(spark, workspace(spark, sf_dir))
    return rows.select("pos", "roi", "file_name", "time_count", "channel_count", F.element_at("time_indices", -1).alias("last_frame"))


@query(f"WITH {N_SQL} SELECT pos, roi, 1 AS channel_count, range(frames)[-1]::INT AS last_frame FROM n")
def s3_lenient_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    for pos, rois in nations(spark, sf_dir).items():
        put_file(spark, f"{folder}/Pos{pos}/index.json", json.dumps({"position": pos, "timeCount": pos + 2, "rois": [{"roi": r, "fileName": "x"} for r in rois]}).encode())
    rows = B.read_index(spark, f"{folder}/Pos*/index.json", strict=False)
    return rows.select("pos", "roi", "channel_count", F.element_at("time_indices", -1).alias("last_frame"))


@query(f"WITH {N_SQL}, p AS (SELECT n.*, unnest(range(frames)) AS f, c FROM n, (SELECT unnest([0, 1]) AS c)) SELECT pos, roi, (f * 5)::INT AS t, c::INT AS channel, (6 * (roi + 10 * f + 100 * c) + 15)::DOUBLE AS total FROM p")
def s5_s7_stack_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, sf_dir)
    planes = stack_source.planes(spark, folder)
    return planes.select("pos", "roi", "t", "channel", F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query(f"WITH {N_SQL} SELECT pos, roi, 5 AS t, (6 * (roi + 110) + 15)::DOUBLE AS total, (roi + 110.5)::DOUBLE AS background FROM n")
def s8_s9_selected_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, sf_dir)
    planes = tiff.read_stacks(spark, folder, index_of(spark, folder), channels=[1], frames=[1], z=[0])
    rows = A.fluorescence(planes, spark.createDataFrame([(k, 1) for k in range(5)], "pos int, channel int"))
    return rounded(rows.select("pos", "roi", "t", F.col("sum").alias("total"), "background"))


#: Pixels of the stacks above.
PIXELS_SQL = f"{N_SQL}, px AS (SELECT n.*, f, c, i, roi + 10 * f + 100 * c + i AS v FROM n, (SELECT unnest(range(6)) AS f), (SELECT unnest([0, 1]) AS c), (SELECT unnest(range(6)) AS i) WHERE f < frames)"


@query(f"""WITH {PIXELS_SQL}, m AS (SELECT * FROM px WHERE c = 1), q AS (SELECT pos, roi, f, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM m GROUP BY pos, roi, f)
    SELECT m.pos, m.roi, (5 * m.f)::INT AS frame_id, sum((i + 1) * floor(least(greatest((v - own.lo) / greatest(own.hi - own.lo, 1e-6), 0), 1) * 255))::BIGINT AS own,
        sum((i + 1) * floor(least(greatest((v - first.lo) / greatest(first.hi - first.lo, 1e-6), 0), 1) * 255))::BIGINT AS baseline
    FROM m JOIN q own USING (pos, roi, f) JOIN q first ON first.pos = m.pos AND first.roi = m.roi AND first.f = 0 WHERE m.f % 2 = 0 GROUP BY m.pos, m.roi, m.f""")
def s12_movie_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, sf_dir)
    told = F.aggregate(F.transform("gray", lambda g, i: (g * (i + 1)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    own, baseline = (stack_source.movie_frames(spark, folder, channel=1, stride=2, contrast=c).select("pos", "roi", "frame_id", told.alias(name)) for c, name in (("frame", "own"), ("baseline", "baseline")))
    return own.join(baseline, ["pos", "roi", "frame_id"])


@query(f"WITH {PIXELS_SQL} SELECT 'Pos' || pos AS position, roi AS roi_id, f::INT AS frame, sum(v)::DOUBLE AS total FROM px WHERE c = 1 AND f < 2 GROUP BY pos, roi, f")
def s10_s11_two_channel_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = workspace(spark, sf_dir)
    found = tiff.discover(spark, f"{folder}/roi")
    pages = found.join(spark.createDataFrame([(f, tiff.two_channel_page(f, 1, 4)) for f in range(2)], "frame int, page int"))
    planes = stack_source.planes(spark, folder).select("pos", "roi", (F.col("stack_t") * 2 + F.col("channel")).alias("page"), F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x).alias("total"))
    return pages.join(planes, (F.col("position") == F.concat(F.lit("Pos"), "pos")) & (pages["roi_id"] == planes["roi"]) & (pages["page"] == planes["page"])).select("position", "roi_id", "frame", "total")


@query(f"WITH {N_SQL} SELECT sum(frames)::BIGINT AS frames FROM n WHERE pos IN (1, 3)")
def e4_e5_frame_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([(1,), (3,), (99,)], "pos int")  # the last one has no index and is left out
    return B.total_frames(B.skip_missing(wanted, index_of(spark, workspace(spark, sf_dir))))


@query("SELECT s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal, s_acctbal > 0 AS rich FROM supplier")
def s13_s14_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), (F.col("s_acctbal") > 0).alias("rich"))
    B.write_csv(rows, f"{folder}/out")
    return B.read_csv(spark, f"{folder}/out", "s_suppkey long, s_name string, s_acctbal double, rich boolean")


@query(f"WITH {N_SQL} SELECT pos, 2 AS channel, roi, unnest(range(frames))::INT AS t, (roi * 1.5)::DOUBLE AS corrected FROM n")
def s16_s17_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    for pos, rois in nations(spark, sf_dir).items():
        lines = [f"{r},{t},6,1.0,2.0,{r * 1.5}" for r in rois for t in range(pos + 2)]
        put_file(spark, f"{folder}/analysis/Pos{pos}/ch2.csv", "\n".join(["roi,t,area,background,sum,corrected", *lines, ""]).encode())
    return B.read_traces(spark, folder).select("pos", "channel", "roi", "t", "corrected")


@query(f"WITH {N_SQL} SELECT pos, roi, frames - 1 AS t, round(((frames - 1) * 2.75)::DOUBLE, 4) AS minutes, roi % 4 AS engagements FROM n")
def s18_engagement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    for pos, rois in nations(spark, sf_dir).items():
        lines = [f"{r},{pos + 1},{(pos + 1) * 2.75:.4f},1,2,{r % 4}" for r in rois]
        put_file(spark, f"{folder}/analysis/Pos{pos}/engagement.csv", "\n".join(["roi,t,minutes,tumor_cells,t_cells,engagements", *lines, ""]).encode())
    return rounded(B.read_engagement(spark, folder).select("pos", "roi", "t", "minutes", "engagements"), 4)


@query("SELECT (row_number() OVER (ORDER BY r_regionkey) - 1)::INT AS sample_idx, r_name AS name, list_sort(list_distinct([r_regionkey::INT, r_regionkey::INT + 10, r_regionkey::INT + 11, r_regionkey::INT + 12])) AS positions, 0.5::DOUBLE AS interval_minutes FROM region")
def s19_assay(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    names = [(int(r.r_regionkey), r.r_name) for r in table(spark, sf_dir, "region").orderBy("r_regionkey").collect()]
    assay = {"interval": {"value": 30, "unit": "second"}, "analysis": {"channels": {"signal": [1], "segmentation": 0}}, "samples": [{"name": n, "positions": f"{k + 10}:{k + 12}, {k}"} for k, n in names]}
    put_file(spark, f"{folder}/assay.json", json.dumps(assay).encode())
    return B.read_assay(spark, f"{folder}/assay.json").select("sample_idx", "name", F.array_sort("positions").alias("positions"), "interval_minutes")


@query("SELECT n_regionkey::INT AS shard, count(*) AS cells, sum(n_nationkey)::BIGINT AS total FROM nation WHERE n_regionkey <> 2 GROUP BY 1")
def s24_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    for pos, rois in nations(spark, sf_dir).items():
        if pos != 2:  # a shard without the file is skipped
            put_file(spark, f"{folder}/shard{pos}/results/x.csv", "\n".join(["shard,cell", *(f"{pos},{r}" for r in rois), ""]).encode())
    rows = B.read_shards(spark, [f"{folder}/shard{k}" for k in range(5)], "results/x.csv", "shard int, cell long")
    return rows.groupBy("shard").agg(F.count("*").alias("cells"), F.sum("cell").alias("total"))


@query("SELECT 'Pos' || n_regionkey AS position, n_nationkey::INT AS roi_id, 0 AS frame FROM nation WHERE n_nationkey % 3 = 0")
def s26_manifest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.struct(F.concat(F.lit("Pos"), F.col("n_regionkey").cast("string")).alias("position"), F.col("n_nationkey").cast("int").alias("roi_id"), F.lit(0).alias("frame"), F.when(F.col("n_nationkey") % 3 == 0, "val").otherwise("train").alias("split"))
    return B.manifest_split(table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(sample).alias("samples")), "val").select("position", "roi_id", "frame")


@query("""SELECT '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}' AS json FROM part""")
def s27_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.json_rows(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"))


@query("SELECT n_regionkey::INT AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::INT AS line, n_nationkey::VARCHAR AS key, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN (n_nationkey / 4)::DOUBLE END AS share FROM nation")
def s15_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cell of every sheet, read back from the workbooks."""
    share = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") / 4)
    books = B.workbooks(table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("int").alias("region"), "n_nationkey", "n_name", share.alias("share")), "region")

    def cells(batches):  # noqa: ANN001, ANN202
        import io
        import re
        import zipfile

        import pandas as pd

        for pdf in batches:
            for region, content in zip(pdf.region, pdf.content, strict=True):
                sheet = zipfile.ZipFile(io.BytesIO(bytes(content))).read("xl/worksheets/sheet1.xml").decode()
                rows = [[re.sub("<[^>]*>", "", c) for c in re.findall(r"<c/>|<c.*?</c>", row)] for row in re.findall("<row>(.*?)</row>", sheet)][1:]
                yield pd.DataFrame([(region, k + 1, key, name, float(x) if x else None) for k, (key, name, x) in enumerate(rows)], columns=["region", "line", "key", "name", "share"])

    return books.mapInPandas(cells, "region int, line int, key string, name string, share double")


@query("SELECT p_partkey, p_size::VARCHAR AS whole, (p_size + 0.5)::VARCHAR AS half, CASE WHEN p_size % 2 = 0 THEN '' ELSE 'nan' END AS odd FROM part")
def k9_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.columns import rendered

    odd = F.when(F.col("p_size") % 2 == 0, F.lit(None)).otherwise(float("nan")).cast("double")
    return table(spark, sf_dir, "part").select("p_partkey", rendered(F.col("p_size").cast("double")).alias("whole"), rendered(F.col("p_size") + F.lit(0.5)).alias("half"), rendered(odd).alias("odd"))


@query("SELECT n_nationkey AS id, r_name AS ref_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def j11_neighbour_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("ref_idx"))
    return J.neighbour_ids(near, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("ref_idx"), F.col("r_name").alias("id")))


@query("SELECT 'S' || n_regionkey AS sample, count(*) AS n, true AS ordered FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def d27_o1_ordered_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the rows of each sample lie together in one partition and in order."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = A.ordered_traces(rows.select(F.concat(F.lit("S"), F.col("n_regionkey").cast("string")).alias("sample"), F.col("s_suppkey").alias("roi")), "roi")
    rows = rows.select("sample", "roi", F.monotonically_increasing_id().alias("at"))
    return rows.groupBy("sample").agg(F.count("*").alias("n"), ((F.max("at") - F.min("at") + 1 == F.count("*")) & (F.sort_array(F.collect_list(F.struct("at", "roi"))).getField("roi") == F.sort_array(F.collect_list("roi")))).alias("ordered"))


@query("SELECT 'best-' || max(n_nationkey) || '.ckpt' AS checkpoint FROM nation")
def o5_newest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect():
        for name in (f"best-{r.n_nationkey}.ckpt", f"last-{r.n_nationkey}.ckpt"):
            put_file(spark, f"{folder}/{name}", b"x", modified=1_000_000 * (int(r.n_nationkey) + 1))
    return spark.createDataFrame([(G.newest_checkpoint(spark, folder).split("/")[-1],)], "checkpoint string")


@query("SELECT p_partkey::VARCHAR AS id, md5(p_brand) AS sha, (length(p_brand) + CASE WHEN split_part(p_brand, '#', 2)::INT % 2 = 1 THEN 1000 ELSE 0 END)::DOUBLE AS size, split_part(p_brand, '#', 2)::DOUBLE AS told FROM part")
def v7_embed_with_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands that end in an odd digit come from the cache, where 1000 marks them, the others are encoded."""
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").cast("binary").alias("content"))
    text = F.col("content").cast("string")
    known = images.select("content").distinct().where(F.substring_index(text, "#", -1).cast("int") % 2 == 1)
    identity = G.cache_key("m", "1", "p")
    cache = known.select(F.lit(identity).alias("identity"), F.sha2("content", 256).alias("sha"), F.array((F.length(text) + 1000).cast("float"), F.substring_index(text, "#", -1).cast("float")).alias("vector"))
    vectors, _ = G.embed_with_cache(images, cache, lambda contents: [[float(len(c)), float(c.split(b"#")[1])] for c in contents], identity)
    return vectors.join(images, "id").select("id", F.md5("content").alias("sha"), F.col("vector")[0].cast("double").alias("size"), F.col("vector")[1].cast("double").alias("told"))


@query("SELECT p_partkey::VARCHAR AS id, length(p_brand)::DOUBLE AS size, split_part(p_brand, '#', 2)::DOUBLE AS told, (SELECT count(DISTINCT p_brand) FROM part) AS cached FROM part")
def v7_cache_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the images fill a cache on disk, all of them the rest of it; a third run, whose encoder fails, finds everything."""
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").cast("binary").alias("content"))
    path, identity = fresh_folder(spark), G.cache_key("m", "2", "p")

    def encode(contents):  # noqa: ANN001, ANN202
        return [[float(len(c)), float(c.split(b"#")[1])] for c in contents]

    def fail(contents):  # noqa: ANN001, ANN202
        raise ValueError("nothing is left to encode")

    stores.embed_images(spark, images.where(F.substring_index(F.col("content").cast("string"), "#", -1).cast("int") % 2 == 1), path, encode, identity)
    stores.embed_images(spark, images, path, encode, identity)
    found = stores.embed_images(spark, images, path, fail, identity)
    cached = stores.embedding_cache(spark, path, identity).agg(F.count("*").alias("cached"))
    return found.join(cached).select("id", F.col("vector")[0].cast("double").alias("size"), F.col("vector")[1].cast("double").alias("told"), "cached")


@query("""WITH old AS (SELECT 'Pos' || s_nationkey AS position, s_suppkey AS roi_id, (s_suppkey % 50)::INT AS death, 0 AS n FROM supplier),
    new AS (SELECT position, roi_id, 7 AS death, 1 AS n FROM old WHERE roi_id % 3 = 0 UNION ALL SELECT position, roi_id, 5, 1 FROM old WHERE roi_id % 9 = 0 UNION ALL SELECT position, roi_id + 100000, 1, 1 FROM old WHERE roi_id % 5 = 0)
    SELECT position, roi_id, death AS death_frame FROM (SELECT * FROM old UNION ALL SELECT * FROM new) QUALIFY row_number() OVER (PARTITION BY position, roi_id ORDER BY n DESC, death DESC) = 1""")
def s22_label_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written to a store, changed there, and read again."""
    rows, changes = label_rows(spark, sf_dir)
    path = fresh_folder(spark)
    stores.put_labels(spark, path, rows, 60)
    stores.put_labels(spark, path, changes, 60)
    return stores.label_store(spark, path).select("position", "roi_id", "death_frame")


@query("""WITH r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, vec_id % 3 AS kind, embedding FROM embeddings)
    SELECT i AS ref_idx, 'v' || vec_id AS id, CASE kind WHEN 0 THEN 'viable' ELSE 'dead' END AS label, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM r WHERE (vec_id // 10) % 5 <> 0 AND kind < 2""")
def s25_reference_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder with a manifest and an array file made from the embeddings, imported twice into a store and read from it."""
    import io

    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").toPandas()  # a fixture of a few thousand vectors
    folder, path = fresh_folder(spark), fresh_folder(spark)
    listed = [{"id": f"v{v}", "group": f"g{v // 10}", "split": "reference" if v // 10 % 5 else "evaluation", "label": ("viable", "dead", "uncertain")[v % 3]} for v in rows.vec_id]
    out = io.BytesIO()
    np.save(out, np.stack(rows.embedding.to_numpy()).astype(np.float32))
    put_file(spark, f"{folder}/manifest.json", json.dumps({"rows": listed}).encode())
    put_file(spark, f"{folder}/embeddings.json", json.dumps({"model_id": "m", "revision": "1", "ids": [r["id"] for r in listed]}).encode())
    put_file(spark, f"{folder}/embeddings.npy", out.getvalue())
    for _ in range(2):
        stores.add_collection(spark, path, "c", stores.read_collection(spark, folder, "m", "1", 64))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return stores.collection(spark, path, "c").select("ref_idx", "id", "label", F.round(total, 3).alias("total"))


@query("SELECT p_partkey::VARCHAR AS id FROM part WHERE p_partkey % 10 = 3")
def v6_changed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").cast("binary").alias("content"))
    manifest = images.select("id", F.when(F.col("id").cast("long") % 10 == 3, "another").otherwise(F.sha2("content", 256)).alias("sha"))
    return G.check_digests(images, manifest).select("id")


@query("SELECT user_id, count(*) AS frames, ((count(*) - 1) // 32)::INT AS last_batch FROM events GROUP BY 1")
def e1_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = G.batch_numbers(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], 32, "event_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("frames"), F.max("batch").alias("last_batch"))


@query("SELECT 'Pos' || s_nationkey AS position, s_suppkey::INT AS roi_id, CASE WHEN s_suppkey % 2 = 0 THEN (s_suppkey % 50)::INT END AS death_time_toto, s_suppkey % 5 + 1 AS frames, (s_suppkey / 4)::DOUBLE AS last FROM supplier")
def s28_inference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inference rows written as JSON and read again."""
    k, path = F.col("s_suppkey"), fresh_folder(spark)
    series = F.transform(F.sequence(F.lit(0).cast("long"), k % 5), lambda i: F.when(i == k % 5, k / 4).otherwise(0.0).cast("float"))
    rows = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("Pos"), F.col("s_nationkey").cast("string")).alias("position"), k.cast("int").alias("roi_id"), (k % 5 + 1).cast("int").alias("frame_count"), F.when(k % 2 == 0, (k % 50).cast("int")).alias("death_time_toto"),
        F.lit(None).cast("int").alias("death_time_viability"), series.alias("toto_raw"), series.alias("toto_alive"), series.alias("death_probability"),
    )
    B.write_inference(rows, path)
    back = B.read_inference(spark, path)
    return back.select("position", "roi_id", "death_time_toto", F.size("toto_raw").cast("long").alias("frames"), F.element_at("death_probability", -1).cast("double").alias("last"))
