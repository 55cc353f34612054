"""Deduplication of lines by levelled sorted runs of line hashes.

The table is cut into batches of whole documents, and each batch goes through
the same steps:

1.  The batch's lines are counted by hash: in how many documents each stands.
2.  The counts are merge-anti-joined with the runs of settled lines. A line is
    settled once it is known to stand in enough documents; it is dropped
    whatever comes, so later batches need not count or store it.
3.  What is left is added as the batch's own run of level 0, a Parquet table
    (h1, h2, n_docs) sorted by hash within hash partitions; lines that reach
    the number in this batch alone go to a run of settled lines instead.
4.  When FAN runs of a level are there, they are compacted into one of the next:
    their counts are added up, and lines that reach the number move to the
    settled runs, which are compacted in the same way.

So a batch meets few runs however many came before it. At the end the open runs
are added up once more; what reaches the number there and the settled runs are
the lines to drop. Their places are looked up by hash, apart from the texts.

Only DataFrame functions are used. Hashes have 128 bits. Null and empty texts
are one empty line. Documents are counted by id: rows with the same id, null
ids among them, are one document, each with its own lines and output row. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import SLIM, Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of a level that are compacted into one of the next.
FAN = 4
#: Documents of a batch in a table with as many; a table with twice as many rows has one batch more.
BATCH_ROWS = 1 << 14


def batches_of(rows: int) -> int:
    """Batches grow with the logarithm of the rows, so that their number stays small and their size follows the table."""
    return max(1, (max(rows - 1, 0) // BATCH_ROWS).bit_length() + 1)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(text: Column, least: int) -> Column:
    """For each line the hash of its key, a struct of two longs; null for keys with fewer than `least` code points.

    One transform follows the other so that a lambda names its argument's
    expression once: what a lambda repeats is computed again each time.
    """
    bare = F.transform(split_lines(text), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))
    # lower() folds other letters too, so only ASCII takes this faster way
    keys = F.transform(bare, lambda x: F.when(F.octet_length(x) == F.length(x), F.lower(x)).otherwise(F.translate(x, UPPER, LOWER)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(7), k).alias("h2"))))


class LineRuns:
    """Levelled runs of open and of settled lines in a workspace's folder. documents: from how many on a line is settled."""

    def __init__(self, ws: Workspace, documents: int, name: str = "runs"):
        self.ws, self.documents, self.name, self.made = ws, documents, name, 0
        self.open: list[list[tuple[str, DataFrame]]] = []
        self.settled: list[list[tuple[str, DataFrame]]] = []

    def add(self, counted: DataFrame) -> None:
        """Adds the counts (h1, h2, n_docs) of a batch's lines that no settled run holds, and compacts full levels."""
        self._write(self.unsettled(counted), 0)

    def _write(self, counts: DataFrame, level: int) -> None:
        """Writes open and settled lines as runs of their own, in one pass."""
        self.made += 1
        name = f"{self.name}/{self.made}"
        both = counts.withColumn("settled", (F.col("n_docs") >= self.documents).cast("int"))
        made = self.ws.table(both.sortWithinPartitions("settled", "h1", "h2"), name, SLIM, "settled")
        self._place(self.open, level, f"{name}/settled=0", made.where("settled = 0").select("h1", "h2", "n_docs"))
        self._place(self.settled, 0, f"{name}/settled=1", made.where("settled = 1").select("h1", "h2"))
        if len(self.settled[0]) >= FAN:
            self._compact_settled(0)
        if len(self.open[level]) >= FAN:
            runs, self.open[level] = self.open[level], []
            self._write(_sum(runs), level + 1)
            self._drop(runs)

    def _compact_settled(self, level: int) -> None:
        runs, self.settled[level] = self.settled[level], []
        self.made += 1
        name = f"{self.name}/{self.made}"  # a line may have been settled by several open runs
        self._place(self.settled, level + 1, name, self.ws.table(_all(runs).distinct().sortWithinPartitions("h1", "h2"), name, SLIM))
        self._drop(runs)
        if len(self.settled[level + 1]) >= FAN:
            self._compact_settled(level + 1)

    @staticmethod
    def _place(levels: list[list[tuple[str, DataFrame]]], level: int, name: str, run: DataFrame) -> None:
        while len(levels) <= level:
            levels.append([])
        levels[level].append((name, run))

    def _drop(self, runs: list[tuple[str, DataFrame]]) -> None:
        for name, _ in runs:
            self.ws.drop(name)

    def unsettled(self, lines: DataFrame) -> DataFrame:
        """Rows of lines(h1, h2, ...) whose line no settled run holds: one merge-anti-join with each run."""
        for level in self.settled:
            for _, run in level:
                lines = lines.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        return lines

    def common(self) -> DataFrame:
        """(h1, h2) of all lines in enough documents."""
        rest = [run for level in self.open for run in level]
        found = [_all(level) for level in self.settled if level]
        found += [_sum(rest).where(F.col("n_docs") >= self.documents).select("h1", "h2")] if rest else []
        both = found[0]
        for more in found[1:]:
            both = both.unionByName(more)
        return both.distinct()


def _all(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    both = runs[0][1]
    for _, run in runs[1:]:
        both = both.unionByName(run)
    return both


def _sum(runs: list[tuple[str, DataFrame]]) -> DataFrame:
    return _all(runs).groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"))


def count_lines(hashed: DataFrame, repeated: DataFrame | None = None) -> DataFrame:
    """(h1, h2, n_docs): in how many documents of hashed(row_id, hashes, ...) each line stands. repeated: the ids of several rows, if there are any; only their lines are made distinct first."""

    def lines(rows: DataFrame) -> DataFrame:
        each = rows.select("row_id", F.explode(F.array_distinct(F.filter("hashes", lambda h: h.isNotNull()))).alias("h"))
        return each.select("row_id", "h.h1", "h.h2")

    if repeated is None:
        once = lines(hashed)
    else:
        again = repeated.withColumnRenamed("row_id", "again").hint("merge")
        same = hashed["row_id"].eqNullSafe(again["again"])
        once = lines(hashed.join(again, same, "left_anti")).unionByName(lines(hashed.join(again, same, "left_semi")).distinct())
    return once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))


def drop_common_lines(docs: DataFrame, least: int = 1, documents: int = 10, keep_first: bool = False) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines whose key (of `least` code points or more) stands in at least `documents` documents are dropped everywhere, or with keep_first everywhere but in the document with the smallest id.

    Needs columns text and doc_id; all columns stay, but for those named
    n_lines, n_dropped or kept_text, which the new ones replace. The places to
    drop are looked up apart from the texts and joined to them by row, so a line
    that stands in a third of all documents moves no text. The table of places
    stays in the shared folder, as the result reads it.
    """
    ws = Workspace(docs.sparkSession, "line-dedup")
    runs = LineRuns(ws, documents)
    # a row is known by its id and a hash, so rows with the same id keep apart
    mark = [F.col("doc_id").alias("row_id"), F.xxhash64("doc_id", "text").alias("row_hash")]
    hashed = ws.table(docs.select(*mark, line_hashes(F.col("text"), least).alias("hashes")), "hashed")
    ids = hashed.groupBy("row_id").agg(F.count("*").alias("times"))
    repeated = ws.table(ids.where("times > 1").select("row_id"), "repeated", SLIM)
    repeated = repeated if repeated.limit(1).count() else None
    batches = batches_of(hashed.count())
    for k in range(batches):  # by id, so a document is in one batch
        runs.add(count_lines(hashed.where(F.pmod(F.xxhash64("row_id"), F.lit(batches)) == k), repeated))
    common = ws.table(runs.common(), "common", SLIM)
    placed = hashed.select("row_id", "row_hash", F.posexplode("hashes").alias("at", "h")).where("h is not null")
    placed = placed.select("row_id", "row_hash", "at", "h.h1", "h.h2").join(common, ["h1", "h2"])
    if keep_first:
        placed = ws.table(placed, "placed")
        first = placed.groupBy("h1", "h2").agg(F.min("row_id").alias("first"))
        placed = placed.join(first, ["h1", "h2"]).where(~F.col("row_id").eqNullSafe(F.col("first")))
    gone = ws.table(placed.groupBy("row_id", "row_hash").agg(F.collect_set("at").alias("gone")), "gone", SLIM)
    texts = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    rows = texts.select("row", "id", F.xxhash64("id", texts["row.text"]).alias("hash"), split_lines(F.col("text")).alias("lines"))
    rows = rows.join(gone, rows["id"].eqNullSafe(gone["row_id"]) & (rows["hash"] == gone["row_hash"]), "left")
    gone_ = F.coalesce("gone", F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone_)
    text = F.when(F.size(gone_) == 0, F.coalesce(F.col("row.text").cast("string"), F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at("lines", i + 1)), "\n"))
    out = rows.select("row", F.size("lines").cast("long").alias("n_lines"), F.size(gone_).cast("long").alias("n_dropped"), text.alias("kept_text"))
    for name in (runs.name, "common", "hashed", "placed", "repeated"):
        ws.drop(name)
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_dropped", "kept_text")]
    return out.select(*own, "n_lines", "n_dropped", "kept_text")
