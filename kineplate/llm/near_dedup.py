"""MinHash near-duplicate groups from bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct word shingles. Two documents
are linked when the Jaccard similarity of their sets reaches the threshold;
groups are the connected components of the links.

1.  Documents with equal sets form a class with a number of its own, the node
    that is compared. Classes are known by their sets, not by ids, so one id
    with several texts is in the class of each.
2.  A sketch keeps the K smallest hashes. Inverted lists of the retained
    values generate overlaps. A link at 0.8 shares about 0.8 K of the retained
    values, and fewer than NEED of them with a probability below 1e-9, so only
    the K - NEED + 1 rarest retained values of a document are listed: a passage
    that many documents share stays out of the lists unless most of a document
    consists of it. Sets of fewer than K * 0.8 shingles are sketched whole and
    use the exact bound instead.
3.  Every member of a list is compared with the list's smallest one, not with
    all. A pair passes when the union sketch estimates at least the threshold
    less SLACK standard errors, and is then confirmed on the full sets.
4.  Lists that still hold more than one component form families (members of a
    list are of one family). A family is compared in tiles of at most TILE
    documents and TILE_BYTES: the inverted lists of the tile's retained values,
    as the columns of a matrix, give the overlaps of documents in different
    components; those that may reach the threshold pass the union-sketch
    estimate and then the full sets. A tile pair returns a forest of its links,
    never pairs, and pairs whose components it has joined are not tested again.

Documents without words have an empty set and no links. Null ids link with
nothing and get a null component. Repeated rows are members of one class; a
class has its smallest id. Texts are read whole, in slices; a very long one is a
slice of its own. Other columns are not read. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .workspace import FAIR, SLIM, Workspace

K, NEED, SLACK = 64, 26, 6.0
#: Documents of a tile and bytes of their sets.
TILE, TILE_BYTES = 1024, 16 << 20


def _need(n: int, percent: int) -> int:
    """Retained values that a linked document of n shingles shares with its partner."""
    return -(-percent * n // 100) if n * 100 < K * percent else NEED


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, t, n, h1, h2, sketch): hash of the text, set size, 128-bit hash of the set, the K smallest hashes."""
    schema = "doc_id long, t long, n long, h1 long, h2 long, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                ids, size, first, second, kept, at = part.column(0), [], [], [], [], [0]
                for s in T.shingle_sets(part.column(1), width):
                    m = T.mix(s)
                    size.append(len(s))
                    first.append(int(m.sum(dtype=np.uint64).astype(np.int64)))
                    second.append(int((m * (s | np.uint64(1))).sum(dtype=np.uint64).astype(np.int64)))
                    kept.append(s[:K])
                    at.append(at[-1] + len(kept[-1]))
                values = pa.array(np.concatenate(kept).view(np.int64))
                yield pa.RecordBatch.from_arrays([ids, part.column(2), pa.array(size, pa.int64()), pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)], ["doc_id", "t", "n", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _text_hash()).mapInArrow(run, schema)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("t")


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, shingles): the sorted hashes of the whole set of each of nodes(node, rep, t), a document known by its id and text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                sets = [s.tobytes() for s in T.shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), _text_hash())
    # the nodes grow with the documents: merged at every size, never broadcast
    wanted = nodes.withColumnRenamed("t", "u").hint("merge")
    return texts.join(wanted, (F.col("id") == F.col("rep")) & (F.col("t") == F.col("u"))).select("node", "text").mapInArrow(run, "node long, shingles binary")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Share of the union's smallest K values that both sketches hold, and how many values that rests on."""
    union = np.union1d(a, b)
    if len(a) >= K or len(b) >= K:
        union = union[:K]
    both = np.isin(union, a, assume_unique=True) & np.isin(union, b, assume_unique=True)
    return both.sum() / max(len(union), 1), len(union)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) > 0


def passes_estimate(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    share, seen = estimate(a, b)
    q = percent / 100
    return share >= q - SLACK * np.sqrt(q * (1 - q) / max(seen, 1))


def _listed(ws: Workspace, reps: DataFrame, percent: int) -> DataFrame:
    """(v, node, first): members of the inverted lists of rare retained values, with each list's smallest member."""
    posted = reps.select("node", "n", F.explode("sketch").alias("v"))
    # written, so that the join deals both sides anew and hot values can be split
    often = ws.table(posted.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "often", SLIM)
    share = F.when(F.col("n") * 100 < K * percent, F.ceil(F.col("n") * percent / 100)).otherwise(NEED).cast("int")
    kept = posted.join(often, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("by_df"))
    # values that occur once come first in the order of rarity; they link nothing but count
    kept = kept.withColumn("take", F.size("by_df") - share + 1).where("take > 0")
    kept = ws.table(kept.select("node", F.explode(F.slice("by_df", F.lit(1), F.col("take"))).alias("x")).select("node", F.col("x.v").alias("v")), "rare", FAIR)
    lists = kept.groupBy("v").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("node")).alias("sig"), F.min("node").alias("first"), F.max("node").alias("last")).where("m > 1")
    lists = lists.groupBy("m", "sig", "first", "last").agg(F.min("v").alias("v"))  # lists with the same members test the same pairs
    return ws.table(kept.join(lists.select("v", "first"), "v"), "listed", SLIM)


def _confirmed(ws: Workspace, pairs: DataFrame, small: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Those of pairs(a, b) whose documents are linked."""

    def passes(na: pd.Series, sa: pd.Series, nb: pd.Series, sb: pd.Series) -> pd.Series:
        out = np.zeros(len(na), bool)
        for i, (x, s, y, t) in enumerate(zip(na, sa, nb, sb, strict=True)):
            if 100 * min(x, y) >= percent * max(x, y):
                out[i] = passes_estimate(np.asarray(s).view(np.uint64), np.asarray(t).view(np.uint64), percent)
        return pd.Series(out)

    def exact(sa: pd.Series, sb: pd.Series) -> pd.Series:
        return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(sa, sb, strict=True)], dtype=bool)

    def side(frame: DataFrame, key: str) -> DataFrame:
        return frame.select(*(F.col(c).alias(key if c == "node" else f"{c}_{key}") for c in frame.columns))

    test = F.pandas_udf(passes, "boolean")
    sure = F.pandas_udf(exact, "boolean")
    likely = pairs.join(side(small, "a"), "a").join(side(small, "b"), "b").where(test("n_a", "sketch_a", "n_b", "sketch_b")).select("a", "b")
    likely = ws.table(likely, f"{name}-likely", FAIR)
    return likely.join(side(sets, "a"), "a").join(side(sets, "b"), "b").where(sure("shingles_a", "shingles_b")).select("a", "b")


def _tiles(ws: Workspace, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within the families of members(node, n, component, family); each pair of tiles returns a forest."""
    sized = members.join(ws.table(members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / TILE, F.sum("n") * 8 / TILE_BYTES)).cast("int").alias("tiles")), "sizes", SLIM), "family")
    spot = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = sized.withColumn("spot", spot).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("family", "node", "component", "spot", F.least("spot", "other").alias("i"), F.greatest("spot", "other").alias("j"))
    dealt = dealt.join(sets, "node")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, comp, spots = pdf.node.to_numpy(), pdf.component.to_numpy(), pdf.spot.to_numpy()
        full = [np.frombuffer(x, np.uint64) for x in pdf.shingles]
        n = np.array([len(x) for x in full])
        kept = [x[:K] for x in full]
        _, code, often = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
        rank = np.cumsum(often > 1) - 1
        shared = np.zeros((len(ids), int((often > 1).sum())), np.float32)
        rows = np.repeat(np.arange(len(ids)), [len(x) for x in kept])
        two = often[code] > 1
        shared[rows[two], rank[code[two]]] = 1
        overlap = shared @ shared.T
        large, small = np.maximum.outer(n, n), np.minimum.outer(n, n)
        bound = np.where(large <= K, np.ceil(large * percent / 100), NEED)
        test = (comp[:, None] != comp) & (100 * small >= percent * large) & (overlap >= bound)
        if pdf.i.iloc[0] != pdf.j.iloc[0]:
            test &= spots[:, None] != spots
        xs, ys = np.nonzero(np.triu(test, 1))
        best = np.argsort(-overlap[xs, ys], kind="stable")
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        out = []
        for x, y in zip(xs[best].tolist(), ys[best].tolist(), strict=True):
            p, q = find(int(comp[x])), find(int(comp[y]))
            if p != q and passes_estimate(kept[x], kept[y], percent) and similar(full[x], full[y], percent):
                root[max(p, q)] = min(p, q)
                out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return dealt.groupBy("family", "i", "j").applyInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs(doc_id, text, ...).

    component_id is the smallest doc_id that links reach, kept says whether it
    is the row's own. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    with Workspace(spark, "near-dedup") as ws:
        drawn = ws.table(sketches(docs, width), "sketches")
        real = drawn.where("doc_id is not null and n > 0")
        classes = real.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc_id", "t")).alias("of"))
        # written once, so the numbers stay
        classes = ws.table(classes.select("n", "h1", "h2", "of.doc_id", "of.t", F.monotonically_increasing_id().alias("node")).withColumnRenamed("doc_id", "rep"), "classes", SLIM)
        ids = real.join(classes.select(F.col("rep").alias("doc_id"), "t", "node"), ["doc_id", "t"])
        twice = real.count() > real.select("doc_id", "t").distinct().count()
        reps = ws.table((ids.dropDuplicates(["node"]) if twice else ids).select("node", "n", "sketch"), "reps", FAIR)
        members = _listed(ws, reps, percent)
        listed = members.select("node").distinct()
        small = ws.table(reps.join(listed, "node"), "small", SLIM)
        sets = full_sets(docs, classes.join(listed, "node").select("node", "rep", "t"), width)
        sets = ws.table(sets.dropDuplicates(["node"]) if twice else sets, "sets")

        pairs = members.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
        links = ws.table(_confirmed(ws, pairs, small, sets, percent, "one"), "links-1", FAIR)
        found = components(ws, links, "one")
        state = members.join(found.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        unsettled = ws.table(state.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("v"), "unsettled", SLIM)
        left = ws.table(state.join(unsettled, "v").select("node", "component", "first").distinct(), "left", SLIM)
        if left.limit(1).count():
            families = components(ws, left.select(F.col("first").alias("a"), F.col("node").alias("b")), "family")
            rest = left.select("node", "component").distinct().join(families.select(F.col("id").alias("node"), F.col("component").alias("family")), "node")
            rest = rest.join(small.select("node", "n"), "node")
            more = ws.table(links.union(_tiles(ws, rest, sets, percent)), "links-2", FAIR)
            found = components(ws, more, "two")

        least = found.join(classes.select(F.col("node").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
        group = classes.join(found.join(least, "component").select(F.col("id").alias("node"), "least"), "node", "left")
        group = group.select(F.col("n").alias("cn"), F.col("h1").alias("c1"), F.col("h2").alias("c2"), F.coalesce("least", "rep").alias("group_id"))
        out = drawn.join(group, (F.col("n") == F.col("cn")) & (F.col("h1") == F.col("c1")) & (F.col("h2") == F.col("c2")), "left")
        component = F.when(F.col("n") > 0, F.col("group_id")).otherwise(F.col("doc_id"))
        component = F.when(F.col("doc_id").isNotNull(), component)
        out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
        return ws.keep(out)
