"""Clusters of embeddings by whole-number k-means with Hamerly's bounds.

Each component x of a vector becomes floor(scale * x), so that distances, sums
and centroids are exact. Vectors are packed once, where they are read, into
blocks of at most BLOCK_BYTES. Every round is one pass over the blocks:

*   A block's bounds are mapped from the shared folder: for each vector its
    cluster, an upper bound of the distance to that centroid and a lower bound
    of the distance to any other.
*   Upper bounds grow by the drift of the vector's centroid, lower bounds fall
    by the largest drift of the others. A vector whose upper bound stays below
    the lower one, or below half the way from its centroid to the next one,
    keeps its cluster. All bounds are rounded outwards.
*   The other, ambiguous vectors get their exact distances to all centroids;
    ties go to the smaller number. Both bounds are tight again.
*   New bounds are written under the round's own name. What goes on to the
    driver is, for each task, the sum of the vectors that came to and left each
    cluster: k * dims numbers, which Spark adds up.

Repeated tasks write the same bytes. Two rounds of bounds exist at a time.

Left out are vectors that are null, don't have `dims` components, or hold null
or non-finite ones; also those with a component of LIMIT or more after scaling,
none of whose distances fits a long. Components too large for exact products of
doubles are compared as Python's whole numbers. Distances and inertias that
don't fit a long are null. Rows with a null id are clustered, but start no
cluster. Repeated rows count each; of equal hashes the smaller vector starts
first. Fewer vectors than k start as many clusters. An empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, local_path, save

#: Bytes of a block's vectors, rows scanned at once, and the size of a component from which vectors are left out.
BLOCK_BYTES, ROWS, LIMIT = 8 << 20, 8192, 2.0**58
#: Rounding of square roots and sums, outwards.
UP, DOWN = 1 + 1e-14, 1 - 1e-14
BOUNDS = np.dtype([("upper", "f8"), ("lower", "f8"), ("cluster", "i4")])
BLOCKS = "block long, wide boolean, ids array<long>, vectors binary, starts array<struct<hash string, vector array<long>>>"


def narrow(dims: int) -> float:
    """Components below this have exact squared distances in doubles."""
    return 2.0 ** ((51 - (dims - 1).bit_length()) // 2)


def whole_vectors(column: pa.Array, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are kept, their floored components as doubles) of a list column."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = column.offsets.to_numpy()
    sound = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(ends) == dims))
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null becomes NaN
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale * values[ends[sound][:, None] + np.arange(dims)])
    kept = np.isfinite(values[ends[sound][:, None] + np.arange(dims)]).all(1) & (np.abs(x) < LIMIT).all(1)
    return sound[kept], x[kept]


def pack(vectors: DataFrame, dims: int, scale: int, k: int, seed: int) -> DataFrame:
    """Blocks of vectors(vec_id, embedding) made where the rows are; each names its first candidates for a start."""
    most, exact = max(1, BLOCK_BYTES // (4 * dims)), narrow(dims)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        held: dict[bool, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {False: [], True: []}

        def block(wide: bool) -> pa.RecordBatch:
            nonlocal made
            ids, known, x = (np.concatenate(part) for part in zip(*held[wide], strict=True))
            held[wide].clear()
            x = x.astype(np.int64 if wide else np.int32)
            hashes = [hashlib.sha256(b"%d:%d" % (seed, i)).hexdigest() for i in ids[known].tolist()]
            order = sorted(range(len(hashes)), key=hashes.__getitem__)
            last = hashes[order[min(k, len(order)) - 1]] if order else ""
            first = sorted((hashes[i], x[known][i].tolist()) for i in order if hashes[i] <= last)[:k] if order else []
            made += 1
            values = [[made - 1], [wide], [pa.array(ids, mask=~known)], [x.tobytes()], [[{"hash": h, "vector": v} for h, v in first]]]
            kinds = [pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.struct([("hash", pa.string()), ("vector", pa.list_(pa.int64()))]))]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["block", "wide", "ids", "vectors", "starts"])

        for batch in batches:
            rows, x = whole_vectors(batch.column(1), dims, scale)
            ids, known = batch.column(0).fill_null(0).to_numpy()[rows], batch.column(0).is_valid().to_numpy(zero_copy_only=False)[rows]
            wide = (np.abs(x) >= exact).any(1)
            for kind in (False, True):
                these = np.flatnonzero(wide == kind)
                for at in range(0, len(these), most):
                    part = these[at : at + most]
                    if held[kind] and sum(len(h[0]) for h in held[kind]) + len(part) > most:
                        yield block(kind)
                    held[kind].append((ids[part], known[part], x[part]))
        for kind in (False, True):
            if held[kind]:
                yield block(kind)

    return vectors.mapInArrow(blocks, BLOCKS)


class Centroids:
    """Whole-number centroids and what their last move does to bounds."""

    def __init__(self, points: list[list[int]], before: list[list[int]] | None = None):
        self.points, k = points, len(points)
        self.big = max((abs(x) for p in points for x in p), default=0)
        apart = np.array([[_length(p, q) for q in points] for p in points]).reshape(k, k) * DOWN
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * DOWN if k else np.zeros(0)
        drift = np.array([_length(p, q) for p, q in zip(points, before or points, strict=True)]) * UP
        self.drift = drift
        self.others = np.array([max((drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances: whole doubles where those are exact, else Python's numbers."""
        if x.dtype == np.int32 and self.big < narrow(x.shape[1]):
            x, c = x.astype(np.float64), np.array(self.points, np.float64)
            return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)
        x = x.astype(object)
        return np.stack([((x - np.array(p, object)) ** 2).sum(1) for p in self.points], 1)

    def scan(self, x: np.ndarray) -> np.ndarray:
        """Tight bounds from exact distances."""
        out = np.empty(len(x), BOUNDS)
        for at in range(0, len(x), ROWS):
            rows = slice(at, at + ROWS)
            d = self.squares(x[rows])
            out["cluster"][rows] = d.argmin(1)  # the first of equal ones
            two = np.sqrt(np.sort(d, 1)[:, :2].astype(np.float64))
            out["upper"][rows] = two[:, 0] * UP
            out["lower"][rows] = two[:, 1] * DOWN if two.shape[1] > 1 else np.inf
        return out

    def follow(self, x: np.ndarray, old: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds after the centroids' move, and which vectors were scanned."""
        new = old.copy()
        new["upper"] = (old["upper"] + self.drift[old["cluster"]]) * UP
        new["lower"] = (old["lower"] - self.others[old["cluster"]]) * DOWN
        unsure = np.flatnonzero(new["upper"] >= np.maximum(new["lower"], self.half[old["cluster"]]))
        new[unsure] = self.scan(x[unsure])
        return new, unsure


def _length(p: list[int], q: list[int]) -> float:
    return float(sum((a - b) ** 2 for a, b in zip(p, q, strict=True))) ** 0.5


def _vectors(batch: pa.RecordBatch, row: int, dims: int) -> np.ndarray:
    wide = batch.column("wide")[row].as_py()
    return np.frombuffer(batch.column("vectors")[row].as_buffer(), np.int64 if wide else np.int32).reshape(-1, dims)


def _totals(x: np.ndarray) -> list[int]:
    return [int(v) for v in (x.astype(object).sum(0) if x.dtype == np.int64 else x.sum(0, dtype=np.int64))]


MOVED = "cluster int, n long, sums array<decimal(38,0)>, scanned long"


def assign(blocks: DataFrame, now: Centroids, folder: str, step: int, dims: int) -> DataFrame:
    """(cluster, n, sums, scanned): for each task what came to each cluster less what left it; writes the bounds of this step."""
    k = len(now.points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, scanned = [0] * k, [[0] * dims for _ in range(k)], 0
        for batch in batches:
            for row in range(batch.num_rows):
                x, name = _vectors(batch, row, dims), batch.column("block")[row].as_py()
                if step:
                    old = np.load(f"{folder}/{step - 1}/{name}.npy", mmap_mode="r")
                    new, seen = now.follow(x, old)
                    moved = seen[new["cluster"][seen] != old["cluster"][seen]]
                    steps = ((1, new["cluster"][moved]), (-1, old["cluster"][moved]))
                else:
                    new, seen = now.scan(x), x
                    moved = np.arange(len(x))
                    steps = ((1, new["cluster"]),)
                scanned += len(seen)
                for sign, clusters in steps:
                    for j in np.unique(clusters).tolist():
                        these = moved[clusters == j]
                        n[j] += sign * len(these)
                        sums[j] = [a + sign * b for a, b in zip(sums[j], _totals(x[these]), strict=True)]
                save(f"{folder}/{step}/{name}.npy", new)
        kinds = [pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.int64()]
        values = [list(range(k)), n, [[Decimal(v) for v in s] for s in sums], [scanned] + [0] * (k - 1)]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], ["cluster", "n", "sums", "scanned"])

    return blocks.select("block", "wide", "vectors").mapInArrow(run, MOVED)


def _placed(blocks: DataFrame, now: Centroids, folder: str, step: int, dims: int) -> DataFrame:
    """(vec_id, cluster, distance) after the bounds' last step; distance is exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, name = _vectors(batch, row, dims), batch.column("block")[row].as_py()
                cluster = now.follow(x, np.load(f"{folder}/{step}/{name}.npy", mmap_mode="r"))[0]["cluster"] if step >= 0 else now.scan(x)["cluster"]
                ids = batch.column("ids")[row].values
                for at in range(0, len(x), ROWS):
                    d = now.squares(x[at : at + ROWS])
                    own = d[np.arange(len(d)), cluster[at : at + ROWS]]
                    own = pa.array([v if v < 1 << 63 else None for v in own.tolist()], pa.int64()) if own.dtype == object else pa.array(own.astype(np.int64))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, ROWS), pa.array(cluster[at : at + ROWS], pa.int32()), own], ["vec_id", "cluster", "distance"])

    return blocks.select("block", "wide", "vectors", "ids").mapInArrow(run, "vec_id long, cluster int, distance long")


def hamerly_clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3, told: list[dict] | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) for every kept row of vectors(vec_id, embedding, ...).

    Starts are the k vectors with the smallest sha256 of `seed:vec_id`. told, if
    given, gets for each round how many vectors were scanned.
    """
    spark = vectors.sparkSession
    with Workspace(spark, "clusters") as ws:
        kind = vectors.schema["embedding"].dataType.simpleString()
        embedding = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
        blocks = ws.table(pack(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), embedding.alias("embedding")), dims, scale, k, seed), "blocks")
        firsts = blocks.select(F.explode("starts").alias("s")).select("s.hash", "s.vector").orderBy("hash", "vector").limit(k).collect()
        now, folder = Centroids([list(r.vector) for r in firsts]), f"{local_path(spark, ws.path)}/bounds"
        if not firsts:  # no vector has an id
            now = Centroids([])
            blocks = blocks.limit(0)
        n, sums = [0] * len(firsts), [[0] * dims for _ in firsts]
        for step in range(rounds if firsts else 0):
            moved = assign(blocks, now, folder, step, dims)
            each = moved.select("cluster", "n", "scanned", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.sum("scanned").alias("scanned"))
            scanned = 0
            for r in each.collect():  # k * dims rows
                sums[r.cluster][r.at] += int(r.x)
                n[r.cluster] += r.n if r.at == 0 else 0
                scanned += r.scanned if r.at == 0 else 0
            if told is not None:
                told.append({"step": step, "scanned": scanned})
            if step:
                ws.drop(f"bounds/{step - 1}")
            points = [[v // n[j] for v in sums[j]] if n[j] else now.points[j] for j in range(len(firsts))]
            now = Centroids(points, now.points)
        placed = ws.table(_placed(blocks, now, folder, rounds - 1, dims), "placed")
        one = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()  # k rows
        held = {r.cluster: None if r.lost else int(r.d) for r in one}
        whole = None if None in held.values() else sum(held.values())
        rows = [(j, d if d is not None and d < 1 << 63 else None, whole if whole is not None and whole < 1 << 63 else None, now.points[j]) for j, d in held.items()]
        about = spark.createDataFrame(rows, "of int, cluster_inertia long, inertia long, centroid array<long>")
        out = placed.join(F.broadcast(about), placed["cluster"] == about["of"])
        return ws.keep(out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"))
