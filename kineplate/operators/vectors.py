"""Embedding classification: cosine neighbours, linear SVM, evaluation, temporal features.

references(ref_idx, id, label, group, vector) and queries(id, ..., vector) hold
one row per image. References are packed into blocks in the shared folder, which
every task maps; queries stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import unit_vector, usable_label
from ..shared import fresh_folder, get_bytes, lasting, numbered, put_bytes
from .running import each_series

#: Bytes of a block of references, of the queries that meet the blocks together, and of the products held at once.
MATRIX_BYTES, QUERY_BYTES, SCORE_BYTES = 64 << 20, 16 << 20, 16 << 20
#: Tasks that add up the sums of a Newton step.
ADDERS = 4
#: Inverse-distance votes of exact matches stay finite (fixed value).
NEAREST = 1e-6


def unit_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """V1: rows with vectors of length one; bad vectors are errors."""
    return rows.withColumn(vector, unit_vector(vector))


def pack_references(references: DataFrame) -> tuple[str, int]:
    """(folder, number of blocks): unit references as files of at most about MATRIX_BYTES in the shared folder, made in the cluster, each in order of its indices."""
    shape = references.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not shape.n:
        raise ValueError("at least one reference is required")
    count, folder = -(-shape.n * 8 * max(shape.d, 1) // MATRIX_BYTES), fresh_folder(references.sparkSession)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("ref_idx")
        ids = rows.column("ref_idx").to_numpy().astype(np.int64)
        matrix = rows.column("vector").combine_chunks().flatten().to_numpy().astype(np.float64)
        put_bytes(f"{folder}/{key[0].as_py()}", np.array([len(ids), len(matrix) // len(ids)]).tobytes(), ids.tobytes(), matrix.tobytes())
        return pa.table({"n": pa.array([len(ids)], pa.int64())})

    rows = references.select(F.pmod(F.xxhash64("ref_idx"), F.lit(count)).cast("int").alias("block"), F.col("ref_idx").cast("long").alias("ref_idx"), unit_vector("vector").alias("vector"))
    rows.groupBy("block").applyInArrow(pack, "n long").agg(F.sum("n")).collect()
    return folder, count


def _block(folder: str, number: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(indices, matrix) of a block; None of one that got no reference."""
    try:
        raw = get_bytes(f"{folder}/{number}")
    except FileNotFoundError:
        return None
    n, d = np.frombuffer(raw, np.int64, 2).tolist()
    return np.frombuffer(raw, np.int64, n, 16), np.frombuffer(raw, np.float64, n * d, 16 + 8 * n).reshape(n, d)


class TopK:
    """The k best of each query over the blocks so far; the lowest index wins ties."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.index, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.rank = np.zeros(0, np.int64)

    def meet(self, queries: np.ndarray, indices: np.ndarray, matrix: np.ndarray) -> None:
        step = max(1, SCORE_BYTES // (8 * len(indices)))
        found = [(self.query, self.index, self.score)]
        for at in range(0, len(queries), step):
            scores = queries[at : at + step] @ matrix.T
            if len(indices) > self.k:
                least = np.partition(scores, len(indices) - self.k, 1)[:, len(indices) - self.k]
                q, r = np.nonzero(scores >= least[:, None])
            else:
                q, r = (x.ravel() for x in np.indices(scores.shape))
            found.append(self._best(q + at, indices[r], scores[q, r])[:3])
        self.query, self.index, self.score, self.rank = self._best(*(np.concatenate(x) for x in zip(*found, strict=True)))

    def _best(self, query: np.ndarray, index: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.lexsort((index, -score, query))
        query, index, score = query[order], index[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query) + 1
        kept = rank <= self.k
        return query[kept], index[kept], score[kept], rank[kept]


def nearest(queries: DataFrame, references: DataFrame, k: int = 3, normalize_query: bool = True, query_id: str = "id") -> DataFrame:
    """(query_id, ref_idx, similarity, rank) of the k most similar references; the lowest index wins ties.

    References are packed in the cluster into blocks in the shared folder, which
    tasks map into memory. Queries aren't shuffled: each is read once, in
    batches of about QUERY_BYTES that meet one block after the other and keep
    the k best so far.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    folder, count = pack_references(references)
    kind = queries.schema[query_id].dataType.simpleString()
    source = queries.select(query_id, (unit_vector("vector") if normalize_query else F.col("vector").cast("array<double>")).alias("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def search() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            x = rows.column(1).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
            best = TopK(len(x), k)
            for number in range(count):
                if (block := _block(folder, number)) is not None:
                    best.meet(x, *block)
            out = [rows.column(0).take(pa.array(best.query)).combine_chunks(), pa.array(best.index), pa.array(best.score), pa.array(best.rank, pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [query_id, "ref_idx", "similarity", "rank"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.nbytes for b in held) >= QUERY_BYTES:
                yield from search()
                held = []
        if held:
            yield from search()

    return source.mapInArrow(run, f"{query_id} {kind}, ref_idx long, similarity double, rank int")


def vote(neighbours: DataFrame, references: DataFrame, query_id: str = "id") -> DataFrame:
    """V2: (query_id, prediction, support) by inverse-distance votes; the first class in order wins ties. A query's neighbours are few, so a window holds k rows."""
    voted = neighbours.join(references.select("ref_idx", "label"), "ref_idx").groupBy(query_id, "label").agg(F.sum(1.0 / F.greatest(1.0 - F.col("similarity"), F.lit(NEAREST))).alias("votes"))
    w = Window.partitionBy(query_id)
    rows = voted.withColumn("total", F.sum("votes").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("votes"), "label")))
    return rows.where("rank = 1").select(query_id, F.col("label").alias("prediction"), (F.col("votes") / F.col("total")).alias("support"))


def knn(queries: DataFrame, references: DataFrame, k: int = 3, query_id: str = "id") -> DataFrame:
    """V2 over queries; at least two reference classes are required."""
    if references.select("label").distinct().limit(2).count() < 2:
        raise ValueError("at least two reference classes are required")
    return vote(nearest(queries, references, k, query_id=query_id), references, query_id)


def viable_support(queries: DataFrame, references: DataFrame, k: int = 3, query_id: str = "id") -> DataFrame:
    """V3: share of the votes for `viable`, queries taken as they are; viable above one half."""
    near = nearest(queries, references, k, normalize_query=False, query_id=query_id).join(references.select("ref_idx", "label"), "ref_idx")
    weight = 1.0 / F.greatest(1.0 - F.col("similarity"), F.lit(NEAREST))
    one = near.groupBy(query_id).agg((F.sum(weight * (F.col("label") == "viable").cast("int")) / F.sum(weight)).alias("viable_support"))
    return one.withColumn("prediction", F.when(F.col("viable_support") > 0.5, "viable").otherwise("dead"))


class LinearSVM:
    """V4: one-vs-rest squared-hinge SVM with class-balanced weights and a penalised constant.

    Newton steps on the active set. A step's loss, gradient and second
    derivatives are sums over the references, added up in the cluster for all
    classes at once; the driver holds these sums, d * d numbers a class.
    """

    def __init__(self, classes: list[str], weights: np.ndarray):
        self.classes, self.weights = classes, weights

    @staticmethod
    def _sums(rows: DataFrame, w: np.ndarray, signs: dict[str, np.ndarray], costs: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per target: the sum of the weighted squared hinges, its gradient and its second derivatives."""
        k, d = w.shape

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((k, 1 + d + d * d))
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.column_stack([np.stack(pdf.vector.to_numpy()), np.ones(len(pdf))])
                y, cost = np.stack([signs[c] for c in pdf.label]), np.stack([costs[c] for c in pdf.label])
                slack = np.maximum(1 - y * (x @ w.T), 0)
                for j in range(k):
                    on = slack[:, j] > 0
                    a, c, s = x[on], cost[on, j], slack[on, j]
                    total[j, 0] += (c * s * s).sum()
                    total[j, 1 : 1 + d] -= 2 * (a * (c * y[on, j] * s)[:, None]).sum(0)
                    total[j, 1 + d :] += (2 * (a * c[:, None]).T @ a).ravel()
            yield pd.DataFrame({"sums": [total.ravel()]})

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(k * (1 + d + d * d))
            for batch in batches:
                total += batch.column(0).flatten().to_numpy().reshape(batch.num_rows, len(total)).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([total])], ["sums"])

        # one array for each task, then one for each of a few tasks that add them up
        parts = rows.mapInPandas(run, "sums array<double>").repartition(ADDERS).mapInArrow(add, "sums array<double>")
        total = np.sum([np.asarray(r.sums) for r in parts.collect()], 0)
        total = total.reshape(k, -1)
        return total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(k, d, d)

    @classmethod
    def fit(cls, references: DataFrame, c: float = 1.0, rounds: int = 100) -> LinearSVM:
        """references(label, vector of length one)."""
        if c <= 0 or not np.isfinite(c):
            raise ValueError("C must be positive")
        rows = lasting(references.select("label", "vector"))
        sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # one row per class
        classes, n = sorted(sizes), sum(sizes.values())
        if len(classes) < 2:
            raise ValueError("at least two reference classes are required")
        weight = {k: n / (len(classes) * sizes[k]) for k in classes}
        targets = classes[1:] if len(classes) == 2 else classes
        signs = {k: np.array([1.0 if k == t else -1.0 for t in targets]) for k in classes}
        # a one-vs-rest problem weighs its own class by its weight and the rest by one, a two-class one both
        costs = {k: c * np.array([weight[k] if len(classes) == 2 or k == t else 1.0 for t in targets]) for k in classes}
        d = rows.select(F.size("vector")).first()[0] + 1
        w = np.zeros((len(targets), d))

        def look(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            loss, slope, bend = cls._sums(rows, v, signs, costs)
            return loss + 0.5 * (v * v).sum(1), slope + v, bend + np.eye(d)

        loss, slope, bend = look(w)
        for _ in range(rounds):
            open_ = np.linalg.norm(slope, axis=1) > 1e-9 * max(1.0, n)
            if not open_.any():
                break
            step = np.linalg.solve(bend, slope[:, :, None])[:, :, 0] * open_[:, None]
            size = np.ones(len(targets))
            for _ in range(40):
                then = look(w - size[:, None] * step)
                bad = open_ & (then[0] > loss - 1e-4 * size * (slope * step).sum(1) + 1e-12 * np.abs(loss))
                if not bad.any():
                    break
                size[bad] /= 2
            w, (loss, slope, bend) = w - size[:, None] * step, then
        return cls(classes, w)

    def decide(self, vectors: np.ndarray) -> np.ndarray:
        return np.column_stack([vectors, np.ones(len(vectors))]) @ self.weights.T

    def predict(self, vectors: np.ndarray) -> list[str]:
        scores = self.decide(vectors)
        best = (scores[:, 0] > 0).astype(int) if len(self.classes) == 2 else scores.argmax(1)
        return [self.classes[k] for k in best]


def svm(queries: DataFrame, references: DataFrame, c: float = 1.0, query_id: str = "id") -> DataFrame:
    """V4: (query_id, prediction, scores) of a model fitted on all references."""
    model = LinearSVM.fit(references.select("label", unit_vector("vector").alias("vector")), c)
    kind = queries.schema[query_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf.vector.to_numpy())
                yield pd.DataFrame({query_id: pdf[query_id], "prediction": model.predict(x), "scores": list(model.decide(x))})

    return queries.select(query_id, unit_vector("vector").alias("vector")).mapInPandas(run, f"{query_id} {kind}, prediction string, scores array<double>")


def split_manifest(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V5: usable references, numbered in order of their ids, and all evaluation rows; bad manifests are errors."""
    from .joins import overlapping_groups

    wrong = rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.sum(F.coalesce(F.col("split").isin("reference", "evaluation"), F.lit(False)).cast("int")).alias("split")).first()
    if wrong.ids != wrong.n:
        raise ValueError("image ids must be unique")
    if (wrong.split or 0) != wrong.n:
        raise ValueError("every row needs a reference or evaluation split")
    if overlapping_groups(rows).limit(1).count():
        raise ValueError("a group occurs in both splits")
    good = rows.where((F.col("split") == "reference") & usable_label("label"))
    references = numbered(good, [F.col("id")], name="ref_idx")
    queries = rows.where("split = 'evaluation'")
    if not references.limit(1).count() or not queries.limit(1).count():
        raise ValueError("labelled references and evaluation images are needed")
    return references, queries


def evaluate(rows: DataFrame, k: int = 3, c: float = 1.0, methods: tuple[str, ...] = ("knn", "svm")) -> dict[str, DataFrame]:
    """V5: predictions of the methods for every evaluation row, their metrics over the usable ones, and the neighbours' ids."""
    from .aggregates import confusion, macro_metrics
    from .joins import neighbour_ids

    references, queries = split_manifest(rows)
    near = nearest(queries, references, k)
    out = {"neighbours": neighbour_ids(near, references)}
    for method in methods:
        made = vote(near, references) if method == "knn" else svm(queries, references, c)
        joined = queries.select("id", "group", "label").join(made, "id")
        out[f"{method}_predictions"] = joined
        out[f"{method}_metrics"] = macro_metrics(joined)
        out[f"{method}_confusion"] = confusion(joined, references)
    return out


def temporal_problems(rows: DataFrame) -> DataFrame:
    """(group, problem) for groups in two splits, with mixed channels or planes, or with repeated frames; must be empty."""
    frames = rows.groupBy("group").agg(
        F.countDistinct(F.coalesce("split", F.lit(""))).alias("splits"),
        F.countDistinct(F.struct(F.coalesce("channel", F.lit(0)), F.coalesce("z", F.lit(0)))).alias("planes"),
        F.countDistinct("frame").alias("frames"),
        F.count("*").alias("n"),
    )
    problem = F.when(F.col("splits") > 1, "mixed split").when(F.col("planes") > 1, "mixed channel or plane").when(F.col("frames") < F.col("n"), "duplicate frame")
    return frames.select("group", problem.alias("problem")).where("problem is not null")


def trailing_means(x: np.ndarray, window: int, past: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors of the means of each row and up to window - 1 rows before it, the last rows of `past` counting as such."""
    before = np.zeros((0, x.shape[1])) if past is None else past[len(past) - min(len(past), window - 1) :]
    both = np.concatenate([before, x])
    total = both.copy()
    for k in range(1, min(window, len(both))):
        total[k:] += both[:-k]
    total = total[len(before) :]
    length = np.sqrt((total * total).sum(1, keepdims=True))
    if not (length > 0).all():
        raise ValueError("vectors must be non-empty, finite and not zero")
    return total / length


def trailing_mean(rows: DataFrame, window: int = 3) -> DataFrame:
    """Unit vector of the mean of a group's last `window` unit vectors, the current one included."""
    if window < 1:
        raise ValueError("window must be at least 1")
    unit = rows.withColumn("vector", unit_vector("vector"))
    at = rows.columns.index("vector")

    def run(series: pa.Table) -> pa.RecordBatch:
        x = series.column("vector").combine_chunks().flatten().to_numpy().reshape(series.num_rows, -1)
        means = trailing_means(x, window)
        made = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(means.ravel()))
        return series.set_column(at, "vector", made).combine_chunks().to_batches()[0]

    return each_series(unit, ["group"], ["frame"], run, unit.schema)


def baseline_delta(rows: DataFrame) -> DataFrame:
    """Unit vector of a unit vector followed by its difference from the group's first one."""
    w = Window.partitionBy("group").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    unit = rows.withColumn("vector", unit_vector("vector")).withColumn("_f", F.first("vector").over(w))
    both = F.concat("vector", F.zip_with("vector", "_f", lambda a, b: a - b))
    return unit.withColumn("vector", unit_vector(both)).drop("_f")
