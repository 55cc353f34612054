"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Equal vectors form a class with a number of its own and a count. The classes
are dealt to tiles of at most about TILE_BYTES, packed as one row each, and
every pair of tiles is multiplied once; small tables make TILES tiles, so that
there are tasks for all cores and few copies of each tile. Vectors are scaled to length one and
rounded to int8 with a scale of their own; e is the length of the rounding
error and a the length of the rounded vector. For vectors u and v,

    |u . v - s_u s_v (q_u . q_v)| <= a_u e_v + e_u

so pairs whose product plus this bound stays below the threshold are out, and
only the others are computed again in double precision. Products of int8
values are sums of whole numbers below 2**24 and exact in the float32 units;
longer vectors are multiplied in pieces.

A tile pair returns one count per vector and a forest of its links, never the
links themselves. Vectors that are null, zero or hold null or non-finite
components link with nothing, neither do rows with a null id; vectors of
different lengths don't link. Rows are told apart by their vectors, so one id
with two vectors counts the links of each. Other columns are not read. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .workspace import Workspace

#: Bytes of the vectors of a tile, how many tiles there are at least (of LEAST_TILE vectors or more), and rows multiplied at once.
TILE_BYTES, TILES, LEAST_TILE, ROWS = 8 << 20, 8, 512, 256
#: Components whose int8 products add up below 2**24.
PIECE = 1024
#: Covers the rounding of float32 and double arithmetic.
SLACK = 2e-6
EXACT = 50_000


class Tile:
    """Unit vectors and their int8 forms."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray):
        self.ids, self.times = ids, times
        scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # so that squares stay finite
        self.unit = scaled / np.sqrt((scaled**2).sum(1, keepdims=True))
        scale = np.abs(self.unit).max(1) / 127
        whole = np.rint(self.unit / scale[:, None]).astype(np.int8)
        rounded = whole * scale[:, None]
        self.error = np.sqrt(((self.unit - rounded) ** 2).sum(1))
        self.length = np.sqrt((rounded**2).sum(1))
        self.scale = scale.astype(np.float32)
        self.pieces = [whole[:, k : k + PIECE].astype(np.float32) for k in range(0, whole.shape[1], PIECE)]


def links(a: Tile, b: Tile, least: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (x in a, y in b) of pairs with cosine >= least; x < y where the tiles are the same."""
    found_x, found_y = [], []
    for at in range(0, len(a.ids), ROWS):
        rows = slice(at, at + ROWS)
        product = sum(p[rows] @ q.T for p, q in zip(a.pieces, b.pieces, strict=True))
        product *= b.scale
        floor = (least - SLACK - a.error[rows] - a.length[rows] * b.error.max()) / a.scale[rows]
        x, y = np.nonzero(product >= floor[:, None].astype(np.float32))
        x += at
        if same:
            x, y = x[x < y], y[x < y]
        for k in range(0, len(x), EXACT):
            p, q = x[k : k + EXACT], y[k : k + EXACT]
            sure = np.einsum("ij,ij->i", a.unit[p], b.unit[q]) >= least
            found_x.append(p[sure])
            found_y.append(q[sure])
    if not found_x:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_x), np.concatenate(found_y)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest place that links reach from each of n places."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _pack(key: tuple, table: pa.Table) -> pa.Table:
    kind = np.float64 if pa.types.is_float64(table.schema.field("vector").type.value_type) else np.float32
    vectors = np.asarray(table.column("vector").combine_chunks().flatten(), kind)
    ids, times = (table.column(c).to_numpy().astype(np.int64) for c in ("class", "times"))
    return pa.table({"dims": pa.array([key[0].as_py()], pa.int32()), "tile": pa.array([key[1].as_py()], pa.int32()), "ids": [ids.tobytes()], "times": [times.tobytes()], "vectors": [vectors.astype(np.float64).tobytes() if kind == np.float64 else vectors.tobytes()]})


def tiles_of(n: int, size: int) -> int:
    """Tiles of n vectors of `size` bytes each."""
    return max(-(-n * size // TILE_BYTES), min(TILES, -(-n // LEAST_TILE)))


def near_embeddings(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, ...)."""
    spark = vectors.sparkSession
    with Workspace(spark, "embeddings") as ws:
        kind = "double" if vectors.schema["embedding"].dataType.simpleString() == "array<double>" else "float"
        rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("vector"))
        sound = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
        rows = ws.table(rows.withColumn("sound", F.coalesce(sound & F.col("vec_id").isNotNull(), F.lit(False))), "rows")
        classes = rows.where("sound").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
        classes = ws.table(classes.withColumn("class", F.monotonically_increasing_id()), "classes")  # written once, so the numbers stay
        width = 8 if kind == "double" else 4
        sizes = {r.dims: tiles_of(r.n, r.dims * width) for r in classes.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n")).collect()}  # one row per length of vectors
        found = None
        if sizes:
            tiles = F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.size("vector")]
            dealt = classes.select(F.size("vector").alias("dims"), F.pmod(F.xxhash64("class"), tiles).cast("int").alias("tile"), "class", "times", "vector")
            wide = np.dtype(np.float64 if kind == "double" else np.float32)
            packed = ws.table(dealt.groupBy("dims", "tile").applyInArrow(_pack, "dims int, tile int, ids binary, times binary, vectors binary"), "tiles")
            other = F.explode(F.sequence(F.lit(0), F.create_map(*(F.lit(x) for pair in sizes.items() for x in pair))[F.col("dims")] - 1))
            pairs = packed.withColumn("other", other).select("*", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))

            def compare(key: tuple, table: pa.Table) -> pa.Table:
                dims = key[0].as_py()
                made = []
                for k in range(table.num_rows):
                    body = np.frombuffer(table.column("vectors")[k].as_py(), wide).astype(np.float64).reshape(-1, dims)
                    made.append(Tile(np.frombuffer(table.column("ids")[k].as_py(), np.int64), np.frombuffer(table.column("times")[k].as_py(), np.int64), body))
                same = key[1].as_py() == key[2].as_py()
                if len(made) == 1 and not same:  # the other tile got no vector
                    return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
                p, q = made[0], made[0] if same else made[1]
                x, y = links(p, q, least, same)
                ids, times = (p.ids, p.times) if same else (np.concatenate([p.ids, q.ids]), np.concatenate([p.times, q.times]))
                y = y if same else y + len(p.ids)
                counts = np.bincount(x, times[y], len(ids)) + np.bincount(y, times[x], len(ids))
                root = forest(len(ids), x, y)
                some, off = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(ids)))
                n = pa.array(np.concatenate([counts[some], np.zeros(len(off))]).astype(np.int64))
                b = pa.array(np.concatenate([ids[some], ids[root[off]]]))
                return pa.table({"a": pa.array(np.concatenate([ids[some], ids[off]])), "b": b, "n": n})

            found = ws.table(pairs.groupBy("dims", "i", "j").applyInArrow(compare, "a long, b long, n long"), "found")
        if found is None:
            found = spark.createDataFrame([], "a long, b long, n long")
        counts = found.where("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
        groups = components(ws, found.where("a <> b").select("a", "b"), "groups").withColumnRenamed("id", "class")
        smallest = groups.join(classes.select("class", "rep"), "class").groupBy("component").agg(F.min("rep").alias("component_id"))
        known = classes.join(counts, "class", "left").join(groups.join(smallest, "component").select("class", "component_id"), "class", "left")
        known = known.select(F.col("vector").alias("of"), (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
        out = rows.join(known, rows["sound"] & (rows["vector"] == known["of"]), "left")
        component = F.coalesce("component_id", "vec_id")
        out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
        return ws.keep(out)
