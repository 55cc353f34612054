"""Masks larger than a task: components and holes of images that come in tiles.

tiles(keys..., ty, tx, y0, x0, height, width, image_height, image_width, on) hold
one row per tile: its numbers, the place of its first pixel in the image, its
own and the image's size, and its mask in row order. Every tile is labelled by
itself; pieces that touch across a seam are links, which come from the tiles'
rims alone; the components of the links are found over all tiles at once
(`graph.connected`), and every tile takes the final labels of its own pieces. A
task holds one tile, its pieces and their labels, whatever the image's size.
Labels are those of `pixels.components` and masks those of `pixels.fill_holes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from ..shared import numbered, stored
from .graph import connected
from .pixels import MIN_PIXELS

PLACE = ("ty", "tx", "y0", "x0", "height", "width", "image_height", "image_width")
PIECES = "array<struct<id:int,first:bigint,n:bigint,edge:boolean>>"
RIM = "array<struct<y:int,x:int,first:bigint>>"


def cut(planes: DataFrame, keys: list[str], side: int, on: str = "on") -> DataFrame:
    """Tiles of at most side x side pixels of planes(keys, height, width, on array)."""
    names = [f.name for f in planes.select(*keys).schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                h, w = one.column("height")[0].as_py(), one.column("width")[0].as_py()
                mask = one.column(on).flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(h, w)
                for y in range(0, h, side):
                    for x in range(0, w, side):
                        part = mask[y : y + side, x : x + side]
                        place = [pa.array([v], pa.int32()) for v in (y // side, x // side, y, x, *part.shape, h, w)]
                        yield pa.RecordBatch.from_arrays([*(one.column(k) for k in names), *place, pa.array([part.ravel()])], [*names, *PLACE, "on"])

    fields = [*planes.select(*keys).schema.fields, *(StructField(c, IntegerType()) for c in PLACE), StructField("on", ArrayType(BooleanType()))]
    return planes.select(*keys, "height", "width", on).mapInArrow(run, StructType(fields))


def label(mask: np.ndarray, corners: bool) -> np.ndarray:
    """Pieces of a mask, numbered from 1 in raster order, over runs of pixels; with corners, pixels touch across them too."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    turns = np.diff(padded, axis=1)
    y, a = np.nonzero(turns == 1)
    b = np.nonzero(turns == -1)[1] - 1
    reach, wide = int(corners), w + 4  # rows are apart by more than a reach
    low = np.searchsorted(y * wide + b, (y + 1) * wide + a - reach)
    high = np.searchsorted(y * wide + a, (y + 1) * wide + b + reach, "right")
    n = np.maximum(high - low, 0)
    one = np.repeat(np.arange(len(y)), n)
    two = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    root = np.arange(len(y))
    while len(one):
        p, q = root[one], root[two]
        apart = p != q
        if not apart.any():
            break
        one, two, p, q = one[apart], two[apart], p[apart], q[apart]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))  # a root takes the smallest one it meets
        while (up := root[root]).tolist() != root.tolist():
            root = up
    number = np.cumsum(root == np.arange(len(y)))[root] if len(y) else root
    out = np.zeros(h * w, np.int32)
    out[mask.ravel()] = np.repeat(number, b - a + 1)
    return out.reshape(h, w)


def _pieces(tiles: DataFrame, keys: list[str], corners: bool, invert: bool) -> DataFrame:
    """(keys, place, on, labels, pieces, rim) of every tile by itself. A piece is known by the place of its first pixel in the image."""
    names = [*tiles.select(*keys).columns, *PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                y0, x0, h, w, ih, iw = (one.column(c)[0].as_py() for c in PLACE[2:])
                mask = one.column("on").flatten().to_numpy(zero_copy_only=False).astype(bool).reshape(h, w)
                labels = label(~mask if invert else mask, corners)
                flat = labels.ravel()
                n = np.bincount(flat, minlength=1)[1:]
                places = np.flatnonzero(flat)
                at = places[np.unique(flat[places], return_index=True)[1]]
                first = (y0 + at // w).astype(np.int64) * iw + x0 + at % w
                border = np.zeros((h, w), bool)
                border[0] |= y0 == 0
                border[-1] |= y0 + h == ih
                border[:, 0] |= x0 == 0
                border[:, -1] |= x0 + w == iw
                edge = np.zeros(len(n) + 1, bool)
                edge[flat[border.ravel()]] = True
                around = np.zeros((h, w), bool)
                around[[0, -1]] = around[:, [0, -1]] = True
                ry, rx = np.nonzero(around & (labels > 0))
                pieces = [{"id": k + 1, "first": f, "n": c, "edge": e} for k, (f, c, e) in enumerate(zip(first.tolist(), n.tolist(), edge[1:].tolist(), strict=True))]
                rim = [{"y": y, "x": x, "first": f} for y, x, f in zip((ry + y0).tolist(), (rx + x0).tolist(), first[labels[ry, rx] - 1].tolist(), strict=True)]
                kinds = (pa.list_(pa.int32()), _PIECES, _RIM)
                made = [pa.array([v], kind) for v, kind in zip((flat, pieces, rim), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), one.column("on"), *made], [*names, "on", "labels", "pieces", "rim"])

    fields = [*tiles.select(*names, "on").schema.fields, *StructType.fromDDL(f"labels array<int>, pieces {PIECES}, rim {RIM}").fields]
    return tiles.select(*names, "on").mapInArrow(run, StructType(fields))


_PIECES = pa.list_(pa.struct([("id", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("edge", pa.bool_())]))
_RIM = pa.list_(pa.struct([("y", pa.int32()), ("x", pa.int32()), ("first", pa.int64())]))


def _merged(parts: DataFrame, keys: list[str], corners: bool) -> DataFrame:
    """(keys, ty, tx, id, root, n, edge): every piece with the first place of its component, the component's pixels and whether it meets the image's border."""
    rim = parts.select(*keys, "ty", "tx", F.explode("rim").alias("r")).select(*keys, "ty", "tx", "r.*")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if corners else [])
    moved = rim.withColumn("s", F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in steps))))
    moved = moved.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("ty").alias("_ty"), F.col("tx").alias("_tx"), (F.col("y") + F.col("s.dy")).alias("_y"), (F.col("x") + F.col("s.dx")).alias("_x"), F.col("first").alias("_first"))
    same = (F.col("y") == F.col("_y")) & (F.col("x") == F.col("_x"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    links = rim.join(moved, same & ((F.col("ty") != F.col("_ty")) | (F.col("tx") != F.col("_tx"))))

    def node(place: str) -> Column:
        return F.struct(*(F.col(k).alias(k) for k in keys), F.col(place).cast("long").alias("place"))

    groups = connected(links.select(node("_first").alias("a"), node("first").alias("b")).distinct())
    pieces = parts.select(*keys, "ty", "tx", F.explode("pieces").alias("p")).select(*keys, "ty", "tx", "p.*").withColumn("node", node("first"))
    pieces = pieces.join(groups, pieces["node"] == groups["id"], "left").select(*keys, "ty", "tx", pieces["id"], F.coalesce(F.col("component.place"), F.col("first")).alias("root"), "n", "edge")
    whole = pieces.groupBy(*keys, "root").agg(F.sum("n").alias("n"), F.max("edge").alias("edge"))
    back = F.col("a.root") == F.col("b.root")
    for k in keys:
        back &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return pieces.alias("a").join(whole.alias("b"), back).select(*(F.col(f"a.{k}").alias(k) for k in keys), "a.ty", "a.tx", "a.id", "a.root", "b.n", "b.edge")


def _told(parts: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """parts with `values`, the value of each of their pieces in order."""
    lists = values.groupBy(*keys, "ty", "tx").agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "value"))), lambda v: v["value"]).alias("values"))
    same = (F.col("p.ty") == F.col("v.ty")) & (F.col("p.tx") == F.col("v.tx"))
    for k in keys:
        same &= F.col(f"p.{k}").eqNullSafe(F.col(f"v.{k}"))
    return parts.alias("p").join(lists.alias("v"), same, "left").select(*(F.col(f"p.{c}").alias(c) for c in (*keys, *PLACE, "on", "labels")), "v.values")


def component_tiles(tiles: DataFrame, keys: list[str], least: int = MIN_PIXELS) -> DataFrame:
    """(keys, place, label): 8-connected components numbered in raster order over the whole image from 1; those of fewer pixels have label 0, their numbers stay unused."""
    parts = stored(_pieces(tiles, keys, True, False))
    merged = stored(_merged(parts, keys, True))
    roots = merged.select(*keys, "root").distinct()
    ranks = numbered(roots, [*(F.col(k) for k in keys), F.col("root")], keys, "rank")
    same = F.col("m.root") == F.col("r.root")
    for k in keys:
        same &= F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}"))
    number = F.when(F.col("m.n") < least, 0).otherwise(F.col("r.rank") + 1).cast("int")
    values = merged.alias("m").join(ranks.alias("r"), same).select(*(F.col(f"m.{k}").alias(k) for k in keys), "m.ty", "m.tx", "m.id", number.alias("value"))
    return _relabelled(_told(parts, values, keys), keys)


def fill_tiles(tiles: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, place, on): those background pixels on as well that no 4-connected path joins to the image's border."""
    parts = stored(_pieces(tiles, keys, False, True))
    values = _merged(parts, keys, False).select(*keys, "ty", "tx", "id", (~F.col("edge")).cast("int").alias("value"))
    filled = _relabelled(_told(parts, values, keys), keys, "hole")
    return filled.withColumn("on", F.zip_with("on", "hole", lambda a, b: a | (b > 0))).drop("hole")


def _relabelled(told: DataFrame, keys: list[str], into: str = "label") -> DataFrame:
    """told with its pieces' values in the place of their labels."""
    names = [*told.select(*keys).columns, *PLACE, *(["on"] if into != "label" else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1)
                labels, values = one.column("labels").flatten().to_numpy(), one.column("values").flatten().to_numpy(zero_copy_only=False)
                made = np.r_[np.int32(0), values.astype(np.int32)][labels]
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), pa.array([made], pa.list_(pa.int32()))], [*names, into])

    fields = [*told.select(*names).schema.fields, StructField(into, ArrayType(IntegerType()))]
    return told.mapInArrow(run, StructType(fields))
