"""Image operators over pixel rows: windows, grouping and joins within images.

pixels(keys..., height, width, y, x, value) holds one row per pixel; keys name an
image. Images are independent of each other: a table is dealt by image once
(`pixel_rows`), and the windows along rows and columns then sort within its
partitions without another exchange. Masks are boolean columns, `on` if not
named otherwise. Components are found over runs of a row, which are few: runs of
neighbouring rows are joined, and the links of an image are folded to roots.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..shared import lasting
from . import histogram as H
from .running import each_series, whole_groups

#: Fixed values of the assay: smallest component, cell diameter, seed and diameter rules.
MIN_PIXELS, DIAMETER = 4, 10.0
SEED_SHARE, SPACING_SHARE, LEAST_DIAMETER, MOST_DIAMETER = 0.25, 0.55, 0.7, 1.3
#: Squared distance where there is no background at all (fixed value).
FAR = 1e15
NEAR = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def pixel_rows(planes: DataFrame, keys: list[str], **columns: str) -> DataFrame:
    """(keys, height, width, y, x, names...) from arrays in row order, e.g. v="pixels"; arrays of a plane are as long as each other."""
    both = F.arrays_zip(*(F.col(c).alias(n) for n, c in columns.items()))
    rows = planes.repartition(*keys).select(*keys, "height", "width", F.posexplode(both).alias("i", "_p"))
    return rows.select(*keys, "height", "width", F.floor(F.col("i") / F.col("width")).cast("int").alias("y"), (F.col("i") % F.col("width")).alias("x"), "_p.*")


def planes_of(pixels: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """(keys, height, width, into): pixel rows as one array in row order per image."""
    rows = pixels.groupBy(*keys, "height", "width").agg(F.sort_array(F.collect_list(F.struct("y", "x", value))).alias("_p"))
    return rows.select(*keys, "height", "width", F.transform("_p", lambda p: p[value]).alias(into))


def _row(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "y").orderBy("x")


def _column(keys: list[str]) -> Window:
    return Window.partitionBy(*keys, "x").orderBy("y")


def neighbour_max(pixels: DataFrame, keys: list[str], value: str, into: str) -> DataFrame:
    """I8: pixels with the largest value of the 3 x 3 pixels around each, itself included; along rows, then along columns."""
    rows = pixels.withColumn(into, F.max(value).over(_row(keys).rowsBetween(-1, 1)))
    return rows.withColumn(into, F.max(into).over(_column(keys).rowsBetween(-1, 1)))


# ------------------------------------------------------------- components


def _runs(pixels: DataFrame, keys: list[str], on: Column) -> DataFrame:
    """(keys, y, a, b, node): runs from a to b of pixels that are on; node is the place of the first one."""
    rows = pixels.where(on).withColumn("_g", F.col("x") - F.row_number().over(_row(keys)))
    runs = rows.groupBy(*keys, "height", "width", "y", "_g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    return runs.select(*keys, "height", "width", "y", "a", "b", (F.col("y").cast("long") * F.col("width") + F.col("a")).alias("node"))


def _joined(runs: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """runs with `root`, the smallest node of their component; runs of neighbouring rows touch when they overlap, or with reach 1 also across corners."""
    below = runs.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("y") - 1).alias("_y"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("node").alias("_node"))
    same = F.col("y") == F.col("_y")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    links = runs.join(below, same & (F.col("a") <= F.col("_b") + reach) & (F.col("_a") <= F.col("b") + reach))

    def rooted(image: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def find(n: int) -> int:
            while (up := root.setdefault(n, n)) != n:
                root[n] = n = root[up]
            return n

        for one, two in zip(image.node.tolist(), image["_node"].tolist(), strict=True):
            a, b = find(one), find(two)
            root[max(a, b)] = min(a, b)
        nodes = list(root)
        first = image[keys].iloc[:1]
        return first.loc[first.index.repeat(len(nodes))].assign(node=nodes, root=[find(n) for n in nodes])

    schema = runs.select(*keys, "node").schema.add("root", LongType())
    roots = links.select(*keys, "node", "_node").groupBy(*keys).applyInPandas(rooted, schema)
    return runs.join(roots, [*keys, "node"], "left").withColumn("root", F.coalesce("root", "node"))


def components(pixels: DataFrame, keys: list[str], on: str = "on", least: int = MIN_PIXELS) -> DataFrame:
    """(keys, y, x, label) of the pixels that are on: 8-connected components numbered in raster order from 1; those of fewer pixels have label 0, their numbers stay unused."""
    runs = _runs(pixels, keys, F.col(on))
    rows = _joined(runs, keys, 1)
    rows = rows.withColumn("label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("root")))
    pieces = rows.select(*keys, "y", "label", F.explode(F.sequence("a", "b")).alias("x"))
    return drop_small(pieces.select(*keys, "y", "x", "label"), keys, least)


def _sized(labels: DataFrame, keys: list[str]) -> tuple[DataFrame, Column]:
    """labels with the number of pixels of each row's label."""
    return labels.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "label"))), F.col("_n")


def drop_small(labels: DataFrame, keys: list[str], least: int = MIN_PIXELS) -> DataFrame:
    """Labels of fewer pixels become 0."""
    rows, n = _sized(labels, keys)
    return rows.withColumn("label", F.when(n < least, 0).otherwise(F.col("label"))).drop("_n")


def keep_diameter(labels: DataFrame, keys: list[str], diameter: float = DIAMETER) -> DataFrame:
    """Labels whose equivalent diameter is not within 0.7 and 1.3 of a cell's become 0."""
    rows, n = _sized(labels, keys)
    size = 2 * F.sqrt(n / math.pi)
    good = (size >= LEAST_DIAMETER * diameter) & (size <= MOST_DIAMETER * diameter)
    return rows.withColumn("label", F.when(good, F.col("label")).otherwise(0)).drop("_n")


def count_labels(labels: DataFrame, keys: list[str], into: str) -> DataFrame:
    """(keys, into): the number of labels of each image that has any."""
    return labels.where("label <> 0").groupBy(*keys).agg(F.countDistinct("label").cast("int").alias(into))


def fill_holes(pixels: DataFrame, keys: list[str], on: str = "on") -> DataFrame:
    """Pixels with those background pixels on as well that no 4-connected path joins to the border."""
    runs = _runs(pixels, keys, ~F.col(on))
    rows = _joined(runs, keys, 0)
    border = (F.col("y") == 0) | (F.col("y") == F.col("height") - 1) | (F.col("a") == 0) | (F.col("b") == F.col("width") - 1)
    inner = rows.withColumn("_out", F.max(border).over(Window.partitionBy(*keys, "root"))).where("not _out")
    holes = inner.select(*keys, "y", F.explode(F.sequence("a", "b")).alias("x"), F.lit(True).alias("_hole"))
    return pixels.join(holes, [*keys, "y", "x"], "left").withColumn(on, F.col(on) | F.coalesce("_hole", F.lit(False))).drop("_hole")


# ------------------------------------------------------ distance and cells


def nearest_squares(g: np.ndarray, on: np.ndarray) -> np.ndarray:
    """Along a line: for each place x that is on the smallest (x - i)^2 + g[i]^2 over all places i with g[i] >= 0, FAR without any; 0 where it is off.

    The parabolas' lower envelope, in whole numbers and linear time: a place is
    on the stack from `since` on until a later one gets below it. Off places
    have g = 0 and part the line, so every stretch between two is on its own.
    """
    n, out = len(g), np.zeros(len(g))
    cuts = np.flatnonzero(~on)
    for first, last in zip(np.r_[-1, cuts], np.r_[cuts, n], strict=True):
        if last - first < 2:
            continue
        low, high = max(int(first), 0), min(int(last), n - 1)  # with the off places at both ends
        stack: list[tuple[int, int]] = []
        since: list[int] = []
        for i, d in enumerate(g[low : high + 1].tolist(), low):
            if d < 0:
                continue
            start = low
            while stack:
                j, e = stack[-1]
                # from here on i is below j; the earlier one keeps ties
                start = (i * i - j * j + d * d - e * e) // (2 * (i - j)) + 1
                if start > since[-1]:
                    break
                stack.pop()
                since.pop()
                start = low
            if start <= high:
                stack.append((i, d))
                since.append(max(start, low))
        if not stack:
            out[first + 1 : last] = FAR
            continue
        x = np.arange(first + 1, last)
        best = np.array(stack, np.int64)[np.searchsorted(np.array(since), x, "right") - 1]
        out[first + 1 : last] = (x - best[:, 0]) ** 2 + best[:, 1] ** 2
    return out


def distance(pixels: DataFrame, keys: list[str], on: str = "on", into: str = "distance") -> DataFrame:
    """Pixels with the distance to the nearest pixel that is off, 0 for those; the border is none, and without any the distance is the root of FAR.

    First along columns by windows; then along rows, each of which is one fold
    in linear time. Rows are dealt out singly, so an image may be larger than a
    task.
    """
    w = _column(keys)
    off = F.when(~F.col(on), F.col("y"))
    up = F.col("y") - F.last(off, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.first(off, True).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.col("y")
    rows = pixels.withColumn("_g", F.coalesce(F.least(up, down), F.lit(-1)).cast("int"))
    names = pixels.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, [*keys, "y"]):
            g, mask = table.column("_g").to_numpy(), table.column(on).to_numpy()
            found = [nearest_squares(g[a:b], mask[a:b].astype(bool)) for a, b in zip(at[:-1], at[1:], strict=True)]
            made = table.select(names).append_column(into, pa.array(np.sqrt(np.concatenate(found))))
            yield from made.combine_chunks().to_batches()

    schema = StructType([*pixels.schema.fields, StructField(into, DoubleType())])
    return rows.repartition(*keys, "y").sortWithinPartitions(*keys, "y", "x").mapInArrow(fold, schema)


def spaced(y: np.ndarray, x: np.ndarray, spacing: float) -> np.ndarray:
    """O3: indices of points, in their order, that are no nearer than spacing to one taken before. Points lie in squares of the spacing's side, so a point meets only those of nine squares, a few each."""
    squares: dict[tuple[int, int], list[tuple[int, int]]] = {}
    taken = []
    for k, (a, b) in enumerate(zip(y.tolist(), x.tolist(), strict=True)):
        i, j = int(a // spacing), int(b // spacing)
        near = (p for dy, dx in NEAR for p in squares.get((i + dy, j + dx), ()))
        if all((a - c) ** 2 + (b - d) ** 2 >= spacing * spacing for c, d in near):
            squares.setdefault((i, j), []).append((a, b))
            taken.append(k)
    return np.array(taken, np.int64)


def seeds(pixels: DataFrame, keys: list[str], on: str = "on", diameter: float = DIAMETER, value: str = "distance") -> DataFrame:
    """(keys, y, x, seed): local maxima of the distance, the farthest from background first, then in raster order, none closer than the spacing to an earlier one; numbered from 1."""
    spacing, least = max(SPACING_SHARE * diameter, 1.0), max(SEED_SHARE * diameter, 1.0)
    rows = neighbour_max(pixels.withColumn("_d", F.when(F.col(on), F.col(value))), keys, "_d", "_m")
    tops = rows.where(F.col(on) & (F.col(value) >= least) & (F.col("_d") >= F.col("_m"))).select(*keys, "y", "x", (-F.col(value)).alias("_o"))

    def run(image: pa.Table) -> pa.RecordBatch:
        kept = spaced(image.column("y").to_numpy(), image.column("x").to_numpy(), spacing)
        made = image.select([*keys, "y", "x"]).take(kept).append_column("seed", pa.array(np.arange(1, len(kept) + 1), pa.int32()))
        return made.combine_chunks().to_batches()[0]

    return each_series(tops, keys, ["_o", "y", "x"], run, StructType([*tops.drop("_o").schema.fields, StructField("seed", IntegerType())]))


def watershed(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, x, label): floods pixels(on, distance, seed) of each image from its seeds, by distance in whole thousandths, then lower place; a pixel takes its label when it is reached.

    The order of the flood is that of one queue, so an image is flooded as a whole.
    """
    rows = pixels.where("on").select(*keys, "y", "x", "width", F.floor(F.col("distance") * 1000).cast("long").alias("level"), F.coalesce("seed", F.lit(0)).alias("label"))

    def flood(image: pd.DataFrame) -> pd.DataFrame:
        width = int(image.width.iloc[0]) + 2  # a frame of places that are no pixels
        place = ((image.y + 1) * width + image.x + 1).to_numpy()
        level = dict(zip(place.tolist(), image.level.tolist(), strict=True))
        label = {p: s for p, s in zip(place.tolist(), image.label.tolist(), strict=True) if s}
        heap = [(-level[p], p) for p in label]
        heapq.heapify(heap)
        while heap:
            _, p = heapq.heappop(heap)
            for dy, dx in NEAR:
                q = p + dy * width + dx
                if q in level and q not in label:
                    label[q] = label[p]
                    heapq.heappush(heap, (-level[q], q))
        return image.assign(label=np.array([label.get(p, 0) for p in place.tolist()], np.int32))[[*keys, "y", "x", "label"]]

    schema = pixels.select(*keys, "y", "x").schema.add("label", IntegerType())
    return rows.groupBy(*keys).applyInPandas(flood, schema)


def split_cells(pixels: DataFrame, keys: list[str], on: str = "on", diameter: float = DIAMETER) -> DataFrame:
    """(keys, y, x, label): touching round cells taken apart; images without a seed have their components."""
    rows = lasting(distance(pixels.withColumn("on", F.col(on)), keys))
    found = lasting(seeds(rows, keys, "on", diameter))
    flooded = watershed(rows.join(found.select(*keys).distinct(), keys, "left_semi").join(found, [*keys, "y", "x"], "left"), keys)
    plain = components(rows.join(found.select(*keys).distinct(), keys, "left_anti"), keys)
    return keep_diameter(drop_small(flooded, keys).unionByName(plain), keys, diameter)


def touching(labels: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of labels on a pixel that is, or is next to, a pixel of others with a label."""
    near = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in NEAR))).alias("_o")
    around = others.where("label <> 0").select(*keys, "y", "x", near)
    around = around.select(*keys, (F.col("y") + F.col("_o.dy")).alias("y"), (F.col("x") + F.col("_o.dx")).alias("x")).distinct()
    return labels.join(around, [*keys, "y", "x"], "left_semi")


def engagement(pixels: DataFrame, keys: list[str], diameter: float = DIAMETER) -> DataFrame:
    """(keys, tumor_cells, t_cells, engagements) of pixels(tumor, engager, ...): tumour components, split engagers, and engagers that touch a tumour component."""
    tumors = lasting(components(pixels, keys, "tumor"))
    engagers = lasting(split_cells(pixels, keys, "engager", diameter))
    out = pixels.select(*keys).distinct()
    for rows, name in ((tumors, "tumor_cells"), (engagers, "t_cells"), (touching(engagers, tumors, keys), "engagements")):
        out = out.join(count_labels(rows, keys, name), keys, "left")
    return out.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("tumor_cells", "t_cells", "engagements")))


# ---------------------------------------------------------------- filters


def _box_sum(rows: DataFrame, line: Window, place: str, size: str, radius: int, value: str, into: str) -> DataFrame:
    """rows with the sum over a window along a line, its ends repeated beyond them: the difference of two running sums, whatever the radius."""
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "_sum": F.sum(value).over(line.rowsBetween(Window.unboundedPreceding, 0)),
        "_first": F.first(value).over(whole),
        "_last": F.last(value).over(whole),
    })
    upto = F.coalesce(F.lead("_sum", radius).over(line), F.last("_sum").over(whole))
    since = F.coalesce(F.lag("_sum", radius + 1).over(line), F.lit(0.0))
    before, after = F.greatest(radius - F.col(place), F.lit(0)), F.greatest(F.col(place) + radius - F.col(size) + 1, F.lit(0))
    return rows.withColumn(into, upto - since + F.col("_first") * before + F.col("_last") * after).drop("_sum", "_first", "_last")


def box_mean(pixels: DataFrame, keys: list[str], radius: int, value: str = "v", into: str = "mean") -> DataFrame:
    """Pixels with the mean over a square window, the border repeated."""
    if radius < 0:
        raise ValueError("radius must not be negative")
    rows = _box_sum(pixels, _row(keys), "x", "width", radius, value, into)
    rows = _box_sum(rows, _column(keys), "y", "height", radius, into, into)
    return rows.withColumn(into, F.col(into) / float((2 * radius + 1) ** 2))


def local_deviation(pixels: DataFrame, keys: list[str], radius: int, value: str = "v", into: str = "deviation") -> DataFrame:
    """Pixels with the deviation within a square window, the border repeated."""
    rows = box_mean(pixels.withColumn("_q", F.col(value) * F.col(value)), keys, radius, value, "_m")
    rows = box_mean(rows, keys, radius, "_q", "_q")
    return rows.withColumn(into, F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))).drop("_q", "_m")


def gaussian(pixels: DataFrame, keys: list[str], sigma: float, value: str = "v", into: str = "smooth") -> DataFrame:
    """Pixels smoothed to three deviations along rows and columns, the border repeated."""
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if sigma == 0:
        return pixels.withColumn(into, F.col(value))
    radius = max(1, math.ceil(3 * sigma))
    weight = np.exp(-(np.arange(-radius, radius + 1.0) ** 2) / (2 * sigma * sigma))
    weight /= weight.sum()

    def along(name: str, line: Window) -> Column:
        whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        terms = [float(weight[radius]) * F.col(name)]
        for k in range(1, radius + 1):
            terms.append(float(weight[radius + k]) * (F.coalesce(F.lag(name, k).over(line), F.first(name).over(whole)) + F.coalesce(F.lead(name, k).over(line), F.last(name).over(whole))))
        return sum(terms[1:], terms[0])

    return pixels.withColumn(into, along(value, _row(keys))).withColumn(into, along(into, _column(keys)))


def segment(pixels: DataFrame, keys: list[str], value: str = "v", radius: int = 2, sigma: float = 1.0) -> DataFrame:
    """Pixels with `on`, a cell's mask in brightfield."""
    rows = lasting(gaussian(local_deviation(pixels, keys, radius, value), keys, sigma, "deviation"))
    rows = rows.join(H.otsu_centres(rows, keys, "smooth"), keys).withColumn("on", F.col("smooth") > F.col("threshold"))
    return fill_holes(rows.drop("deviation", "smooth", "threshold"), keys)


def masked_signal(pixels: DataFrame, keys: list[str], value: str = "stain", on: str = "on") -> DataFrame:
    """(keys, v): stain inside the cell less its area times the median outside; 0 without a cell."""
    inside = F.col(on)
    rows = pixels.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(inside, F.col(value))), F.lit(0.0)).alias("_s"),
        F.count(F.when(inside, 1)).alias("_n"),
        F.coalesce(F.percentile(F.when(~inside, F.col(value)), 0.5), F.lit(0.0)).alias("_b"),
    )
    return rows.select(*keys, F.when(F.col("_n") > 0, F.col("_s") - F.col("_n") * F.col("_b")).otherwise(0.0).alias("v"))


# --------------------------------------------------------------- contrast


def quantile_limits(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """(keys, low, high): the 1 and 99 % quantiles of each image."""
    return pixels.groupBy(*keys).agg(F.percentile(value, 0.01).alias("low"), F.percentile(value, 0.99).alias("high"))


def contrast(pixels: DataFrame, keys: list[str], form: str = "sheet", value: str = "v", limits: DataFrame | None = None) -> DataFrame:
    """Pixels with `gray`, 0 to 255, between their image's 1 and 99 % quantiles or given limits(keys..., low, high), truncated; all three colours are the same.

    form: sheet (a flat image is black), png (a flat image's range is one) or
    movie (the range is 1e-6 at least, and pixels must be finite).
    """
    joined = pixels.join(quantile_limits(pixels, keys, value) if limits is None else limits, [c for c in keys if limits is None or c in limits.columns])
    v = F.col(value)
    if form == "movie":
        v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("pixels must be finite")).cast("double")).otherwise(v)
    span = F.col("high") - F.col("low")
    wide = {"sheet": F.when(span > 0, span), "png": F.when(span > 0, span).otherwise(1.0), "movie": F.greatest(span, F.lit(1e-6))}[form]
    share = F.least(F.greatest((v - F.col("low")) / wide, F.lit(0.0)), F.lit(1.0))
    gray = share * 255 if form == "movie" else F.when(F.col("high") > F.col("low") if form == "sheet" else F.lit(True), share * 255).otherwise(0.0)
    return joined.withColumn("gray", F.floor(F.coalesce(gray, F.lit(0.0))).cast("int")).drop("low", "high")
