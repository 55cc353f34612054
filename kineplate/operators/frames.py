"""Frames as rows with pixel arrays: pairing of channels, counts per frame and model inputs.

What looks at neighbouring pixels goes through pixel rows (pixels.py); what
resizes an image is an expression over its array, so pixels stay where they
were read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import histogram as H
from . import pixels as P

#: Mean and deviation of the colour channels of the standard image set (fixed values).
IMAGE_MEAN, IMAGE_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)
FRAME = ["pos", "roi", "t"]


def paired(planes: DataFrame, **channels: int) -> DataFrame:
    """One row per frame with a pixel column per named channel; planes of a frame meet by one grouping on their key."""
    rows = planes.where("z = 0").where(F.col("channel").isin(list(channels.values())))
    picks = [F.first(F.when(F.col("channel") == c, F.col("pixels")), ignorenulls=True).alias(name) for name, c in channels.items()]
    return rows.groupBy(*FRAME).agg(F.first("height").alias("height"), F.first("width").alias("width"), *picks)


def engagement_counts(frames: DataFrame, diameter: float = P.DIAMETER) -> DataFrame:
    """frames(tumor, engager boolean arrays, height, width, keys...) with tumor_cells, t_cells and engagements; all other columns are the key of a frame."""
    keys = [c for c in frames.columns if c not in ("tumor", "engager", "height", "width")]
    pixels = P.lasting(P.pixel_rows(frames, keys, tumor="tumor", engager="engager"))
    return frames.select(*keys, "height", "width").join(P.engagement(pixels, keys, diameter), keys, "left").na.fill(0, ["tumor_cells", "t_cells", "engagements"])


def minority_mask(planes: DataFrame, keys: list[str], column: str, into: str) -> DataFrame:
    """I4: planes with the boolean array `into`, the rarer side of each plane's own Otsu threshold; nothing for a constant one."""
    pixels = planes.select(*keys, F.explode(column).alias("v"))
    thresholds = H.otsu_levels(pixels, keys).select(*keys, "threshold")
    return planes.join(thresholds, keys, "left").withColumn(into, H.minority_mask(column, "threshold")).drop("threshold")


def position_engagement(planes: DataFrame, signal: int, segmentation: int, interval: float, diameter: float = P.DIAMETER) -> DataFrame:
    """I16: (pos, roi, t, minutes, tumor_cells, t_cells, engagements) in two passes: a scale per position from all its frames, then the counts.

    The scale is one row per position and joins by it.
    """
    own = planes.where("z = 0").where(F.col("channel") == signal)
    scales = H.robust_scale(H.plane_histogram(own, ["pos"]), ["pos"], own)
    rows = paired(planes, signal=signal, cells=segmentation).join(scales, "pos").withColumn("engager", H.scale_mask("signal", "threshold")).drop("low", "threshold")
    rows = minority_mask(rows, FRAME, "cells", "tumor").select(*FRAME, "tumor", "engager", "height", "width")
    counts = engagement_counts(rows, diameter)
    return counts.select(*FRAME, F.round(F.col("t") * interval, 4).alias("minutes"), "tumor_cells", "t_cells", "engagements")


def stain_traces(planes: DataFrame, brightfield: int = 0, stain: int = 1) -> DataFrame:
    """(pos, roi, t, v): the stain inside the cell that brightfield shows, per frame."""
    pixels = P.pixel_rows(paired(planes, bright=brightfield, light=stain), FRAME, v="bright", stain="light")
    return P.masked_signal(P.segment(pixels, FRAME), FRAME)


def baseline_limits(planes: DataFrame) -> DataFrame:
    """(pos, roi, channel, z, low, high): the 1 and 99 % quantiles of each movie's first frame."""
    keys = ["pos", "roi", "channel", "z"]
    first = planes.groupBy(*keys).agg(F.min_by("pixels", "t").alias("p"))
    return first.select(*keys, quantile_of("p", 0.01).alias("low"), quantile_of("p", 0.99).alias("high"))


def quantile_of(pixels: str, q: float) -> Column:
    """Interpolated quantile of an array."""
    s = F.array_sort(pixels)
    place = (F.size(pixels) - 1) * q
    low = F.floor(place).cast("int")
    return F.get(s, low) + (place - low) * (F.get(s, F.least(low + 1, F.size(pixels) - 1)) - F.get(s, low))


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def model_input(planes: DataFrame, side: int = 128, pixels: str = "pixels", into: str = "input") -> DataFrame:
    """Planes with an array of side x side values: quantile contrast to 0..1, resized by linear weights around pixel centres, the border repeated. All colour channels are the same."""

    def scaled(limits: Column) -> Column:
        low, high = F.get(limits, F.lit(0)), F.get(limits, F.lit(1))
        return F.transform(pixels, lambda v: F.when(high > low, F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0))).otherwise(0.0))

    def weights(k: Column, n: str) -> tuple[Column, Column, Column]:
        at = F.greatest((k + 0.5) * F.col(n) / side - 0.5, F.lit(0.0))
        one = F.least(F.floor(at).cast("int"), F.col(n) - 1)
        return one, F.least(one + 1, F.col(n) - 1), at - one

    def resized(p: Column) -> Column:
        def value(i: Column) -> Column:
            a, b, f = weights(F.floor(i / side).cast("int"), "height")
            c, d, g = weights(i % side, "width")

            def at(y: Column, x: Column) -> Column:
                return F.get(p, y * F.col("width") + x)

            return (at(a, c) * (1 - f) + at(b, c) * f) * (1 - g) + (at(a, d) * (1 - f) + at(b, d) * f) * g

        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), value)

    limits = F.array(quantile_of(pixels, 0.01), quantile_of(pixels, 0.99))
    return planes.withColumn(into, _with(_with(limits, scaled), resized).cast("array<float>"))


def network_input(planes: DataFrame, side: int = 224, pixels: str = "pixels", into: str = "input") -> DataFrame:
    """Planes with an array of 3 x side x side values: full range to 8 bits, resized with a triangle whose support widens when the image shrinks, standardised per colour channel (channels first); flat images are 0 before that."""
    width, height = F.col("width"), F.col("height")

    def gray(limits: Column) -> Column:
        low, high = F.get(limits, F.lit(0)), F.get(limits, F.lit(1))
        return F.transform(pixels, lambda v: F.when(high > low, F.floor((v - low) / (high - low) * 255 + 0.5)).otherwise(0).cast("double"))

    def mean(k: Column, n: Column, pick: Callable[[Column], Column]) -> Column:
        """Weighted mean around place k of `side` along a line of n values."""
        scale = F.greatest(n / side, F.lit(1.0))
        centre = (k + 0.5) * n / side
        near = F.sequence(F.greatest(F.floor(centre - scale - 0.5).cast("int"), F.lit(0)), F.least(F.ceil(centre + scale - 0.5).cast("int"), n - 1))

        def weight(j: Column) -> Column:
            return F.greatest(1 - F.abs(j + 0.5 - centre) / scale, F.lit(0.0))

        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("w"))
        both = lambda t, j: F.struct((t.s + weight(j) * pick(j)).alias("s"), (t.w + weight(j)).alias("w"))
        return F.aggregate(near, start, both, lambda t: t.s / t.w)

    def down(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), side * width - 1), lambda i: mean(F.floor(i / width).cast("int"), height, lambda j: F.get(p, j * width + i % width)))

    def across(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.floor(mean(i % side, width, lambda j: F.get(p, F.floor(i / side).cast("int") * width + j)) + 0.5) / 255)

    def channels(p: Column) -> Column:
        def standard(m: float, s: float) -> Column:
            return F.transform(p, lambda v: (v - m) / s)

        return F.concat(*(standard(m, s) for m, s in zip(IMAGE_MEAN, IMAGE_STD, strict=True)))

    limits = F.array(F.array_min(pixels), F.array_max(pixels))
    return planes.withColumn(into, _with(_with(_with(_with(limits, gray), down), across), channels).cast("array<float>"))
