"""Intensity histograms, robust scales, thresholds and masks, in SQL over pixels or planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import MAD, MAX_DOUBLE

#: Fixed values of the shared scale.
SAMPLE_EVERY, BINS, SIGMAS = 4, 65_536, 8.0


def sampled_histogram(pixels: DataFrame, keys: list[str], value: str = "v", index: str = "idx") -> DataFrame:
    """A4: (keys, bin, n) of every fourth pixel by its index in the frame; finite, not negative, rounded half away, below 65536."""
    rows = pixels.where((F.col(index) % SAMPLE_EVERY == 0) & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")) & (F.col(value) >= 0))
    return rows.groupBy(*keys, F.round(value).cast("long").alias("bin")).agg(F.count("*").alias("n")).where(F.col("bin") < BINS)


def plane_histogram(planes: DataFrame, keys: list[str], pixels: str = "pixels") -> DataFrame:
    """A4 over planes: every fourth pixel is picked inside the array, so only those are exploded."""
    picked = F.filter(pixels, lambda x, i: i % SAMPLE_EVERY == 0)
    return sampled_histogram(planes.select(*keys, F.explode(picked).alias("v"), F.lit(0).alias("idx")), keys)


def histogram_percentile(histogram: DataFrame, keys: list[str], q: float, bin: str = "bin") -> DataFrame:
    """A5: (keys, value, total): the smallest bin whose running count exceeds round((n - 1) * q), rounded half away."""
    so_far = Window.partitionBy(*keys).orderBy(bin).rowsBetween(Window.unboundedPreceding, 0)
    rows = histogram.withColumn("upto", F.sum("n").over(so_far)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    return rows.where(F.col("upto") > F.round((F.col("total") - 1) * q)).groupBy(*keys).agg(F.min(bin).alias("value"), F.max("total").alias("total"))


def robust_scale(histogram: DataFrame, keys: list[str], every: DataFrame | None = None) -> DataFrame:
    """(keys, low, threshold): median, and median plus 8 robust deviations, or the median alone where nothing deviates.

    `every` lists keys that must come out even if their histogram is empty: low 0 and the largest double.
    """
    low = histogram_percentile(histogram, keys, 0.5).select(*keys, F.col("value").alias("low"))
    apart = histogram.join(low, keys).groupBy(*keys, F.abs(F.col("bin") - F.col("low")).alias("apart")).agg(F.sum("n").alias("n"))
    mad = histogram_percentile(apart, keys, 0.5, "apart").select(*keys, (F.col("value") * MAD).alias("sigma"))
    out = low.join(mad, keys).select(*keys, F.col("low").cast("double").alias("low"), F.when(F.col("sigma") == 0, F.col("low").cast("double")).otherwise(F.col("low") + SIGMAS * F.col("sigma")).alias("threshold"))
    if every is None:
        return out
    return every.select(*keys).distinct().join(out, keys, "left").select(*keys, F.coalesce("low", F.lit(0.0)).alias("low"), F.coalesce("threshold", F.lit(MAX_DOUBLE)).alias("threshold"))


def _beside(pixels: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels joined to the one row of their group. A task holds its groups' rows hashed and lets the pixels pass, so that they are never sorted."""
    return pixels.join(groups.hint("shuffle_hash"), keys)


def _limited(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, v, low, high): values with their group's smallest and largest, one row per group joined to the pixels."""
    limits = pixels.groupBy(*keys).agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"))
    return _beside(pixels.select(*keys, F.col(value).cast("double").alias("v")), limits, keys)


def otsu_levels(pixels: DataFrame, keys: list[str], value: str = "v", levels: int = 255) -> DataFrame:
    """(keys, low, high, level, threshold) by between-class variance over the values scaled to 0..255; groups without a range are left out.

    The first of equal maxima wins. Values above the threshold are foreground.
    """
    good = pixels.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    rows = _limited(good, keys, value).where("high > low")
    bin = F.greatest(F.least(F.round((F.col("v") - F.col("low")) * (F.lit(float(levels)) / (F.col("high") - F.col("low")))), F.lit(float(levels))), F.lit(0.0)).cast("int")
    counts = rows.groupBy(*keys, "low", "high", bin.alias("level")).agg(F.count("*").alias("n"))
    return _between(counts, keys, F.col("level").cast("double")).select(*keys, "low", "high", "level", (F.col("low") + F.col("level") / float(levels) * (F.col("high") - F.col("low"))).alias("threshold"))


def _between(counts: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """(keys, low, high, level, x): the row of counts(keys, low, high, level, n) with the first largest between-class variance, or the only one of a constant group."""
    upto = Window.partitionBy(*keys).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = counts.withColumn("x", place).withColumn("w", F.sum("n").over(upto)).withColumn("s", F.sum(F.col("n") * F.col("x")).over(upto))
    rows = rows.withColumn("wt", F.sum("n").over(whole)).withColumn("st", F.sum(F.col("n") * F.col("x")).over(whole)).where("w < wt OR low = high")
    gap = F.col("s") / F.col("w") - (F.col("st") - F.col("s")) / F.nullif(F.col("wt") - F.col("w"), F.lit(0))
    # rounded, so that equal variances that differ in their last bits stay ties
    score = F.round(F.col("w") * (F.col("wt") - F.col("w")) * gap * gap / (F.col("wt") * F.col("wt")), 9)
    best = F.max(F.struct(score.alias("score"), (-F.col("level")).alias("back"), "low", "high", "level", "x"))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.low", "best.high", "best.level", "best.x")


def otsu_centres(pixels: DataFrame, keys: list[str], value: str = "v", bins: int = 256) -> DataFrame:
    """(keys, threshold) by bin centres of an equal-width histogram, the constant itself where all values are equal."""
    good = pixels.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    rows = _limited(good, keys, value)
    width = (F.col("high") - F.col("low")) / bins
    bin = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("v") - F.col("low")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counts = rows.groupBy(*keys, "low", "high", bin.alias("level")).agg(F.count("*").alias("n"))
    centre = F.col("low") + (F.col("level") + 0.5) * (F.col("high") - F.col("low")) / bins
    return _between(counts, keys, centre).select(*keys, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("x")).alias("threshold"))


def minority_counts(pixels: DataFrame, thresholds: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """I4: (keys, above, n, on, kept): how many pixels lie above a threshold and how many the minority mask keeps; `above` wins ties, a one-sided split keeps none."""
    one = _beside(pixels, thresholds.select(*keys, "threshold"), keys).groupBy(*keys).agg(F.sum((F.col(value) > F.col("threshold")).cast("long")).alias("above"), F.count("*").alias("n"))
    side = F.when((F.col("above") == 0) | (F.col("above") == F.col("n")), "none").when(F.col("above") <= F.col("n") - F.col("above"), "above").otherwise("below")
    kept = F.when(side == "above", F.col("above")).when(side == "below", F.col("n") - F.col("above")).otherwise(F.lit(0))
    return one.select(*keys, "above", "n", side.alias("on"), kept.alias("kept"))


def minority_mask(pixels: str | Column, threshold: str | Column) -> Column:
    """I4 over a plane's array: boolean mask of the rarer side of the threshold."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (pixels, threshold))
    above = F.transform(p, lambda x: F.coalesce(x > t, F.lit(False)))
    on = F.size(F.filter(above, lambda x: x))
    none = F.transform(p, lambda x: F.lit(False))
    return F.when(t.isNull() | (on == 0) | (on == F.size(p)), none).when(on <= F.size(p) - on, above).otherwise(F.transform(above, lambda x: ~x))


def scale_mask(pixels: str | Column, threshold: str | Column) -> Column:
    """Finite pixels strictly above a threshold."""
    p, t = (F.col(x) if isinstance(x, str) else x for x in (pixels, threshold))
    return F.transform(p, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")) & (x > t), F.lit(False)))


def sigma_threshold(pixels: DataFrame, keys: list[str], value: str = "v", sigmas: float = 6.0) -> DataFrame:
    """(keys, threshold, on): mean plus 6 population deviations and the number of pixels above; null and 0 without deviation."""
    good = pixels.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf")))
    one = good.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"))
    rule = one.select(*keys, F.when(F.col("sd") > 0, F.col("m") + sigmas * F.col("sd")).alias("threshold"))
    return _beside(good, rule, keys).groupBy(*keys).agg(F.max("threshold").alias("threshold"), F.coalesce(F.sum((F.col(value) > F.col("threshold")).cast("long")), F.lit(0)).alias("on"))
