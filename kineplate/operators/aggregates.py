"""Aggregates over pixels, engagements, predictions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import finite, quantile, usable_label


def frame_stats(pixels: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """A2 over one row per pixel: area, background (10 % quantile), sum, corrected = sum - area * background."""
    one = pixels.groupBy(*keys).agg(F.count("*").cast("int").alias("area"), quantile(value, 0.1).alias("background"), F.sum(F.col(value).cast("double")).alias("sum"))
    return one.withColumn("corrected", F.col("sum") - F.col("area") * F.col("background"))


def plane_stats(planes: DataFrame, pixels: str = "pixels") -> DataFrame:
    """A2 over one row per plane, without a shuffle: the quantile interpolates in the sorted finite pixels."""
    sound = F.array_sort(F.filter(pixels, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = planes.withColumn("_s", sound)
    place = (F.size("_s") - 1) * 0.1
    low = F.floor(place).cast("int")
    at = F.get("_s", low) + (place - low) * (F.get("_s", F.least(low + 1, F.size("_s") - 1)) - F.get("_s", low))
    rows = rows.withColumn("area", F.size(pixels)).withColumn("background", F.when(F.size("_s") > 0, at).otherwise(F.lit(0.0)))
    rows = rows.withColumn("sum", F.aggregate(pixels, F.lit(0.0), lambda s, x: s + x))
    return rows.withColumn("corrected", F.col("sum") - F.col("area") * F.col("background")).drop("_s")


def fluorescence(planes: DataFrame, channels: DataFrame) -> DataFrame:
    """A3: (pos, channel, roi, t, area, background, sum, corrected) of the signal channels at z = 0; channels(pos, channel) says which are read."""
    rows = planes.where("z = 0").join(channels, ["pos", "channel"], "left_semi")
    return plane_stats(rows).select("pos", "channel", "roi", "t", "area", "background", "sum", "corrected")


def engagement_summary(rows: DataFrame) -> DataFrame:
    """Frames and mean counts per ROI."""
    means = [F.avg(c).alias(f"{c}_mean") for c in ("engagements", "tumor_cells", "t_cells")]
    return rows.groupBy("pos", "roi").agg(F.count("*").alias("frames"), *means)


def summary_curve(traces: DataFrame, interval: float, value: str = "corrected") -> DataFrame:
    """A10: mean, median and quartiles of finite values per sample and minute; times are equal to a millionth of a minute."""
    rows = traces.where(finite(value)).withColumn("minute_key", F.round(F.col("t") * interval * 1e6).cast("long"))
    quarters = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    one = rows.groupBy("sample", "minute_key").agg(F.avg(value).alias("mean"), quarters.alias("q"), F.count("*").alias("n_traces"))
    return one.select("sample", "minute_key", (F.col("minute_key") / 1e6).alias("minutes"), "mean", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "n_traces")


def axis_range(rows: DataFrame, value: str = "v", low_margin: float = 1.0, high_margin: float = 0.9) -> DataFrame:
    """One row (low, high) around the finite values; (0, 1) for none, and room on both sides of a single value."""
    one = rows.agg(F.min(F.when(finite(value), F.col(value))).alias("a"), F.max(F.when(finite(value), F.col(value))).alias("b"))
    one = one.select((F.col("a") * low_margin).alias("a"), (F.col("b") / high_margin).alias("b"))
    room = F.when(F.col("a") == 0, F.lit(1.0)).otherwise(F.abs("a") * 0.05)
    low = F.when(F.col("a").isNull(), F.lit(0.0)).when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("a") - room)
    high = F.when(F.col("a").isNull(), F.lit(1.0)).when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("b") + room)
    return one.select(low.alias("low"), high.alias("high"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(top / F.nullif(bottom, F.lit(0)), F.lit(0.0))


def binary_metrics(rows: DataFrame, prediction: str = "prediction", truth: str = "truth", keys: tuple[str, ...] = ()) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; rates over nothing are 0."""

    def count(p: int, t: int, name: str) -> Column:
        return F.coalesce(F.sum(((F.col(prediction) == p) & (F.col(truth) == t)).cast("long")), F.lit(0)).alias(name)

    both = F.col(prediction).isin(0, 1) & F.col(truth).isin(0, 1)
    grouped = rows.where(both).groupBy(*keys).agg(count(1, 1, "tp"), count(0, 0, "tn"), count(1, 0, "fp"), count(0, 1, "fn"))
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    rated = grouped.select("*", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"), precision.alias("precision"), recall.alias("recall"))
    return rated.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(rows: DataFrame, references: DataFrame, prediction: str = "prediction", truth: str = "label") -> DataFrame:
    """(truth, prediction, n) over usable rows for all pairs of truth and reference classes, 0 where a pair doesn't occur.

    The pairs of classes come from an aggregate of each class with the sorted
    list of all of them, so no join of everything with everything is made.
    """
    good = rows.where(usable_label(truth)).select(F.col(truth).alias("truth"), F.col(prediction).alias("prediction"))
    counts = good.groupBy("truth", "prediction").agg(F.count("*").alias("n"))
    classes = good.select(F.col("truth").alias("class")).union(references.where(usable_label("label")).select("label")).agg(F.array_sort(F.collect_set("class")).alias("all"))
    grid = classes.select(F.explode("all").alias("truth"), "all").select("truth", F.explode("all").alias("prediction"))
    return grid.join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def macro_metrics(rows: DataFrame, prediction: str = "prediction", truth: str = "label") -> DataFrame:
    """One row (scored, accuracy, macro_recall) over usable rows; recall is averaged over the classes of the truth. Null rates without rows."""
    good = rows.where(usable_label(truth)).withColumn("hit", (F.col(prediction) == F.col(truth)).cast("int"))
    per = good.groupBy(truth).agg(F.count("*").alias("n"), F.sum("hit").alias("hits"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"), (F.sum("hits") / F.sum("n")).alias("accuracy"), F.avg(F.col("hits") / F.col("n")).alias("macro_recall"))


def class_support(rows: DataFrame, label: str = "label", group: str = "group") -> DataFrame:
    """Images and groups per usable class."""
    return rows.where(usable_label(label)).groupBy(label).agg(F.count("*").alias("images"), F.countDistinct(group).alias("groups"))


def manifest_counts(samples: DataFrame) -> DataFrame:
    """Viable and dead counts of each split (label 1 is viable)."""
    return samples.groupBy("split").agg(F.sum((F.col("label") == 1).cast("long")).alias("viable"), F.sum((F.col("label") == 0).cast("long")).alias("dead"))


def class_weights(samples: DataFrame) -> DataFrame:
    """One row (weight_viable, weight_dead): total over twice the count, both 1 where a class is missing."""
    one = samples.agg(F.coalesce(F.sum((F.col("label") == 1).cast("long")), F.lit(0)).alias("v"), F.coalesce(F.sum((F.col("label") == 0).cast("long")), F.lit(0)).alias("d"))
    both = (F.col("v") > 0) & (F.col("d") > 0)
    total = F.col("v") + F.col("d")
    return one.select(F.when(both, total / (2 * F.nullif("v", F.lit(0)))).otherwise(F.lit(1.0)).alias("weight_viable"), F.when(both, total / (2 * F.nullif("d", F.lit(0)))).otherwise(F.lit(1.0)).alias("weight_dead"))


def component_count(labels: str | Column) -> Column:
    """Distinct labels other than 0."""
    return F.size(F.array_distinct(F.filter(labels, lambda x: x != 0)))


def error_audit(errors: DataFrame) -> DataFrame:
    """Images, errors, false positives and false negatives per group, of the rows of label_errors()."""
    fp, fn = F.col("false_positive").cast("long"), F.col("false_negative").cast("long")
    wrong = (F.col("prediction") != F.col("label")).cast("long")
    return errors.groupBy("group").agg(F.count("*").alias("images"), F.sum(wrong).alias("errors"), F.sum(fp).alias("false_positives"), F.sum(fn).alias("false_negatives"))


def trial_means(trials: DataFrame) -> DataFrame:
    """Mean metrics per annotation budget over seeds; trials(budget, seed, method, accuracy, macro_recall)."""
    return trials.groupBy("budget", "method").agg(F.count("*").alias("trials"), F.avg("accuracy").alias("accuracy"), F.avg("macro_recall").alias("macro_recall"))


def ellipse(rows: DataFrame, x: str, y: str, keys: tuple[str, ...] = (), n_std: float = 1.0) -> DataFrame:
    """Centre, spread and correlation of points, and the half axes of their ellipse along the diagonals; none for fewer than two points or no spread."""
    one = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(x).alias("mean_x"), F.avg(y).alias("mean_y"), F.covar_samp(x, y).alias("cov"), F.stddev_samp(x).alias("sd_x"), F.stddev_samp(y).alias("sd_y"))
    one = one.where((F.col("n") >= 2) & (F.col("sd_x") > 0) & (F.col("sd_y") > 0))
    r = F.greatest(F.least(F.col("cov") / (F.col("sd_x") * F.col("sd_y")), F.lit(0.999)), F.lit(-0.999))
    one = one.withColumn("r", r)
    return one.select(*keys, "n", "mean_x", "mean_y", (F.col("sd_x") * n_std).alias("scale_x"), (F.col("sd_y") * n_std).alias("scale_y"), "r", F.sqrt(1 + F.col("r")).alias("radius_x"), F.sqrt(1 - F.col("r")).alias("radius_y"))


def death_histogram(deaths: DataFrame, bins: int = 20, key: str = "sample", value: str = "death_time") -> DataFrame:
    """Counts per sample in equal bins from its least to its largest death time; the last bin holds the largest."""
    whole = Window.partitionBy(key)
    rows = deaths.select(key, F.col(value).cast("double").alias("x"), F.min(value).over(whole).cast("double").alias("lo"), F.max(value).over(whole).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0))
    return rows.groupBy(key, place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def normalised_survival(curves: DataFrame, interval: float) -> DataFrame:
    """(sample, minutes, pct), from an explicit percentage, else alive over total, else alive over the sample's peak; clamped to 0..100.

    curves(sample, t, n_alive, and pct_viable or n_total or null ones).
    """
    from_total = F.when(F.col("n_total") > 0, F.col("n_alive") * 100.0 / F.nullif("n_total", F.lit(0)))
    y = F.coalesce("pct_viable", from_total, F.col("n_alive").cast("double"), F.lit(0.0))
    explicit = F.col("pct_viable").isNotNull() | F.coalesce(F.col("n_total") > 0, F.lit(False))
    whole = Window.partitionBy("sample")
    rows = curves.select("sample", "t", y.alias("y"), F.max(explicit).over(whole).alias("explicit"))
    peak = F.max("y").over(whole)
    pct = F.when(F.col("explicit"), F.col("y")).when(peak > 0, F.col("y") * 100.0 / F.nullif(peak, F.lit(0.0))).otherwise(F.lit(100.0))
    return rows.select("sample", (F.col("t") * interval).alias("minutes"), F.greatest(F.least(pct, F.lit(100.0)), F.lit(0.0)).alias("pct"))


def ordered_traces(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of a sample together, in order of the keys within it."""
    return rows.repartition("sample").sortWithinPartitions("sample", *keys)
