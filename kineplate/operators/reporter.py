"""Death calls from a fluorescent reporter: series, calibration, sustained steps, survival curve.

Series are keyed by (sample_idx, pos, roi): a position under two samples counts
in both. Here a death frame is the first dead frame.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DIFF_MAD, finite, quantile
from ..shared import stored
from .running import each_series, medians_before, squares_before
from .selection import exact_quantiles

KEY = ("sample_idx", "pos", "roi")
#: Fixed values of the caller.
EARLY, SUSTAIN, SIGMAS, SHARE, SUSTAIN_SHARE, FLOOR = 3, 3, 6.0, 0.5, 0.8, 10.0


def load_series(rows: DataFrame, value: str = "corrected", order: str = "file_order") -> DataFrame:
    """(sample_idx, pos, roi, t, v): finite values, the first row of each frame; unreadable rows are skipped."""
    v = F.expr(f"try_cast(`{value}` AS double)")
    t = F.expr("try_cast(try_cast(t AS double) AS int)")
    parsed = rows.select(*KEY, t.alias("t"), v.alias("v"), F.col(order).alias("o")).where(F.col("t").isNotNull() & finite("v"))
    first = Window.partitionBy(*KEY, "t").orderBy("o")
    return parsed.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn", "o")


def diff_mad(diff: str = "d") -> Column:
    """Noise from absolute neighbour differences; 0 where there are none."""
    return quantile(F.abs(F.col(diff)), 0.5) / DIFF_MAD


def _numbered(series: DataFrame) -> DataFrame:
    by_t = Window.partitionBy(*KEY).orderBy("t")
    return series.withColumn("rn", F.row_number().over(by_t)).withColumn("d", F.abs(F.col("v") - F.lag("v").over(by_t)))


def roi_stats(series: DataFrame) -> DataFrame:
    """Early median, noise, peak and length of every series."""
    return _numbered(series).groupBy(*KEY).agg(
        quantile(F.when(F.col("rn") <= EARLY, F.col("v")), 0.5).alias("early"),
        diff_mad().alias("sigma"),
        F.max("v").alias("peak"),
        F.count("*").alias("n"),
        quantile("v", 0.5).alias("median"),
        F.min("t").alias("t0"),
    )


def calibration(stats: DataFrame) -> DataFrame:
    """One row (base, noise, min_step, series) pooled over the workspace; empty when there is no series.

    Runs jobs at once: the pooled quantiles are found by narrowing ranges.
    """
    each = stats.select(F.explode(F.array(F.struct(F.lit("early").alias("name"), F.col("early").alias("x")), F.struct(F.lit("sigma").alias("name"), F.when(F.col("sigma") > 1e-9, F.col("sigma")).alias("x")))).alias("e")).select("e.*")
    found = exact_quantiles(each, {"early": 0.25, "sigma": 0.5})
    (base, series), (typical, _) = found["early"], found["sigma"]
    if base is None:
        return stats.sparkSession.createDataFrame([], "base double, noise double, series long, min_step double")
    noise = typical if typical is not None else max(abs(base) * 0.05, 1.0)
    return stats.sparkSession.createDataFrame([(base, noise, series, max(SIGMAS * noise, abs(base) * SHARE, FLOOR))], "base double, noise double, series long, min_step double")


def best_step(v: np.ndarray, noise: float, min_step: float) -> tuple[int, float, float] | None:
    """(place, level before, size over noise) of the accepted step that leaves the smallest squared deviations on both sides."""
    n = len(v)
    if n < 2:
        return None
    pre, post = medians_before(v)[1:n], medians_before(v[::-1])[n - 1 : 0 : -1]
    mad = medians_before(np.abs(np.diff(v))) / DIFF_MAD
    least = np.maximum(np.maximum(min_step, SIGMAS * mad[-1]), SHARE * np.abs(pre))
    whole = np.median(np.lib.stride_tricks.sliding_window_view(v, SUSTAIN), 1)[1:] if n >= SUSTAIN else v[:0]
    held = np.r_[whole, [np.median(v[k:]) for k in range(max(n - SUSTAIN + 1, 1), n)]]  # windows at the end are shorter
    good = np.flatnonzero((post - pre >= least) & (held - pre >= SUSTAIN_SHARE * least))
    if not len(good):
        return None
    apart = squares_before(v)[1:n] + squares_before(v[::-1])[n - 1 : 0 : -1]
    k = good[np.argmin(apart[good])]  # the first of equal ones
    return int(k + 1), float(pre[k]), float(max((post[k] - pre[k]) / max(mad[k] if k else 0.0, noise, 1.0), 0.0))


def sustained_steps(series: DataFrame, pooled: DataFrame) -> DataFrame:
    """The best accepted step of every series that has one: its frame, level before, and size over the noise before. n log n a series."""

    def run(rows: pa.Table) -> pa.RecordBatch | None:
        found = best_step(rows.column("v").to_numpy(), rows.column("noise")[0].as_py(), rows.column("min_step")[0].as_py())
        if found is None:
            return None
        keys = [rows.column(k).slice(0, 1).combine_chunks() for k in KEY]
        made = [rows.column("t").slice(found[0], 1).combine_chunks(), pa.array([found[1]]), pa.array([found[2]])]
        return pa.RecordBatch.from_arrays([*keys, *made], [*KEY, "step_frame", "step_base", "step_snr"])

    rows = series.select(*KEY, "t", F.col("v").cast("double").alias("v")).join(F.broadcast(pooled.select("noise", "min_step")))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in series.select(*KEY, F.col("t").alias("step_frame")).schema]
    return each_series(rows, list(KEY), ["t"], run, ", ".join([*kinds, "step_base double", "step_snr double"]))


def viability_calls(series: DataFrame) -> DataFrame:
    """(sample_idx, pos, roi, dead, death_frame, baseline, peak, snr) for every series."""
    stats = stored(roi_stats(series))
    pooled = calibration(stats)
    rows = stats.join(F.broadcast(pooled)).join(sustained_steps(series, pooled), list(KEY), "left")
    stepped = F.col("step_frame").isNotNull()
    over = F.col("median") - F.col("base")
    twice = 2 * F.col("min_step")
    started = ~stepped & (F.col("series") >= 4) & (F.col("n") >= 3) & (F.col("early") >= F.col("base") + twice) & (over >= twice)
    noise = F.greatest("sigma", "noise", F.lit(1.0))
    alive_snr = F.when(F.col("n") < 2, F.lit(0.0)).otherwise(F.greatest((F.col("peak") - F.col("early")) / noise, F.lit(0.0)))
    return rows.select(
        *KEY,
        (stepped | started).alias("dead"),
        F.when(stepped, F.col("step_frame")).when(started, F.col("t0")).alias("death_frame"),
        F.when(stepped, F.col("step_base")).when(started, F.col("base")).otherwise(F.col("early")).alias("baseline"),
        "peak",
        F.when(stepped, F.col("step_snr")).when(started, F.greatest(over / noise, F.lit(0.0))).otherwise(alive_snr).alias("snr"),
    )


def survival_curve(series: DataFrame, calls: DataFrame, interval: float) -> DataFrame:
    """Per sample and observed frame the numbers alive and dead.

    The join of every frame with every earlier death is a running sum over
    deaths counted per frame.
    """
    frames = series.select("sample_idx", "t").distinct().withColumn("n", F.lit(0).cast("long"))
    # the calls are read once: survivors are counted under a null frame
    counts = calls.groupBy("sample_idx", F.when(F.col("dead"), F.col("death_frame")).alias("t")).agg(F.count("*").alias("n"))
    events = frames.unionByName(counts).groupBy("sample_idx", "t").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy("sample_idx")
    so_far = whole.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    rows = events.withColumn("n_total", F.sum("n").over(whole)).withColumn("n_dead", F.sum(F.when(F.col("t").isNotNull(), F.col("n")).otherwise(0)).over(so_far)).where("t is not null")
    alive = F.col("n_total") - F.col("n_dead")
    pct = alive * 100.0 / F.col("n_total")
    return rows.select("sample_idx", "t", (F.col("t") * F.lit(float(interval))).alias("minutes"), "n_total", alive.alias("n_alive"), "n_dead", pct.alias("pct_viable"), (100.0 - pct).alias("pct_dead"))
