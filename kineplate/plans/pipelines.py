"""The assay's analyses end to end, as lazy DataFrames that pass from operator to operator without files.

Every function returns named tables; writing them is a separate call. Nothing
runs until a table is used, and tables that several others need can be
persisted by the caller.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import minutes
from ..operators import aggregates as A
from ..operators import changepoint as P
from ..operators import classifier as K
from ..operators import frames as I
from ..operators import joins as J
from ..operators import reporter as R
from ..operators.scoring import Scorer, score_planes


def death_reporter(planes: DataFrame, mapping: DataFrame, interval: float) -> dict[str, DataFrame]:
    """Signal planes to fluorescence, traces per sample, death calls, survival curves and figure tables.

    The calls pool a calibration over the whole workspace: one row, joined to
    every series; all else is parallel over cells.
    """
    fluorescence = A.fluorescence(planes, J.position_channels(mapping))
    traces = J.trace_owners(fluorescence, mapping)
    first = mapping.select("sample_idx", "name", F.explode("positions").alias("pos"), F.get("signal", F.lit(0)).alias("channel"))
    rows = fluorescence.join(first, ["pos", "channel"])
    series = R.load_series(rows.withColumn("file_order", F.col("t")))
    calls = R.viability_calls(series)
    named = calls.join(mapping.select("sample_idx", F.col("name").alias("sample")), "sample_idx")
    deaths = named.select("pos", "roi", "sample", "dead", F.col("death_frame").alias("death_time"), minutes("death_frame", interval).alias("death_minutes"), "baseline", "peak", "snr")
    curve = R.survival_curve(series, calls, interval).join(mapping.select("sample_idx", F.col("name").alias("sample")), "sample_idx").drop("sample_idx")
    return {
        "fluorescence": fluorescence,
        "traces": traces,
        "reporter_death_times": deaths,
        "reporter_kill_curve": curve,
        "summary_curve": A.summary_curve(traces.withColumnRenamed("name", "sample"), interval),
        "survival_figure": A.normalised_survival(curve.select("sample", "t", "n_alive", "n_total", "pct_viable"), interval),
        "death_histogram": A.death_histogram(deaths.where("dead")),
    }


def engagement(planes: DataFrame, mapping: DataFrame, interval: float) -> dict[str, DataFrame]:
    """Contacts of engagers and tumour cells per frame and their means per cell; every position needs exactly one sample."""
    shared = mapping.select(F.get("signal", F.lit(0)).alias("signal"), "segmentation").distinct().limit(2).collect()
    if len(shared) != 1:
        raise ValueError("samples of an assay share their channels")
    rows = I.position_engagement(planes, shared[0].signal, shared[0].segmentation, interval)
    owned = J.position_owner(rows, mapping)
    return {"engagement": owned, "engagement_summary": J.first_owner(A.engagement_summary(rows), mapping)}


def label_free(predictions: DataFrame) -> dict[str, DataFrame]:
    """Classifier labels to cleaned labels, death times and kill curves; death times are last alive frames."""
    cleaned = K.clean_monotone(predictions)
    deaths = K.death_times(cleaned)
    return {"predictions_cleaned": cleaned, "classifier_death_times": deaths, "classifier_kill_curve": K.kill_curve(deaths)}


def predict(planes: DataFrame, scorer: Scorer, prepare, names: DataFrame, channel: int, batch: int = 32) -> dict[str, DataFrame]:  # noqa: ANN001
    """Planes of one channel through a model to label_free(); names(pos, sample)."""
    scored = score_planes(planes.where((F.col("channel") == channel) & (F.col("z") == 0)), scorer, prepare, batch)
    rows = scored.join(names, "pos").select("t", F.col("roi").alias("crop"), "p_dead", "label", "pos", "sample")
    return {"predictions": rows} | label_free(rows)


def infer_cells(traces: DataFrame, probabilities: DataFrame) -> DataFrame:
    """One row per cell: death frames by stain and by probability, with the three traces as arrays.

    traces(pos, roi, t, v), probabilities(pos, roi, t, p).
    """
    keys = ["pos", "roi"]
    residual = P.residual(traces, ["pos"])
    stain = P.death_from_intensity(residual, keys).withColumnRenamed("death_time", "death_time_toto")
    model = P.death_from_probability(probabilities, keys).select(*keys, F.col("death_time").alias("death_time_viability"))

    def packed(df: DataFrame, column: str, name: str) -> DataFrame:
        rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("t", F.col(column).cast("float").alias("x")))).alias("s"))
        return rows.select(*keys, F.transform("s", lambda p: p.x).alias(name))

    out = stain.join(model, keys)
    for part in (packed(traces, "v", "toto_raw"), packed(P.alive_signal(traces, keys), "alive", "toto_alive"), packed(probabilities, "p", "death_probability")):
        out = out.join(part, keys)
    return out


def movie_viability(supports: DataFrame, history: int = 1) -> dict[str, DataFrame]:
    """Viable supports(roi, t, s) of sampled frames to smoothed supports and one switch per movie."""
    smooth = P.smooth(supports, ["roi"], history)
    return {"supports": smooth, "fit": P.step_fit(smooth, ["roi"], "smoothed")}
