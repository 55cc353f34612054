"""Explicit schemas of every dataset, as DDL that Spark reads without a session, and the check that replaces missing-column errors."""

from __future__ import annotations

from pyspark.sql import DataFrame

FLUORESCENCE = "roi int, t int, area int, background double, sum double, corrected double"
REPORTER_VIABILITY = "roi int, dead boolean, death_time int, death_minutes double, baseline double, peak double, snr double"
#: death_time is the first dead frame.
REPORTER_DEATH_TIMES = "pos int, roi int, sample string, dead boolean, death_time int, death_minutes double, baseline double, peak double, snr double"
#: death_time is the last alive frame.
CLASSIFIER_DEATH_TIMES = "crop int, death_time int, pos int, sample string"
REPORTER_KILL_CURVE = "sample string, t int, minutes double, n_total long, n_alive long, n_dead long, pct_viable double, pct_dead double"
CLASSIFIER_KILL_CURVE = "t int, n_alive long, sample string"
ENGAGEMENT = "roi int, t int, minutes double, tumor_cells int, t_cells int, engagements int"
ENGAGEMENT_SUMMARY = "roi int, frames long, engagements_mean double, tumor_cells_mean double, t_cells_mean double"
TRACE = "roi int, t int, p_dead double"
PREDICTIONS = "t int, crop int, p_dead double, label boolean, pos int, sample string"
PREDICTIONS_RAW = "t string, crop string, p_dead string, label string, pos string, sample string"
PREDICTIONS_CLEANED = "t int, crop int, label boolean, pos int, sample string"
MANUAL_LABELS = "position string, roi_id int, death_frame int, labeled_at string"
PLANES = "pos int, roi int, stack_t int, t int, channel int, z int, height int, width int, pixels array<double>"
POSITION_INDEX = (
    "position int, axisOrder string, channelCount int, timeCount int, zCount int, timeIndices array<int>, "
    "rois array<struct<roi: int, fileName: string, bbox: struct<roi: int, x: int, y: int, w: int, h: int>, shape: array<int>>>"
)
ASSAY = (
    "interval struct<value: double, unit: string>, analysis struct<channels: struct<signal: array<int>, segmentation: int>>, "
    "samples array<struct<name: string, positions: string>>"
)
MAPPING = "sample_idx int, name string, positions array<int>, signal array<int>, segmentation int"
EMBEDDING_MANIFEST = "id string, group string, split string, label string, label_source string, frame int, channel int, z int, vector array<double>"
MANIFEST_SAMPLES = "position string, roi_id int, frame int, label int, split string"
INFERENCE = (
    "position string, roi_id int, frame_count int, death_time_toto int, death_time_viability int, "
    "toto_raw array<float>, toto_alive array<float>, death_probability array<float>"
)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """df, or an error that names the required columns it lacks."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing column(s): {', '.join(missing)}")
    return df
