"""Joins between measurements and the sample mapping, and join-shaped checks.

mapping(sample_idx, name, positions, signal, segmentation) is one row per
sample of an assay. Its exploded forms grow with the assay, not with the data,
and are left to the optimizer's size check; nothing is force-broadcast here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import safe_name
from ..shared import numbered


def _checked(rows: DataFrame, count: Column, none: str, many: str, key: Column) -> DataFrame:
    """rows, with an error naming the key where count is not one."""
    text = F.concat(F.when(count == 0, F.lit(none)).otherwise(F.lit(many)), F.lit(": "), key)
    ok = F.when(count == 1, F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))
    return rows.where(ok)


def trace_owners(traces: DataFrame, mapping: DataFrame) -> DataFrame:
    """Traces with sample_idx and name of the one sample that has their position and signal channel; none or several are errors."""
    owned = mapping.select("sample_idx", "name", F.explode("positions").alias("pos"), "signal").withColumn("channel", F.explode("signal")).drop("signal")
    owned = owned.groupBy("pos", "channel").agg(F.countDistinct("sample_idx").alias("owners"), F.min("sample_idx").alias("sample_idx"), F.min_by("name", "sample_idx").alias("name"))
    rows = traces.join(owned, ["pos", "channel"], "left")
    key = F.format_string("Pos%d/ch%d", "pos", "channel")
    return _checked(rows, F.coalesce("owners", F.lit(0)), "no sample for", "Ambiguous sample for", key).drop("owners")


def position_owner(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with the one sample that has their position; none or several are errors."""
    owned = mapping.select("sample_idx", "name", F.explode("positions").alias("pos")).groupBy("pos").agg(F.countDistinct("sample_idx").alias("owners"), F.min("sample_idx").alias("sample_idx"), F.min_by("name", "sample_idx").alias("name"))
    joined = rows.join(owned, "pos", "left")
    return _checked(joined, F.coalesce("owners", F.lit(0)), "no sample for", "several samples for", F.format_string("Pos%d", "pos")).drop("owners")


def first_owner(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with the first sample in assay order that has their position; others are dropped."""
    owned = mapping.select("sample_idx", "name", F.explode("positions").alias("pos")).groupBy("pos").agg(F.min("sample_idx").alias("sample_idx"), F.min_by("name", "sample_idx").alias("name"))
    return rows.join(owned, "pos")


def position_channels(mapping: DataFrame) -> DataFrame:
    """Distinct signal channels of each position over all samples that have it."""
    return mapping.select(F.explode("positions").alias("pos"), "signal").select("pos", F.explode("signal").alias("channel")).dropDuplicates(["pos", "channel"])


def ordered_positions(mapping: DataFrame) -> DataFrame:
    """(pos, place) of distinct positions in assay order, by where each comes first."""
    rows = mapping.select("sample_idx", F.posexplode("positions").alias("at", "pos"))
    first = rows.groupBy("pos").agg(F.min(F.struct("sample_idx", "at")).alias("first"))
    return numbered(first, [F.col("first")], name="place").select("pos", (F.col("place") + 1).cast("int").alias("place"))


def by_sample_name(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows with the index of the first sample of their name; rows of unknown names are dropped."""
    names = mapping.groupBy(F.col("name").alias("sample")).agg(F.min("sample_idx").alias("sample_idx"))
    return rows.join(names, "sample")


def overlapping_groups(rows: DataFrame, group: str = "group", split: str = "split") -> DataFrame:
    """Groups that occur in the reference and the evaluation split; must be empty."""
    reference = rows.where(F.col(split) == "reference").select(group).distinct()
    return rows.where(F.col(split) == "evaluation").select(group).distinct().join(reference, group, "left_semi")


def neighbour_ids(neighbours: DataFrame, references: DataFrame) -> DataFrame:
    """neighbours(ref_idx, ...) with the reference's id in place of its index."""
    return neighbours.join(references.select("ref_idx", F.col("id").alias("ref_id")), "ref_idx").drop("ref_idx")


def with_labels(rois: DataFrame, labels: DataFrame) -> DataFrame:
    """Every ROI with its death frame, null where it has no label."""
    return rois.join(labels.select("position", "roi_id", "death_frame"), ["position", "roi_id"], "left")


def label_errors(predictions: DataFrame, truth: DataFrame, positive: str) -> DataFrame:
    """Predictions with their label and whether they are false positives or false negatives for `positive`."""
    rows = predictions.join(truth.select("id", "group", "label"), "id")
    wrong = F.col("prediction") != F.col("label")
    return rows.select("id", "group", "label", "prediction", (wrong & (F.col("prediction") == positive)).alias("false_positive"), (wrong & (F.col("label") == positive)).alias("false_negative"))


def sample_folders(mapping: DataFrame) -> DataFrame:
    """(sample_idx, name, folder); samples whose folder names are equal get their index in front."""
    named = mapping.select("sample_idx", "name", safe_name("name").alias("base"))
    twice = F.count("*").over(Window.partitionBy("base")) > 1
    return named.select("sample_idx", "name", F.when(twice, F.concat(F.col("sample_idx").cast("string"), F.lit("_"), F.col("base"))).otherwise(F.col("base")).alias("folder"))
