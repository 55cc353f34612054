"""Reproducible splits and samples: whole ROIs go to one side, frames never split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import frame_label, on_stride

#: Bits of a hash by which keys are counted before the last ones are ranked.
COUNTED_BITS = 16


def seeded(seed: int, *keys: str) -> Column:
    """A whole number below 2 ** 60 from a seed and keys, by sha256 of `seed:key:...`, so that others can draw the same sample."""
    text = F.concat_ws(":", F.lit(seed), *(F.col(k).cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def draw(keys: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n keys of distinct ones (all if there are fewer): those with the least seeded hashes, so larger draws hold smaller ones.

    Keys are counted by the first bits of their hashes; only those with the bits
    at which n is reached are ranked.
    """
    hashed = keys.select(key).distinct().withColumn("_h", seeded(seed, key)).withColumn("_b", F.shiftright("_h", 60 - COUNTED_BITS))
    upto = 0
    for b, count in sorted((r._b, r.n) for r in hashed.groupBy("_b").agg(F.count("*").alias("n")).collect()):  # at most 2 ** COUNTED_BITS rows
        if upto + count > n:
            last = hashed.where(F.col("_b") == b).withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))).where(F.col("_r") <= n - upto)
            return hashed.where(F.col("_b") < b).select(key).unionByName(last.select(key))
        upto += count
    return hashed.select(key)


def balanced_subset(references: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """V8: size // classes references of each class, by a seeded order of the ids, so that larger subsets hold smaller ones."""
    order = Window.partitionBy("label").orderBy(seeded(seed, "id"), "id")
    classes = references.select("label").distinct().count()
    return references.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size // max(classes, 1)).drop("_r")


def roi_split(frames: DataFrame, rois: int, frames_per_roi: int, seed: int = 42, share: float = 0.7) -> DataFrame:
    """V9: a seeded sample of ROIs, `share` of them (at least one, not all) for reference, and of frames within each."""
    chosen = draw(frames, "group", rois, seed)
    n = chosen.count()
    reference = draw(chosen, "group", max(1, min(n - 1, round(n * share))) if n > 1 else n, seed).withColumn("split", F.lit("reference"))
    table = chosen.join(reference, "group", "left").withColumn("split", F.coalesce("split", F.lit("evaluation")))
    drawn = Window.partitionBy("group").orderBy(seeded(seed, "group", "frame"), "frame")
    return frames.join(table, "group").withColumn("_r", F.row_number().over(drawn)).where(F.col("_r") <= frames_per_roi).drop("_r")


def import_labelled(frames: DataFrame, stride: int, recode: dict[int, str] | None = None) -> DataFrame:
    """Labelled frames on the stride, train as reference and val as evaluation; a group in two splits, repeated ids and unknown labels are errors."""
    leaks = frames.groupBy("group").agg(F.countDistinct("split").alias("n")).where("n > 1")
    if leaks.limit(1).count():
        raise ValueError("a group occurs in two splits")
    rows = frames.where(on_stride("frame", stride))
    if rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError("image ids must be unique")
    table = F.create_map(*(F.lit(x) for pair in (recode or {0: "dead", 1: "viable"}).items() for x in pair))
    label = F.coalesce(F.try_element_at(table, "label"), F.raise_error(F.lit("unmapped label")).cast("string"))
    split = F.when(F.col("split") == "train", "reference").when(F.col("split") == "val", "evaluation").otherwise(F.raise_error(F.lit("split must be train or val")).cast("string"))
    return rows.withColumn("label", label).withColumn("split", split)


def dataset_manifest(labels: DataFrame, counts: DataFrame, val_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """(position, roi_id, frame, label, split) of every frame of every labelled ROI; a seeded fifth of the cells, one at least, is for validation.

    labels(position, roi_id, death_frame), counts(position, roi_id, frame_count).
    """
    cells = labels.withColumn("cell", F.concat("position", F.lit("/Roi"), F.col("roi_id").cast("string")))
    n = cells.select("cell").distinct().count()
    if not n:
        raise ValueError("no labels found")
    val = draw(cells, "cell", max(1, int(round(n * val_fraction))), seed).withColumn("split", F.lit("val"))
    rows = cells.join(counts, ["position", "roi_id"]).join(val, "cell", "left").where("frame_count > 0").withColumn("split", F.coalesce("split", F.lit("train")))
    rows = rows.withColumn("frame", F.explode(F.sequence(F.lit(0), F.col("frame_count") - 1)))
    return rows.select("position", "roi_id", "frame", frame_label("frame", "death_frame", "frame_count").cast("int").alias("label"), "split")


def overview_frames(rois: DataFrame, count: int = 6) -> DataFrame:
    """ROIs with `review`, the sorted union of their sampled frames and `count` frames spread from first to last, rounded down.

    rois(..., frame_count, sampled array<int>).
    """
    last = F.col("frame_count") - 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * last / max(count - 1, 1)).cast("int"))
    return rois.withColumn("review", F.array_sort(F.array_distinct(F.concat("sampled", spread))))


def first_per_group_label(rows: DataFrame) -> DataFrame:
    """The first row, by frame and id, of every group and label."""
    order = Window.partitionBy("group", "label").orderBy("frame", "id")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")
