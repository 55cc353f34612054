"""Calls from frame-wise classifier labels: cleaning, death times, kill curve.

A label is true for alive. Here a death time is the last alive frame, 0 where
there is none or where only the first frame is alive.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ("pos", "sample", "crop")
#: Share of alive labels up to a death time (fixed value).
ALIVE_SHARE = 0.8


def clean_monotone(predictions: DataFrame, *order: str) -> DataFrame:
    """After a crop's first dead label every later label is dead. `order` breaks ties of t, as the source's row order does."""
    so_far = Window.partitionBy(*KEY).orderBy("t", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return predictions.withColumn("label", F.min("label").over(so_far))


def death_times(cleaned: DataFrame) -> DataFrame:
    """(pos, sample, crop, death_time) by the longest span from the first frame in which 0.8 of the labels are alive.

    The span is a range of frame numbers, so rows with the same t count
    together; one shuffle serves the window and the aggregate.
    """
    span = Window.partitionBy(*KEY).orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = cleaned.withColumn("share", F.avg(F.col("label").cast("int")).over(span))
    alive = F.col("label")
    end = F.coalesce(F.max(F.when(alive & (F.col("share") >= ALIVE_SHARE), F.col("t"))), F.min(F.when(alive, F.col("t"))))
    one = rows.groupBy(*KEY).agg(end.alias("end"), F.min("t").alias("begin"))
    return one.select(*KEY, F.when(F.col("end").isNull() | (F.col("end") == F.col("begin")), F.lit(0)).otherwise(F.col("end")).cast("int").alias("death_time"))


def kill_curve(deaths: DataFrame) -> DataFrame:
    """(sample, t, n_alive) for t from 0 to a sample's last death time, over crops that die after frame 0.

    Deaths are counted per time first; the curve is the total less a running
    sum, so its cost follows the number of frames, not of crops.
    """
    counts = deaths.where("death_time > 0").groupBy("sample", "death_time").agg(F.count("*").alias("n"))
    ends = counts.groupBy("sample").agg(F.max("death_time").alias("last"), F.sum("n").alias("total"))
    grid = ends.select("sample", "total", F.explode(F.sequence(F.lit(0), "last")).alias("t"))
    before = Window.partitionBy("sample").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    hit = grid.join(counts.withColumnRenamed("death_time", "t"), ["sample", "t"], "left")
    return hit.select("sample", "t", (F.col("total") - F.coalesce(F.sum(F.coalesce("n", F.lit(0))).over(before), F.lit(0))).alias("n_alive"))
