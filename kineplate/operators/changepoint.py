"""Change points of intensity and probability traces.

Traces are long: key columns, t (0, 1, 2, ... within a key) and a value. Ties
of a best step go to the earliest frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the callers.
BASELINE_FRAMES, SUSTAINED, MIN_CONTRAST, MIN_RAW = 10, 3, 400_000.0, 500_000.0


def _w(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy("t")


def residual(traces: DataFrame, group: list[str], value: str = "v") -> DataFrame:
    """Value less the group's median at the same frame, by a window instead of a self-join."""
    middle = F.percentile(value, F.lit(0.5)).over(Window.partitionBy(*group, "t"))
    return traces.withColumn("group_median", middle).withColumn("residual", F.col(value) - F.col("group_median"))


def alive_signal(traces: DataFrame, keys: list[str], value: str = "v", baseline_frames: int = BASELINE_FRAMES) -> DataFrame:
    """One less the stain's share of the way from the early median to the peak."""
    whole = Window.partitionBy(*keys)
    base = F.percentile(F.when(F.col("t") < baseline_frames, F.col(value)), F.lit(0.5)).over(whole)
    span = F.greatest(F.max(value).over(whole) - base, F.lit(1.0))
    return traces.withColumn("alive", 1 - F.greatest(F.least((F.col(value) - base) / span, F.lit(1.0)), F.lit(0.0)))


def first_sustained(traces: DataFrame, keys: list[str], threshold: float, length: int, value: str = "v") -> DataFrame:
    """First frame of the first run of `length` values at or above a threshold, null where there is none."""
    ahead = _w(keys).rowsBetween(0, length - 1)
    held = (F.min(F.when(F.col(value) >= threshold, 1).otherwise(0)).over(ahead) == 1) & (F.count("*").over(ahead) == length)
    return traces.withColumn("held", held).groupBy(*keys).agg(F.min(F.when(F.col("held"), F.col("t"))).alias("start"))


def jump_gate(low: Column, high: Column, relative: float = 1.25, absolute: float = 300.0) -> Column:
    """Whether a range is wide enough, for values above 10 also by ratio."""
    wide = high - low >= absolute
    return F.coalesce(wide & F.when(low > 10, high / F.greatest(low, F.lit(1.0)) >= relative).otherwise(F.lit(True)), F.lit(False))


def _best(scored: DataFrame, keys: list[str], traces: DataFrame) -> DataFrame:
    """(keys, best_t, best_delta) of the largest delta; null and 0 for keys without a candidate."""
    pick = Window.partitionBy(*keys).orderBy(F.desc("delta"), "t")
    top = scored.withColumn("rank", F.row_number().over(pick)).where("rank = 1").select(*keys, F.col("t").alias("best_t"), F.col("delta").alias("best_delta"))
    return traces.select(*keys).distinct().join(top, keys, "left").withColumn("best_delta", F.coalesce("best_delta", F.lit(0.0)))


def best_local_step(traces: DataFrame, keys: list[str], window: int = 3, value: str = "v", pre: int | None = None, post: int | None = None, first: int | None = None, least: int | None = None) -> DataFrame:
    """Largest rise of the mean of the next `post` over that of the last `pre` values.

    D14 uses one window for both; D16 is pre 3, post 8, first frame 8.
    """
    pre, post = pre or window, post or window
    first = pre if first is None else first
    least = 2 * window + 1 if least is None else least
    w = _w(keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    delta = F.avg(value).over(w.rowsBetween(0, post - 1)) - F.avg(value).over(w.rowsBetween(-pre, -1))
    scored = traces.select(*keys, "t", n.alias("n"), delta.alias("delta")).where((F.col("n") >= least) & (F.col("t") >= first) & (F.col("t") < F.col("n") - post))
    return _best(scored, keys, traces)


def best_sustained_step(traces: DataFrame, keys: list[str], pre: int = 3, post: int = 8, first: int = 8, value: str = "v") -> DataFrame:
    """D16."""
    return best_local_step(traces, keys, value=value, pre=pre, post=post, first=first, least=first + post + 1)


def detrend(traces: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """Value less its least-squares line over t."""
    whole = Window.partitionBy(*keys)
    slope = F.coalesce(F.covar_pop("t", value).over(whole) / F.nullif(F.var_pop("t").over(whole), F.lit(0.0)), F.lit(0.0))
    return traces.withColumn("detrended", F.col(value) - F.avg(value).over(whole) - slope * (F.col("t") - F.avg("t").over(whole)))


def best_mean_step(traces: DataFrame, keys: list[str], min_seg: int = 3, value: str = "v") -> DataFrame:
    """Largest mean after less mean before, with `min_seg` values kept on either side."""
    w = _w(keys)
    n = F.count("*").over(Window.partitionBy(*keys))
    delta = F.avg(value).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    scored = traces.select(*keys, "t", n.alias("n"), delta.alias("delta")).where((F.col("n") >= 2 * min_seg) & (F.col("t") >= min_seg) & (F.col("t") < F.col("n") - min_seg))
    return _best(scored, keys, traces)


def death_from_intensity(traces: DataFrame, keys: list[str], contrast: str = "residual", raw: str = "v", min_contrast: float = MIN_CONTRAST, min_raw: float = MIN_RAW, absolute: float = 150.0, relative: float = 1.1, baseline_frames: int = BASELINE_FRAMES) -> DataFrame:
    """(keys, frame_count, death_time): first sustained rise of the detrended contrast that the raw trace shares; frame_count for survivors."""
    w, whole = _w(keys), Window.partitionBy(*keys)
    rows = detrend(traces, keys, contrast)
    post = SUSTAINED
    rise = F.avg("detrended").over(w.rowsBetween(0, post - 1)) - F.avg("detrended").over(w.rowsBetween(-SUSTAINED, -1))
    raw_rise = F.avg(raw).over(w.rowsBetween(0, post)) - F.avg(raw).over(w.rowsBetween(-SUSTAINED, -1))
    n = F.count("*").over(whole)
    gate = jump_gate(F.min("detrended").over(whole), F.max("detrended").over(whole), relative, absolute)
    rows = rows.select(*keys, "t", n.alias("n"), gate.alias("gate"), rise.alias("rise"), raw_rise.alias("raw_rise"))
    hit = F.col("gate") & (F.col("t") >= baseline_frames) & (F.col("t") < F.col("n") - post) & (F.col("rise") >= min_contrast) & (F.col("raw_rise") >= min_raw)
    one = rows.groupBy(*keys).agg(F.max("n").cast("int").alias("frame_count"), F.min(F.when(hit, F.col("t"))).alias("hit"))
    survives = F.col("hit").isNull() | (F.col("hit") >= F.col("frame_count") - 3)
    return one.select(*keys, "frame_count", F.when(survives, F.col("frame_count")).otherwise(F.col("hit")).cast("int").alias("death_time"))


def death_from_probability(traces: DataFrame, keys: list[str], value: str = "p", min_seg: int = SUSTAINED) -> DataFrame:
    """(keys, frame_count, death_time) by the best mean step of a death probability that really rises."""
    stats = traces.groupBy(*keys).agg(F.count("*").cast("int").alias("frame_count"), F.min(value).alias("low"), F.max(value).alias("high"))
    rows = stats.join(best_mean_step(traces, keys, min_seg, value), keys)
    real = (F.col("high") - F.col("low") >= 0.25) & (F.col("high") >= 0.35) & F.col("best_t").isNotNull() & (F.col("best_delta") >= 0.25) & (F.col("best_t") < F.col("frame_count") - 2)
    return rows.select(*keys, "frame_count", F.when(real, F.col("best_t")).otherwise(F.col("frame_count")).cast("int").alias("death_time"))


def step_fit(supports: DataFrame, keys: list[str], value: str = "s", frame: str = "t") -> DataFrame:
    """(keys, switch, first_dead_frame, state) of the best fit of ones followed by zeros.

    A boundary row past the last frame stands for the fit without a switch;
    losses within 1e-10 of the least are ties and the first one wins.
    """
    w = Window.partitionBy(*keys).orderBy(frame)
    rows = supports.select(*keys, F.col(frame).alias("t"), F.col(value).alias("s"), (F.row_number().over(w) - 1).alias("i"))
    end = rows.groupBy(*keys).agg(F.count("*").cast("int").alias("i")).select(*keys, F.lit(None).cast("int").alias("t"), F.lit(None).cast("double").alias("s"), "i")
    both = rows.select(*keys, F.col("t").cast("int").alias("t"), F.col("s").cast("double").alias("s"), "i").unionByName(end)
    by_i = Window.partitionBy(*keys).orderBy("i")
    alive = F.coalesce(F.sum((1 - F.col("s")) * (1 - F.col("s"))).over(by_i.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    dead = F.coalesce(F.sum(F.col("s") * F.col("s")).over(by_i.rowsBetween(0, Window.unboundedFollowing)), F.lit(0.0))
    loss = both.select(*keys, "i", "t", (alive + dead).alias("loss"))
    whole = Window.partitionBy(*keys)
    tied = loss.withColumn("least", F.min("loss").over(whole)).withColumn("last", F.max("i").over(whole)).where("abs(loss - least) <= 1e-10")
    one = tied.groupBy(*keys).agg(F.min(F.struct("i", "t", "last")).alias("x"))
    state = F.when(F.col("x.i") == 0, "always_dead").when(F.col("x.i") == F.col("x.last"), "always_viable").otherwise("transition")
    return one.select(*keys, F.col("x.i").alias("switch"), F.col("x.t").alias("first_dead_frame"), state.alias("state"))


def smooth(supports: DataFrame, keys: list[str], history: int, value: str = "s") -> DataFrame:
    """Mean of the last `history` supports, the current one included."""
    if history < 1:
        raise ValueError("history must be at least 1")
    return supports.withColumn("smoothed", F.avg(value).over(_w(keys).rowsBetween(1 - history, 0)))


def rise_interval(traces: DataFrame, deaths: DataFrame, keys: list[str], value: str = "v", pre_frames: int = 15, post_window: int = 12) -> DataFrame:
    """(keys, start, end) of the rise from 15 to 85 % around a death frame; keys without a rise are left out.

    deaths(keys, death_time, frame_count). One row per frame near the death is
    kept; the two scans are a maximum and a minimum over them.
    """
    near = traces.join(deaths.where("death_time < frame_count"), keys)
    low_start = F.greatest(F.lit(BASELINE_FRAMES), F.col("death_time") - pre_frames)
    near = near.withColumn("pre_start", F.when(low_start >= F.col("death_time"), F.greatest(F.lit(0), F.col("death_time") - 5)).otherwise(low_start))
    before = (F.col("t") >= F.col("pre_start")) & (F.col("t") < F.col("death_time"))
    after = (F.col("t") >= F.col("death_time")) & (F.col("t") < F.col("death_time") + post_window)
    whole = Window.partitionBy(*keys)
    near = near.where(before | after)
    near = near.withColumn("base", F.percentile(F.when(before, F.col(value)), F.lit(0.5)).over(whole)).withColumn("peak", F.max(F.when(after, F.col(value))).over(whole))
    near = near.where(F.col("peak") > F.col("base") + 1.0)
    span = F.col("peak") - F.col("base")
    one = near.groupBy(*keys, "death_time", "frame_count").agg(
        F.max(F.when(before & (F.col(value) < F.col("base") + 0.15 * span), F.col("t") + 1)).alias("from"),
        F.min(F.when(after & (F.col(value) >= F.col("base") + 0.85 * span), F.col("t"))).alias("to"),
    )
    start = F.coalesce("from", "death_time")
    end = F.coalesce("to", F.least(F.col("death_time") + 4, F.col("frame_count") - 1))
    return one.select(*keys, start.cast("int").alias("start"), F.greatest(end, start).cast("int").alias("end"))
