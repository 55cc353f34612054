"""Column expressions shared by the operators; all stay inside the JVM.

IDs in docstrings are the inventory's.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest finite double; threshold of an empty histogram.
MAX_DOUBLE = 1.7976931348623157e308
#: Consistency constant of the median absolute difference of neighbours (fixed value).
DIFF_MAD = 0.9539
#: Consistency constant of the median absolute deviation (fixed value).
MAD = 1.4826


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: str | Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    x = c(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def quantile(x: str | Column, q: float) -> Column:
    """A1: linear-interpolated quantile of finite values, 0.0 for none, q clamped to [0, 1]."""
    x = c(x)
    return F.coalesce(F.percentile(F.when(finite(x), x.cast("double")), F.lit(min(max(q, 0.0), 1.0))), F.lit(0.0))


def is_alive(p_dead: str | Column) -> Column:
    """K1: alive below one half, strictly."""
    return c(p_dead) < 0.5


def dead_probability(absent: str | Column, present: str | Column) -> Column:
    """K2: softmax weight of the first of two logits, with the larger one taken off first."""
    a, b = c(absent).cast("double"), c(present).cast("double")
    top = F.greatest(a, b)
    return F.exp(a - top) / (F.exp(a - top) + F.exp(b - top))


def frame_label(frame: str | Column, death_frame: str | Column, frame_count: str | Column) -> Column:
    """K3: whether a cell is alive at a frame; a death frame at or past the end is a survivor."""
    return F.when(c(death_frame) >= c(frame_count), F.lit(True)).otherwise(c(frame) < c(death_frame))


def usable_label(label: str | Column) -> Column:
    """K4: a label that is neither missing, empty nor 'uncertain'."""
    return ~F.coalesce(c(label), F.lit("")).isin("", "uncertain")


def on_stride(frame: str | Column, stride: int) -> Column:
    """K5: frames at multiples of the stride."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    return c(frame) % stride == 0


def recode(value: str | Column, mapping: dict[str, str]) -> Column:
    """K6: value by an explicit map; a value outside it is an error."""
    table = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    found = F.try_element_at(table, c(value).cast("string"))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("unmapped label: "), F.coalesce(c(value).cast("string"), F.lit("null")))).cast("string"))


def roi_key(position: str | Column, roi: str | Column) -> Column:
    """K7: position/Roi key."""
    return F.concat_ws("/", c(position), F.concat(F.lit("Roi"), c(roi).cast("string")))


def image_id(pos: str | Column, roi: str | Column, frame: str | Column, channel: str | Column, z: str | Column) -> Column:
    """K7: identifier of one plane."""
    return F.format_string("Pos%d-Roi%d-t%d-c%d-z%d", c(pos), c(roi), c(frame), c(channel), c(z))


def minutes(t: str | Column, interval: float | str | Column, digits: int | None = None) -> Column:
    """K8: acquisition minutes, raw or to a number of digits."""
    value = c(t) * (F.lit(float(interval)) if isinstance(interval, (int, float)) else c(interval))
    return value if digits is None else F.round(value, digits)


def rendered(x: str | Column) -> Column:
    """K9: shortest text that reads back as the same double; `nan` for non-finite values, empty for null."""
    x = c(x).cast("double")
    whole = (x == F.rint(x)) & (F.abs(x) < 1e15)
    return F.when(x.isNull(), F.lit("")).when(~finite(x), F.lit("nan")).when(whole, F.try_cast(x, "decimal(20,0)").cast("string") if hasattr(F, "try_cast") else x.cast("decimal(20,0)").cast("string")).otherwise(x.cast("string"))


def safe_name(name: str | Column) -> Column:
    """A name fit for a folder: reserved, control and white characters become one underscore, trimmed; `sample` when nothing is left."""
    clean = F.regexp_replace(c(name), r"[<>:\"/\\|?*\p{Cntrl}\s]+", "_")
    clean = F.regexp_replace(clean, "_+", "_")
    clean = F.regexp_replace(clean, r"^[_. ]+|[_. ]+$", "")
    return F.when(F.length(clean) > 0, clean).otherwise(F.lit("sample"))


def parse_positions(text: str | Column) -> Column:
    """S20: '1,3:5,10:20:2' as positions, ends included, the first of repeated ones kept; bad parts are errors."""

    def part(p: Column) -> Column:
        bits = F.split(F.trim(p), ":")
        first, last, step = F.get(bits, 0).cast("int"), F.coalesce(F.get(bits, 1), F.get(bits, 0)).cast("int"), F.coalesce(F.get(bits, 2), F.lit("1")).cast("int")
        bad = F.raise_error(F.concat(F.lit("bad position range: "), p)).cast("array<int>")
        return F.when((F.size(bits) > 3) | (step < 1) | (last < first), bad).otherwise(F.sequence(first, F.greatest(last, first), F.greatest(step, F.lit(1))))

    parts = F.filter(F.split(c(text), ","), lambda p: F.length(F.trim(p)) > 0)
    return F.array_distinct(F.flatten(F.transform(parts, part)))


def interval_minutes(value: str | Column, unit: str | Column) -> Column:
    """An interval in minutes; unknown units and values not above 0 are errors."""
    v = c(value).cast("double")
    factor = F.when(c(unit).isNull() | (c(unit) == "minute"), F.lit(1.0)).when(c(unit) == "second", F.lit(1.0 / 60.0)).when(c(unit) == "hour", F.lit(60.0))
    wrong = factor.isNull() | v.isNull() | (v <= 0) | ~finite(v)
    return F.when(wrong, F.raise_error(F.lit("interval must be a positive number of seconds, minutes or hours")).cast("double")).otherwise(v * factor)


def truthy(text: str | Column) -> Column:
    """True, 1 and yes in any case, with white space around."""
    return F.coalesce(F.lower(F.trim(c(text).cast("string"))).isin("true", "1", "yes"), F.lit(False))


def is_assay_kind(kind: str | Column) -> Column:
    """One of the two kinds of assay."""
    return F.coalesce(c(kind).isin("death-reporter", "label-free"), F.lit(False))


def plotted_death(dead: str | Column | None, death_time: str | Column) -> Column:
    """Deaths that figures show: flagged dead at a frame of 0 or more, or, without a flag, at a frame above 0."""
    if dead is None:
        return F.coalesce(c(death_time) > 0, F.lit(False))
    return F.coalesce((F.lower(c(dead).cast("string")) == "true") & (c(death_time) >= 0), F.lit(False))


def both_before(first: str | Column, second: str | Column, last: int = 200) -> Column:
    """Both death times at or before a frame."""
    return (c(first) <= last) & (c(second) <= last)


def trace_color(channel: str | Column) -> Column:
    """Plot colour by fluorophore name."""
    low = F.lower(F.coalesce(c(channel), F.lit("")))
    return F.when(low.contains("gfp"), "green").when(low.contains("mcherry"), "red").when(low.contains("yfp"), "yellow").when(low.contains("bfp"), "blue").otherwise("gray")


def unit_vector(vector: str | Column) -> Column:
    """V1: a double vector of length one; empty, non-finite and zero vectors are errors."""
    v = c(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    bad = (F.size(v) < 1) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | (norm == 0)
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("vectors must be non-empty, finite and not zero")).cast("array<double>")).otherwise(F.transform(v, lambda x: x / norm))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(c(a), c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
