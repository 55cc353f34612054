"""Exact quantiles of whole tables by narrowing value ranges: no task and no driver ever holds more than one small range's values."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a count tells apart, and values that are sorted at the end.
RANGES, SORTED = 1024, 1024


def magnitude(x: Column) -> Column:
    """A whole number that rises with x: its sign and power of two."""
    power = F.floor(F.log2(F.abs(x))) + 1100
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x).cast("long") * power)


@dataclass
class Search:
    """Where the value of a rank is looked for: among the `count` values from low to high, the first of which has rank `before`."""

    rank: int
    share: float
    low: float = -math.inf
    high: float = math.inf
    before: int = 0
    count: int = 0
    here: float | None = None
    next: float | None = None

    @property
    def found(self) -> bool:
        return self.here is not None and (self.share == 0 or self.next is not None)

    def narrow(self, ranges: list[tuple[float, float, int]]) -> None:
        """Goes on with the range that holds the rank; ranges are (low, high, count) in their order and cover what was there."""
        before = self.before
        for k, (low, high, count) in enumerate(ranges):
            if self.here is None and self.rank < before + count:
                self.low, self.high, self.before, self.count = low, high, before, count
                if self.rank + 1 >= before + count and k + 1 < len(ranges):
                    self.next = ranges[k + 1][0]
                if low == high:
                    self.here = low
                    self.next = low if self.rank + 1 < before + count else self.next
                return
            before += count

    @property
    def value(self) -> float:
        return self.here if self.share == 0 else (1 - self.share) * self.here + self.share * self.next


def exact_quantiles(values: DataFrame, wanted: dict[str, float]) -> dict[str, tuple[float | None, int]]:
    """A1 over a table: (quantile, number of values) for each wanted name of values(name, x), linearly interpolated between the two nearest ranks; None without values.

    x is finite or null, null is left out. The first pass counts by sign and
    power of two, each later one by RANGES equal parts of the range that holds
    the rank, until that holds one value or at most SORTED ones, which are
    fetched. What comes to the driver is bounded by RANGES rows a name.
    """
    x = F.col("x")
    rows = values.where(x.isNotNull() & F.col("name").isin(list(wanted)))

    def ranges(part: DataFrame, by: Column) -> dict[str, list[tuple[float, float, int]]]:
        out: dict[str, list[tuple[float, float, int]]] = {}
        counted = part.groupBy("name", by.alias("by")).agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("n"))
        for r in sorted(counted.collect(), key=lambda r: r.by):
            out.setdefault(r.name, []).append((r.low, r.high, r.n))
        return out

    searches: dict[str, Search] = {}
    counts = dict.fromkeys(wanted, 0)
    for name, found in ranges(rows, magnitude(x)).items():
        counts[name] = sum(n for _, _, n in found)
        place = (counts[name] - 1) * min(max(wanted[name], 0.0), 1.0)
        searches[name] = Search(math.floor(place), place - math.floor(place))
        searches[name].narrow(found)
    while still := {n: s for n, s in searches.items() if not s.found}:
        inside, part = F.lit(False), F.lit(None).cast("long")
        for name, s in still.items():
            mine = F.col("name") == name
            inside |= mine & x.between(s.low, s.high)
            small = F.lit(s.count <= SORTED)
            part = F.when(mine, F.when(small, F.lit(None).cast("long")).otherwise(F.floor((x - s.low) / (s.high - s.low) * RANGES).cast("long"))).otherwise(part)
        few = [n for n, s in still.items() if s.count <= SORTED]
        if few:
            for r in rows.where(inside & F.col("name").isin(few)).groupBy("name").agg(F.sort_array(F.collect_list("x")).alias("xs")).collect():
                s = still[r.name]
                s.here = r.xs[s.rank - s.before]
                s.next = r.xs[s.rank - s.before + 1] if s.rank - s.before + 1 < len(r.xs) else s.next
        if len(few) < len(still):
            for name, found in ranges(rows.where(inside & ~F.col("name").isin(few)), part).items():
                still[name].narrow(found)
    return {n: (searches[n].value if n in searches else None, counts[n]) for n in wanted}
