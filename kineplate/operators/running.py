"""Running statistics of ordered series, in one pass over sorted rows."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


#: Rows of an Arrow batch that is handed on.
BATCH = 4096


class RunningMedian:
    """Median of the values so far, by a heap of the smaller and one of the larger half; log n a value."""

    def __init__(self) -> None:
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, x: float) -> None:
        if self.low and x >= -self.low[0]:
            heapq.heappush(self.high, x)
        else:
            heapq.heappush(self.low, -x)
        if len(self.high) > len(self.low):
            heapq.heappush(self.low, -heapq.heappop(self.high))
        elif len(self.low) > len(self.high) + 1:
            heapq.heappush(self.high, -heapq.heappop(self.low))

    def value(self) -> float:
        """Mean of the two middle values where their number is even; NaN of none."""
        if not self.low:
            return float("nan")
        return -self.low[0] if len(self.low) > len(self.high) else 0.5 * -self.low[0] + 0.5 * self.high[0]


def medians_before(x: np.ndarray) -> np.ndarray:
    """For each place and the end the median of what comes before it; NaN at the first."""
    out, running = np.empty(len(x) + 1), RunningMedian()
    for k, v in enumerate(x.tolist()):
        out[k] = running.value()
        running.add(v)
    out[len(x)] = running.value()
    return out


def squares_before(x: np.ndarray) -> np.ndarray:
    """For each place and the end the squared deviations from their mean of what comes before it."""
    out, mean, squares = np.zeros(len(x) + 1), 0.0, 0.0
    for k, v in enumerate(x.tolist()):
        off = v - mean
        mean += off / (k + 1)
        squares += off * (v - mean)
        out[k + 1] = squares
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, where each key's rows begin and the end) of batches sorted by keys, no key's rows in two of them; null is a key of its own."""

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for k in keys:
            column = rows.column(k).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        same = all(batch.column(k)[-1] == held[0].column(k)[0] or not (batch.column(k)[-1].is_valid or held[0].column(k)[0].is_valid) for k in keys)
        if same:
            continue  # still one key's rows, to be put together once
        rows = pa.Table.from_batches(held)
        at = starts(rows)
        yield rows.slice(0, at[-1]), at
        held = rows.slice(at[-1]).combine_chunks().to_batches()
    if held:
        rows = pa.Table.from_batches(held)
        yield rows, np.r_[starts(rows), rows.num_rows]


def each_series(df: DataFrame, keys: list[str], order: list[str], run: Callable[[pa.Table], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """run over the rows of every key in order, one series after the other in each partition; a task holds one batch and one series."""

    def series(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[pa.RecordBatch] = []
        for rows, at in whole_groups(batches, keys):
            made += [found for a, b in zip(at[:-1], at[1:], strict=True) if (found := run(rows.slice(a, b - a))) is not None]
            if sum(m.num_rows for m in made) >= BATCH:
                yield from pa.Table.from_batches(made).combine_chunks().to_batches()
                made = []
        if made:
            yield from pa.Table.from_batches(made).combine_chunks().to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(series, schema)
