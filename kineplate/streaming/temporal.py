"""Temporal features of movies on a stream of frame embeddings.

A stream brings rows (group, frame, id, vector) of many movies; frames of a movie
arrive in order of time across micro-batches and are sorted within one. Each row
is answered once, with the feature that the batch operators give it:
`vectors.trailing_mean` and `vectors.baseline_delta`. What a movie keeps is a
list of its last unit vectors, or its first one, and the number of its last
frame; a timer drops it when the movie has been idle for a while. A movie that
comes back after that starts anew. Frames at or before the last one, repeated
ones included, are left out: their answer is out already.

Bad vectors (empty, of another length, non-finite, zero) are errors, as in the
batch operators; null groups are a movie, null frames an error. Needs the
session settings of `settings()`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.vectors import trailing_means

ROWS = "group string, frame long, id string, vector array<double>"
#: Milliseconds without a frame after which a movie's state goes.
IDLE = 6 * 3_600_000


def settings() -> dict[str, str]:
    """Session settings that these operators need. Without the second one Spark runs empty batches for the timers without end, also where a query is to end with what is available; with it, timers run out with the next batch of data."""
    return {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def units(vectors: pd.Series) -> np.ndarray:
    rows = [np.asarray(v, np.float64) for v in vectors]
    if len({len(v) for v in rows}) != 1 or not len(rows[0]):
        raise ValueError("vectors must be non-empty, finite and not zero")
    x = np.stack(rows)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    if not np.isfinite(x).all() or not (length > 0).all():
        raise ValueError("vectors must be non-empty, finite and not zero")
    return x / length


class Movie(StatefulProcessor):
    """What both features share: order, late frames and the timer."""

    def __init__(self, idle: int):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "frame long")
        self.open(handle)

    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def features(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def forget(self) -> None:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows)).sort_values("frame", kind="stable")
        if table.frame.isna().any():
            raise ValueError("frames must have a number")
        last = self.last.get()[0] if self.last.exists() else None
        table = table.drop_duplicates("frame")
        if last is not None:
            table = table[table.frame > last]
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if len(table):
            made = self.features(units(table.vector))
            self.last.update((int(table.frame.iloc[-1]),))
            yield table[["group", "frame", "id"]].assign(vector=list(made))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.last.clear()
        self.forget()
        yield from ()


class Trailing(Movie):
    """The state holds up to window - 1 unit vectors."""

    def __init__(self, window: int, idle: int):
        super().__init__(idle)
        self.window = window

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "vector array<double>")

    def features(self, x: np.ndarray) -> np.ndarray:
        past = [np.asarray(v[0], np.float64) for v in self.past.get()] if self.past.exists() else []
        held = np.stack(past) if past else np.zeros((0, x.shape[1]))
        if held.shape[1] != x.shape[1]:
            raise ValueError("vectors of a movie must be of one length")
        made = trailing_means(x, self.window, held)
        both = np.concatenate([held, x])
        if self.window > 1:
            self.past.put([(v.tolist(),) for v in both[max(len(both) - self.window + 1, 0) :]])
        return made

    def forget(self) -> None:
        self.past.clear()


class Baseline(Movie):
    """The state holds the first unit vector."""

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "vector array<double>")

    def features(self, x: np.ndarray) -> np.ndarray:
        if not self.first.exists():
            self.first.update((x[0].tolist(),))
        first = np.asarray(self.first.get()[0], np.float64)
        if len(first) != x.shape[1]:
            raise ValueError("vectors of a movie must be of one length")
        both = np.concatenate([x, x - first], 1)
        return both / np.sqrt((both * both).sum(1, keepdims=True))

    def forget(self) -> None:
        self.first.clear()


def _run(rows: DataFrame, processor: Movie) -> DataFrame:
    typed = rows.selectExpr("CAST(`group` AS string) AS `group`", "CAST(frame AS long) AS frame", "CAST(id AS string) AS id", "CAST(vector AS array<double>) AS vector")
    return typed.groupBy("group").transformWithStateInPandas(processor, ROWS.replace("group string", "`group` string"), "append", "ProcessingTime")


def trailing_mean(rows: DataFrame, window: int = 3, idle: int = IDLE) -> DataFrame:
    """D22 on a stream: (group, frame, id, vector), vector being the unit vector of the mean of the movie's last `window` unit vectors."""
    if window < 1:
        raise ValueError("window must be at least 1")
    return _run(rows, Trailing(window, idle))


def baseline_delta(rows: DataFrame, idle: int = IDLE) -> DataFrame:
    """D23 on a stream: (group, frame, id, vector), vector being the unit vector of a unit vector followed by its difference from the movie's first one."""
    return _run(rows, Baseline(idle))
