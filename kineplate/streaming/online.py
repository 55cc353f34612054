"""Operators that may run while a movie is taken: death latch and causal smoothing.

Both look at a cell's past only. A stream must bring the frames of a cell in
order of time across micro-batches; within a batch they are sorted. Frames at
or before one already seen are answered by the state as it is, since what was
sent out cannot be taken back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATCH = "pos int, sample string, crop long, t int, label boolean"


def latch(predictions: DataFrame) -> DataFrame:
    """D1 on a stream of predictions(pos, sample, crop, t, label): alive labels after a dead one become dead. The state is one number per crop."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dead_from = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        dead = rows.t[~rows.label.astype(bool)]
        if len(dead):
            dead_from = int(dead.min()) if dead_from is None else min(dead_from, int(dead.min()))
        if dead_from is not None:
            state.update((dead_from,))
            rows["label"] = rows.label.astype(bool) & (rows.t < dead_from)
        yield rows[["pos", "sample", "crop", "t", "label"]]

    rows = predictions.selectExpr("CAST(pos AS int) AS pos", "sample", "CAST(crop AS long) AS crop", "CAST(t AS int) AS t", "label")
    return rows.groupBy("pos", "sample", "crop").applyInPandasWithState(run, LATCH, "dead_from int", "append", GroupStateTimeout.NoTimeout)


def smooth(supports: DataFrame, history: int) -> DataFrame:
    """D21 on a stream of supports(roi, t, s): mean of the last `history` supports. The state is as many numbers per cell."""
    if history < 1:
        raise ValueError("history must be at least 1")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("t", kind="stable")
        both = pd.Series([*past, *rows.s])
        rows["smoothed"] = both.rolling(history, min_periods=1).mean().to_numpy()[len(past) :]
        state.update(([float(x) for x in both.tail(max(history - 1, 1))] if history > 1 else [],))
        yield rows[["roi", "t", "s", "smoothed"]]

    rows = supports.selectExpr("CAST(roi AS long) AS roi", "CAST(t AS int) AS t", "CAST(s AS double) AS s")
    return rows.groupBy("roi").applyInPandasWithState(run, "roi long, t int, s double, smoothed double", "past array<double>", "append", GroupStateTimeout.NoTimeout)
