"""Running medians and selection by ranges against sorting."""

import numpy as np
import pyarrow as pa
import pytest

from kineplate.operators import reporter as R
from kineplate.operators import running as U
from kineplate.operators import selection as S


@pytest.mark.parametrize("n", [0, 1, 2, 3, 50, 501])
def test_running(n):
    rng = np.random.default_rng(n)
    for x in (rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.sort(rng.normal(size=n)), np.zeros(n)):
        got, squares = U.medians_before(x), U.squares_before(x)
        assert np.isnan(got[0]) and squares[0] == 0
        for k in range(1, n + 1):
            assert got[k] == np.median(x[:k]) and abs(squares[k] - ((x[:k] - x[:k].mean()) ** 2).sum()) < 1e-9


def test_a_long_series_takes_n_log_n():
    import time

    x = np.random.default_rng(1).normal(size=200_000)
    began = time.perf_counter()
    x[150_000:] += 1000
    assert R.best_step(x, 1.0, 10.0)[0] == 150_000
    assert time.perf_counter() - began < 20


def test_each_series_spans_batches(spark):
    rows = [(k if k else None, t, float(k * t)) for k in range(7) for t in range((k + 1) * 50)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = spark.createDataFrame(rows, "k int, t int, v double").repartition(5)

        def run(series):
            t = series.column("t").to_pylist()
            assert t == sorted(t)
            return pa.RecordBatch.from_arrays([series.column("k").slice(0, 1).combine_chunks(), pa.array([float(sum(series.column("v").to_pylist()))]), pa.array([len(t)], pa.int32())], ["k", "s", "n"])

        got = {(r.k, r.s, r.n) for r in U.each_series(df, ["k"], ["t"], run, "k int, s double, n int").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(k or None, float(k * sum(range((k + 1) * 50))), (k + 1) * 50) for k in range(7)}
    assert U.each_series(df.limit(0), ["k"], ["t"], run, "k int, s double, n int").count() == 0


@pytest.mark.parametrize("small", [1, 3, 1024])
def test_quantiles(spark, small, monkeypatch):
    monkeypatch.setattr(S, "SORTED", small)
    monkeypatch.setattr(S, "RANGES", 8)
    rng = np.random.default_rng(small)
    data = {
        "normal": rng.normal(size=700), "ties": rng.integers(-2, 3, 500).astype(float), "wide": np.concatenate([10.0 ** rng.uniform(-300, 300, 200), -(10.0 ** rng.uniform(-300, 300, 201))]),
        "one": np.array([4.5]), "two": np.array([-0.0, 1.0]), "close": 1.0 + np.arange(40) * 2.0**-52, "same": np.full(90, -7.25),
    }
    rows = spark.createDataFrame([(n, float(v)) for n, x in data.items() for v in x] + [("normal", None), ("unasked", 1.0)], "name string, x double")
    for q in (0.0, 0.25, 0.5, 0.77, 1.0):
        got = S.exact_quantiles(rows, dict.fromkeys([*data, "none"], q))
        assert got["none"] == (None, 0)
        for n, x in data.items():
            s, place = np.sort(x), (len(x) - 1) * q
            low = int(place)
            want = s[low] if place == low else (1 - (place - low)) * s[low] + (place - low) * s[low + 1]
            assert got[n] == (want, len(x)), (n, q)
