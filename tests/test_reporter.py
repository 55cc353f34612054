"""Worked examples of reporter calls, and a loop-style twin on random series."""

import numpy as np
import pytest

from kineplate.operators import reporter as R

SERIES = {
    (0, 1, 0): [5, 6, 4.5, 5.5, 5, 6], (0, 1, 1): [8, 7, 8.5, 7.5, 8, 7], (1, 2, 0): [6, 7, 420, 430, 415, 410],
    (1, 2, 1): [5, 6, 5.5, 6.5, 380, 390], (1, 2, 2): [7, 6.5, 7.5, 6, 7, 6.5], (1, 2, 3): [450, 460, 445, 455, 450, 440],
}
DDL = "sample_idx int, pos int, roi int, t int, v double"


def table(spark, series):
    return spark.createDataFrame([(*k, t, float(v)) for k, vs in series.items() for t, v in enumerate(vs)], DDL)


def test_calls(spark):
    got = {(r.pos, r.roi): r for r in R.viability_calls(table(spark, SERIES)).collect()}
    assert {k: r.death_frame for k, r in got.items()} == {(1, 0): None, (1, 1): None, (2, 0): 2, (2, 1): 4, (2, 2): None, (2, 3): 0}
    assert got[2, 0].snr == pytest.approx(392.0529) and got[2, 3].snr == pytest.approx(42.365084, abs=1e-5)
    assert got[2, 3].baseline == 5.875 and got[1, 1].snr == pytest.approx(0.47695)


def test_curve(spark):
    rows = table(spark, SERIES)
    got = {(r.sample_idx, r.t): r for r in R.survival_curve(rows, R.viability_calls(rows), 5.0).collect()}
    assert got[0, 5].n_alive == 2 and got[0, 5].pct_viable == 100 and got[0, 5].minutes == 25
    assert [got[1, t].pct_viable for t in (0, 2, 4)] == [75, 50, 25]


def test_load_skips_bad_and_keeps_first(spark):
    raw = [(0, 1, 0, "1", "5.0", 0), (0, 1, 0, "1", "9.0", 1), (0, 1, 0, "x", "5.0", 2), (0, 1, 0, "2", "bad", 3), (0, 1, 0, "3", "nan", 4), (0, 1, 0, "0", "1", 5)]
    got = R.load_series(spark.createDataFrame(raw, "sample_idx int, pos int, roi int, t string, corrected string, file_order int")).orderBy("t").collect()
    assert [(r.t, r.v) for r in got] == [(0, 1.0), (1, 5.0)]


def twin(series):
    q = lambda x, p: float(np.quantile(x, p)) if len(x) else 0.0
    mad = lambda x: q(np.abs(np.diff(x)), 0.5) / 0.9539 if len(x) > 1 else 0.0
    sse = lambda x: float(((x - x.mean()) ** 2).sum())
    early = {k: q(v[:3], 0.5) for k, v in series.items()}
    sigma = {k: mad(v) for k, v in series.items()}
    base = q(list(early.values()), 0.25)
    noisy = [s for s in sigma.values() if s > 1e-9]
    noise = q(noisy, 0.5) if noisy else max(abs(base) * 0.05, 1)
    least = max(6 * noise, abs(base) * 0.5, 10)
    out = {}
    for k, v in series.items():
        best = None
        for i in range(1, len(v)):
            pre, step = q(v[:i], 0.5), q(v[i:], 0.5) - q(v[:i], 0.5)
            need = max(least, 6 * sigma[k], abs(pre) * 0.5)
            if step >= need and q(v[i : i + 3], 0.5) - pre >= 0.8 * need:
                score = sse(v[:i]) + sse(v[i:])
                if best is None or score < best[0] - 1e-9:
                    best = (score, i)
        if best:
            out[k] = best[1]
        else:
            start = len(series) >= 4 and len(v) >= 3 and early[k] >= base + 2 * least and q(v, 0.5) - base >= 2 * least
            out[k] = 0 if start else None
    return out


def test_random_series_match_twin(spark):
    rng = np.random.default_rng(5)
    series = {}
    for k in range(60):
        v = rng.normal(20, 2, rng.integers(1, 14))
        if k % 3 == 0:
            v[rng.integers(0, len(v)) :] += 300
        series[0, k % 4, k] = v
    got = {(r.sample_idx, r.pos, r.roi): r.death_frame for r in R.viability_calls(table(spark, series)).collect()}
    assert got == twin(series)


def test_empty(spark):
    assert R.viability_calls(spark.createDataFrame([], DDL)).count() == 0
