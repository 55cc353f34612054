"""Change points against loop-style twins."""

import numpy as np
import pytest

from kineplate.operators import changepoint as P


def traces(spark, arrays, name="v"):
    return spark.createDataFrame([(k, t, float(x)) for k, a in arrays.items() for t, x in enumerate(a)], f"k int, t int, {name} double")


@pytest.mark.parametrize("seed", range(4))
def test_step_fit(spark, seed):
    """Supports of many frames with gaps between them, against the errors of all switches."""
    rng = np.random.default_rng(seed)
    frames = np.sort(rng.choice(200, 23, replace=False))
    cut = [0, 9, 16, 23][seed]
    s = np.clip(np.where(np.arange(23) < cut, 0.85, 0.2) + rng.normal(0, 0.15, 23), 0, 1)
    errors = [((s[:k] - 1) ** 2).sum() + (s[k:] ** 2).sum() for k in range(24)]
    best = int(np.argmin(errors))
    want = ("always_dead", int(frames[0])) if best == 0 else ("always_viable", None) if best == 23 else ("transition", int(frames[best]))
    got = P.step_fit(spark.createDataFrame([(1, int(t), float(x)) for t, x in zip(frames, s)], "k int, t int, s double"), ["k"]).first()
    assert (got.state, got.first_dead_frame) == want


def test_steps_match_twins(spark):
    rng = np.random.default_rng(1)
    arrays = {k: rng.normal(0, 1, n) + (np.arange(n) > n // 2) * k for k, n in enumerate([5, 6, 7, 12, 30, 41])}
    local = {r.k: r for r in P.best_local_step(traces(spark, arrays), ["k"]).collect()}
    mean = {r.k: r for r in P.best_mean_step(traces(spark, arrays), ["k"]).collect()}
    flat = {(r.k, r.t): r.detrended for r in P.detrend(traces(spark, arrays), ["k"]).collect()}
    for k, a in arrays.items():
        cand = [(a[t : t + 3].mean() - a[t - 3 : t].mean(), t) for t in range(3, len(a) - 3)] if len(a) >= 7 else []
        assert local[k].best_t == (max(cand)[1] if cand else None)
        cand = [(a[t:].mean() - a[:t].mean(), t) for t in range(3, len(a) - 3)] if len(a) >= 6 else []
        assert mean[k].best_t == (max(cand)[1] if cand else None)
        t = np.arange(len(a))
        want = a - np.polyval(np.polyfit(t, a, 1), t)
        assert np.allclose([flat[k, i] for i in t], want)


def test_intensity_death(spark):
    base = np.full(30, 1000.0)
    up = base.copy()
    up[15:] += 2e6
    rows = traces(spark, {1: base, 2: up, 3: base}).withColumnRenamed("k", "roi")
    got = {r.roi: r.death_time for r in P.death_from_intensity(P.residual(rows, []), ["roi"]).collect()}
    assert got[1] == got[3] == 30 and 13 <= got[2] <= 15


def test_probability_death(spark):
    p = {1: [0.1] * 10 + [0.9] * 10, 2: [0.1] * 20, 3: [0.1] * 18 + [0.9] * 2}
    got = {r.k: r.death_time for r in P.death_from_probability(traces(spark, p, "p"), ["k"]).collect()}
    assert got[1] == 10 and got[2] == 20


def test_smoothing_looks_back_only(spark):
    a = {1: [1, 0, 1, 1, 0]}
    b = {1: [1, 0, 1, 1, 1]}
    first, second = ([r.smoothed for r in P.smooth(traces(spark, x, "s"), ["k"], 3).orderBy("t").collect()] for x in (a, b))
    assert first[:4] == second[:4] and first[2] == pytest.approx(2 / 3)


def test_rise_interval(spark):
    v = [0.0] * 20 + [50.0, 100.0, 100.0] + [100.0] * 10
    deaths = spark.createDataFrame([(1, 20, 33)], "k int, death_time int, frame_count int")
    got = P.rise_interval(traces(spark, {1: v}), deaths, ["k"]).first()
    assert (got.start, got.end) == (20, 21)
