"""Pixel operators over DataFrames against plain loops over arrays, on generated disks and noise."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.operators import frames as R
from kineplate.operators import histogram as H
from kineplate.operators import pixels as P

from . import by_arrays as K


def disk(h, w, *circles):
    y, x = np.mgrid[:h, :w] + 0.5
    out = np.zeros((h, w), bool)
    for cx, cy, r in circles:
        out |= (x - cx) ** 2 + (y - cy) ** 2 <= r * r
    return out


def planes(spark, images, column="pixels", kind="double"):
    rows = [(k, *image.shape, image.ravel().tolist()) for k, image in images.items()]
    return spark.createDataFrame(rows, f"k int, height int, width int, {column} array<{kind}>")


def pixels(spark, images, name, kind="double"):
    return P.pixel_rows(planes(spark, images, kind=kind), ["k"], **{name: "pixels"})


def image_of(rows, shape, column):
    out = np.zeros(shape)
    for r in rows:
        out[r.y, r.x] = r[column]
    return out


def check(rows, images, column, want):
    got = {}
    for r in rows.collect():
        got.setdefault(r.k, []).append(r)
    for k, image in images.items():
        assert np.allclose(image_of(got.get(k, []), image.shape, column), want(image)), k


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(2)
    spur = disk(32, 32, (16, 16, 5))
    spur[2, 2:4] = True
    return {0: disk(48, 48, (26, 24, 5), (40, 8, 5)), 1: disk(32, 40, (16, 16, 5), (24, 16, 5)), 2: spur, 3: rng.random((17, 23)) > 0.3, 4: np.zeros((5, 4), bool), 5: np.ones((4, 6), bool), 6: disk(20, 20, (10, 10, 6)) & ~disk(20, 20, (10, 10, 3)), 7: rng.random((9, 30)) > 0.6, 8: np.array([[True]])}


def test_components_distance_and_holes(spark, masks):
    rows = pixels(spark, masks, "on", "boolean").persist()
    check(P.components(rows, ["k"], least=1), masks, "label", lambda m: K.components(m, 1))
    check(P.components(rows, ["k"]), masks, "label", K.components)
    check(P.distance(rows, ["k"]), masks, "distance", K.distance)
    check(P.fill_holes(rows, ["k"]), masks, "on", K.fill_holes)
    check(P.neighbour_max(rows.withColumn("v", F.col("on").cast("int")), ["k"], "v", "m"), masks, "m", lambda m: np.maximum(K.neighbour_max(m.astype(int), 0), m))


def test_cells_are_split(spark, masks):
    rows = pixels(spark, masks, "on", "boolean").persist()
    dist = P.distance(rows, ["k"]).persist()
    got = {}
    for r in P.seeds(dist, ["k"]).collect():
        got.setdefault(r.k, {})[r.seed] = r.y * masks[r.k].shape[1] + r.x
    for k, m in masks.items():
        assert [got.get(k, {})[s] for s in sorted(got.get(k, {}))] == K.seeds(K.distance(m), m, 5.5, 2.5), k
    check(P.split_cells(rows, ["k"]), masks, "label", K.split_cells)
    areas = P.split_cells(rows.where("k = 1"), ["k"]).where("label > 0").groupBy("label").count().collect()
    assert sorted(r["count"] for r in areas) == [68, 84]


def test_engagements(spark):
    cases = {0: (disk(48, 48, (16, 24, 6)), disk(48, 48, (26, 24, 5), (40, 8, 5)), (1, 2, 1)), 1: (disk(40, 40, (10, 10, 5)), disk(40, 40, (30, 30, 5)), (1, 1, 0)), 2: (np.zeros((8, 8), bool), np.zeros((8, 8), bool), (0, 0, 0))}
    rows = [(k, *a.shape, a.ravel().tolist(), b.ravel().tolist()) for k, (a, b, _) in cases.items()]
    frames = spark.createDataFrame(rows, "k int, height int, width int, tumor array<boolean>, engager array<boolean>")
    got = {r.k: (r.tumor_cells, r.t_cells, r.engagements) for r in R.engagement_counts(frames).collect()}
    assert got == {k: want for k, (_, _, want) in cases.items()} == {k: K.engagement(a, b) for k, (a, b, _) in cases.items()}


def test_filters_and_signal(spark):
    rng = np.random.default_rng(3)
    images = {0: rng.random((9, 11)), 1: 100 + 40 * rng.standard_normal((40, 40)) * disk(40, 40, (20, 20, 8)), 2: np.full((8, 8), 5.0), 3: rng.random((3, 2)), 4: rng.random((1, 7))}
    rows = pixels(spark, images, "v").persist()
    check(P.box_mean(rows, ["k"], 2), images, "mean", lambda v: K.box_mean(v, 2))
    check(P.local_deviation(rows, ["k"], 2).withColumn("q", F.col("deviation") ** 2), images, "q", lambda v: K.local_deviation(v, 2) ** 2)
    check(P.gaussian(rows, ["k"], 1.0), images, "smooth", lambda v: K.gaussian(v, 1.0))
    few = {k: images[k] for k in (0, 1, 2)}
    rows = rows.where("k < 3").withColumn("stain", F.when(F.col("v") > 120, 50.0).otherwise(F.col("x") % 7 + 10.0))
    done = P.segment(rows, ["k"]).persist()
    check(done, few, "on", K.segment)
    want = {k: K.masked_signal(v, np.where(v > 120, 50.0, np.arange(v.shape[1]) % 7 + 10.0)) for k, v in few.items()}
    got = {r.k: r.v for r in P.masked_signal(done, ["k"]).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want) and want[2] == 0


def test_contrast(spark):
    images = {0: np.arange(100.0).reshape(10, 10), 1: np.full((4, 4), 7.0), 2: np.array([[0.0, 1.0], [2.0, 30.0]])}
    rows = pixels(spark, images, "v")
    check(P.contrast(rows, ["k"]), images, "gray", lambda v: K.contrast_rgb(v)[..., 0])
    check(P.contrast(rows, ["k"], "movie"), images, "gray", lambda v: K.contrast_rgb(v, floor=1e-6)[..., 0])
    fixed = spark.createDataFrame([(k, 0.0, 50.0) for k in images], "k int, low double, high double")
    check(P.contrast(rows, ["k"], "movie", limits=fixed), images, "gray", lambda v: K.contrast_rgb(v, (0, 50), 1e-6)[..., 0])
    assert {r.gray for r in P.contrast(rows, ["k"], "png").where("k = 1").collect()} == {0}
    with pytest.raises(Exception, match="finite"):
        P.contrast(pixels(spark, {0: np.array([[np.nan, 1.0]])}, "v"), ["k"], "movie", limits=fixed).collect()


def test_model_inputs(spark):
    rng = np.random.default_rng(5)
    images = {0: rng.random((10, 13)) * 100, 1: np.full((10, 10), 3.0), 2: rng.random((300, 17))}
    rows = planes(spark, images)
    for r in R.model_input(rows, 16).collect():
        assert np.allclose(np.array(r.input).reshape(16, 16), K.model_input(images[r.k], 16)[0], atol=1e-6)
    for r in R.network_input(rows, 32).collect():
        assert np.abs(np.array(r.input).reshape(3, 32, 32) - K.network_input(images[r.k], 32)).max() < 1e-5
    assert R.model_input(rows.limit(0)).count() == 0


@pytest.mark.parametrize(("low", "high"), [(0, 200), (200, 0)])
def test_minority(spark, low, high):
    image = np.full((20, 20), float(low))
    image[8:12, 8:12] = high
    got = {r.k: np.array(r.on) for r in R.minority_mask(planes(spark, {0: image, 1: np.zeros((4, 4))}), ["k"], "pixels", "on").collect()}
    assert (got[0].reshape(20, 20) == K.minority(image)).all() and got[0].sum() == 16 and not got[1].any()


def test_small_patches(spark):
    image = np.full((32, 32), 10.0)
    image[4:7, 4:7] = 1000
    one = H.sigma_threshold(pixels(spark, {0: image, 1: np.full((8, 8), 3.0)}, "v"), ["k"]).collect()
    assert {r.k: r.on for r in one} == {0: 9, 1: 0} and K.above_sigma(image).sum() == 9
    assert not P.split_cells(pixels(spark, {0: image > 100}, "on", "boolean"), ["k"]).where("label > 0").count()


def test_thresholds_sort_no_pixels(spark):
    rng = np.random.default_rng(4)
    images = {k: rng.choice([0.0, 1.0, 5.0, 9.0, 9.5] if k % 2 else rng.normal(0, 50, 97), (5, 4 + k)).round(3) for k in range(12)}
    images |= {20: np.full((3, 3), 7.5), 21: np.array([[0.0, 1.0], [np.nan, 3.0]]), 22: np.array([[-2.0, 2.0]])}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = pixels(spark, images, "v")
        made = {"levels": H.otsu_levels(rows, ["k"]), "centres": H.otsu_centres(rows, ["k"]), "sigma": H.sigma_threshold(rows, ["k"]), "minority": H.minority_counts(rows, H.otsu_levels(rows, ["k"]), ["k"])}
        for name, df in made.items():
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan, name
        got = {name: {r.k: r for r in df.collect()} for name, df in made.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["centres"].keys() == images.keys() and got["levels"].keys() == got["minority"].keys() == images.keys() - {20}
    for k, image in images.items():
        assert got["centres"][k].threshold == pytest.approx(K.otsu_by_centres(image), abs=1e-9), k
        if k != 20:
            assert got["levels"][k].threshold == pytest.approx(K.otsu(image), abs=1e-9), k


def quiet(salt):
    return (190 + (17 * np.arange(96 * 96) + salt) % 31).astype(float).reshape(96, 96)


def test_shared_scale(spark):
    busy = np.where(disk(96, 96, (48, 48, 5)), 4500.0, quiet(3))
    rows = spark.createDataFrame([(0, busy.ravel().tolist()), (0, quiet(11).ravel().tolist()), (1, [])], "pos int, pixels array<double>")
    got = {r.pos: r for r in H.robust_scale(H.plane_histogram(rows, ["pos"]), ["pos"], rows).collect()}
    assert got[0].low == 205 and got[0].threshold == pytest.approx(299.8864)
    assert got[1].low == 0 and got[1].threshold > 1e308
    assert not K.above_scale(quiet(11), got[0].threshold).any()


@pytest.mark.parametrize("n", [1, 2, 7, 60, 400])
def test_lower_envelope(n):
    rng = np.random.default_rng(n)
    for share in (0.0, 0.05, 0.5, 1.0):
        on = rng.random(n) > share
        g = np.where(on, rng.integers(1, 30, n), 0)
        for far in (g, np.where(on & (rng.random(n) < 0.4), -1, g), np.where(on, -1, 0)):
            x = np.arange(n)
            every = np.where(far[None] >= 0, (x[:, None] - x) ** 2.0 + far[None] ** 2, P.FAR).min(1)
            assert (P.nearest_squares(far, on) == np.where(on, every, 0)).all()


def test_a_long_line_takes_linear_time():
    import time

    g, on = np.full(400_000, 5), np.ones(400_000, bool)
    began = time.perf_counter()
    assert (P.nearest_squares(g, on) == 25).all() and (P.nearest_squares(np.abs(np.arange(400_000) - 200_000) + 1, on) > 0).all()
    assert time.perf_counter() - began < 8


def test_box_filters_of_any_radius(spark):
    rng = np.random.default_rng(8)
    images = {0: rng.integers(0, 900, (6, 13)).astype(float), 1: rng.integers(0, 9, (1, 1)).astype(float), 2: rng.integers(0, 99, (20, 3)).astype(float)}
    rows = pixels(spark, images, "v").persist()
    for radius in (0, 1, 5, 40):
        check(P.box_mean(rows, ["k"], radius), images, "mean", lambda v: K.box_mean(v, radius))  # noqa: B023


def test_spaced_points():
    rng = np.random.default_rng(9)
    for spacing in (1.0, 2.5, 5.5):
        y, x = rng.integers(0, 60, (2, 900))
        want = []
        for k in range(900):
            if all((y[k] - y[j]) ** 2 + (x[k] - x[j]) ** 2 >= spacing**2 for j in want):
                want.append(k)
        assert P.spaced(y, x, spacing).tolist() == want
