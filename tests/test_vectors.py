"""Neighbours, SVM, evaluation and temporal features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.operators import vectors as V

REFS = [(0, "a", "present", [1.0, 0.0]), (1, "b", "present", [1.0, 0.1]), (2, "c", "empty", [-1.0, 0.0]), (3, "d", "empty", [-1.0, -0.1])]
MANIFEST = "id string, group string, split string, label string, frame int, channel int, z int, vector array<double>"


@pytest.fixture
def refs(spark):
    return spark.createDataFrame(REFS, "ref_idx long, id string, label string, vector array<double>")


def test_knn_and_svm(spark, refs):
    queries = spark.createDataFrame([(0, [4.0, 0.1]), (1, [-8.0, 0.1])], "id long, vector array<double>")
    got = {r.id: r for r in V.knn(queries, refs).collect()}
    assert (got[0].prediction, got[1].prediction) == ("present", "empty") and 0 <= got[0].support <= 1
    near = V.nearest(queries, refs).where("id = 0 and rank = 1").first()
    assert near.ref_idx == 0
    assert {r.id: r.prediction for r in V.svm(queries, refs).collect()} == {0: "present", 1: "empty"}


def test_blocks_give_the_same_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(0)
    refs = spark.createDataFrame([(i, str(i), "x" if i % 2 else "y", rng.standard_normal(4).round(1).tolist()) for i in range(40)], "ref_idx long, id string, label string, vector array<double>")
    queries = spark.createDataFrame([(i, rng.standard_normal(4).tolist()) for i in range(7)], "id long, vector array<double>")
    whole = sorted(map(tuple, V.nearest(queries, refs).select("id", "ref_idx", "rank").collect()))
    monkeypatch.setattr(V, "MATRIX_BYTES", 8 * 4 * 9)
    assert sorted(map(tuple, V.nearest(queries, refs).select("id", "ref_idx", "rank").collect())) == whole


def test_queries_are_not_shuffled_and_ties_go_to_the_lowest_index(spark, monkeypatch):
    monkeypatch.setattr(V, "MATRIX_BYTES", 8 * 2 * 3)
    refs = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(20)], "ref_idx long, vector array<double>")
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, vector array<double>")
    near = V.nearest(queries, refs, 4)
    assert "Exchange" not in near._jdf.queryExecution().toString()
    got = {}
    for r in near.orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.ref_idx)
    assert got == {0: [0, 2, 4, 6], 1: [0, 1, 2, 3], 2: [1, 3, 5, 7], 3: [1, 3, 5, 7], 4: [1, 3, 5, 7]}
    few = V.nearest(queries.limit(1), refs.limit(2), 4).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]
    with pytest.raises(ValueError):
        V.nearest(queries, refs.limit(0))


def test_trailing_means_with_a_past():
    x = np.random.default_rng(3).standard_normal((9, 4))
    for window in (1, 2, 3, 20):
        whole = V.trailing_means(x, window)
        for cut in range(9):
            assert np.allclose(V.trailing_means(x[cut:], window, x[:cut]), whole[cut:])


def test_svm_reaches_its_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 3))
    labels = ["a" if v > 0.2 else "b" for v in x[:, 0] + 0.5 * rng.standard_normal(60)]
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in zip(labels, x)], "label string, vector array<double>")
    model = V.LinearSVM.fit(rows.repartition(3))
    w = model.weights[0]
    xs, y = np.column_stack([x, np.ones(60)]), np.where(np.array(labels) == "b", 1.0, -1.0)
    cost = np.where(y > 0, 60 / (2 * (y > 0).sum()), 60 / (2 * (y < 0).sum()))
    slack = np.maximum(1 - y * (xs @ w), 0)
    assert np.linalg.norm(w - 2 * (xs * (cost * y * slack)[:, None]).sum(0)) < 1e-6
    with pytest.raises(ValueError):
        V.LinearSVM.fit(rows.where("label = 'a'"))


def test_bad_vectors_are_errors(spark):
    for bad in ([0.0, 0.0], [float("nan")], []):
        with pytest.raises(Exception, match="vectors must be"):
            V.unit_vectors(spark.createDataFrame([(bad,)], "vector array<double>")).collect()


def test_evaluate(spark):
    rows = [("a", "g1", "reference", "present", 0, 0, 0, [1.0, 0.0]), ("b", "g2", "reference", "empty", 0, 0, 0, [-1.0, 0.0]), ("c", "g3", "evaluation", "present", 0, 0, 0, [1.0, 0.1]), ("d", "g4", "evaluation", "uncertain", 0, 0, 0, [0.0, 1.0])]
    out = V.evaluate(spark.createDataFrame(rows, MANIFEST))
    assert out["svm_metrics"].first().accuracy == 1 and out["knn_metrics"].first().scored == 1
    assert out["neighbours"].where("id = 'c' and rank = 1").first().ref_id == "a"
    with pytest.raises(ValueError, match="both splits"):
        V.evaluate(spark.createDataFrame([(*r[:1], "g", *r[2:]) for r in rows], MANIFEST))


def test_temporal_features(spark):
    vs, groups, frames = [[0.0, 1.0], [-1.0, 0.0], [1.0, 0.0], [1.0, 1.0]], "abaa", [20, 0, 0, 10]
    rows = spark.createDataFrame([(str(i), groups[i], "reference", "x", frames[i], 0, 0, vs[i]) for i in range(4)], MANIFEST)
    mean = {r.id: np.array(r.vector) for r in V.trailing_mean(rows, 2).collect()}
    s = 1 / 2**0.5
    want = np.array([s, 1 + s]) / np.linalg.norm([s, 1 + s])
    assert np.allclose(mean["0"], want) and np.allclose(mean["2"], [1, 0])
    delta = {r.id: np.array(r.vector) for r in V.baseline_delta(rows).collect()}
    assert np.allclose(delta["2"], [1, 0, 0, 0]) and np.allclose(delta["0"], np.array([0, 1, -1, 1]) / 3**0.5)
    assert V.temporal_problems(rows).count() == 0
    assert V.temporal_problems(rows.withColumn("frame", F.lit(1))).first().problem == "duplicate frame"
