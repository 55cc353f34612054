"""Tiled components and holes against whole images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.operators import graph, tiles as T

from . import by_arrays as K
from .test_kernels import disk


def images():
    rng = np.random.default_rng(4)
    snake = np.ones((31, 40), bool)
    snake[1::2] = False
    for k in range(1, 31, 4):
        snake[k, -1] = snake[min(k + 2, 30), 0] = True
    return {
        None: rng.random((23, 37)) > 0.6, 1: snake, 2: disk(40, 40, (20, 20, 15)) & ~disk(40, 40, (20, 20, 11)) | disk(40, 40, (20, 20, 3)), 3: np.zeros((9, 9), bool), 4: np.ones((17, 8), bool),
        5: np.eye(25, dtype=bool), 6: rng.random((1, 33)) > 0.4, 7: rng.random((33, 1)) > 0.4, 8: ~snake,
    }


def tiled(spark, side):
    rows = [(k, *m.shape, m.ravel().tolist()) for k, m in images().items()]
    return T.cut(spark.createDataFrame(rows, "k int, height int, width int, lit array<boolean>"), ["k"], side, "lit")


def whole(rows, column, kind):
    out = {}
    for r in rows.collect():
        image = out.setdefault(r.k, np.zeros((r.image_height, r.image_width), kind))
        image[r.y0 : r.y0 + r.height, r.x0 : r.x0 + r.width] = np.array(r[column]).reshape(r.height, r.width)
    return out


@pytest.mark.parametrize("corners", [True, False])
def test_label_of_one_tile(corners):
    for m in images().values():
        got = T.label(m, corners)
        want = K.components(m, 1) if corners else None
        assert want is None or (got == want).all()
        if not corners:
            assert ((T.label(~m, False) == 0) == m).all() and len(np.unique(got)) >= len(np.unique(T.label(m, True)))


@pytest.mark.parametrize("side, few", [(7, 0), (8, graph.FEW), (100, graph.FEW)])
def test_tiles_equal_whole_images(spark, side, few, monkeypatch):
    monkeypatch.setattr(T, "connected", lambda edges: graph.connected(edges, few))
    tiles = tiled(spark, side)
    for least in (1, 4):
        got = whole(T.component_tiles(tiles, ["k"], least), "label", int)
        for k, m in images().items():
            assert (got[k] == K.components(m, least)).all(), (k, least)
    got = whole(T.fill_tiles(tiles, ["k"]), "on", bool)
    for k, m in images().items():
        assert (got[k] == K.fill_holes(m)).all(), k


def test_one_large_image_over_many_tasks(spark):
    side, n = 512, 8  # one component winds through all tiles, and a dot lies in every second row of tiles
    made = spark.range(n * n).select(F.lit(0).alias("k"), F.floor(F.col("id") / n).cast("int").alias("ty"), (F.col("id") % n).cast("int").alias("tx"))
    made = made.select("k", "ty", "tx", (F.col("ty") * side).alias("y0"), (F.col("tx") * side).alias("x0"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(n * side).alias("image_height"), F.lit(n * side).alias("image_width"))
    i = F.sequence(F.lit(0), F.lit(side * side - 1))
    made = made.repartition(16).withColumn("on", F.transform(i, lambda p: (F.floor(p / side) + F.col("y0") == 100) | ((p % side) + F.col("x0") == 2000) | ((F.floor(p / side) == 300) & (p % side < 3) & (F.col("y0") % (2 * side) == 0))))
    out = T.component_tiles(made, ["k"], 1)
    sizes = {r.label: r.n for r in out.select(F.explode("label").alias("label")).where("label > 0").groupBy("label").agg(F.count("*").alias("n")).collect()}
    line = n * side
    assert T._pieces(made, ["k"], True, False).rdd.getNumPartitions() == 16 and sizes.pop(1) == 2 * line - 1 and sorted(sizes) == list(range(2, 2 + n // 2 * n)) and set(sizes.values()) == {3}
