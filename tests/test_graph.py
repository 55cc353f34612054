"""Components against union-find, on graphs of many shapes."""

import math
import random

import pytest

from kineplate.operators import graph as G


def roots(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {x: find(x) for x in up}


def shapes():
    rng = random.Random(7)
    chain = list(range(100, 1100))
    rng.shuffle(chain)
    loose = [(rng.randrange(5000, 9000), rng.randrange(5000, 9000)) for _ in range(2500)]
    hub = [(20_000, 20_001 + k) for k in range(1500)]
    return [(a, b) for a, b in [*zip(chain[:-1], chain[1:], strict=True), *zip(range(3000, 3300), range(3001, 3301), strict=True), *loose, *hub, (1, 2), (2, 1), (1, 2)] if a != b]


@pytest.mark.parametrize("few", [0, 500, G.FEW])
def test_components(spark, few):
    edges = shapes()
    df = spark.createDataFrame([*edges, (7, 7), (8, None), (None, None)], "a long, b long").repartition(3)
    told = []
    got = {r.id: r.component for r in G.connected(df, few, told).collect()}
    assert got == roots(edges)
    assert len(told) <= math.log2(len(edges)) + 2 and (few == G.FEW) == (not told)


@pytest.mark.parametrize("few", [0, G.FEW])
def test_ids_of_several_columns(spark, few):
    edges = [((None, 1), (None, 2)), (("a", 2), ("a", 1)), (("a", 2), ("a", 9))]
    kind = "struct<k:string,n:long>"
    got = {tuple(r.id): tuple(r.component) for r in G.connected(spark.createDataFrame(edges, f"a {kind}, b {kind}"), few).collect()}
    assert got == {(None, 1): (None, 1), (None, 2): (None, 1), ("a", 1): ("a", 1), ("a", 2): ("a", 1), ("a", 9): ("a", 1)}


def test_no_links(spark):
    assert G.connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_a_shuffled_chain_takes_few_rounds(spark):
    n = 100_000
    ids = spark.range(n - 1).selectExpr("(id * 38183 + 7) % 100003 AS a", "((id + 1) * 38183 + 7) % 100003 AS b")
    told = []
    out = G.connected(ids, 1000, told)
    assert out.count() == n and out.select("component").distinct().count() == 1 and len(told) <= 8
