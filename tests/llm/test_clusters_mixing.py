"""Clusters against plain whole-number k-means, mixes against a loop over sources."""

import hashlib
import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.llm import clustering as C
from kineplate.llm import mixing as X
from kineplate.llm.queries import ORACLES, QUERIES

from .conftest import words

DATA = "/root/testdata/sf0.001"


def lloyd(rows, k, rounds, dims, seed=3):
    """Rows (vec_id, vector) as (vec_id, cluster, distance, cluster inertia, inertia, centroid)."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        parts = defaultdict(list)
        for _, v in kept:
            parts[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(parts[j]) for x in zip(*parts[j], strict=True)] if parts[j] else c for j, c in enumerate(centroids)]
    placed = [(i, *nearest(v)[::-1]) for i, v in kept]
    whole = Counter()
    for _, j, d in placed:
        whole[j] += d
    return Counter((i, j, d, whole[j], sum(whole.values()), tuple(centroids[j])) for i, j, d in placed)


def found(spark, rows, k, rounds, dims, kind="float", told=None):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("block", F.lit("x")).withColumn("cluster", F.lit(None).cast("string")).withColumn("a.b", F.lit(1))
    out = C.hamerly_clusters(frame.repartition(3), k, rounds, dims, told=told).collect()
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out)


@pytest.mark.parametrize("block", [C.BLOCK_BYTES, 4 * 6 * 7])
def test_bounds_change_nothing(spark, block, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_BYTES", block)
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(5, 6))
    rows = [(i, (middles[i % 5] + 0.4 * rng.normal(size=6)).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)] + [(1, rows[1][1])] * 3  # copies and repeated rows
    told = []
    assert found(spark, rows, 4, 8, 6, told=told) == lloyd(rows, 4, 8, 6)
    scanned = [t["scanned"] for t in told]
    assert scanned[0] == len(rows) and sum(scanned[1:]) < 0.6 * 7 * len(rows)  # bounds spare most scans


def test_odd_vectors(spark):
    tie = [[1.0, 0.0], [-1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [0.0, -1.0]]
    rows = [(i, v) for i, v in enumerate(tie * 3)]
    rows += [(None, [0.5, 0.25]), (90, None), (91, [1.0]), (92, [1.0, None]), (93, [float("nan"), 1.0]), (94, [float("inf"), 1.0]), (95, []), (96, [-1e-9, 1e5]), (97, [3e6, -2.5e6])]
    assert found(spark, rows, 3, 5, 2, "double") == lloyd(rows, 3, 5, 2)
    assert found(spark, rows[:2], 8, 10, 2) == lloyd(rows[:2], 8, 10, 2)
    assert not found(spark, [], 8, 10, 2) and not found(spark, [(None, [1.0, 2.0])], 8, 10, 2)


def test_distances_beyond_a_long_are_null(spark):
    rows = [(i, [float(i), 0.0]) for i in range(4)] + [(9, [1e8, 1e8]), (10, [1e14, 0.0]), (11, [1e30, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.vec_id: r for r in C.hamerly_clusters(frame, 1, 3, 2).collect()}
    assert out.keys() == {0, 1, 2, 3, 9, 10} and out[10].distance is None and out[0].inertia is None


def mixed(rows, weights=(3, 1, 2), part=1.5, most=2, seed=0):
    """Rows (doc_id, text, source) as Counter of (doc_id, source, size, source_size, taken) and {source: target}."""
    size = Counter()
    sized = [(i, s, len(words(t))) for i, t, s in rows]
    for _, s, n in sized:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    share = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while open_:
        level = (part * sum(size.values()) - sum(target.values())) / sum(share[s] for s in open_)
        above = {s for s in open_ if share[s] * level > most * size[s]}
        target |= {s: float(most * size[s]) for s in above}
        open_ -= above
        if not above:
            target |= {s: share[s] * level for s in open_}
            break
    out = Counter()
    for s in order:
        docs = [(i, n) for i, z, n in sized if z == s]
        copies = target[s] / size[s] if size[s] else 0.0
        whole, p = int(copies), copies - int(copies)
        taken, ranked, rest = [], [], target[s]
        for i, n in docs:
            rest -= whole * n
            if p > 0 and n:
                u = (int(hashlib.sha256(f"{seed}:{'-' if i is None else i}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                odds = (u / (1 - u)) / (p / (1 - p))
                ranked.append([math.floor(odds / (1 + odds) * 2**52), i is not None, i or 0, n, i, 0])
            else:
                taken.append((i, n, whole * n))
        ranked.sort(key=lambda r: r[:4])
        end = None
        for r in ranked:
            if r[3] > rest:
                end = r
                break
            r[5], rest = 1, rest - r[3]
        if end:
            k = ranked.index(end)
            ends = [(abs(r[3] - rest) if j >= k else abs(rest - end[3] + r[3]), j < k, r[:4], j) for j, r in enumerate(ranked)]
            if (best := min(ends))[0] < rest:
                ranked[best[3]][5] = 0 if best[1] else 1
                end[5] = 1 if best[1] else end[5]
        taken += [(r[4], r[3], (whole + r[5]) * r[3]) for r in ranked]
        for i, n, t in taken:
            out[i, s, n, size[s], t] += 1
    return out, target


def texts(seed=1, hot=500):
    rng = random.Random(seed)

    def text():
        return " ".join("w" for _ in range(rng.choice([0, 1, 3, 20, 60, 200])))

    rows = [(i, text(), "hot") for i in range(hot)] + [(hot + i, text(), f"s{i % 7}") for i in range(200)] + [(2000 + i, text(), None) for i in range(30)]
    rows += [(None, text(), "s1") for _ in range(5)] + [(3000, None, "s2"), (3001, "", "only empty"), (3002, "\x0b a\xa0b\tc \n", ""), (3003, "long " * 50_000, "s3")]
    return rows + [rows[4]] * 60 + [(4000, "same row of five words", "same")] * 90


DOCS = "doc_id long, text string, source string"


@pytest.mark.parametrize("bins, least", [(8, 2048), (3, 4)])
def test_mix(spark, bins, least, monkeypatch):
    monkeypatch.setattr(X, "BINS", bins)
    monkeypatch.setattr(X, "SORTED", least)
    rows = texts()
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("rank", F.lit(1)).withColumn("A.b", F.lit(2)).repartition(4)
    got = X.mix_sources(docs).collect()
    want, target = mixed(rows)
    assert Counter((r.doc_id, r.source, r.size, r.source_size, r.taken) for r in got) == want
    assert all(abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r.size <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert abs(taken["hot"] - target["hot"]) <= 3
    assert got and Counter(map(tuple, got)) == Counter(map(tuple, X.mix_sources(docs.repartition(7)).collect()))  # reruns agree


def test_mix_of_nothing(spark):
    assert X.mix_sources(spark.createDataFrame([], DOCS)).collect() == []
    (row,) = X.mix_sources(spark.createDataFrame([(1, None, None)], DOCS)).collect()
    assert (row.size, row.source_size, row.target, row.taken) == (0, 0, 0.0, 0)
    with pytest.raises(ValueError):
        X.mix_sources(spark.createDataFrame([(1, "a", "b")], DOCS), percent=300)


def test_unequal_shares(spark):
    """Inclusion follows the shares, held at `most`, and the words stay at the target."""
    docs = spark.createDataFrame([(i, "word " * 10, "a", (1, 2, 40)[i % 3]) for i in range(3000)], f"{DOCS}, share long")
    times = Counter()
    for r in X.mix_sources(docs, weights=(1,), percent=100, weight="share").collect():
        times[r.doc_id % 3] += r.copies
    assert times[2] == 2000 and sum(times.values()) == 3000  # held at two copies, the others have the other thousand
    assert abs(times[1] / 1000 - 2 / 3) < 0.05 and abs(times[0] / 1000 - 1 / 3) < 0.05


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_centroid_clusters", "op13_pareto_mixing"])
def test_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()) == Counter(want.fetchall())
