"""Groups of near duplicates against all pairs, and the text and graph helpers."""

import numpy as np
import pyarrow as pa
import pytest

from kineplate.llm import near_dedup as N
from kineplate.llm import text as T
from kineplate.llm.graph import components
from kineplate.llm.workspace import Workspace

from .conftest import documents, shingles, words


def groups(sets, percent=80):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("width", [4, 5])
def test_groups_match_all_pairs(spark, corpus, width):
    sets = {i: shingles(t, width) for i, t in corpus}
    got = {r.doc_id: r for r in N.near_duplicates(documents(spark, corpus), width, 80).collect()}
    assert {i: r.component_id for i, r in got.items()} == groups(sets)
    assert all(got[i].n_shingles == len(s) and got[i].kept == (got[i].component_id == i) for i, s in sets.items())


def test_families_are_tested_in_tiles(spark, monkeypatch):
    """Chains in which neighbours are linked and far members are not, with tiles smaller than the family."""
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):
        base = [f"n{rng.integers(1e9)}" if rng.random() < 0.035 else w for w in base]
        rows.append((k, " ".join(base)))
    monkeypatch.setattr(N, "TILE", 8)
    got = {r.doc_id: r.component_id for r in N.near_duplicates(documents(spark, rows), 4, 80).collect()}
    assert got == groups({i: shingles(t, 4) for i, t in rows})


def test_no_rows_null_ids_and_repeated_rows(spark):
    assert N.near_duplicates(documents(spark, []), 5).count() == 0
    rows = documents(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "a b c d e F")])
    got = sorted((r.doc_id or -1, r.component_id, r.kept) for r in N.near_duplicates(rows, 5).collect() if r.doc_id)
    assert got == [(4, 4, True), (4, 4, True), (9, 4, False)]


@pytest.mark.parametrize("turn", [1, -1])
def test_one_id_with_two_texts(spark, turn):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, one), (1, two), (1, two), (5, one + " z"), (6, two + " z"), (7, "other words of no group at all"), (0, "x")][::turn]
    docs = documents(spark, rows).selectExpr("*", "'c' AS t", "1 AS node", "2 AS rep", "3 AS id", "4 AS component_id")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs, 5).collect())
    assert got == [(0, 1, 0, True), (1, 56, 1, True), (1, 56, 1, True), (1, 56, 1, True), (5, 57, 1, False), (6, 57, 1, False), (7, 3, 7, True)]


def test_words_of_chunks(corpus, monkeypatch):
    column = pa.array([t for _, t in corpus], pa.string())
    whole, at = T.words(column)
    assert np.diff(at).tolist() == [len(words(t)) for _, t in corpus]
    distinct = {}
    for h, w in zip(whole.tolist(), [w for _, t in corpus for w in words(t)], strict=True):
        assert distinct.setdefault(w, h) == h
    assert len(set(distinct.values())) == len(distinct)
    monkeypatch.setattr(T, "CHUNK", 64)
    assert (T.words(column)[0] == whole).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 300), (200, 300), (7, 7)]
    with Workspace(spark, "t") as ws:
        got = {r.id: r.component for r in components(ws, spark.createDataFrame(edges, "a long, b long"), "x").collect()}
    assert got == {k: 0 for k in range(41)} | {100: 100, 200: 100, 300: 100}
