"""The trie and its scores against counts in dictionaries."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from kineplate.llm import lm
from kineplate.llm.elias_fano import EliasFano
from kineplate.llm.queries import fold
from kineplate.llm.workspace import Workspace

from .conftest import documents, words


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top, width in ((0, 10, None), (1, 1, None), (500, 700, None), (3000, 10**12, None), (4000, 5000, 0), (2000, 10**6, 3)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = EliasFano.encode(values, top, width)
        assert (ef.decode() == values).all()
        for x in (values, rng.integers(0, top, 400).astype(np.uint64)):
            found = ef.find(x)
            first = np.searchsorted(values, x)
            known = np.isin(x, values)
            assert ((found >= 0) == known).all() and (values[found[known]] == x[known]).all() and len(first) == len(x)
    clustered = np.concatenate([np.arange(1000), [10**9]]).astype(np.uint64)  # a bucket with a thousand values
    assert (EliasFano.encode(clustered, 10**9 + 1).find(clustered) == np.arange(1001)).all()


def test_select_in_long_runs():
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([rng.integers(0, 50, 30_000), rng.integers(0, 5000, 3000), np.full(5000, 4000)])).astype(np.uint64)
    ef = EliasFano.encode(values, 5000, 0)
    assert (ef.before(np.arange(5001)) == np.searchsorted(values, np.arange(5001))).all()
    assert (ef.find(np.arange(5000)) >= 0).tolist() == np.isin(np.arange(5000), values).tolist()


def model(tokens, held, order):
    """Counts in dictionaries, and log10 P(word | as long a context as there is)."""
    count, times = Counter(), {k: Counter() for k in range(2, order + 1)}
    for i, t in tokens:
        if not held[i]:
            count.update(t)
            told = [None, *t]
            for at in range(1, len(told)):
                for k in range(2, min(order, at + 1) + 1):
                    times[k][tuple(told[at - k + 1 : at + 1])] += 1
    n, v = sum(count.values()), len(count)
    discount, total, left = {}, Counter(), Counter()
    for k, grams in times.items():
        often = Counter(grams.values())
        discount[k] = lm.discounts([often[j] for j in range(1, 5)])
        for g, c in grams.items():
            total[g[:-1]] += c
            left[g[:-1]] += discount[k][min(c, 3)]

    def log10(context, w):
        p = (count[w] + 0.5) / (n + 0.5 * (v + 1))
        for k in range(2, len(context) + 2):
            c = tuple(context[len(context) - k + 1 :])
            if total[c]:
                seen = times[k][(*c, w)]
                p = (seen - discount[k][min(seen, 3)] * (seen > 0) + left[c] * p) / total[c]
        return math.log10(p)

    return count, times, log10


@pytest.mark.parametrize("order", [2, 3, 4])
def test_scores_match_dictionaries(spark, corpus, order, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 500)
    monkeypatch.setattr(lm, "SHARD_BYTES", 5_000)
    docs = documents(spark, corpus)
    with Workspace(spark, "lm") as ws:
        trie = lm.learn(ws, docs.where(~fold(5, 1)), order)
        rows = lm.score(docs, trie, fold(5, 1)).collect()
        end = int(trie.ids(np.array([lm.END], np.uint64))[0])
        followers = len(trie.successors(2, end))
        assert all(len(x) > 2 for x in trie.offsets.values())
        bits = [8 * sum(trie.sequence(k, s, "next").bytes() for s in np.flatnonzero(np.diff(trie.offsets[k]))) / trie.offsets[k][-1] for k in range(2, order + 1)]
        assert not os.path.exists(f"{trie.folder(2, 0)}/times.npy") and max(bits) < 64
    tokens = [(i, [*words(t), None]) for i, t in corpus]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in tokens}
    count, times, log10 = model(tokens, held, order)
    n, v = sum(count.values()), len(count)
    assert followers == sum(g[0] is None for g in times[2])
    assert [int(trie.offsets[k][-1]) for k in range(1, order + 1)] == [v, *(len(times[k]) for k in range(2, order + 1))]
    for r, (i, t) in zip(sorted(rows, key=lambda r: r.doc_id), sorted(tokens, key=lambda x: x[0]), strict=True):
        told = [None, *t]
        score = sum(log10(told[max(at - order + 1, 0) : at], told[at]) for at in range(1, len(told)))
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i, held[i], len(t), sum(w in count for w in t), n)
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert abs(r.base_score - base) < 1e-6 * len(t) and abs(r.score - score) < 2e-4 * order * len(t)


def test_packed_runs():
    for values in (np.array([], np.uint64), np.array([5, 9, 2**63], np.uint64)):
        assert (lm.from_planes(lm.planes(values), np.uint64) == values).all()


def test_null_ids_and_repeated_rows(spark):
    docs = documents(spark, [(None, "a b a b"), (1, "a b"), (1, "a b"), (2, None)])
    with Workspace(spark, "lm") as ws:
        rows = lm.score(docs, lm.learn(ws, docs)).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in rows) == [(0, 5, 12), (1, 3, 12), (1, 3, 12), (2, 1, 12)]
    assert len({r.score for r in rows if r.doc_id == 1}) == 1 and all(r.score > r.base_score for r in rows if r.n_tokens > 1)


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "a b"), (2, None)])
    with Workspace(spark, "lm") as ws:
        rows = lm.score(docs, lm.learn(ws, docs.limit(0))).collect()
    assert [(r.n_tokens, r.n_known, r.base_score, r.score) for r in rows] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]
    with Workspace(spark, "lm") as ws:
        assert lm.score(docs.limit(0), lm.learn(ws, docs)).count() == 0
