"""Line dedup and decontamination against loops."""

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kineplate.llm import decontaminate as D
from kineplate.llm import line_dedup as L
from kineplate.llm.workspace import Workspace

from .conftest import FOLD, documents, shingles, words

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return line.strip(SPACE).translate(FOLD)


@pytest.fixture
def lined():
    rng = random.Random(1)
    common = ["License Line", "  license line ", "Éa Über", "éa über", "", " ", "\x0b", "x"]
    rows = [(i, "\n".join(rng.choice(common) if rng.random() < 0.3 else f"own {rng.random()}" for _ in range(rng.randint(0, 9)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "\n" * 5000), (63, rows[0][1]), (63, rows[0][1]), (None, "license line\nrest"), (64, "license line\n" * 3)]


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("least, rows", [(1, 1 << 14), (5, 2)])
def test_lines_match_loop(spark, lined, least, rows, first, monkeypatch):
    monkeypatch.setattr(L, "BATCH_ROWS", rows)
    seen, lead = {}, {}
    for i, t in lined:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= least:
                seen.setdefault(k, set()).add(i)
                lead[k] = min(lead.get(k, 10**9), 10**9 if i is None else i)
    want = Counter()
    for i, t in lined:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(seen.get(key(x), ())) < 10 or (first and lead[key(x)] == i)]
        want[i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    got = L.drop_common_lines(documents(spark, lined), least, 10, first).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got) == want


def test_repeated_ids_are_one_document(spark):
    rows = [(i, "nine times\nten times") for i in range(9)] + [(8, "nine times\nother"), (8, "nine times"), (9, "ten times"), (None, "x")]
    got = {(r.doc_id, r.kept_text) for r in L.drop_common_lines(documents(spark, rows)).collect()}
    assert got == {(i, "nine times") for i in range(9)} | {(8, "nine times\nother"), (9, ""), (None, "x")}


def test_columns_of_the_operators_names(spark):
    docs = documents(spark, [(i, "same line\nown %d" % i) for i in range(12)])
    names = ("gone", "lines", "lines_", "row", "id", "hash", "row_id", "row_hash", "row_hash_", "at")
    out = L.drop_common_lines(docs.select("*", *(F.lit(5).alias(c) for c in names), F.lit(6).alias("KEPT_TEXT"), F.lit(7).alias("n_lines"))).collect()
    assert {r.kept_text for r in out} == {"own %d" % i for i in range(12)} and {r.n_lines for r in out} == {2}
    assert all(r[c] == 5 for r in out for c in names)


def test_batches_meet_the_runs_and_add_their_own(spark):
    def counts(*rows):
        return spark.createDataFrame(rows, "h1 long, h2 long, n_docs long")

    def held(run):
        return {r.h1: r.n_docs for r in run[1].collect()}

    with Workspace(spark, "runs") as ws:
        runs = L.LineRuns(ws, 10)
        runs.add(counts((1, 1, 12), (2, 2, 4), (3, 3, 1)))
        runs.add(counts((1, 1, 50), (2, 2, 5), (4, 4, 9)))  # line 1 is settled and met by the anti-join
        assert [held(r) for r in runs.open[0]] == [{2: 4, 3: 1}, {2: 5, 4: 9}]
        runs.add(counts((5, 5, 10), (1, 2, 9)))
        runs.add(counts((2, 2, 1), (5, 5, 3)))  # the fourth run: compacted, which settles line 2
        assert [len(x) for x in runs.open] == [0, 1] and held(runs.open[1][0]) == {3: 1, 4: 9, 1: 9}
        runs.add(counts((2, 2, 7), (4, 4, 1), (1, 1, 1), (5, 5, 1)))
        assert held(runs.open[0][0]) == {4: 1}
        assert {(r.h1, r.h2) for r in runs.common().collect()} == {(1, 1), (2, 2), (4, 4), (5, 5)}
        assert sum(map(len, runs.settled)) < runs.made
    assert [L.batches_of(n) for n in (0, 1, 1 << 14, (1 << 14) + 1, 1 << 20)] == [1, 1, 1, 2, 7]


def test_native_and_empty(spark):
    assert L.drop_common_lines(documents(spark, [])).count() == 0
    out = L.drop_common_lines(documents(spark, [(1, "a")]))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def items():
    rng = random.Random(2)
    return [(k, " ".join(f"t{rng.randint(0, 400)}" for _ in range(n))) for k, n in enumerate([1, 3, 4, 5, 9, 15, 40, 57, 300])] + [(50, ""), (51, None), (52, "Dup Dup Dup Dup Dup Dup Dup")]


def test_partitions_ask_for_hits_of_their_own():
    from kineplate.llm import text as T

    assert [D.hits(m) for m in (1, 15, 31, 32, 63, 64, 300)] == [1, 1, 2, 3, 3, 5, 17]
    rng = random.Random(9)
    large = [f"w{rng.random()}" for _ in range(304)]
    index = D.ItemIndex.build(pa.array([1]), pa.array([" ".join(large)]), 5, 80)
    assert index.tables[:, 1].tolist() == [17] and len(index.values) == 300 - 240 + 17
    kept = set(index.values.tolist())
    runs = T.window_hashes(T.words(pa.array([" ".join(large)]))[0], 5).tolist()
    few = [" ".join(large[k : k + 5]) for k in [k for k, r in enumerate(runs) if r in kept][:16]]
    for texts, n in ((few, 16), ([" ".join(large[: 4 + 260])], 260)):
        hashes, at = T.words(pa.array([" | ".join(texts)]))
        assert [f[:2] for f in index.search(hashes, at)] == ([] if n < 17 else [(0, 0)])


def test_containment_matches_loop(spark, items, monkeypatch):
    rng = random.Random(4)
    rows = []
    for k, t in items:
        for loss in (0, 0.03, 0.1, 0.3):
            inside = [f"z{rng.random()}" if rng.random() < loss else w for w in (t or "").split()]
            rows.append((len(rows), " ".join([*(f"q{rng.randint(0, 999)}" for _ in range(rng.randint(0, 500))), *inside, "end"]).upper()))
    rows += [(900, None), (901, ""), (902, rows[8][1]), (902, rows[8][1]), (None, items[5][1]), (903, "dup dup dup dup dup")]
    want = Counter()
    for i, t in rows:
        for k, item in items:
            n = len(words(item))
            own = shingles(item, 5)
            have = shingles(t, min(n, 5)) if len(words(t)) >= min(n, 5) else set()
            common = len(own & have)
            if own and 100 * common >= 80 * len(own):
                want[i, k, len(own), common] += 1
    table = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    for block in (D.BLOCK, 200):
        monkeypatch.setattr(D, "BLOCK", block)
        got = D.contained_items(documents(spark, rows), table).collect()
        assert Counter((r.doc_id, r.item_id, r.item_shingles, r.common) for r in got) == want
    assert max(n for *_, n, _ in want) > 128  # more than one hit asked for
    clean = D.decontaminated(documents(spark, rows), table)
    assert clean.columns == documents(spark, []).columns and {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, *_ in want}
    odd = spark.createDataFrame([(None, items[5][1]), (7, items[5][1]), (7, items[5][1])], "item_id long, text string")
    assert Counter(r.item_id for r in D.contained_items(documents(spark, [(1, items[5][1])]), odd).collect()) == {None: 1, 7: 2}
    assert D.contained_items(documents(spark, rows), table.limit(0)).count() == 0 == D.contained_items(documents(spark, []), table).count()
