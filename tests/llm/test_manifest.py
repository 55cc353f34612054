"""The manifest against a recursive tree in plain Python."""

import functools
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kineplate.llm import manifest as M
from kineplate.llm.queries import op11_merkle_manifest
from kineplate.llm.workspace import Workspace

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, proof of each node as [(left, right)])."""
    if len(nodes) == 1:
        return nodes[0], [[]]
    runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
    root, above = tree([sha("".join(r)) for r in runs])
    return root, [[("".join(r[:k]), "".join(r[k + 1 :]))] + above[j] for j, r in enumerate(runs) for k in range(len(r))]


def want(rows):
    """Counter of (doc_id, leaf, subroot, root, proof hash, folded root) of rows as FIELDS."""
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[1]].append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    made = {s: tree([leaf(r) for r in trees[s]]) for s in sources}
    root, outer = tree([made[s][0] for s in sources]) if rows else ("", [])
    out = Counter()
    for s, above in zip(sources, outer, strict=True):
        for r, inner in zip(trees[s], made[s][1], strict=True):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                now = (*r[:4], "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]))
            node, proof = leaf(now), inner + above
            for left, right in proof:
                node = sha(left + node + right)
            out[r[0], leaf(r), made[s][0], root, sha("".join(a + b for a, b in proof)), node] += 1
    return out


@pytest.fixture
def rows():
    rng = random.Random(5)
    hot = [(i, "hot", "en", rng.randint(0, 9), f"Text {i} É漢") for i in range(900)]
    few = [(2000 + i, f"s{i % 300}", None, None, rng.choice([None, "", "A b", "x" * 5000])) for i in range(330)]
    odd = [(None, None, None, None, None), (None, "", "de", 1, "Null id"), (5, None, "fr", 2, "Null source"), (5, "hot", "fr", 2, "same id"), (-7, "ﬀ", "fr", 2, "Z" * 200_000), (8, "𝒳", "a", 3, "b")]
    return hot + few + odd + [hot[3]] * 40 + [(77, "one", "x", 1, "Copies")] * 300


@pytest.mark.parametrize("depth", [1, 3])
def test_trees(spark, rows, depth, monkeypatch, tmp_path):
    monkeypatch.setattr(M, "manifest", functools.partial(M.manifest, depth=depth))
    rng = random.Random(2)
    spark.createDataFrame(rng.sample(rows, len(rows)), "doc_id long, source string, lang string, n_chars long, text string").withColumn("pos", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("node", F.lit(None).cast("int")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:6] for r in got) == want(rows)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 16, 17])
def test_small_tables(spark, n, tmp_path):
    rows = [(i, "s", "en", 1, f"T{i}") for i in range(n)]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_merkle_manifest(spark, str(tmp_path)).collect()
    assert Counter(tuple(r)[:6] for r in got) == want(rows)


def test_chunks_are_whole_blocks(monkeypatch):
    monkeypatch.setattr(M, "CHUNK", 10)
    group, block = [None] * 7 + [""] * 9 + ["a"] * 25 + ["b"], [0] * 16 + [0] * 12 + [1] * 13 + [0]
    table = pa.table({"group": pa.array(group), "block": pa.array(block), "pos": pa.array(range(len(block)))})
    chunks = list(M._chunks(iter(table.to_batches(max_chunksize=4))))
    assert pa.concat_tables([t for t, _ in chunks]) == table and len(chunks) > 2
    for t, of in chunks:
        keys = list(zip(t.column("group").to_pylist(), t.column("block").to_pylist(), strict=True))
        assert len(set(keys)) == of[-1] + 1 and of[0] == 0
    ends = [(t.column("group")[-1].as_py(), t.column("block")[-1].as_py()) for t, _ in chunks]
    assert len(set(ends)) == len(ends)
    assert not list(M._chunks(iter([])))


def test_manifest_of_any_fields(spark):
    docs = spark.createDataFrame([("k1", 3, 1.5), ("k0", 3, None)], "name string, part int, `x.y` double")
    with Workspace(spark, "test") as ws:
        out = M.manifest(ws, docs, ("name", "x.y"), "name", "part", {"twice": F.col("part") * 2}).withColumn("back", M.folded(F.col("leaf"), F.col("proof"))).collect()
    a, b = leaf(("k0", None)), leaf(("k1", 1.5))
    assert {(r.name, r.part, r.leaf, r.twice) for r in out} == {("k0", "3", a, 6), ("k1", "3", b, 6)}
    assert {r.root for r in out} == {r.back for r in out} == {sha(a + b)}
