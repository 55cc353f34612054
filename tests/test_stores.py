"""Label store, reference collections and embedding cache: round trips, repeats, errors."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.sources import stores as S

KEYS = "position string, roi_id long, death_frame int"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_label_store(spark, tmp_path):
    path = str(tmp_path / "labels")
    assert S.label_store(spark, path).count() == 0
    S.put_labels(spark, path, spark.createDataFrame([(f"Pos{p}", r, r) for p in range(4) for r in range(5)], KEYS), 10)
    before = files(path)
    S.put_labels(spark, path, spark.createDataFrame([("Pos2", 1, 9), ("Pos2", 77, 0), ("Pos9", 3, 10), ("Pos2", 1, 8)], KEYS), 10)
    want = {(f"Pos{p}", r): r for p in range(4) for r in range(5)} | {("Pos2", 1): 9, ("Pos2", 77): 0, ("Pos9", 3): 10}
    assert {(r.position, r.roi_id): r.death_frame for r in S.label_store(spark, path).collect()} == want
    after = files(path)
    kept = {f: t for f, t in before.items() if "position=Pos2" not in f}
    assert {f: after.get(f) for f in kept} == kept and len(after) == 5  # a file per position, others untouched
    with pytest.raises(Exception, match="outside the movie"):
        S.put_labels(spark, path, spark.createDataFrame([("Pos0", 0, 11)], KEYS), 10)
    assert files(path) == after


def folder(tmp_path, name="c", **changes):
    at = tmp_path / name
    at.mkdir()
    rows = [{"id": f"i{k}", "group": f"g{k // 2}", "split": "evaluation" if k > 9 else "reference", "label": ["viable", "dead", "uncertain"][k % 3]} for k in range(12)]
    vectors = np.random.default_rng(1).standard_normal((12, 5)).astype(changes.pop("kind", np.float32))
    about = {"model_id": "m", "revision": "r", "ids": [r["id"] for r in rows]} | changes.pop("about", {})
    for k, v in changes.pop("rows", {}).items():
        rows[k] |= v
    vectors = changes.pop("vectors", lambda v: v)(vectors)
    (at / "manifest.json").write_text(json.dumps({"rows": rows}))
    (at / "embeddings.json").write_text(json.dumps(about))
    np.save(at / "embeddings.npy", vectors)
    return str(at), rows, vectors


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_collection(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(S, "ROWS", 12)
    at, rows, vectors = folder(tmp_path, kind=kind)
    got = S.read_collection(spark, at, "m", "r", 5).collect()
    want = [(k, r["id"], r["label"], r["group"]) for k, r in enumerate(rows) if r["split"] == "reference" and r["label"] != "uncertain"]
    assert sorted((r.ref_idx, r.id, r.label, r.group) for r in got) == want
    assert all(np.allclose(r.vector, vectors[r.ref_idx].astype(np.float32)) for r in got)
    store = str(tmp_path / "store")
    found = S.read_collection(spark, at, "m", "r", 5)
    assert S.add_collection(spark, store, "one", found) and not S.add_collection(spark, store, "one", found)
    assert S.add_collection(spark, store, "two", found.where("ref_idx > 0")) and S.collection(spark, store, "one").count() == len(want)
    with pytest.raises(ValueError, match="other contents"):
        S.add_collection(spark, store, "one", found.where("ref_idx > 0"))


@pytest.mark.parametrize(("changes", "text"), [
    ({"about": {"revision": "x"}}, "model or revision"), ({"about": {"ids": ["i1", "i0", *(f"i{k}" for k in range(2, 12))]}}, "order"), ({"about": {"ids": ["i0"]}}, "order"),
    ({"vectors": lambda v: v[:-1]}, "number of rows"), ({"vectors": lambda v: v[:, :4]}, "5 components"), ({"vectors": lambda v: v * (np.arange(12) != 3)[:, None]}, "not zero"),
    ({"vectors": lambda v: np.where(v == v[2, 1], np.nan, v)}, "finite"), ({"rows": {10: {"group": "g0"}}}, "a group occurs"), ({"rows": {k: {"label": "viable"} for k in range(12)}}, "viable and dead"),
    ({"vectors": lambda v: np.asfortranarray(v)}, "rows of floats"),
])
def test_bad_collections(spark, tmp_path, changes, text):
    at, _, _ = folder(tmp_path, **changes)
    with pytest.raises(ValueError, match=text):
        S.read_collection(spark, at, "m", "r", 5)


def test_cache_encodes_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), spark.sparkContext.accumulator(0)

    def encoder(contents):
        calls.add(len(contents))
        return [[float(len(c)), float(c[0])] for c in contents]

    images = spark.createDataFrame([(str(k), bytes([k % 7] * (k % 5 + 1))) for k in range(60)], "id string, content binary")
    want = {str(k): [k % 5 + 1.0, float(k % 7)] for k in range(60)}
    for k in range(3):
        got = S.embed_images(spark, images, path, encoder, "e1", 4)
        assert {r.id: list(r.vector) for r in got.collect()} == want and calls.value == 35, k
    S.embed_images(spark, images.where("id < 10"), path, encoder, "e2").count()
    assert calls.value > 35 and S.embedding_cache(spark, path, "e1").count() == 35
    before = files(path)
    S.embed_images(spark, images.limit(0).unionByName(images.select("id", F.lit(b"new").alias("content"))), path, encoder, "e1").count()
    assert len(files(path)) == len(before) + 1 and before.items() <= files(path).items()
