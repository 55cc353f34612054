"""Temporal features on streams: any split into micro-batches gives what the batch operators give."""

import time

import numpy as np
import pytest

from kineplate.operators import vectors as V
from kineplate.streaming import temporal as S

DDL = "`group` string, frame long, id string, vector array<double>"


@pytest.fixture
def rows():
    rng = np.random.default_rng(2)
    return [(g, f, f"{g}-{f}", rng.standard_normal(5).tolist()) for g in ("a", "b", None, "c") for f in range(1 if g == "c" else 9)]


@pytest.fixture
def stored(spark):
    for k, v in S.settings().items():
        spark.conf.set(k, v)
    yield
    for k in S.settings():
        spark.conf.unset(k)


def stream(spark, folder, name, batches, operator):
    source = folder / "in"
    got = []

    def keep(df, k):
        got.append(df.collect())

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, DDL).coalesce(1).write.parquet(str(source / f"{k:03}"))
        rows = spark.readStream.schema(DDL).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(source))
        query = operator(rows).writeStream.foreachBatch(keep).option("checkpointLocation", str(folder / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    return {(r.group, r.frame): r.vector for part in got for r in part}, sum(map(len, got))


@pytest.mark.parametrize("cuts", [[9], [2, 3, 7, 9]])
def test_streams_equal_batches(spark, rows, tmp_path, stored, cuts):
    df = spark.createDataFrame(rows, DDL)
    for name, one, all_ in (("mean", lambda d: S.trailing_mean(d, 3), lambda d: V.trailing_mean(d, 3)), ("delta", S.baseline_delta, V.baseline_delta)):
        want = {(r.group, r.frame): r.vector for r in all_(df).collect()}
        batches = [[r for r in rows if low <= r[1] < high] for low, high in zip([0, *cuts], cuts)]
        (tmp_path / name).mkdir()
        got, n = stream(spark, tmp_path / name, "c", batches, one)
        assert got.keys() == want.keys() and n == len(rows)
        assert all(np.allclose(got[k], want[k]) for k in want)


def test_late_and_repeated_frames_are_left_out(spark, rows, tmp_path, stored):
    one = [r for r in rows if r[0] == "a"]
    got, n = stream(spark, tmp_path, "c", [one[:5] + one[3:5], one[2:7], one[7:]], lambda d: S.trailing_mean(d, 4))
    want = {(r.group, r.frame): r.vector for r in V.trailing_mean(spark.createDataFrame(one, DDL), 4).collect()}
    assert n == len(one) and all(np.allclose(got[k], want[k]) for k in want)


def test_idle_movies_are_dropped(spark, rows, tmp_path, stored):
    one = [r for r in rows if r[0] == "a"]
    batches = [one[:3], [r for r in rows if r[0] == "b"], one[3:5]]

    def slow():
        for b in batches:
            yield b
            time.sleep(1.5)

    got, _ = stream(spark, tmp_path, "c", slow(), lambda d: S.baseline_delta(d, idle=1000))
    new = V.baseline_delta(spark.createDataFrame(one[3:5], DDL)).collect()
    assert all(np.allclose(got[r.group, r.frame], r.vector) for r in new)


def test_bad_vectors(spark, tmp_path, stored):
    for k, bad in enumerate(([0.0, 0.0], [float("nan"), 1.0], [])):
        (tmp_path / str(k)).mkdir()
        with pytest.raises(Exception, match="vectors must be"):
            stream(spark, tmp_path / str(k), "c", [[("a", 0, "x", bad)]], S.baseline_delta)
    with pytest.raises(ValueError):
        S.trailing_mean(None, 0)
