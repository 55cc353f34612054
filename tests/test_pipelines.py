"""Analyses end to end on planes, streams, and the registered queries against their SQL."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.operators import changepoint as P
from kineplate.operators import classifier as K
from kineplate.plans import pipelines, queries
from kineplate.streaming import online

PLANES = "pos int, roi int, stack_t int, t int, channel int, z int, height int, width int, pixels array<double>"


def planes(spark):
    rng = np.random.default_rng(0)
    rows = []
    for pos in (1, 2):
        for roi in range(4):
            for t in range(8):
                bright = 5.0 if not (pos == 2 and roi < 2 and t >= 4) else 500.0
                for channel in (0, 1):
                    image = rng.integers(10, 13, (12, 12)).astype(float)
                    if channel == 1:
                        image[3:8, 3:8] += bright
                    rows.append((pos, roi, t, t, channel, 0, 12, 12, image.ravel().tolist()))
    return spark.createDataFrame(rows, PLANES)


@pytest.fixture
def mapping(spark):
    return spark.createDataFrame([(0, "Control", [1], [1], 0), (1, "Effector 5:1", [2], [1], 0)], "sample_idx int, name string, positions array<int>, signal array<int>, segmentation int")


def test_death_reporter(spark, mapping):
    out = pipelines.death_reporter(planes(spark), mapping, 5.0)
    dead = {(r.pos, r.roi): r.death_time for r in out["reporter_death_times"].collect()}
    assert dead == {(p, r): 4 if p == 2 and r < 2 else None for p in (1, 2) for r in range(4)}
    curve = {(r.sample, r.t): r.pct_viable for r in out["reporter_kill_curve"].collect()}
    assert curve["Control", 7] == 100 and curve["Effector 5:1", 3] == 100 and curve["Effector 5:1", 4] == 50
    assert out["traces"].count() == 64 and out["summary_curve"].count() == 16 and out["survival_figure"].count() == 16 and out["death_histogram"].first().n == 2


def test_engagement(spark, mapping):
    out = pipelines.engagement(planes(spark), mapping, 2.75)
    assert out["engagement"].count() == 64 and out["engagement_summary"].count() == 8
    with pytest.raises(Exception, match="no sample"):
        pipelines.engagement(planes(spark), mapping.where("sample_idx = 0"), 1.0)["engagement"].collect()


def test_predict_and_infer(spark):
    names = spark.createDataFrame([(1, "A"), (2, "B")], "pos int, sample string")

    def scorer(images):
        level = images.mean(1)
        return np.stack([level, np.full(len(level), 50.0)], 1)

    out = pipelines.predict(planes(spark), scorer, lambda p: p.withColumn("input", F.col("pixels").cast("array<float>")), names, 1)
    got = {(r.pos, r.crop): r.death_time for r in out["classifier_death_times"].collect()}
    assert got == {(p, r): 3 if p == 2 and r < 2 else 7 for p in (1, 2) for r in range(4)}
    traces = planes(spark).where("channel = 1").select("pos", "roi", "t", F.aggregate("pixels", F.lit(0.0), lambda s, x: s + x).alias("v"))
    cells = pipelines.infer_cells(traces, traces.select("pos", "roi", "t", (F.col("v") > 5000).cast("double").alias("p")))
    assert cells.count() == 8 and all(len(r.toto_raw) == r.frame_count == 8 for r in cells.collect())
    fit = pipelines.movie_viability(spark.createDataFrame([(1, t, 1.0 if t < 3 else 0.0) for t in range(6)], "roi int, t int, s double"))["fit"].first()
    assert fit.first_dead_frame == 3


def run_stream(spark, tmp_path, batches, ddl, operator, name):
    source = tmp_path / name
    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, ddl).coalesce(1).write.parquet(f"{source}/b{k}")
        for f in (source / f"b{k}").glob("part*"):
            os.utime(f, (k + 1, k + 1))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    query = operator(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c-{name}").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_match_batch(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(0, "A", c, t, bool(rng.random() < 0.8)) for c in range(5) for t in range(12)]
    got = run_stream(spark, tmp_path, [[r for r in rows if r[3] // 4 == k] for k in range(3)], online.LATCH, online.latch, "latch")
    want = K.clean_monotone(spark.createDataFrame(rows, online.LATCH))
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    rows = [(c, t, float(rng.random())) for c in range(3) for t in range(12)]
    ddl = "roi long, t int, s double"
    got = run_stream(spark, tmp_path, [[r for r in rows if r[1] // 5 == k] for k in range(3)], ddl, lambda s: online.smooth(s, 4), "smooth")
    want = P.smooth(spark.createDataFrame(rows, ddl), ["roi"], 4)
    assert np.allclose(*(np.array(sorted(map(tuple, x.select("roi", "t", "smoothed").collect()))) for x in (got, want)))


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["d1_monotone_clean", "d3_death_times", "a9_classifier_kill_curve", "d8_viability_calls", "a8_survival_curve", "d20_step_fit", "v2_knn_votes", "i1_otsu"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)

    def norm(rows):
        return sorted(str([round(x, 4) + 0.0 if isinstance(x, float) else x for x in r]) for r in rows)

    assert norm(tuple(r) for r in got.select(*columns).collect()) == norm(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
