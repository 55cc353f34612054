"""Readers, writers and their errors."""

import io
import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kineplate.operators import aggregates as A
from kineplate.operators import scoring as G
from kineplate.sources import tables as B
from kineplate.sources import tiff


@pytest.fixture
def workspace(tmp_path):
    folder = tmp_path / "roi/Pos7"
    folder.mkdir(parents=True)
    index = {"position": 7, "axisOrder": "tczyx", "channelCount": 2, "timeCount": 2, "zCount": 1, "timeIndices": [3, 8], "rois": [{"roi": 3, "fileName": "Roi3.tif", "bbox": {"roi": 3, "x": 0, "y": 0, "w": 2, "h": 2}}]}
    (folder / "index.json").write_text(json.dumps(index))
    pages = [np.full((2, 2), 255, np.uint8), np.array([[4, 9], [16, 25]], np.uint8), np.full((2, 2), 255, np.uint8), np.full((2, 2), 10, np.uint8)]
    (folder / "Roi3.tif").write_bytes(tiff.encode(pages))
    return tmp_path


def test_stack_to_fluorescence(spark, workspace):
    index = B.read_index(spark, f"{workspace}/roi/Pos7/index.json")
    assert B.total_frames(index).first().frames == 2
    planes = tiff.read_stacks(spark, str(workspace), index, channels=[1])
    channels = spark.createDataFrame([(7, 1)], "pos int, channel int")
    rows = A.fluorescence(planes, channels).orderBy("t").collect()
    assert [(r.t, r.area, r.sum, round(r.background, 6), round(r.corrected, 6)) for r in rows] == [(3, 4, 54.0, 5.5, 32.0), (8, 4, 40.0, 10.0, 0.0)]


@pytest.mark.parametrize("order", "<>")
def test_tiff_round_trip(order):
    pages = [np.arange(12, dtype=np.uint16).reshape(3, 4) * 5000, np.zeros((3, 4), np.uint16)]
    stack = tiff.Stack(tiff.encode(pages, order))
    assert all((stack.read(k) == p).all() for k, p in enumerate(pages)) and stack.shape(0) == (3, 4)
    with pytest.raises(ValueError, match="TIFF"):
        tiff.Stack(b"nothing like it")
    info = tiff.movie_info(tiff.encode(pages), time_indices=[7, 19])
    assert info["frame_ids"] == [7, 19]
    with pytest.raises(ValueError):
        tiff.movie_info(tiff.encode(pages), time_indices=[19, 7])


def test_bad_indices(spark, tmp_path):
    for change in ({"axisOrder": "ZYX"}, {"rois": []}, {"timeIndices": [1]}):
        index = {"position": 1, "axisOrder": "TCZYX", "channelCount": 1, "timeCount": 2, "zCount": 1, "rois": [{"roi": 0, "fileName": "Roi0.tif", "bbox": {"w": 1, "h": 1}}]} | change
        (tmp_path / "index.json").write_text(json.dumps(index))
        with pytest.raises(Exception, match="axis order|needs ROIs|timeIndices"):
            B.read_index(spark, f"{tmp_path}/index.json").collect()


def test_assay(spark, tmp_path):
    (tmp_path / "assay.json").write_text(json.dumps({"interval": {"value": 30, "unit": "second"}, "analysis": {"channels": {"signal": [2], "segmentation": 0}}, "samples": [{"name": "A", "positions": "1,3:5,10:20:5,3"}]}))
    row = B.read_assay(spark, f"{tmp_path}/assay.json").first()
    assert row.positions == [1, 3, 4, 5, 10, 15, 20] and row.interval_minutes == pytest.approx(0.5)


def test_shards_and_traces(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"s{k}/results").mkdir(parents=True)
        (tmp_path / f"s{k}/results/predictions.csv").write_text(f"t,crop,p_dead,label,pos,sample\n0,{k},0.1,true,1,A\n")
    got = B.read_shards(spark, [f"{tmp_path}/s{k}" for k in (1, 2, 3)], "results/predictions.csv", B.S.PREDICTIONS)
    assert sorted(r.crop for r in got.collect()) == [1, 2]
    with pytest.raises(ValueError):
        B.read_shards(spark, [str(tmp_path)], "results/predictions.csv", B.S.PREDICTIONS)
    (tmp_path / "analysis/Pos7").mkdir(parents=True)
    (tmp_path / "analysis/Pos7/ch2.csv").write_text("roi,t,area,background,sum,corrected\n1,0,4,1.3,46,40.8\n")
    row = B.read_traces(spark, str(tmp_path)).first()
    assert (row.pos, row.channel, row.corrected) == (7, 2, 40.8)


def test_labels_and_writers(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps([{"position": "Pos0", "roi_id": 1, "death_frame": d, "labeled_at": "x"} for d in (5, 9)]))
    labels = B.read_labels(spark, f"{tmp_path}/labels.json")
    assert labels.first().death_frame == 9
    new = spark.createDataFrame([("Pos0", 2, 4)], "position string, roi_id int, death_frame int")
    assert [r.death_frame for r in B.upsert_labels(labels, new, 241).collect()] == [9, 4]
    with pytest.raises(Exception, match="outside"):
        B.upsert_labels(labels, new.replace(4, 999), 241).collect()
    df = spark.createDataFrame([(1, 2.0, "<x>", True, None), (2, float("nan"), "", False, 0.1)], "a int, b double, c string, d boolean, e double")
    B.write_csv(df.coalesce(1), f"{tmp_path}/out")
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text[0] == "a,b,c,d,e" and text[1].startswith("1,2,<x>,true") and text[2].startswith("2,nan,")
    books = {r.k: bytes(r.content) for r in B.workbooks(df.withColumn("k", F.lit("one")), "k").collect()}
    sheet = zipfile.ZipFile(io.BytesIO(books["one"])).read("xl/worksheets/sheet1.xml").decode()
    assert "<v>1</v>" in sheet and "&lt;x&gt;" in sheet
    assert json.loads(B.json_rows(spark.createDataFrame([(1, None, [0.5])], "a int, b double, c array<double>")).first().json) == {"a": 1, "b": None, "c": [0.5]}
    for bad in ([(float("nan"), None)], [(1.0, [float("inf")])]):
        with pytest.raises(Exception, match="no JSON"):
            B.json_rows(spark.createDataFrame(bad, "a double, c array<double>")).collect()


def test_scoring(spark):
    assert list(map(len, G.batched(range(5), 2))) == [2, 2, 1]
    frames = spark.createDataFrame([(p, t) for p in (1, 2) for t in range(5)], "pos int, t int")
    assert sorted(r.batch for r in G.batch_numbers(frames, ["pos"], 2).collect()) == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    heard = []
    assert G.run_cancellable(spark, lambda: frames.repartition(3, "t").count(), lambda *x: heard.append(x)) == 10 and heard[-1][0] <= heard[-1][1]
    with pytest.raises(G.Cancelled):
        G.run_cancellable(spark, lambda: 1 / 0, cancelled=lambda: True)
    slow = spark.range(0, 10**13, 1, 2).selectExpr("sum(hash(id))")
    calls = iter([False, False, True])
    with pytest.raises(G.Cancelled):
        G.run_cancellable(spark, slow.collect, cancelled=lambda: next(calls, True), poll=0.5)
    with pytest.raises(ValueError):
        G.as_logits(np.zeros((1, 2)), 2)
    assert G.as_logits(np.array([2.0, 0.0]), 1).shape == (1, 2) == G.as_logits(np.zeros((1, 2, 1, 1)), 1).shape
    images = spark.createDataFrame([("a", b"1"), ("b", b"1"), ("c", b"2")], "id string, content binary")
    cache = spark.createDataFrame([], "identity string, sha string, vector array<float>")
    vectors, made = G.embed_with_cache(images, cache, lambda contents: [[float(c)] for c in contents], G.cache_key("m", "1", "p"))
    assert {r.id: r.vector for r in vectors.collect()} == {"a": [1.0], "b": [1.0], "c": [2.0]} and made.count() == 2
    assert G.embed_with_cache(images, made, None, G.cache_key("m", "1", "p"))[0].count() == 3


def test_source_queries_match_sql(spark):
    import duckdb

    import __spark_entry__ as entry

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("the driver's tables are not here")
    con = duckdb.connect()
    for name in ("nation", "region", "supplier", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    known, sql = entry.queries(), entry.oracle_sql()
    for name in ("s2_index_scan", "s3_lenient_index", "s5_s7_stack_planes", "s8_s9_selected_plane", "e4_e5_frame_count", "s16_s17_traces", "s18_engagement_files", "s19_assay", "s24_shards", "s15_workbooks", "o5_newest_checkpoint"):
        got = known[name](spark, data)
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({sql[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want)), name
