"""The format of stacks: pushed filters, page ranges, movies, errors."""

import json
import struct

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from kineplate.sources import stack_source as S
from kineplate.sources import tiff

T, C, Z, H, W = 4, 3, 2, 5, 6


def pixel(roi, t, c, z):
    return (np.arange(H * W) + 1000 * roi + 100 * t + 10 * c + z).astype(np.uint16).reshape(H, W)


@pytest.fixture
def folder(tmp_path):
    for pos in (0, 1):
        at = tmp_path / "roi" / f"Pos{pos}"
        at.mkdir(parents=True)
        index = {"position": pos, "axisOrder": "tczyx", "timeCount": T, "channelCount": C, "zCount": Z, "timeIndices": [5 * t for t in range(T)], "rois": [{"roi": r, "fileName": f"Roi{r}.tif", "bbox": {"w": W, "h": H}} for r in (3, 4)]}
        (at / "index.json").write_text(json.dumps(index))
        for r in (3, 4):
            (at / f"Roi{r}.tif").write_bytes(tiff.encode([pixel(r, t, c, z) for t in range(T) for c in range(C) for z in range(Z)], "<>"[pos]))
    return tmp_path


def big_stack(path, pages, h, w, gap=0):
    """A BigTIFF of 16-bit pages, each with its number as first pixel; pages lie `gap` bytes apart, holes between them."""
    with open(path, "wb") as f:
        f.write(b"II" + struct.pack("<HHHQ", 43, 8, 0, 16))
        at = 16
        for k in range(pages):
            data = at + 8 + 20 * 9 + 8
            after = data + h * w * 2 + gap
            entries = [(256, 4, w), (257, 4, h), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 16, data), (277, 3, 1), (278, 4, h), (279, 4, h * w * 2)]
            f.seek(at)
            f.write(struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQQ", tag, kind, 1, v) for tag, kind, v in entries) + struct.pack("<Q", after if k + 1 < pages else 0))
            f.write(struct.pack("<H", k))
            f.truncate(after)
            at = after
    return str(path)


def test_all_planes(spark, folder):
    for options in ({}, {"partbytes": 3 * H * W * 2}):
        rows = S.planes(spark, str(folder), **options).collect()
        assert len(rows) == 4 * T * C * Z
        for r in rows:
            assert r.pixels == pixel(r.roi, r.stack_t, r.channel, r.z).ravel().tolist() and r.t == 5 * r.stack_t and (r.height, r.width) == (H, W)
    assert S.planes(spark, str(folder), partbytes=3 * H * W * 2).rdd.getNumPartitions() == 4 * T * C * Z // 3


def test_options_decide_what_is_opened(spark, folder):
    # the other position's stacks are broken
    for r in (3, 4):
        (folder / f"roi/Pos0/Roi{r}.tif").write_bytes(b"broken")
    rows = S.planes(spark, str(folder), {"pos": [1], "roi": [4, 9], "t": range(5, 15), "channel": [2]}, z="0:0").where("stack_t > 0")
    assert sorted((r.pos, r.roi, r.t, r.channel, r.z) for r in rows.collect()) == [(1, 4, 5, 2, 0), (1, 4, 10, 2, 0)]
    assert S.planes(spark, str(folder), {"pos": [1]}).count() == 2 * T * C * Z
    with pytest.raises(Exception, match="TIFF"):
        S.planes(spark, str(folder)).count()


def test_one_frame_with_many_filters(spark, folder):
    rows = S.planes(spark, str(folder))
    assert [rows.where(f"channel = {c}").count() for c in range(4)] == [4 * T * Z] * 3 + [0] and rows.count() == 4 * T * C * Z
    assert rows.where("t = 0").alias("a").join(rows.alias("b"), ["pos", "roi", "channel", "z"]).count() == 4 * T * C * Z


def test_filters_are_pushed_with_sparks_flag(spark, folder):
    for r in (3, 4):
        (folder / f"roi/Pos0/Roi{r}.tif").write_bytes(b"broken")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = S.planes(spark, str(folder), pushdown="true").where("pos = 1 AND roi IN (4, 9) AND t >= 5 AND t < 15 AND channel = 2 AND z <> 1")
        pushed = rows._jdf.queryExecution().explainString(rows.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "PushedFilters" in pushed and "EqualTo(channel,2)" in pushed and "LessThan(t,15)" in pushed
        assert sorted((r.pos, r.roi, r.t, r.channel, r.z) for r in rows.collect()) == [(1, 4, 5, 2, 0), (1, 4, 10, 2, 0)]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_filter_decides_which_pages_are_read():
    reader = S.PushedReader({"path": "x"})
    from pyspark.sql import datasource as D

    rest = list(reader.pushFilters([D.EqualTo(("channel",), 1), D.LessThan(("t",), 3), D.GreaterThan(("t",), 0), D.Not(D.EqualTo(("z",), 0)), D.EqualTo(("path",), "p")]))
    assert [type(f).__name__ for f in rest] == ["Not", "EqualTo"]
    assert [t for t in range(9) if reader.pick.holds(t=t, channel=1)] == [1, 2] and not reader.pick.holds(channel=0)


def test_three_gigabytes_by_several_tasks(spark, tmp_path):
    path = big_stack(tmp_path / "large.tif", 48, 1000, 1000, gap=64 << 20)
    assert (tmp_path / "large.tif").stat().st_size > 3 << 30
    rows = S.planes(spark, path, channels=2)
    assert rows.rdd.getNumPartitions() == 3
    found = S.planes(spark, path, {"t": [0, 23]}, channels=2).select("t", "channel", F.col("pixels")[0].alias("first")).collect()
    assert {(r.t, r.channel): r.first for r in found} == {(0, 0): 0, (0, 1): 1, (23, 0): 46, (23, 1): 47}


def test_errors(spark, folder):
    def fails(text, path=folder):
        with pytest.raises((PythonException, Exception), match=text):
            S.planes(spark, str(path)).count()

    fails("no stack and no folder", folder / "nowhere")
    at = folder / "roi/Pos0"
    whole = (at / "Roi3.tif").read_bytes()
    (at / "Roi3.tif").write_bytes(tiff.encode([pixel(3, 0, 0, 0)] * (T * C * Z - 1)))
    fails("pages for 4 x 3 x 2")
    (at / "Roi3.tif").write_bytes(tiff.encode([np.zeros((H, W + 1), np.uint8)] * (T * C * Z)))
    fails("is 5 x 7")
    (at / "Roi3.tif").unlink()
    fails("no file")
    (at / "Roi3.tif").write_bytes(whole)
    (at / "loose.tif").write_bytes(tiff.encode([pixel(0, 0, 0, 0)] * 2))
    fails("neither an index nor axes")
    assert S.planes(spark, str(at / "loose.tif"), channels=2).count() == 2
    empty = folder / "empty"
    empty.mkdir()
    assert S.planes(spark, str(empty)).count() == 0


def test_axes_of_descriptions():
    assert S.described(b'{"axes": "TCYX", "shape": [7, 2, 5, 5]}\0') == (7, 2, 1)
    assert S.described(b"ImageJ=1.1\nimages=6\nchannels=2\nframes=3\n") == (3, 2, 1)
    assert S.described(b"slices=4\nchannels=2\n") is None and S.described(b"") is None and S.described(b"{") is None
    with pytest.raises(ValueError):
        S.described(b'{"axes": "QYX", "shape": [7, 5, 5]}')


@pytest.mark.parametrize("contrast", ["frame", "baseline"])
def test_movie(spark, folder, contrast):
    rows = S.movie_frames(spark, str(folder / "roi/Pos1/Roi3.tif"), channel=1, z=1, stride=3, contrast=contrast).collect()
    first = np.percentile(pixel(3, 0, 1, 1), [1, 99])
    assert sorted(r.frame_id for r in rows) == [0, 15]
    for r in rows:
        x = pixel(3, r.stack_t, 1, 1).astype(float).ravel()
        low, high = first if contrast == "baseline" else np.percentile(x, [1, 99])
        assert r.gray == (np.clip((x - low) / max(high - low, 1e-6), 0, 1) * 255).astype(int).tolist()


def test_movie_limits(spark, folder, tmp_path):
    for kwargs, text in (({"channel": 3}, "channel outside"), ({"z": 2}, "z outside")):
        with pytest.raises(Exception, match=text):
            S.movie_frames(spark, str(folder / "roi/Pos1/Roi3.tif"), **kwargs).count()
    with pytest.raises(Exception, match="megapixel"):
        S.movie_frames(spark, big_stack(tmp_path / "wide.tif", 1, 1001, 1000)).count()
    with pytest.raises(Exception, match="4096 frames"):
        S.movie_frames(spark, big_stack(tmp_path / "long.tif", 4097, 1, 1), channels=1).count()
    with pytest.raises(ValueError):
        S.movie_frames(spark, "x", contrast="other")
    index = json.loads((folder / "roi/Pos1/index.json").read_text())
    (folder / "roi/Pos1/index.json").write_text(json.dumps(index | {"timeIndices": [0, 5, 5, 6]}))
    with pytest.raises(Exception, match="must rise"):
        S.movie_frames(spark, str(folder / "roi/Pos1")).count()
