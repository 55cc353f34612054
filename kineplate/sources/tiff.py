"""Multi-page TIFF stacks: baseline, uncompressed, 8 or 16 bits of gray, either byte order.

Files are listed and read by Spark's binaryFile source, so any file system that
Spark reads will do; a page that no filter asks for is not decoded.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tags of the format (fixed values).
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS, SAMPLE_FORMAT = 256, 257, 258, 259, 273, 277, 278, 279, 339
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_FORMS = {1: "B", 3: "H", 4: "I"}


class Stack:
    """The pages of a file; only their directories are read at first."""

    def __init__(self, raw: bytes):
        self.raw = raw
        order = {b"II": "<", b"MM": ">"}.get(raw[:2])
        if order is None or struct.unpack(f"{order}H", raw[2:4])[0] != 42:
            raise ValueError("not a baseline TIFF")
        self.order, self.pages, at = order, [], struct.unpack(f"{order}I", raw[4:8])[0]
        seen = set()
        while at and at not in seen:
            seen.add(at)
            count = struct.unpack_from(f"{order}H", raw, at)[0]
            self.pages.append(dict(self._entry(at + 2 + 12 * k) for k in range(count)))
            at = struct.unpack_from(f"{order}I", raw, at + 2 + 12 * count)[0]

    def _entry(self, at: int) -> tuple[int, tuple[int, ...]]:
        tag, kind, count = struct.unpack_from(f"{self.order}HHI", self.raw, at)
        if kind not in _FORMS:
            return tag, ()
        size = _SIZES[kind] * count
        where = at + 8 if size <= 4 else struct.unpack_from(f"{self.order}I", self.raw, at + 8)[0]
        return tag, struct.unpack_from(f"{self.order}{count}{_FORMS[kind]}", self.raw, where)

    def shape(self, page: int) -> tuple[int, int]:
        return self.pages[page][HEIGHT][0], self.pages[page][WIDTH][0]

    def read(self, page: int) -> np.ndarray:
        """A page as doubles."""
        tags = self.pages[page]
        bits = tags.get(BITS, (1,))[0]
        if bits not in (8, 16) or tags.get(COMPRESSION, (1,))[0] != 1 or tags.get(SAMPLES, (1,))[0] != 1 or tags.get(SAMPLE_FORMAT, (1,))[0] != 1:
            raise ValueError("only uncompressed gray pages of unsigned 8 or 16 bits are read")
        data = b"".join(self.raw[o : o + n] for o, n in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        h, w = self.shape(page)
        flat = np.frombuffer(data, f"{self.order}u{bits // 8}")
        if len(flat) != h * w:
            raise ValueError(f"page {page} has {len(flat)} pixels for {h} x {w}")
        return flat.reshape(h, w).astype(np.float64)


def encode(pages: Sequence[np.ndarray], order: str = "<") -> bytes:
    """A TIFF of unsigned 8- or 16-bit pages."""
    out = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        bits = page.dtype.itemsize * 8
        if page.dtype.kind != "u" or bits not in (8, 16):
            raise ValueError("pages must be unsigned 8 or 16 bits")
        data_at = len(out)
        out += page.astype(page.dtype.newbyteorder(order)).tobytes()
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        entries = [(WIDTH, 4, page.shape[1]), (HEIGHT, 4, page.shape[0]), (BITS, 3, bits), (COMPRESSION, 3, 1), (262, 3, 1), (OFFSETS, 4, data_at), (SAMPLES, 3, 1), (ROWS, 4, page.shape[0]), (COUNTS, 4, page.nbytes)]
        out += struct.pack(f"{order}H", len(entries))
        for tag, kind, value in entries:
            out += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}HH", value, 0) if kind == 3 else struct.pack(f"{order}I", value))
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


def page_number(frame: int, channel: int, z: int, channels: int, depth: int) -> int:
    """Page of a plane in time, channel, z order."""
    return (frame * channels + channel) * depth + z


def check_channel(channel: int, channels: int) -> int:
    """S9."""
    if not 0 <= channel < channels:
        raise ValueError(f"channel {channel} is outside 0..{channels - 1}")
    return channel


PLANES = "pos int, roi int, stack_t int, t int, channel int, z int, height int, width int, pixels array<double>"


def read_stacks(spark: SparkSession, workspace: str, rois: DataFrame, channels: Sequence[int] | None = None, frames: Sequence[int] | None = None, z: Sequence[int] | None = None) -> DataFrame:
    """One row per plane of every ROI file in workspace/roi/Pos*/ that rois lists.

    rois(pos, roi, axes sizes time_count, channel_count, z_count, time_indices,
    and box width and height or null). A ROI without a file, a page count other
    than T * C * Z and a page of another size are errors.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Roi*.tif").load(f"{workspace}/roi")
    named = files.select(F.regexp_extract("path", r"Pos(\d+)/Roi(\d+)\.tif$", 1).alias("p"), F.regexp_extract("path", r"Pos(\d+)/Roi(\d+)\.tif$", 2).alias("r"), "content").where("p <> ''")
    named = named.select(F.col("p").cast("int").alias("pos"), F.col("r").cast("int").alias("roi"), "content")
    rows = rois.select("pos", "roi", "time_count", "channel_count", "z_count", "time_indices", "width", "height").join(named, ["pos", "roi"], "left")
    missing = F.when(F.col("content").isNull(), F.raise_error(F.format_string("no file for Pos%d/Roi%d", "pos", "roi")).cast("binary")).otherwise(F.col("content"))
    rows = rows.select("pos", "roi", "time_count", "channel_count", "z_count", "time_indices", "width", "height", missing.alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stack, (t_n, c_n, z_n) = Stack(row["content"]), (row["time_count"], row["channel_count"], row["z_count"])
                if len(stack.pages) != t_n * c_n * z_n:
                    raise ValueError(f"Pos{row['pos']}/Roi{row['roi']} has {len(stack.pages)} pages for {t_n} x {c_n} x {z_n}")
                want_c = [check_channel(c, c_n) for c in channels] if channels is not None else range(c_n)
                kinds = [pa.int32()] * 8 + [pa.list_(pa.float64())]
                for f in frames if frames is not None else range(t_n):
                    for c in want_c:
                        for k in z if z is not None else range(z_n):
                            page = page_number(f, c, k, c_n, z_n)
                            if not 0 <= f < t_n or not 0 <= k < z_n:
                                raise ValueError("frame or z outside the stack")
                            h, w = stack.shape(page)
                            if row["width"] is not None and (h, w) != (row["height"], row["width"]):
                                raise ValueError(f"page {page} of Pos{row['pos']}/Roi{row['roi']} is {h} x {w}")
                            times = row["time_indices"]
                            made = (row["pos"], row["roi"], f, times[f] if times else f, c, k, h, w, stack.read(page).ravel())
                            # a plane at a time, so a worker holds the file and one plane of doubles
                            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(made, kinds, strict=True)], ["pos", "roi", "stack_t", "t", "channel", "z", "height", "width", "pixels"])

    return rows.mapInArrow(run, PLANES)


#: Limits of a movie that is handed in at once (fixed values).
MOVIE_PIXELS, MOVIE_FRAMES = 1_000_000, 4096


def movie_info(raw: bytes, channels: int = 1, depth: int = 1, time_indices: list[int] | None = None, stride: int = 1) -> dict[str, object]:
    """Frames, their ids and sizes of a movie in memory, every `stride`-th frame kept; too large movies and wrong frame ids are errors."""
    stack = Stack(raw)
    frames, rest = divmod(len(stack.pages), channels * depth)
    if rest or not frames:
        raise ValueError("pages don't fill the axes")
    h, w = stack.shape(0)
    if h * w > MOVIE_PIXELS or frames > MOVIE_FRAMES:
        raise ValueError("the movie is too large")
    ids = list(range(frames)) if time_indices is None else list(time_indices)
    if len(ids) != frames or any(b <= a for a, b in zip(ids, ids[1:], strict=False)) or ids[0] < 0:
        raise ValueError("frame ids must rise and there must be one per frame")
    if stride < 1:
        raise ValueError("stride must be at least 1")
    return {"height": h, "width": w, "frames": list(range(0, frames, stride)), "frame_ids": ids[::stride]}


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(position, roi_id, path) of Pos*/Roi<digits>.tif, to be sorted by position name and ROI number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "Roi*.tif").load(root).select("path")
    part = r"(Pos[^/]*)/Roi(\d+)\.tif$"
    found = files.select(F.regexp_extract("path", part, 1).alias("position"), F.regexp_extract("path", part, 2).alias("r"), "path").where("r <> ''")
    return found.select("position", F.col("r").cast("int").alias("roi_id"), "path").orderBy("position", "roi_id")


def two_channel_page(frame: int, channel: int, pages: int) -> int:
    """Page of a frame in a file of two channels."""
    if pages % 2 or channel not in (0, 1) or not 0 <= frame < pages // 2:
        raise ValueError("no such page in a two-channel stack")
    return 2 * frame + channel
