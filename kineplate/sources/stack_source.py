"""The `roi_tiff` format: planes of TIFF stacks, read page by page.

    spark.dataSource.register(StackSource)
    spark.read.format("roi_tiff").option("channel", "1").option("t", "0:49").load(folder)

path names a stack, or a folder with stacks anywhere below it, as a local path or
a URI that pyarrow opens. A stack that is listed in an index.json beside it has
the axes, frames and box given there; one without has the axes of its own
description, or those of the options `channels` and `depth`. A partition is a
range of pages of one file, of about PART_BYTES of pixels, so a stack of any
size is read by many tasks, each of which seeks to its own pages.

Options pos, roi, t, stack_t, channel and z list what is wanted, as numbers and
ranges (`0,3,5:9`): other files and pages are neither opened nor decoded. Option
`stride` keeps every n-th frame of a stack. With the option `pushdown` and Spark's
flag spark.sql.python.filterPushdown.enabled, comparisons of these columns with
numbers are taken over in the same way. Use a frame that was loaded so with one
filter only: Spark 4.1 keeps the pages of the last filter in the loaded frame,
and what is derived from it by another filter, or by none, misses rows. Other
options have no such effect.
Stacks are baseline TIFF or BigTIFF, uncompressed, 8 or 16 bits of gray.

Errors, not results: a listed stack without a file, a number of pages other than
frames x channels x depth, a page of another size than its box, several pages
without axes. An index that lists no stack and an empty folder give no rows.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any, BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import functions as F

from ..shared import opened
from .tiff import BITS, COMPRESSION, COUNTS, HEIGHT, OFFSETS, SAMPLE_FORMAT, SAMPLES, WIDTH

#: Bytes of pixels of a partition and of an Arrow batch of doubles.
PART_BYTES, BATCH_BYTES = 32 << 20, 8 << 20
#: Limits of a movie (fixed values).
MOVIE_PIXELS, MOVIE_FRAMES = 1_000_000, 4096
DESCRIPTION = 270
SCHEMA = "path string, pos int, roi int, stack_t int, t int, channel int, z int, height int, width int, pixels array<double>"
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 16: 8}
_FORMS = {1: "B", 3: "H", 4: "I", 16: "Q"}


class Pages:
    """Directories and pages of an open stack; nothing but what is asked for is read."""

    def __init__(self, file: BinaryIO):
        self.file = file
        head = self._at(0, 16)
        self.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        magic = struct.unpack(f"{self.order}H", head[2:4])[0] if self.order else 0
        if magic not in (42, 43):
            raise ValueError("not a TIFF")
        self.big = magic == 43
        self.first = struct.unpack(f"{self.order}{'Q' if self.big else 'I'}", head[8:16] if self.big else head[4:8])[0]
        #: Bytes of the count of entries, of an entry, and of an offset.
        self.count, self.entry, self.offset = (8, 20, 8) if self.big else (2, 12, 4)
        self.known: list[int] = []

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _number(self, raw: bytes) -> int:
        return struct.unpack(f"{self.order}{ {2: 'H', 4: 'I', 8: 'Q'}[len(raw)]}", raw)[0]

    def offsets(self, upto: int | None = None) -> list[int]:
        """Where the directories of the pages are, as far as page `upto`; only links are read."""
        at = self.first if not self.known else self._next(self.known[-1])
        while at and (upto is None or len(self.known) <= upto):
            if at in self.known[-1:] or (self.known and at == self.known[0]):
                raise ValueError("the pages of this TIFF go in a circle")
            self.known.append(at)
            at = self._next(at)
        return self.known

    def _next(self, at: int) -> int:
        entries = self._number(self._at(at, self.count))
        return self._number(self._at(at + self.count + entries * self.entry, self.offset))

    def tags(self, page: int) -> dict[int, tuple[int, ...] | bytes]:
        offsets = self.offsets(page)
        if page >= len(offsets):
            raise ValueError(f"a stack of {len(offsets)} pages has no page {page}")
        raw = self._at(offsets[page] + self.count, self._number(self._at(offsets[page], self.count)) * self.entry)
        return dict(self._tag(raw[k : k + self.entry]) for k in range(0, len(raw), self.entry))

    def _tag(self, raw: bytes) -> tuple[int, tuple[int, ...] | bytes]:
        tag, kind = struct.unpack(f"{self.order}HH", raw[:4])
        count, value = self._number(raw[4 : 4 + self.offset]), raw[4 + self.offset :]
        size = _SIZES.get(kind, 0) * count
        if not size:
            return tag, ()
        data = value[:size] if size <= len(value) else self._at(self._number(value), size)
        return tag, data if kind == 2 else struct.unpack(f"{self.order}{count}{_FORMS[kind]}", data)

    def read(self, page: int) -> np.ndarray:
        tags = self.tags(page)
        bits = tags.get(BITS, (1,))[0]
        if bits not in (8, 16) or any(tags.get(t, (1,))[0] != 1 for t in (COMPRESSION, SAMPLES, SAMPLE_FORMAT)):
            raise ValueError("only uncompressed gray pages of unsigned 8 or 16 bits are read")
        h, w = tags[HEIGHT][0], tags[WIDTH][0]
        data = b"".join(self._at(o, n) for o, n in zip(tags[OFFSETS], tags[COUNTS], strict=True))
        if len(data) != h * w * bits // 8:
            raise ValueError(f"page {page} has {len(data)} bytes for {h} x {w}")
        return np.frombuffer(data, f"{self.order}u{bits // 8}").reshape(h, w)


def described(text: bytes) -> tuple[int, int, int] | None:
    """(frames, channels, depth) of a page's description: JSON with axes and shape, or lines name=number; None where it names none."""
    told = text.rstrip(b"\0").decode("utf-8", "replace")
    if told.startswith("{"):
        try:
            made = json.loads(told)
        except ValueError:
            return None
        axes, shape = made.get("axes"), made.get("shape")
        if not isinstance(axes, str) or not isinstance(shape, list) or len(axes) != len(shape):
            return None
        if not re.fullmatch("T?C?Z?YX", axes):
            raise ValueError(f"axes {axes} are not in the order TCZYX")
        size = dict(zip(axes, shape, strict=True))
        return size.get("T", 1), size.get("C", 1), size.get("Z", 1)
    named = dict(re.findall(r"^(frames|channels|slices)=(\d+)$", told, re.M))
    if not named or (int(named.get("slices", 1)) > 1 and int(named.get("channels", 1)) > 1):  # that form has depth outside channels
        return None
    return int(named.get("frames", 1)), int(named.get("channels", 1)), int(named.get("slices", 1))


@dataclass
class Entry:
    """A stack as its index has it."""

    path: str
    pos: int | None = None
    roi: int | None = None
    axes: tuple[int, int, int] | None = None
    times: list[int] | None = None
    box: tuple[int, int] | None = None
    size: int = 0


@dataclass
class Range(D.InputPartition):
    """Pages of one file; the last range of a file also counts its pages."""

    entry: Entry
    pages: list[int]
    counts: bool = False
    value: Any = None


@dataclass
class Bounds:
    """What filters leave of a column: numbers that are allowed, or bounds."""

    low: float = float("-inf")
    high: float = float("inf")
    among: set[int] | None = None

    def holds(self, x: int | None) -> bool:
        return x is not None and self.low <= x <= self.high and (self.among is None or x in self.among)


#: Columns by which files and pages are picked.
PICKED = ("pos", "roi", "t", "stack_t", "channel", "z")


def numbers(told: str) -> set[int]:
    """The numbers of a list such as `0,3,5:9`."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in told.split(","))):
        low, _, high = part.partition(":")
        out.update(range(int(low), int(high or low) + 1))
    return out


@dataclass
class Pick:
    """What options ask for and filters leave."""

    columns: dict[str, Bounds] = field(default_factory=dict)

    def take(self, f: D.Filter) -> bool:
        name = getattr(f, "attribute", (None,))
        if len(name) != 1 or name[0] not in PICKED:
            return False
        if isinstance(f, D.IsNotNull):
            self.columns.setdefault(name[0], Bounds())
            return True
        value = getattr(f, "value", None)
        if isinstance(f, D.In):
            among = {v for v in value if v is not None}
        elif isinstance(f, D.EqualTo | D.EqualNullSafe) and value is not None:
            among = {value}
        elif isinstance(f, D.GreaterThan | D.GreaterThanOrEqual | D.LessThan | D.LessThanOrEqual) and value is not None:
            among = None
        else:
            return False
        b = self.columns.setdefault(name[0], Bounds())
        if among is not None:
            b.among = among if b.among is None else b.among & among
        elif isinstance(f, D.GreaterThan | D.GreaterThanOrEqual):
            b.low = max(b.low, value + isinstance(f, D.GreaterThan))
        else:
            b.high = min(b.high, value - isinstance(f, D.LessThan))
        return True

    def holds(self, **known: int | None) -> bool:
        return all(self.columns[c].holds(v) for c, v in known.items() if c in self.columns)


class StackReader(D.DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.axes = (int(options["channels"]) if "channels" in options else None, int(options.get("depth", 1)))
        self.stride = int(options.get("stride", 1))
        self.movie = options.get("movie", "false").lower() == "true"
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        if self.stride < 1:
            raise ValueError("stride must be at least 1")
        self.asked = {c: options[c] for c in PICKED if c in options}
        self.pick = self._asked()

    def _asked(self) -> Pick:
        return Pick({c: Bounds(among=numbers(told)) for c, told in self.asked.items()})

    def entries(self) -> list[Entry]:
        """Stacks below the path, with what their folders' indices say; only indices are read."""
        system, path = opened(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(f"no stack and no folder {self.path}")
        if info.type == pafs.FileType.File:
            folder, files = path.rpartition("/")[0], [info]
        else:
            folder = None
            files = [f for f in system.get_file_info(pafs.FileSelector(path, recursive=True)) if f.type == pafs.FileType.File]
        stacks = {f.path: f for f in files if re.search(r"\.tiff?$", f.path, re.I)}
        folders = {p.rpartition("/")[0] for p in stacks} | {f.path.rpartition("/")[0] for f in files if f.path.endswith("/index.json")}
        out, listed = [], set()
        for at in sorted(folders):
            try:
                with system.open_input_stream(f"{at}/index.json") as f:
                    index = json.loads(f.read())
            except FileNotFoundError:
                continue
            for e in self._indexed(at, index):
                if folder is not None and e.path != path:
                    continue
                if not self.pick.holds(pos=e.pos, roi=e.roi):
                    listed.add(e.path)
                    continue
                if e.path not in stacks:
                    raise FileNotFoundError(f"no file {e.path} that its index lists")
                listed.add(e.path)
                e.size = stacks[e.path].size
                out.append(e)
        for p, f in stacks.items():
            if p not in listed:
                named = re.search(r"Pos(\d+)/Roi(\d+)\.tiff?$", p)
                e = Entry(p, *(map(int, named.groups()) if named else (None, None)), size=f.size)
                if self.pick.holds(pos=e.pos, roi=e.roi):
                    out.append(e)
        return sorted(out, key=lambda e: e.path)

    @staticmethod
    def _indexed(folder: str, index: dict) -> Iterator[Entry]:
        if str(index.get("axisOrder", "TCZYX")).upper() != "TCZYX":
            raise ValueError(f"axis order must be TCZYX in {folder}")
        axes = tuple(int(index.get(k, 1)) for k in ("timeCount", "channelCount", "zCount"))
        times = index.get("timeIndices")
        for r in index.get("rois") or []:
            mine = axes
            if isinstance(r.get("shape"), list) and len(r["shape"]) == 5:
                mine = tuple(int(n) for n in r["shape"][:3])
            if times is not None and len(times) != mine[0]:
                raise ValueError(f"timeIndices must have {mine[0]} entries in {folder}")
            box = r.get("bbox") or {}
            size = (int(box["h"]), int(box["w"])) if "h" in box and "w" in box else None
            yield Entry(f"{folder}/{r.get('fileName', f'Roi{r['roi']}.tif')}", index.get("position"), r.get("roi"), mine, times, size)

    def _known(self, system: pafs.FileSystem, e: Entry) -> tuple[int, int]:
        """(height, width) of an entry, whose axes are filled in from the stack where no index has them."""
        if e.axes and e.box and not self.movie:
            return e.box
        with system.open_input_file(e.path) as f:
            pages = Pages(f)
            tags = pages.tags(0)
            shape = (tags[HEIGHT][0], tags[WIDTH][0])
            if e.axes is None:
                n = len(pages.offsets())
                told = tags.get(DESCRIPTION, b"")
                e.axes = described(told if isinstance(told, bytes) else b"")
                if e.axes is None:
                    channels, depth = self.axes
                    if channels is None and n > 1:
                        raise ValueError(f"{e.path} has {n} pages and neither an index nor axes")
                    channels = channels or 1
                    if n % (channels * depth):
                        raise ValueError(f"{n} pages of {e.path} don't fill {channels} channels and {depth} planes")
                    e.axes = (n // (channels * depth), channels, depth)
        if self.movie:
            if shape[0] * shape[1] > MOVIE_PIXELS:
                raise ValueError(f"{e.path} has more than a megapixel")
            if e.axes[0] > MOVIE_FRAMES:
                raise ValueError(f"{e.path} has more than {MOVIE_FRAMES} frames")
            if e.times is not None and (any(t < 0 for t in e.times) or any(b <= a for a, b in zip(e.times, e.times[1:], strict=False))):
                raise ValueError(f"frame ids of {e.path} must rise from 0 on")
            for name in ("channel", "z"):
                asked = self.pick.columns.get(name, Bounds()).among or set()
                if asked and min(asked) < 0 or asked and max(asked) >= e.axes[1 if name == "channel" else 2]:
                    raise ValueError(f"{name} outside {e.path}")
        return shape

    def partitions(self) -> list[Range]:
        system = opened(self.path)[0]
        out = []
        for e in self.entries():
            h, w = self._known(system, e)
            t_n, c_n, z_n = e.axes
            pages = [
                (t * c_n + c) * z_n + z
                for t in range(t_n)
                if t % self.stride == 0 and self.pick.holds(stack_t=t, t=e.times[t] if e.times else t)
                for c in range(c_n)
                if self.pick.holds(channel=c)
                for z in range(z_n)
                if self.pick.holds(z=z)
            ]
            step = max(1, self.part_bytes // max(1, 2 * h * w))
            out += [Range(e, pages[k : k + step], k + step >= len(pages)) for k in range(0, len(pages), step)]
        return out or [Range(Entry(""), [])]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        e = partition.entry
        if not partition.pages:
            return
        t_n, c_n, z_n = e.axes
        kinds = [pa.string(), *[pa.int32()] * 8, pa.list_(pa.float64())]
        names = ["path", "pos", "roi", "stack_t", "t", "channel", "z", "height", "width", "pixels"]
        rows, held = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        with opened(self.path)[0].open_input_file(e.path) as f:
            stack = Pages(f)
            if partition.counts and len(stack.offsets()) != t_n * c_n * z_n:
                raise ValueError(f"{e.path} has {len(stack.offsets())} pages for {t_n} x {c_n} x {z_n}")
            for page in partition.pages:
                x = stack.read(page)
                if e.box is not None and x.shape != e.box:
                    raise ValueError(f"page {page} of {e.path} is {x.shape[0]} x {x.shape[1]}")
                t, c, z = page // (c_n * z_n), page // z_n % c_n, page % z_n
                rows.append((e.path, e.pos, e.roi, t, e.times[t] if e.times else t, c, z, *x.shape, x.ravel().astype(np.float64)))
                held += x.size * 8
                if held >= BATCH_BYTES:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class PushedReader(StackReader):
    """A reader that takes filters over; Spark refuses one where its flag is off."""

    def pushFilters(self, filters: list[D.Filter]) -> Iterator[D.Filter]:  # noqa: N802
        self.pick = self._asked()  # Spark may ask a reader again for another query
        for f in filters:
            if not self.pick.take(f):
                yield f


class StackSource(D.DataSource):
    """spark.read.format("roi_tiff")"""

    @classmethod
    def name(cls) -> str:
        return "roi_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: Any) -> StackReader:
        return (PushedReader if self.options.get("pushdown", "false").lower() == "true" else StackReader)(self.options)


def planes(spark: SparkSession, path: str, where: dict[str, Iterable[int]] | None = None, **options: Any) -> DataFrame:
    """Planes of all stacks at a path; where names the positions, ROIs, frames, channels and planes that are read."""
    spark.dataSource.register(StackSource)
    reader = spark.read.format("roi_tiff").option("path", path)
    told = {c: ",".join(map(str, wanted)) for c, wanted in (where or {}).items()}
    for name, value in (told | options).items():
        reader = reader.option(name, str(value))
    return reader.load()


def movie_frames(spark: SparkSession, path: str, channel: int = 0, z: int = 0, stride: int = 1, contrast: str = "frame", channels: int | None = None) -> DataFrame:
    """Every `stride`-th frame of the movies at a path: (path, pos, roi, stack_t, frame_id, height, width, gray), gray from 0 to 255.

    contrast: `frame` spreads each frame between its own 1 and 99 % quantiles,
    `baseline` all frames of a movie between those of its first one. Movies of
    more than a megapixel or 4096 frames, falling frame ids and channels or
    planes outside a movie are errors.
    """
    if contrast not in ("frame", "baseline"):
        raise ValueError("contrast is frame or baseline")
    options = {"movie": "true", "stride": stride} | ({"channels": channels} if channels else {})
    picked = {"channel": [channel], "z": [z]}
    rows = planes(spark, path, picked, **options)
    if contrast == "frame":
        rows = _limits(rows)
    else:
        first = _limits(planes(spark, path, picked | {"stack_t": [0]}, **options)).select(F.col("path").alias("of"), "low", "high")
        rows = rows.join(first, F.col("path") == F.col("of")).drop("of")
    return _gray(rows).select("path", "pos", "roi", "stack_t", F.col("t").alias("frame_id"), "height", "width", "gray")


def _limits(rows: DataFrame) -> DataFrame:
    """rows of planes with their 1 and 99 % quantiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels = batch.column("pixels")
            ends = pixels.offsets.to_numpy()
            q = np.array([np.percentile(pixels.values.to_numpy()[a:b], [1, 99]) for a, b in zip(ends[:-1], ends[1:], strict=True)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q[:, 0]), pa.array(q[:, 1])], [*batch.schema.names, "low", "high"])

    return rows.mapInArrow(run, f"{SCHEMA}, low double, high double")


def _gray(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pixels, low, high = batch.column("pixels"), batch.column("low").to_numpy(), batch.column("high").to_numpy()
            n = np.diff(pixels.offsets.to_numpy())
            x = pixels.flatten().to_numpy()
            spread = np.clip((x - np.repeat(low, n)) / np.repeat(np.maximum(high - low, 1e-6), n), 0, 1)
            gray = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array((spread * 255).astype(np.int32)))
            keep = [c for c in batch.schema.names if c not in ("pixels", "low", "high")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), gray], [*keep, "gray"])

    return rows.mapInArrow(run, f"{SCHEMA.replace(', pixels array<double>', '')}, gray array<int>")
