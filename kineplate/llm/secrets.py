"""Secret scan with a worklist of decoded layers.

The raw text is scanned first. Then what looks encoded is unwrapped: percent
codes and backslash escapes in the whole text around them, base64 runs, and gzip, zlib or zstd
data found inside base64, member by member and as often as they are nested. A decoded layer is scanned and searched for further
segments, until nothing new comes out. Layers are known by content and place,
so codes that decode to themselves end. Every character of a layer carries
the span of the raw text that it came from; spans found in a layer are
reported there.

Compressed data that are damaged or break off are read up to that place, as
many runs only look compressed; any other failure fails the task.

Null and empty texts have no spans. Repeated rows are scanned each for itself.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: Code points of base64 that an encoded text has at least.
LEAST_BASE64 = 16
#: The same over several lines.
LINES = re.compile(r"[A-Za-z0-9+/_-]{4,}={0,2}(?:\r?\n[\x20\t]*[A-Za-z0-9+/_-]{4,}={0,2})+")
#: A stretch without which no bytes hold a secret or an encoded one.
STRETCH = re.compile(rb"[\x20-\x7e\t\r\n]{12,}")
#: Bytes of decompressed data that are looked at together, and those that pieces share at least.
PIECE, SHARED = 4 << 20, 1 << 16
#: Bytes that are unpacked at a time, and the largest window that zstd can hold.
STEP, MOST_WINDOW = 1 << 14, 1 << 31
#: Head of a zstd frame that holds no data.
SKIPPED = re.compile(rb"[\x50-\x5f]\x2a\x4d\x18")
_TAIL = re.compile(rb"[A-Za-z0-9+/_=%\\.:\"'\x20\r\n\t-]*\Z")
SCHEMA = "doc_id long, spans array<struct<kind: string, start: int, end: int, layer: int>>"

_IS_HEX, _IS_BASE64 = np.zeros(256, bool), np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_IS_BASE64[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_SIX = np.zeros(256, np.uint8)  # a character's six bits
_SIX[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")] = range(64)
_SIX[list(b"-_")] = 62, 63


def scan(text: str, hex_runs: bool = True) -> list[tuple[int, int, int]]:
    """(kind, start, end) of one layer; matches of a kind don't overlap and failing ones are dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hex_runs:
        found += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def packed(head: bytes) -> bool:
    return head[:2] == b"\x1f\x8b" or head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0 or head[:4] == b"\x28\xb5\x2f\xfd"


class Unpacker:
    """What a file's members or frames unfold to, one after another; what follows the last one comes as it is.

    The file is sent in pieces where `run` gives None, an empty piece ends it.
    Damaged data and data that break off end the rest, after everything that
    stands before that place. Only what zlib and zstd call damaged is taken for
    that; any other failure fails the task.
    """

    def __init__(self):
        self.held, self.more = b"", True

    def run(self) -> Generator[bytes | None, bytes, None]:
        frames = False
        while True:
            yield from self.need(4)
            if frames and SKIPPED.match(self.held):
                whole = yield from self.skipped()
            elif not packed(self.held[:4]):
                break
            elif frames := self.held[:1] == b"\x28":
                whole = yield from self.frame()
            else:
                whole = yield from self.member()
            if not whole:
                return
        while self.held:
            yield self.take(len(self.held))
            yield from self.need(1)

    def need(self, n: int) -> Generator[None, bytes, None]:
        while self.more and len(self.held) < n:
            fresh = yield None
            self.more = bool(fresh)
            self.held += fresh

    def take(self, n: int) -> bytes:
        taken, self.held = self.held[:n], self.held[n:]
        return taken

    def member(self) -> Generator[bytes | None, bytes, bool]:
        """A gzip or zlib member."""
        member, before = zlib.decompressobj(47), zlib.decompressobj(47)
        while not member.eof:
            yield from self.need(1)
            try:
                piece = member.decompress(self.held, STEP)
            except zlib.error:
                yield from until_damaged(before, self.held)
                return False
            if piece:
                yield piece
            elif not self.held:
                return False
            self.held = member.unused_data or member.unconsumed_tail
            before = member if member.eof else member.copy()
        return True

    def frame(self) -> Generator[bytes | None, bytes, bool]:
        """A zstd frame, block by block: a call that meets damage gives nothing of what it decoded before."""
        yield from self.need(18)
        try:
            about = zstandard.get_frame_parameters(self.held)
            if about.window_size > MOST_WINDOW:
                return False
            decoder = zstandard.ZstdDecompressor(max_window_size=MOST_WINDOW).decompressobj()
            step, last = zstandard.frame_header_size(self.held), False
            while step:
                yield from self.need(step)
                whole = len(self.held) >= step
                if piece := decoder.decompress(self.take(step)):
                    yield piece
                if not whole:
                    return False
                if last:
                    step = 0 if decoder.eof else 4  # the checksum
                    continue
                yield from self.need(3)
                block = int.from_bytes(self.held[:3], "little")
                last, step = bool(block & 1), 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        except zstandard.ZstdError as error:
            if "not enough memory" in str(error):
                raise MemoryError(str(error)) from error
            return False
        return True

    def skipped(self) -> Generator[None, bytes, bool]:
        yield from self.need(8)
        left = int.from_bytes(self.take(8)[4:], "little")
        while left:
            yield from self.need(1)
            if not self.held:
                return False
            left -= len(self.take(left))
        return True


def until_damaged(member: zlib._Decompress, data: bytes) -> Iterator[bytes]:
    """What a member gives before the byte that shows the damage."""
    for k in range(len(data)):
        try:
            if piece := member.decompress(data[k : k + 1]):
                yield piece
        except zlib.error:
            return


def inflate(data: bytes, levels: int) -> Iterator[bytes]:
    """Pieces of what data unfold to so many times. The levels call one another in this loop, as they may be more than Python's stack holds."""
    stages = [Unpacker().run() for _ in range(levels)]
    wants = [next(s) is None for s in stages]
    at, k, fed = 0, levels - 1, None
    while True:
        if wants[k] and fed is None:
            if k:
                k -= 1
                continue
            fed, at = data[at : at + STEP], at + STEP
        try:
            piece = stages[k].send(fed)
        except StopIteration:
            piece = b""
        fed, wants[k] = None, piece is None
        if piece is not None:
            if k < levels - 1:
                k, fed = k + 1, piece
            elif piece:
                yield piece
            else:
                return


def unfold(data: bytes) -> Iterator[bytes]:
    """Overlapping pieces of what compressed data unfold to, and of what that unfolds to, until nothing looks compressed (text may look so, too)."""
    seen, levels, first = set(), 0, data
    while packed(first[:4]):
        mark = hashlib.sha256(first).digest()
        if mark in seen:  # data that unfold to themselves end
            return
        seen.add(mark)
        levels, first, only = levels + 1, b"", False
        for k, piece in enumerate(pieces(inflate(data, levels))):
            first, only = first or piece, not k
            yield piece
        if only:  # held as a whole, so the next level starts from here
            data, levels = first, 0


def pieces(source: Iterator[bytes]) -> Iterator[bytes]:
    """Overlapping pieces; a piece's last run of encoded text starts the next one."""
    held, fresh = bytearray(), 0
    for more in source:
        held += more
        fresh += len(more)
        if fresh >= max(PIECE, len(held) // 2):
            yield bytes(held)
            del held[: min(_TAIL.search(held, max(0, len(held) - PIECE)).start(), len(held) - SHARED)]
            fresh = 0
    if held:
        yield bytes(held)


def decode_base64(run: str | bytes) -> tuple[bytes, bool] | None:
    """A base64 run's bytes if they may hold anything, and whether they are compressed."""
    raw = run.encode() if isinstance(run, str) else run
    raw = raw[: len(raw) - (len(raw) % 4 == 1)].translate(_PLAIN)
    try:
        data = base64.b64decode(raw + b"=" * (-len(raw) % 4))
    except binascii.Error:
        return None
    if packed(data):
        return data, True
    return (data, False) if STRETCH.search(data) else None


_PLAIN = bytes.maketrans(b"-_", b"+/")


class Same(Sequence):
    """One value for every place."""

    def __init__(self, value: int, n: int):
        self.value, self.n = value, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, at: int | slice) -> int | list[int]:
        return [self.value] * len(range(*at.indices(self.n))) if isinstance(at, slice) else self.value


class Layer:
    """A text and, for each character, the raw span it came from."""

    def __init__(self, text: str, starts: Sequence[int], ends: Sequence[int], depth: int = 0):
        self.text, self.starts, self.ends, self.depth = text, starts, ends, depth

    def span(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]

    def children(self) -> Iterator[Layer]:
        yield from self.escapes()
        for m in BASE64.finditer(self.text):
            yield from self.base64(range(m.start(), m.end()))
        if "\n" in self.text:
            yield from self.lines()

    def lines(self) -> Iterator[Layer]:
        for m in LINES.finditer(self.text):
            places = [k for k in range(m.start(), m.end()) if self.text[k] not in "\r\n\t\x20="]
            if len(places) >= LEAST_BASE64:
                yield from self.base64(places)

    def base64(self, places: Sequence[int]) -> Iterator[Layer]:
        """What the characters at these places stand for at each of the four alignments."""
        whole = self.text[places[0] : places[-1] + 1] if isinstance(places, range) else "".join([self.text[k] for k in places])
        for shift in range(4):
            if (found := decode_base64(whole[shift:])) is None:
                continue
            data, compressed = found
            own = places[shift:]
            if compressed:
                lo, hi = self.starts[own[0]], self.ends[own[-1]]
                for piece in unfold(data):
                    text = piece.decode(errors="replace")
                    yield Layer(text, Same(lo, len(text)), Same(hi, len(text)), self.depth + 1)
            starts, ends, at = [], [], 0
            text = data.decode(errors="surrogateescape")
            for c in text:
                n = 1 if 0xD800 <= ord(c) < 0xE000 else len(c.encode())
                starts.append(self.starts[own[at * 4 // 3]])
                ends.append(self.ends[own[min(len(own), -(-(at + n) * 4 // 3)) - 1]])
                at += n
            yield Layer("".join("�" if 0xD800 <= ord(c) < 0xE000 else c for c in text), starts, ends, self.depth + 1)

    def escapes(self) -> Iterator[Layer]:
        """The whole text with all escapes of one kind replaced, so that what stands on both sides of them is scanned together."""
        if "%" in self.text and PERCENT.search(self.text):
            yield self._replaced(PERCENT, self._percent)
        if "\\" in self.text and ESCAPE.search(self.text):
            yield self._replaced(ESCAPE, self._backslash)

    def _replaced(self, escape: re.Pattern, decode: Callable[[re.Match], Iterator[tuple[str, int, int]]]) -> Layer:
        out, starts, ends, at = [], [], [], 0
        for m in escape.finditer(self.text):
            out.append(self.text[at : m.start()])
            starts += self.starts[at : m.start()]
            ends += self.ends[at : m.start()]
            for c, a, b in decode(m):
                out.append(c)
                starts.append(self.starts[a])
                ends.append(self.ends[b - 1])
            at = m.end()
        return Layer("".join([*out, self.text[at:]]), [*starts, *self.starts[at:]], [*ends, *self.ends[at:]], self.depth + 1)

    @staticmethod
    def _percent(m: re.Match) -> Iterator[tuple[str, int, int]]:
        at = m.start()
        for c in bytes.fromhex(m[0].replace("%", "")).decode(errors="surrogateescape"):
            bad = 0xD800 <= ord(c) < 0xE000
            n = 3 if bad else 3 * len(c.encode())
            yield "�" if bad else c, at, at + n
            at += n

    @staticmethod
    def _backslash(m: re.Match) -> Iterator[tuple[str, int, int]]:
        value = int(m[1] or m[2], 16)
        yield "�" if 0xD800 <= value < 0xE000 else chr(value), m.start(), m.end()


def layers(work: list[Layer]) -> Iterator[Layer]:
    """Everything that the given layers unwrap to, themselves included, the least nested first."""
    seen: set[tuple] = set()
    work = deque(work)
    while work:
        layer = work.popleft()
        if not layer.text:
            continue
        mark = (layer.text, *layer.span(0, len(layer.text)))
        if mark in seen:
            continue
        seen.add(mark)
        yield layer
        work += layer.children()


def find(text: str, hex_runs: bool = True, base64_runs: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int, int]]:
    """All spans (kind, start, end, layer) by start and kind; layer 0 is the raw text. base64_runs: runs of the raw text that may hold something, where they are known."""
    base = scan(text, hex_runs)
    found = {(k, a, b): 0 for k, a, b in base}
    whole = range(len(text))
    raw = Layer(text, whole, range(1, len(text) + 1))
    if base64_runs is None:
        work = list(raw.children())
    else:
        work = [c for a, b in base64_runs for c in raw.base64(range(a, b))]
        work += raw.lines() if "\n" in text else []
        work += raw.escapes()
    for layer in layers(work):
        for k, a, b in scan(layer.text):
            found.setdefault((k, *layer.span(a, b)), layer.depth)
    return sorted(((KINDS[k], a, b, depth) for (k, a, b), depth in found.items()), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _runs(mask: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of `least` or more that don't cross documents."""
    inner = offsets[1:-1][offsets[1:-1] < len(mask)]
    before, after = np.append(False, mask[:-1]), np.append(mask[1:], False)
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def promising(body: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which base64 runs may hold readable text or compressed data, by the nine bytes that their first twelve characters stand for."""
    six = _SIX[body[starts[:, None] + np.arange(12)]].reshape(-1, 3, 4).astype(np.int32)
    word = (six << np.array([18, 12, 6, 0])).sum(2)
    data = ((word[:, :, None] >> np.array([16, 8, 0])) & 255).reshape(-1, 9)
    follows, leads = (data & 0xC0) == 0x80, (data >= 0xC2) & (data < 0xF5)
    plain = (data >= 32) & (data < 127) | (data == 9) | (data == 10) | (data == 13)
    text = (plain | follows | leads).all(1) & ~follows[:, 0] & ~(follows[:, 1:] & ~(leads | follows)[:, :-1]).any(1) & ~(leads[:, :-1] & ~follows[:, 1:]).any(1)
    two = data[:, 0] * 256 + data[:, 1]
    packed = (two == 0x1F8B) | (two == 0x28B5) | (data[:, 0] == 0x78) & (two % 31 == 0)
    return text | packed


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for every row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                body, offsets = T.as_bytes(part.column(1))
                hexed, coded = np.zeros(part.num_rows, bool), {}
                if len(body):
                    at, _ = _runs(_IS_HEX[body], offsets, 24)
                    hexed[np.searchsorted(offsets, at, "right") - 1] = True
                    starts, ends = _runs(_IS_BASE64[body], offsets, LEAST_BASE64)
                    rows = np.searchsorted(offsets, starts, "right") - 1
                    data = body.tobytes()
                    for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
                        if any(decode_base64(data[a + k : b]) for k in range(4)):
                            before = len(data[offsets[row] : a].decode())
                            coded.setdefault(row, []).append((before, before + b - a))
                spans = []
                for row, text in enumerate(part.column(1)):
                    found = find(text.as_py() or "", bool(hexed[row]), coded.get(row, []))
                    spans.append([dict(zip(("kind", "start", "end", "layer"), s, strict=True)) for s in found])
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("layer", pa.int32())]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
