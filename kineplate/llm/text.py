"""Vectorised words and shingles of whole texts.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
Words get 64-bit polynomial hashes from prefix sums over the bytes of many
texts at once; no Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once: bounds the memory of a task whatever the batch or text.
CHUNK = 1 << 20
#: Bytes of text in one slice of an Arrow batch.
SLICE = 1 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_rng = np.random.Generator(np.random.PCG64(0x5EED))
_SYMBOL = _rng.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
_SYMBOL_LOWER = _SYMBOL[LOWER]
_BASE = int(_rng.integers(0, 1 << 62)) * 2 + 1
_ROLE = _rng.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, by doubling."""
    out = np.ones(n, dtype=np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        _powers["p"] = _power(_BASE, n)
        _powers["q"] = _power(pow(_BASE, -1, 1 << 64), n)
    return _powers["p"], _powers["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and n+1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return body, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `limit` bytes of text each; a longer text comes alone."""
    if not batch.num_rows:
        return
    _, offsets = as_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _cut(body: np.ndarray, offsets: np.ndarray, at: int) -> int:
    """Where to stop a chunk that begins at `at`: after white space or between documents, so that no word is cut."""
    end = at + CHUNK
    while end < len(body):
        stop = int(offsets[np.searchsorted(offsets, end, "right") - 1])
        white = SPACE[body[end - CHUNK : end]][::-1]
        if white.any():
            stop = max(stop, end - int(white.argmax()))
        if stop > at:
            return stop
        end += CHUNK
    return len(body)


def word_spans(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word in document order."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(body)
    while at < n:
        end = _cut(body, offsets, at)
        b = body[at:end]
        solid = ~SPACE[b]
        cut = offsets[np.searchsorted(offsets, at, "left") : np.searchsorted(offsets, end, "left")] - at
        before = np.empty(len(b), bool)
        before[0] = False
        before[1:] = solid[:-1]
        before[cut] = False
        s = np.flatnonzero(solid & ~before)
        after_ = np.empty(len(b), bool)
        after_[-1] = False
        after_[:-1] = solid[1:]
        after_[cut[cut > 0] - 1] = False
        e = np.flatnonzero(solid & ~after_) + 1
        p, q = _tables(len(b) + 1)
        total = np.empty(len(b) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_SYMBOL_LOWER[b] * p[: len(b)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * q[s]))
        starts.append(s + at)
        ends.append(e + at)
        at = end
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all documents and the n+1 positions at which documents start."""
    body, offsets = as_bytes(column)
    starts, _, hashes = word_spans(body, offsets)
    return hashes, np.searchsorted(starts, offsets, "left")


def hash_words(texts: list[str]) -> np.ndarray:
    """Hashes of single words, as words() gives them."""
    return words(pa.array(texts, pa.large_string()))[0]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, documents not regarded."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out += hashes[k : k + n] * _ROLE[k] + (hashes[k : k + n] >> np.uint64(29)) * _ROLE[k + 32]
    return mix(out)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct shingle hashes: runs of `width` words; with fewer words all of them as one; none without words."""
    hashes, at = words(column)
    runs = window_hashes(hashes, width)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            yield window_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
