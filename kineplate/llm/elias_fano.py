"""Elias-Fano sequences with vectorised access and successor search."""

from __future__ import annotations

import numpy as np

#: Zeros between two entries of the directory, and words between two counts of zeros.
STRIDE, JUMP = 64, 8
ONE = np.uint64(1)
#: Queries answered at once.
BLOCK = 1 << 14


def _pack(bits: np.ndarray) -> np.ndarray:
    """Booleans as 64-bit words, the lowest bit first, with a spare word."""
    raw = np.packbits(bits, bitorder="little")
    out = np.zeros(len(bits) // 64 + 2, np.uint64)
    out.view(np.uint8)[: len(raw)] = raw
    return out


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    places = np.arange(width, dtype=np.uint64)
    for a in range(0, len(values), 1 << 16):  # a multiple of 64 values fills whole words
        bits = ((values[a : a + (1 << 16), None] >> places) & ONE).astype(np.uint8)
        raw = np.packbits(bits.ravel(), bitorder="little")
        out.view(np.uint8)[a * width // 8 : a * width // 8 + len(raw)] = raw
    return out


_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
#: Place of the r-th one of a byte, at byte * 8 + r.
_IN_BYTE = np.array([([k for k in range(8) if byte >> k & 1] + [0] * 8)[r] for byte in range(256) for r in range(8)], np.int64)


def _bit(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Place of the rank-th one of each word, from 0: by the ones of its bytes, added up from the lowest, then within the byte."""
    ones = words - ((words >> ONE) & np.uint64(0x5555555555555555))
    ones = (ones & np.uint64(0x3333333333333333)) + ((ones >> np.uint64(2)) & np.uint64(0x3333333333333333))
    upto = ((ones + (ones >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    byte = np.bitwise_count((((rank * _EACH) | _TOP) - upto) & _TOP).astype(np.uint64) << np.uint64(3)
    inside = rank - (((upto << np.uint64(8)) >> byte) & np.uint64(0xFF))
    return byte.astype(np.int64) + _IN_BYTE[(((words >> byte) & np.uint64(0xFF)) << np.uint64(3) | inside).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence of n values below `universe`, in about 2 + log2(universe / n) bits each.

    shape holds n and the width of the low parts. Arrays may be memory-mapped.
    """

    PARTS = ("shape", "low", "high", "zeros", "counts")

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, counts: np.ndarray):
        self.shape, self.low, self.high, self.zeros, self.counts = shape, low, high, zeros, counts
        self.n, self.width = int(shape[0]), int(shape[1])

    @classmethod
    def encode(cls, values: np.ndarray, universe: int, width: int | None = None) -> EliasFano:
        """width: of the low parts, where the caller knows how values are spread; else by the mean gap."""
        values, n = values.astype(np.uint64), len(values)
        if width is None:
            width = max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)
        top = (values >> np.uint64(width)).astype(np.int64)
        bits = np.zeros(n + ((max(universe, 1) - 1) >> width) + 2, bool)
        bits[top + np.arange(n)] = True
        low = _pack_low(values, width) if width else np.zeros(2, np.uint64)
        high, kind = _pack(bits), np.uint32 if len(bits) < 1 << 32 else np.uint64
        counts = np.concatenate([[0], np.cumsum(np.bitwise_count(~high), dtype=np.int64)])[: len(high) : JUMP]
        return cls(np.array([n, width], np.int64), low, high, np.flatnonzero(~bits)[::STRIDE].astype(kind), counts.astype(kind))

    def bytes(self) -> int:
        return sum(getattr(self, p).nbytes for p in self.PARTS)

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        value |= np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return value & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero of the high bits, from 0."""
        entry = k // STRIDE
        at = self.zeros[entry].astype(np.int64)
        word, rest = at >> 6, (k % STRIDE).astype(np.int64)
        free = ~self.high[word] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (at & 63).astype(np.uint64))
        # where ones run on for long, the counts tell the words in which the zero lies
        until = np.where(entry + 1 < len(self.zeros), self.zeros[np.minimum(entry + 1, len(self.zeros) - 1)].astype(np.int64) >> 6, len(self.high) - 1)
        far = np.flatnonzero((until - word > JUMP) & (rest > 0))
        if len(far):
            low, high, want = word[far] // JUMP, until[far] // JUMP + 1, k[far]
            while (high - low > 1).any():
                middle = (low + high) >> 1
                under = self.counts[np.minimum(middle, len(self.counts) - 1)] <= want
                under &= middle < len(self.counts)
                low, high = np.where(under, middle, low), np.where(under, high, middle)
            moved = low * JUMP > word[far]
            far, low = far[moved], low[moved]
            word[far], rest[far] = low * JUMP, k[far] - self.counts[low].astype(np.int64)
            free[far] = ~self.high[word[far]]
        todo = np.arange(len(k))
        while len(todo):
            count = np.bitwise_count(free[todo]).astype(np.int64)
            todo, count = todo[over := rest[todo] >= count], count[over]
            rest[todo] -= count
            word[todo] += 1
            free[todo] = ~self.high[word[todo]]
        return word * 64 + _bit(free, rest.astype(np.uint64))

    def before(self, bucket: np.ndarray) -> np.ndarray:
        """How many values have a high part below each bucket."""
        out = np.zeros(len(bucket), np.int64)
        inner = np.flatnonzero(bucket > 0)
        out[inner] = self._select(bucket[inner] - 1) - bucket[inner] + 1
        return out

    def _run(self, at: np.ndarray) -> np.ndarray:
        """Ones that follow from each place of the high bits, up to 64."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        window = self.high[word] >> shift
        window |= np.where(shift > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        free = ~window
        return np.bitwise_count((free & (~free + ONE)) - ONE).astype(np.int64)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of the first element equal to each x, else -1: a binary search in the one bucket that may hold x. Queries go in blocks that stay in the cache."""
        out = np.full(len(x), -1, np.int64)
        if self.n:
            for k in range(0, len(x), BLOCK):
                out[k : k + BLOCK] = self._find(x[k : k + BLOCK].astype(np.uint64))
        return out

    def _find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, np.int64)
        bucket = (x >> np.uint64(self.width)).astype(np.int64)
        want = x & np.uint64((1 << self.width) - 1)
        low = self.before(bucket)
        size = self._run(low + bucket)
        full = np.flatnonzero(size == 64)
        size[full] = self._select(bucket[full]) - bucket[full] - low[full]
        end = low + size
        high = end.copy()
        todo = np.flatnonzero(size)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            less = self._low(middle) < want[todo]
            low[todo[less]] = middle[less] + 1
            high[todo[~less]] = middle[~less]
            todo = todo[low[todo] < high[todo]]
        inside = np.flatnonzero(low < end)
        hit = inside[self._low(low[inside]) == want[inside]]
        out[hit] = low[hit]
        return out

    def decode(self) -> np.ndarray:
        """All values."""
        bits = np.unpackbits(np.asarray(self.high).view(np.uint8), bitorder="little")
        top = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        return (top.astype(np.uint64) << np.uint64(self.width)) | self._low(np.arange(self.n))
