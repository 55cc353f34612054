"""Hierarchical multi-length packing of tokenised documents.

Every task tokenises its documents and packs them as it goes, without a
shuffle and with bounded memory. Whole windows of the longest tier are cut
from long documents; what remains of a document is routed to the smallest
context tier that holds it. When about BLOCK tokens wait, tiers are packed
from the longest to the shortest: each window takes one document of its own
tier, its gap the largest fitting ones of shorter tiers, and the last gap the
head of a shorter document, or of one of the same tier, that is cut there. One
window at most stays open, when nothing shorter is left; its pieces are routed
again with the next block. Windows are dealt to steps so that all steps of a
block carry about as many tokens. What is left at a task's end is cut into ever
shorter powers of two; only the last tokens below TAIL are padded.

Null and empty texts are the end token alone. Repeated rows are packed each
for itself; null ids stay null. Long texts are cut into windows as they come.
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)
TAIL = 64
BLOCK = 1 << 20
#: Tokens of a training step.
STEP = 16 * 2048
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_id long, ids binary"
END = 1
_encoders: dict[str, object] = {}


def encoder(name: str = "byte_bpe_50k"):
    """The byte-level vocabulary as ranks; yields the ids that the tokenizers file of that name gives, special token included, at several times its pace."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
    return _encoders[name]


def encode(text: str | None, name: str = "byte_bpe_50k") -> np.ndarray:
    """Ids of a whole text and the end id."""
    ids = encoder(name).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids.astype("<u4"), np.uint32(END))


class Packer:
    """Packs pieces (row, start, ids); take() returns finished ones as rows of SCHEMA without doc_id and doc_tokens."""

    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS, step: int = STEP):
        self.base, self.tiers, self.step_tokens = base, tiers, step
        self.pools: list[list[tuple]] = [[] for _ in tiers]  # (length, order, key, start, ids), ascending
        self.waiting, self.order, self.sequences, self.steps = 0, 0, 0, 0
        self.windows: list[tuple[int, list[tuple]]] = []
        self.rest: list[tuple] = []

    def add(self, key: tuple, ids: np.ndarray) -> None:
        top, at = self.tiers[-1], 0
        while len(ids) - at >= top:
            self.windows.append((top, [(key, at, ids[at : at + top])]))
            at += top
        if at < len(ids):
            self._route(key, at, ids[at:])
        self.waiting += len(ids)

    def _route(self, key: tuple, start: int, ids: np.ndarray) -> None:
        self.order += 1
        tier = next(i for i, t in enumerate(self.tiers) if len(ids) <= t)
        insort(self.pools[tier], (len(ids), self.order, key, start, ids))

    def _fitting(self, below: int, gap: int) -> tuple | None:
        """The largest waiting piece of the tiers below `below` that fits, else None."""
        for pool in reversed(self.pools[:below]):
            if at := bisect_right(pool, gap, key=lambda p: p[0]):
                return pool.pop(at - 1)
        return None

    def _fill(self, tier: int, window: list[tuple], gap: int) -> int:
        """Puts pieces of shorter tiers, and of the shortest tier its own, into a gap, then the head of a piece of up to the same tier; returns what stays open."""
        below = max(tier, 1)
        while gap:
            if piece := self._fitting(below, gap):
                window.append(piece[2:])
                gap -= piece[0]
            elif pool := next((p for p in self.pools[: tier + 1] if p), None):
                _, _, key, start, ids = pool.pop()
                window.append((key, start, ids[:gap]))
                self._route(key, start + gap, ids[gap:])
                gap = 0
            else:
                break
        return gap

    def pack(self) -> Iterator[tuple]:
        left, self.rest = self.rest, []
        for piece in left:
            self._route(*piece)
        for tier in reversed(range(len(self.tiers))):
            while self.pools[tier]:
                piece = self.pools[tier].pop()
                window = [piece[2:]]
                if self._fill(tier, window, self.tiers[tier] - piece[0]):
                    self.rest += window
                else:
                    self.windows.append((self.tiers[tier], window))
        self.waiting = 0
        yield from self._steps()

    def _steps(self) -> Iterator[tuple]:
        """Deals windows to steps, the longest first and each to the emptiest step."""
        if not self.windows:
            return
        import heapq

        n = -(-sum(t for t, _ in self.windows) // self.step_tokens)
        heap = [(0, i) for i in range(n)]
        for size, window in sorted(self.windows, key=lambda w: -w[0]):
            load, i = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, i))
            yield from self._rows(size, window, self.base + self.steps + i)
        self.steps += n
        self.windows = []

    def _rows(self, size: int, window: list[tuple], step: int) -> Iterator[tuple]:
        sequence, offset = self.base + self.sequences, 0
        self.sequences += 1
        for key, start, ids in window:
            yield key, start, ids, sequence, offset, size, step
            offset += len(ids)

    def finish(self) -> Iterator[tuple]:
        """The waiting pieces, then what no window could close: cut one after the other into falling powers of two."""
        yield from self.pack()
        left, total = self.rest, sum(len(p[2]) for p in self.rest)
        self.rest, size = [], self.tiers[-1]
        while total:
            while size > total and size > TAIL:
                size //= 2
            room, window = min(size, total), []
            total -= room
            while room:
                key, start, ids = left[0]
                window.append((key, start, ids[:room]))
                if len(ids) > room:
                    left[0] = (key, start + room, ids[room:])
                else:
                    left = left[1:]
                room -= len(window[-1][2])
            self.windows.append((size if sum(len(w[2]) for w in window) == size else self.tiers[-1], window))
        yield from self._steps()


def pack_documents(docs: DataFrame, tiers: tuple[int, ...] = TIERS, tokenizer: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of docs(doc_id, text, ...): its place in the document and in its sequence, tier, step and ids (little-endian unsigned 32 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 32, tiers)

        def out(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held: list[list] = [[] for _ in range(9)]
            size = 0
            for (doc, n), start, ids, sequence, offset, tier, step in rows:
                for column, x in zip(held, (doc, start, len(ids), n, sequence, offset, tier, step, ids.tobytes()), strict=True):
                    column.append(x)
                size += len(ids)
                if size >= BLOCK:
                    yield make(held)
                    held, size = [[] for _ in range(9)], 0
            if size:
                yield make(held)

        def make(held: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(held, kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_id", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py(), tokenizer)
                packer.add((doc, len(ids)), ids)
                if packer.waiting >= BLOCK:
                    yield from out(packer.pack())
        yield from out(packer.finish())

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
