"""Benchmark decontamination by size-partitioned MinHash containment search.

An item is contained in a document when at least `percent` of the item's
distinct word shingles occur there, however long the document is. Items are
partitioned by the size of their shingle set, and each partition has a number
of hits and a sketch size of its own: an item of m shingles keeps its
m - need + hits smallest hashes, need = ceil(m * percent / 100). A document that
contains the item lacks m - need of its shingles at most, so it holds `hits` of
the kept ones at least. Small items need one hit; large ones need more, so a
long document that happens to share a few shingles with a large item is no
candidate. Candidates are verified on the whole sets.

Items are indexed in the cluster, in blocks of about BLOCK characters whose
index is written to the shared folder; nothing of them passes through the
driver. Documents are read and hashed once, whole, in slices, and never
shuffled; a task maps one block's index after the other into memory. The index
stays in the shared folder, as the result reads it.

An item of fewer words than the shingle width is one run of all its words,
searched as such; items without words match nothing. Null and empty texts
contain nothing; null ids are kept. Repeated documents and items, and items with
equal texts, give a row each. Columns of other names are not read, and
decontaminated() keeps them as they are. Without items nothing is found; an
empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .workspace import Workspace, local_path, save

#: Characters of item texts in one block.
BLOCK = 16 << 20
SCHEMA = "doc_id long, item_id long, item_shingles long, common long, containment double"


def need(m: int, percent: int) -> int:
    return -(-m * percent // 100)


def hits(size: int) -> int:
    """How many kept shingles make a candidate in the partition of items of `size` shingles, sizes of one partition sharing their highest bit."""
    return 1 + (1 << size.bit_length() - 1) // 16


class ItemIndex:
    """A block of items: ids (known: not null), whole sets (`sets`, cut at `at`), and tables of a shingle width and size partition: rows (width, hits, start, end) of `tables` over the sorted kept `values` and their `owners`."""

    PARTS = ("ids", "known", "at", "sets", "tables", "values", "owners")

    def __init__(self, *parts: np.ndarray):
        self.ids, self.known, self.at, self.sets, self.tables, self.values, self.owners = parts
        self.seen = [self._bits(self.values[a:b]) for _, _, a, b in self.tables.tolist()]

    @classmethod
    def build(cls, ids: pa.Array, texts: pa.Array, width: int, percent: int) -> ItemIndex:
        hashes, words_at = T.words(texts)
        sets, groups = [], {}
        for k in range(len(ids)):
            own = hashes[words_at[k] : words_at[k + 1]]
            w = min(width, len(own))
            sets.append(np.unique(T.window_hashes(own, w)) if w else np.zeros(0, np.uint64))
            if w:
                groups.setdefault((w, len(sets[-1]).bit_length()), []).append(k)
        tables, values, owners, start = [], [], [], 0
        for (w, _), items in sorted(groups.items()):
            enough = hits(len(sets[items[0]]))
            kept = [sets[k][: len(sets[k]) - need(len(sets[k]), percent) + enough] for k in items]
            value, owner = np.concatenate(kept), np.repeat(np.array(items), [len(v) for v in kept])
            order = np.argsort(value, kind="stable")
            values.append(value[order])
            owners.append(owner[order])
            tables.append((w, enough, start, start + len(value)))
            start += len(value)
        none = np.zeros(0, np.uint64)
        known = np.asarray(ids.is_valid())
        return cls(np.asarray(ids.fill_null(0)), known, np.cumsum([0, *map(len, sets)]), np.concatenate([*sets, none]), np.array(tables, np.int64).reshape(-1, 4), np.concatenate([*values, none]), np.concatenate([*owners, none.astype(np.int64)]))

    @staticmethod
    def _bits(values: np.ndarray) -> np.ndarray:
        seen = np.zeros(1 << max(10, (16 * len(values)).bit_length()), bool)
        seen[(values & np.uint64(len(seen) - 1)).astype(np.int64)] = True
        return seen

    def search(self, hashes: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, item shingles, common shingles) of items contained in documents with these word hashes."""
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        runs_of = {w: T.window_hashes(hashes, w) for w in set(self.tables[:, 0].tolist())}
        for (w, enough, a, b), seen in zip(self.tables.tolist(), self.seen, strict=True):
            runs, values, owners = runs_of[w], self.values[a:b], self.owners[a:b]
            if not len(runs):
                continue
            hit = np.flatnonzero(seen[(runs & np.uint64(len(seen) - 1)).astype(np.int64)])
            hit = hit[rows[hit] == rows[hit + w - 1]]  # runs that don't cross documents
            low, high = np.searchsorted(values, runs[hit], "left"), np.searchsorted(values, runs[hit], "right")
            hit, low, high = (x[high > low] for x in (hit, low, high))
            order = np.lexsort((low, rows[hit]))
            hit, low, high = hit[order], low[order], high[order]
            new = np.flatnonzero(np.append(True, (np.diff(rows[hit]) > 0) | (np.diff(low) > 0))[: len(hit)])  # a shingle counts once
            n = (high - low)[new]
            row, of = np.repeat(rows[hit[new]], n), owners[np.repeat(low[new], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]
            pairs, count = np.unique(row * len(self.ids) + of, return_counts=True)
            last, found = -1, np.zeros(0, np.uint64)
            for row, k in zip(*(x.tolist() for x in np.divmod(pairs[count >= enough], len(self.ids))), strict=True):
                if row != last:
                    last, found = row, np.unique(runs[at[row] : at[row + 1] - w + 1])
                own = self.sets[self.at[k] : self.at[k + 1]]
                common = len(np.intersect1d(found, own, assume_unique=True))
                yield row, k, len(own), common


class Blocks:
    """Indexes of all blocks in a folder, mapped one at a time."""

    def __init__(self, path: str, count: int, percent: int):
        self.path, self.count, self.percent = path, count, percent

    def __iter__(self) -> Iterator[ItemIndex]:
        for k in range(self.count):
            if os.path.exists(f"{self.path}/{k}/{ItemIndex.PARTS[-1]}.npy"):
                yield ItemIndex(*(np.asarray(np.load(f"{self.path}/{k}/{p}.npy", mmap_mode="r")) for p in ItemIndex.PARTS))

    def search(self, texts: pa.Array) -> Iterator[tuple[ItemIndex, int, int, int, int]]:
        hashes, at = T.words(texts)
        for index in self.held():
            for row, k, size, common in index.search(hashes, at):
                if 100 * common >= self.percent * size:
                    yield index, row, k, size, common

    def held(self) -> Iterator[ItemIndex]:
        """The only block once for all slices of a task, several ones anew."""
        if self.count > 1:
            yield from self
        else:
            if "only" not in self.__dict__:
                self.only = list(self)
            yield from self.only


def _indexed(ws: Workspace, items: DataFrame, width: int, percent: int) -> Blocks:
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, path = -(-total // BLOCK) or 1, local_path(ws.spark, f"{ws.path}/items")

    def write(table: pa.Table) -> pa.Table:
        k, table = table.column("block")[0].as_py(), table.combine_chunks()
        index = ItemIndex.build(table.column("item_id").chunk(0), table.column("text").chunk(0), width, percent)
        for p in ItemIndex.PARTS:
            save(f"{path}/{k}/{p}.npy", getattr(index, p))
        return pa.table({"block": pa.array([k], pa.int64())})

    rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))).groupBy("block").applyInArrow(write, "block long").count()
    return Blocks(path, blocks, percent)


def contained_items(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row (doc_id, item_id, item_shingles, common, containment) for each item(item_id, text) that a row of docs(doc_id, text, ...) contains."""
    blocks = _indexed(Workspace(docs.sparkSession, "items"), items, width, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                found = list(blocks.search(part.column(1)))
                if found:
                    row, size, common = (np.array([f[k] for f in found]) for k in (1, 3, 4))
                    ids = pa.array([int(index.ids[k]) if index.known[k] else None for index, _, k, _, _ in found], pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), ids, pa.array(size), pa.array(common), pa.array(common / size)], ["doc_id", "item_id", "item_shingles", "common", "containment"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def decontaminated(docs: DataFrame, items: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs(text, ...) that contain no item, in one pass; columns stay as they are."""
    blocks = _indexed(Workspace(docs.sparkSession, "items"), items, width, percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[row for _, row, *_ in blocks.search(part.column(part.schema.get_field_index("text")))]] = False
                yield part.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
