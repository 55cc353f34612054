"""Language identification with language-bitmask n-gram filters.

N-grams are windows of SPAN bytes over lower-cased letters with single spaces
between words. Their counts per language come from all training documents. An
n-gram belongs to a language when its rate there is at least SHARE of its
highest rate. A bit-sliced Bloom filter holds a language bitmask in every slot;
the AND of the masks at an n-gram's slots gives all languages that contain it.
A document counts, per language, its n-grams with that bit; the expected
number of false positives, known from how full each bit slice is, is taken
away, and the language with the largest count wins.

The filter has SLOTS slots or more for each distinct n-gram of the corpus. It is
cut into pieces of PIECE slots; each is merged by OR in the cluster and written
to the shared folder by the task that has it, and tasks map the pieces into
memory. The driver holds one number per language and piece.

Null and empty texts and those without a letter are `und` with score 0, and so
is every text when no language could be learned. Ties go to the language that
comes first in the alphabet. Repeated rows count and are answered each for
itself; texts are read whole. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .workspace import Workspace, local_path, save

SPAN, HASHES, SHARE = 4, 3, 0.5
#: Slots for each distinct n-gram at least, and slots of a piece of the filter.
SLOTS, PIECE = 4, 1 << 16
#: Bits of a mask; more languages take more masks.
PLANE = 63

_LETTER = T.LOWER.copy()
_LETTER[[b for b in range(128) if not (97 <= T.LOWER[b] <= 122)]] = 32


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams and the row of each."""
    body, offsets = T.as_bytes(pc.utf8_lower(column))
    n = len(offsets) - 1
    # each document gets a space on either side
    size = np.diff(offsets)
    padded = np.full(len(body) + 2 * n, 32, np.uint8)
    row = np.repeat(np.arange(n), size)
    padded[np.arange(len(body)) + 2 * row + 1] = _LETTER[body]
    rows = np.repeat(np.arange(n, dtype=np.int32), size + 2)
    blank = padded == 32
    keep = np.ones(len(padded), bool)
    keep[1:] = ~(blank[1:] & blank[:-1] & (rows[1:] == rows[:-1]))
    padded, rows = padded[keep], rows[keep]
    m = len(padded) - SPAN + 1
    if m <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    code = np.zeros(m, np.uint32)
    for k in range(SPAN):
        code = code << np.uint32(8) | padded[k : k + m]
    whole = rows[:m] == rows[SPAN - 1 :]
    return code[whole], rows[:m][whole]


def slots(code: np.ndarray, count: int) -> np.ndarray:
    """HASHES slots of each code, one row per hash."""
    h = T.mix(code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(k) * step) & np.uint64(count - 1)).astype(np.int64) for k in range(HASHES)])


def _counts(train: DataFrame) -> DataFrame:
    """(lang, code, c): how often each n-gram stands in the training texts of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
            values, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return values, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for part in T.slices(batch):
                code, rows = grams(part.column(1))
                langs = part.column(0).dictionary_encode()
                mine = np.asarray(langs.indices)[rows]
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(code[mine == k], return_counts=True))
                    if len(parts) >= 16:
                        held[lang] = [merged(parts)]
        for lang, parts in held.items():
            values, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)], ["lang", "code", "c"])

    return train.select("lang", "text").mapInArrow(run, "lang string, code long, c long").groupBy("lang", "code").agg(F.sum("c").alias("c"))


class LanguageFilter:
    """languages in order; pieces of masks[slot, plane] in a folder that tasks map into memory; rates[k] is how often a strange n-gram shows bit k."""

    def __init__(self, languages: list[str], path: str, count: int, filled: np.ndarray):
        self.languages, self.path, self.count = languages, path, count
        self.rates = (filled / max(count, 1)) ** HASHES
        self.opened: dict[int, np.ndarray | None] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    def piece(self, k: int) -> np.ndarray | None:
        """A piece of the masks; None for one that got no n-gram."""
        if k not in self.opened:
            path = f"{self.path}/{k}.npy"
            self.opened[k] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.opened[k]

    def masks(self, code: np.ndarray) -> np.ndarray:
        """The AND of the masks at the slots of each code: all languages that contain it."""
        out = np.full((len(code), -(-len(self.languages) // PLANE)), np.uint64(0xFFFFFFFFFFFFFFFF))
        for where in slots(code, self.count):
            order = np.argsort(where // PIECE, kind="stable")
            borders = np.searchsorted(where[order] // PIECE, np.arange(-(-self.count // PIECE) + 1))
            for k in np.flatnonzero(np.diff(borders)).tolist():
                mine = order[borders[k] : borders[k + 1]]
                piece = self.piece(k)
                out[mine] &= np.uint64(0) if piece is None else piece[where[mine] % PIECE]
        return out

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Corrected counts (row, language) and the number of n-grams of each row."""
        code, rows = grams(column)
        distinct, back = np.unique(code, return_inverse=True)
        known = self.masks(distinct)[back]
        n = np.bincount(rows, minlength=len(column))
        out = np.empty((len(column), len(self.languages)))
        for k in range(len(self.languages)):
            bit = ((known[:, k // PLANE] >> np.uint64(k % PLANE)) & np.uint64(1)).astype(np.float64)
            out[:, k] = np.bincount(rows, bit, len(column))
        return np.maximum((out - n[:, None] * self.rates) / np.maximum(1 - self.rates, 1e-9), 0), n


def learn(ws: Workspace, train: DataFrame) -> LanguageFilter:
    """A filter in the workspace's folder from train(lang, text), rows with null lang not regarded."""
    path = local_path(ws.spark, f"{ws.path}/filter")
    counts = ws.table(_counts(train.where("lang is not null")), "counts")
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("c").alias("n")).collect()}  # one row per language
    languages = sorted(totals)
    if not languages:
        return LanguageFilter([], path, 0, np.zeros(0))
    planes, size = -(-len(languages) // PLANE), counts.select("code").distinct().count()
    count = 1 << max(SLOTS * size - 1, 1).bit_length()
    scale = train.sparkSession.createDataFrame([(x, k, float(max(totals[x], 1))) for k, x in enumerate(languages)], "lang string, k int, n double")
    rates = counts.join(F.broadcast(scale), "lang").select("code", "k", (F.col("c") / F.col("n")).alias("rate"))
    top = rates.groupBy("code").agg(F.max("rate").alias("top"), F.collect_list(F.struct("k", "rate")).alias("all"))
    own = top.select("code", F.expr(f"transform(filter(all, x -> x.rate >= {SHARE} * top), x -> x.k)").alias("ks"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(piece, slot in it, plane, mask) of the n-grams that a task reads, ORed as far as they meet."""
        for batch in batches:
            code = np.asarray(batch.column(0)).astype(np.uint32)
            at = batch.column(1).offsets.to_numpy()
            ks = batch.column(1).values.to_numpy()[at[0] : at[-1]]
            where = slots(np.repeat(code, np.diff(at)), count).ravel()
            language = np.tile(ks, HASHES)
            order = np.lexsort((language // PLANE, where))
            where, language = where[order], language[order]
            if not len(where):
                continue
            first = np.flatnonzero(np.append(True, (where[1:] != where[:-1]) | (language[1:] // PLANE != language[:-1] // PLANE)))
            mask = np.bitwise_or.reduceat(np.uint64(1) << (language % PLANE).astype(np.uint64), first)
            yield pa.RecordBatch.from_arrays([pa.array(where[first] // PIECE), pa.array(where[first] % PIECE), pa.array(language[first] // PLANE, pa.int64()), pa.array(mask.view(np.int64))], ["piece", "slot", "plane", "mask"])

    def write(table: pa.Table) -> pa.Table:
        """One piece of the filter as a file; how many of its slots show each bit."""
        k = table.column("piece")[0].as_py()
        masks = np.zeros((min(PIECE, count), planes), np.uint64)
        np.bitwise_or.at(masks, (table.column("slot").to_numpy(), table.column("plane").to_numpy()), table.column("mask").to_numpy().view(np.uint64))
        save(f"{path}/{k}.npy", masks)
        filled = [int(((masks[:, x // PLANE] >> np.uint64(x % PLANE)) & np.uint64(1)).sum()) for x in range(len(languages))]
        return pa.table({"piece": pa.array([k], pa.int64()), "filled": pa.array([filled], pa.list_(pa.int64()))})

    # pieces are equal ranges of hashes, so none is hot
    merged = own.mapInArrow(spread, "piece long, slot long, plane long, mask long").groupBy("piece", "slot", "plane").agg(F.bit_or("mask").alias("mask"))
    filled = merged.groupBy("piece").applyInArrow(write, "piece long, filled array<long>").agg(*(F.sum(F.get("filled", F.lit(k))).alias(f"f{k}") for k in range(len(languages)))).first()
    return LanguageFilter(languages, path, count, np.array([x or 0 for x in filled], np.float64))


def identify(docs: DataFrame, model: LanguageFilter, extra: Column | None = None) -> DataFrame:
    """(doc_id, extra, lang_pred, score) for every row of docs(doc_id, text, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, limit=1 << 20):
                column = pc.fill_null(part.column(2), "")
                letters = np.asarray(pc.match_substring_regex(column, r"\p{L}"))
                counts, _ = model.counts(column) if model.languages else (np.zeros((len(column), 1)), None)
                best, total = counts.argmax(1), counts.sum(1)
                score = np.where(letters & (total > 0), counts.max(1) / np.maximum(total, 1e-9), 0.0)
                names = [model.languages[k] if ok and model.languages else "und" for k, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if extra is None else extra).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
