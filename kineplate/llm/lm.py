"""Language-model scoring with an Elias-Fano n-gram trie.

The model is an n-gram model of a given order with modified absolute
discounting, interpolated from order to order:
P(w | c) = (k - D(k)) / C + B / C * P(w | c without its first word), with k the
count of w after c, C the count of c as a context, D(k) one of three discounts
for counts of 1, 2 and more, estimated per order from how many n-grams occur one
to four times, and B the sum of what the context's successors were discounted.
P(w) is (count + 0.5) / (N + 0.5 * (V + 1)), unknown words sharing one place. A
text's first word follows the end token, the second both, and so on.

Training counts all n-grams of all training texts, level by level. Tasks count
what they read in numpy and hand sorted runs of (key, count) to the shard of the
key; a shard merges its runs and writes its part of the level. The key is the
number of the context's entry in the level before, and the word. Level 1 is cut
into equal ranges of the words' hashes, whose order numbers the words; the next
levels are cut into ranges of contexts with about SHARD occurrences, which the
level before knows, so a frequent word's n-grams are spread over many shards. A
single context is not cut; counted by task first, it has at most V entries.

A shard of level 1: the words' sorted hashes as an Elias-Fano sequence, counts
and quantised log probabilities. A shard of another level: monotone pointers
(Elias-Fano) from each context to its run of successors; the successors as one
Elias-Fano sequence, in which every context has a range of V values of its own,
so that a successor is searched by its id relative to the context, in the one
bucket that may hold it; quantised log probabilities of the entries, and
quantised back-off weights of the contexts. Low parts are as wide as the spread
of the entries over these ranges asks, which is less than an id needs.

Files are written to the shared folder under a passing name and renamed, so a
repeated task does no harm; tasks map them into memory and touch only the pages
they need. The driver holds one row per shard.

Null and empty texts are the end token alone. Texts are read whole, in slices; a
very long one is a slice of its own. Repeated rows count and are scored each for
itself; null ids are kept. Other columns are not read. With nothing to learn
from every score is 0; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .elias_fano import EliasFano
from .workspace import Workspace, local_path, save

#: The longest n-grams.
ORDER = 3
#: Steps of a quantised log10 probability: one in 4096, from 0 to -16.
GRAIN, DEEPEST = 4096, 65535
#: Occurrences of contexts in a shard, and bytes of training text in one of level 1.
SHARD, SHARD_BYTES = 2 << 20, 32 << 20
#: Bytes of text looked up together: the more, the more n-grams repeat.
READ = 4 << 20
#: Keys that a task gathers before it hands them on.
GATHERED = 4 << 20
END = T.mix(np.array([0xE0D], np.uint64))[0]


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-log10 * GRAIN), DEEPEST).astype(np.uint16)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as hold them."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, each text's words and then the end, and the n+1 places where texts start."""
    hashes, at = T.words(column)
    n = len(at) - 1
    out = np.full(len(hashes) + n, END, np.uint64)
    rows = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(hashes)) + rows] = hashes
    return out, at + np.arange(n + 1)


class Counter:
    """Counts of 64-bit keys in bounded memory; full() tells when to hand them on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        values, counts = np.unique(keys, return_counts=True)
        self.parts.append((values, counts.astype(np.uint32)))
        self.size += len(values)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size = self.parts, [], 0
        return merge(parts)


def merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys = np.concatenate([p[0] for p in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    counts = np.concatenate([p[1] for p in parts])[order]
    return keys[first], np.add.reduceat(counts, first, dtype=np.uint64) if len(first) else np.zeros(0, np.uint64)


def planes(values: np.ndarray) -> bytes:
    """Bytes by place, the lowest ones of all values first: differences of sorted keys and small counts leave planes of zeros that the shuffle's compression takes out."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _runs(train: DataFrame, keys: Callable[[pa.Array], np.ndarray], cuts: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(shard, keys, counts): packed runs. keys gives the keys of a text column, cuts the places of shard borders in sorted keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            values, counts = counter.take()
            at = cuts(values)
            for s in np.flatnonzero(np.diff(at)).tolist():
                piece = slice(at[s], at[s + 1])
                cells = [planes(np.diff(values[piece], prepend=np.uint64(0))), planes(counts[piece].astype(np.uint32))]
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in cells)], ["shard", "keys", "counts"])

        for batch in batches:
            for part in T.slices(batch, limit=READ):
                counter.add(keys(part.column(0)))
                if counter.size >= GATHERED:
                    yield from out()
        yield from out()

    return train.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "shard int, keys binary, counts binary")


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return merge([(np.cumsum(from_planes(k.as_py(), np.uint64), dtype=np.uint64), from_planes(c.as_py(), np.uint32)) for k, c in zip(table.column("keys"), table.column("counts"), strict=True)])


class Trie:
    """The mapped levels in a folder.

    offsets[k]: the number of the first entry of each shard of level k, then of
    all entries; cuts[k]: the first context of each shard of level k, then the
    number of contexts (levels from 2 on); total: N.
    """

    def __init__(self, path: str, order: int):
        self.path, self.order, self.total = path, order, 0
        self.offsets: dict[int, np.ndarray] = {}
        self.cuts: dict[int, np.ndarray] = {}
        self.opened: dict[str, object] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"opened": {}}

    @property
    def size(self) -> int:
        return int(self.offsets[1][-1])

    @property
    def unknown(self) -> float:
        return float(np.log10(0.5 / (self.total + 0.5 * (self.size + 1))))

    def folder(self, level: int, shard: int) -> str:
        return f"{self.path}/{level}/{shard}"

    def part(self, level: int, shard: int, name: str) -> np.ndarray:
        path = f"{self.folder(level, shard)}/{name}.npy"
        if path not in self.opened:
            self.opened[path] = np.asarray(np.load(path, mmap_mode="r"))
        return self.opened[path]

    def sequence(self, level: int, shard: int, name: str) -> EliasFano:
        key = f"{level}/{shard}/{name}"
        if key not in self.opened:
            self.opened[key] = EliasFano(*(self.part(level, shard, f"{name}-{p}") for p in EliasFano.PARTS))
        return self.opened[key]

    def put(self, level: int, shard: int, name: str, values: np.ndarray | EliasFano) -> None:
        for p in EliasFano.PARTS if isinstance(values, EliasFano) else ("",):
            save(f"{self.folder(level, shard)}/{name}{'-' * bool(p)}{p}.npy", getattr(values, p) if p else values)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        shards = len(self.offsets[1]) - 1
        borders = shard_borders(hashes, shards)
        for s in np.flatnonzero(np.diff(borders)).tolist():
            if self.offsets[1][s + 1] > self.offsets[1][s]:
                place = self.sequence(1, s, "words").find(hashes[borders[s] : borders[s + 1]] - shard_base(s, shards))
                out[borders[s] : borders[s + 1]] = np.where(place >= 0, place + self.offsets[1][s], -1)
        return out

    def gather(self, name: str, ids: np.ndarray, blank: float) -> np.ndarray:
        """An array of level 1 at ids, `blank` where the id is -1."""
        out = np.full(len(ids), blank, np.float64)
        known = np.flatnonzero(ids >= 0)
        shard = np.searchsorted(self.offsets[1], ids[known], "right") - 1
        for s in np.unique(shard).tolist():
            mine = known[shard == s]
            out[mine] = self.part(1, s, name)[ids[mine] - self.offsets[1][s]]
        return out

    def single(self, ids: np.ndarray) -> np.ndarray:
        """log10 P of words without context."""
        return np.where(ids < 0, self.unknown, -self.gather("prob", ids, 0) / GRAIN)

    def step(self, level: int, context: np.ndarray, word: np.ndarray, shorter: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """The entry of level `level` of each word after its context, -1 where there is none, and log10 P(word | context), shorter being log10 P(word | context without its first word). Contexts are entries of the level before; with context -1 both stay."""
        entry = np.full(len(context), -1, np.int64)
        longer = None if shorter is None else shorter.copy()
        some = np.flatnonzero(context >= 0)
        bits = (self.size + 1).bit_length()
        key, back = np.unique(context[some] << bits | np.where(word[some] < 0, self.size, word[some]), return_inverse=True)
        c, w = key >> bits, key & ((1 << bits) - 1)
        found, prob, weight = np.full(len(key), -1, np.int64), np.zeros(len(key)), np.zeros(len(key))
        cuts, offsets = self.cuts[level], self.offsets[level]
        borders = np.searchsorted(c, cuts)
        for s in np.flatnonzero(np.diff(borders)).tolist():
            if offsets[s + 1] == offsets[s]:
                continue
            mine = slice(borders[s], borders[s + 1])
            local = c[mine] - cuts[s]
            at = self.sequence(level, s, "next").find(local * self.size + w[mine])
            at[w[mine] == self.size] = -1
            found[mine] = np.where(at >= 0, at + offsets[s], -1)
            if shorter is not None:
                weight[mine] = self.part(level, s, "back")[local]
                seen = np.flatnonzero(at >= 0)
                prob[borders[s] + seen] = self.part(level, s, "prob")[at[seen]]
        entry[some] = found[back]
        if shorter is not None:
            longer[some] = np.where(found[back] >= 0, -prob[back] / GRAIN, shorter[some] - weight[back] / GRAIN)
        return entry, longer

    def entries(self, level: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """Context and word of each entry of a shard."""
        context, word = np.divmod(self.sequence(level, shard, "next").decode().astype(np.int64), self.size)
        return context + self.cuts[level][shard], word

    def grams(self, level: int, lo: int, hi: int) -> np.ndarray:
        """The words of entries lo to hi of a level, one row each."""
        if level == 1:
            return np.arange(lo, hi)[:, None]
        found = []
        for s in range(int(np.searchsorted(self.offsets[level], lo, "right")) - 1, int(np.searchsorted(self.offsets[level], hi, "left"))):
            a, b = max(lo - int(self.offsets[level][s]), 0), min(hi, int(self.offsets[level][s + 1])) - int(self.offsets[level][s])
            if a < b:
                context, word = (x[a:b] for x in self.entries(level, s))
                first = int(context[0])
                found.append(np.column_stack([self.grams(level - 1, first, int(context[-1]) + 1)[context - first], word]))
        return np.concatenate(found) if found else np.zeros((0, level), np.int64)

    def successors(self, level: int, context: int) -> np.ndarray:
        """Ids that follow a context (an entry of the level before) in training, by its pointers."""
        s = int(np.searchsorted(self.cuts[level], context, "right") - 1)
        if self.offsets[level][s + 1] == self.offsets[level][s]:
            return np.zeros(0, np.int64)
        place = np.array([context - int(self.cuts[level][s])])
        start, end = (int(self.sequence(level, s, "from").before(place + k)[0]) for k in (0, 1))
        return self.entries(level, s)[1][start:end]


def shard_borders(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where shards begin and end in sorted hashes: shards are equal ranges of the hash."""
    return np.append(np.searchsorted(hashes, np.array([shard_base(s, shards) for s in range(shards)], np.uint64)), len(hashes))


def shard_base(shard: int, shards: int) -> np.uint64:
    return np.uint64(shard * ((1 << 64) // shards))


class Read:
    """Tokens of a text column: ids of the distinct ones, the place of each token among them, whether it starts a text, and where texts start."""

    def __init__(self, trie: Trie, column: pa.Array):
        hashes, self.at = tokens(column)
        distinct, place = np.unique(np.append(hashes, END), return_inverse=True)
        self.trie, self.known, self.place = trie, trie.ids(distinct), place[:-1]
        self.word, self.end = self.known[self.place], self.known[place[-1]]
        self.start = np.zeros(len(self.word), bool)
        self.start[self.at[:-1]] = True

    def contexts(self, entry: np.ndarray, first: int) -> np.ndarray:
        """What stands before each token: the entry of the token before, or `first` at the start of a text."""
        return np.where(self.start, first, np.append(-1, entry[:-1]))

    def before(self, level: int) -> np.ndarray:
        """Each token's context in a level, its entry in the level before."""
        out = self.contexts(self.word, int(self.end))
        for k in range(2, level):
            out = self.contexts(self.trie.step(k, out, self.word)[0], -1)
        return out


def learn(ws: Workspace, train: DataFrame, order: int = ORDER) -> Trie:
    """A trie in the workspace's folder from train(text, ...)."""
    if order < 2:
        raise ValueError("the order must be at least 2")
    spark = train.sparkSession
    trie = Trie(local_path(spark, f"{ws.path}/trie"), order)
    size = train.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))

    def cut_points(times: np.ndarray) -> list[int]:
        """Where the next level is cut: at the first entry, and at each after which SHARD more occurrences have gone by."""
        gone = np.cumsum(times) - times
        return np.flatnonzero(np.append(True, gone[1:] // SHARD != gone[:-1] // SHARD)).tolist()

    def words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = _merged(table)
        trie.put(1, shard, "words", EliasFano.encode(keys - shard_base(shard, shards), (1 << 64) // shards + shards))
        trie.put(1, shard, "counts", narrow(counts))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "cuts": pa.array([cut_points(counts.astype(np.int64))], pa.list_(pa.int64()))})

    def placed(rows: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of a level's shards and cuts of the next level, from one row per shard."""
        told = {r.shard: r for r in rows}
        offsets = np.append(0, np.cumsum([told[s].n if s in told else 0 for s in range(n)])).astype(np.int64)
        starts = [offsets[s] + np.array(told[s].cuts, np.int64) for s in range(n) if s in told and told[s].n]
        return offsets, np.append(np.concatenate(starts) if starts else np.zeros(0, np.int64), offsets[-1])

    level = _runs(train, lambda column: tokens(column)[0], lambda v: shard_borders(v, shards))
    rows = level.groupBy("shard").applyInArrow(words, "shard int, n long, total long, cuts array<long>").collect()  # a row per shard
    trie.total = sum(r.total for r in rows)
    trie.offsets[1], cuts = placed(rows, shards)
    if not trie.size:
        return trie
    _each_shard(spark, trie, 1, _single)
    for k in range(2, order + 1):
        trie.cuts[k] = cuts
        cuts = _level(spark, trie, train, k, cut_points, placed)
    _each_shard(spark, trie, None, _without_counts)
    return trie


def _each_shard(spark: SparkSession, trie: Trie, level: int | None, work: Callable[[Trie, int, int], None]) -> None:
    """Calls work for every shard of a level, or of all, that holds anything."""
    levels = trie.offsets if level is None else [level]
    todo = [(k, s) for k in levels for s in np.flatnonzero(np.diff(trie.offsets[k])).tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in batch.column(0).to_pylist():
                work(trie, *todo[n])
            yield batch

    spark.range(0, len(todo), 1, max(1, min(len(todo), 10_000))).mapInArrow(run, "id long").count()


def _single(trie: Trie, level: int, shard: int) -> None:
    p = (trie.part(1, shard, "counts") + 0.5) / (trie.total + 0.5 * (trie.size + 1))
    trie.put(1, shard, "prob", quantise(np.log10(p)))


def _level(spark: SparkSession, trie: Trie, train: DataFrame, level: int, cut_points: Callable, placed: Callable) -> np.ndarray:
    """Counts and encodes a level; returns the cuts of the next one."""
    size, cuts = trie.size, trie.cuts[level]
    if (int(cuts[-1]) + 1).bit_length() + (size + 1).bit_length() > 63:
        raise ValueError(f"{cuts[-1]} contexts and {size} words don't fit a key of 63 bits")

    def keys(column: pa.Array) -> np.ndarray:
        read = Read(trie, column)
        context = read.before(level)
        some = context >= 0
        return context[some].astype(np.uint64) * np.uint64(size) + read.word[some].astype(np.uint64)

    def borders(values: np.ndarray) -> np.ndarray:
        return np.append(np.searchsorted(values, cuts[:-1].astype(np.uint64) * np.uint64(size)), len(values))

    def counted(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        values, times = _merged(table)
        values -= np.uint64(int(cuts[shard]) * size)
        contexts = int(cuts[shard + 1] - cuts[shard])
        trie.put(level, shard, "from", EliasFano.encode(values // np.uint64(size), contexts, 0))
        trie.put(level, shard, "next", EliasFano.encode(values, contexts * size))
        trie.put(level, shard, "times", narrow(times))
        often = np.bincount(np.minimum(times, 5).astype(np.int64), minlength=6)[1:5]
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(values)], pa.int64()), "often": pa.array([often.tolist()], pa.list_(pa.int64())), "cuts": pa.array([cut_points(times.astype(np.int64))], pa.list_(pa.int64()))})

    made = _runs(train, keys, borders).groupBy("shard").applyInArrow(counted, "shard int, n long, often array<long>, cuts array<long>")
    rows = made.collect()  # a row per shard
    trie.offsets[level], after = placed(rows, len(cuts) - 1)
    discount = discounts([sum(r.often[k] for r in rows) for k in range(4)])
    _each_shard(spark, trie, level, lambda trie, level, shard: _smooth(trie, level, shard, discount))
    return after


def discounts(often: list[int]) -> np.ndarray:
    """What is taken off counts of 0, 1, 2 and 3 or more, from how many bigrams occur 1, 2, 3 and 4 times; halves of the counts where these are too few."""
    n1, n2, n3, n4 = often
    out = np.array([0, 0.5, 1.0, 1.5])
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        out[1] = 1 - 2 * y * n2 / n1
        out[2] = 2 - 3 * y * n3 / n2
        out[3] = 3 - 4 * y * n4 / n3 if n3 else 1.5
    return np.clip(out, [0, 0.1, 0.1, 0.1], [0, 0.95, 1.95, 2.95])


def _smooth(trie: Trie, level: int, shard: int, discount: np.ndarray) -> None:
    """Writes the probabilities of a shard's entries and the back-off weights of its contexts, from their counts."""
    context, word = trie.entries(level, shard)
    k = trie.part(level, shard, "times").astype(np.int64)
    lo, hi = int(trie.cuts[level][shard]), int(trie.cuts[level][shard + 1])
    place = context - lo
    total = np.bincount(place, k, hi - lo)
    off = discount[np.minimum(k, 3)]
    left = np.bincount(place, off, hi - lo)
    told, shorter = trie.grams(level - 1, lo, hi), trie.single(word)
    before = told[:, -1]  # the context's last word, then its last two, and so on, as entries
    for j in range(2, level):
        shorter = trie.step(j, before[place], word, shorter)[1]
        if j + 1 < level:
            before = told[:, -j]
            for i in range(2, j + 1):
                before = trie.step(i, before, told[:, i - 1 - j])[0]
    p = (k - off + left[place] * 10**shorter) / total[place]
    with np.errstate(divide="ignore", invalid="ignore"):
        back = np.where(total > 0, np.log10(left / total), 0)
    trie.put(level, shard, "prob", quantise(np.log10(p)))
    trie.put(level, shard, "back", quantise(back))


def _without_counts(trie: Trie, level: int, shard: int) -> None:
    """Removes counts that are no longer needed, once all levels are smoothed."""
    if level > 1 and os.path.exists(path := f"{trie.folder(level, shard)}/times.npy"):
        os.remove(path)


def score(docs: DataFrame, trie: Trie, extra: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs(doc_id, text, ...); held_out is extra."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, limit=READ):
                read = Read(trie, part.column(2))
                counts = trie.gather("counts", read.known, 0)
                base = np.log10((counts + 0.5) / (trie.total + 0.5 * (trie.size + 1)))[read.place]
                told, counts = trie.single(read.known)[read.place], counts[read.place]
                context = read.contexts(read.word, int(read.end))
                for k in range(2, trie.order + 1 if trie.size else 0):
                    entry, told = trie.step(k, context, read.word, told)
                    context = read.contexts(entry, -1)
                sums = [np.add.reduceat(x, read.at[:-1]) for x in ((counts > 0).astype(np.int64), base, told)]
                n = len(read.at) - 1
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(read.at)), pa.array(sums[0]), pa.array(np.full(n, trie.total)), pa.array(sums[1]), pa.array(sums[2])], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), (F.lit(False) if extra is None else extra).alias("held_out"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
