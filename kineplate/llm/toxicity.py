"""Toxicity by weak supervision.

Features of a document are its distinct words and the first PREFIX bytes of
longer words, as 31-bit hashes, besides a few patterns of its characters and
whether it holds a word of a list of insults.

1.  How often each feature stands in toxic and in other labelled documents is
    counted over all labelled training rows. A row weighs one over the number
    of rows of its label with the same smallest shingle hash, so a document
    that was copied many times does not make a lexicon of its words.
2.  The features that speak for toxicity beyond doubt are the lexicon voters;
    the patterns and the list of insults vote too, and the label that came
    with a row is one more voter, not the truth.
3.  A generative model of the votes is fitted by expectation maximisation: it
    estimates how often each voter fires in either class. Voters that still go
    together within the classes are correlated; each voter's evidence is
    divided by the sum of its correlations, and the posterior is formed again.
4.  A logistic classifier over the chosen features is trained on the posterior
    labels; its probability is the score.

Steps 1 and 2 cover every labelled training row; how many features and voters
there are follows from the thresholds SURE and WORTH alone. They are not raised
with the number of features tested, which costs recall; chance voters get
little evidence from the label model. Steps 3 and 4 fit two models of as many
numbers as there are voters and features on at most about `fit_rows` labelled
rows that hold at most about `fit_entries` chosen features (both parameters of
learn()), drawn by a hash of the id; with fewer rows, on all of them.

Null and empty texts have no features and score the classifier's constant.
Without labelled rows of both kinds every score is the share of toxic labels, 0
where there are none. An id with several labels has the largest; rows with a
null id train nothing, but are scored. Repeated rows count and are scored each
for itself, and equal texts score alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .workspace import SLIM, Workspace

PREFIX = 6
#: Entries of a packed block of rows, and pairs of votes looked at at once.
BLOCK, PAIRS = 1 << 20, 1 << 21
#: Labelled rows, and chosen features in them, that the two models are fitted on at most.
FIT_ROWS, FIT_ENTRIES = 40_000, 12_000_000
#: z value of the log odds from which a feature votes, or is looked at.
SURE, WORTH = 2.5, 2.0
PATTERNS = ("symbols", "capitals", "exclaims", "repeats", "short", "insult")

#: Insults that vote together; what their vote is worth comes from the labels (fixed values, a plain word list).
INSULTS = (
    "arrogant bastard brainless clown coward creep cretin despicable dimwit disgrace disgusting dumb dumbass filth filthy fool foolish freak garbage idiot idiotic ignorant imbecile jerk liar loser "
    "lunatic moron moronic nasty pathetic pig repulsive rotten rubbish scum shameful sick sickening stupid trash ugly useless vermin vile wimp worthless wretch "
    "abruti con connard crétin débile imbécile minable ordure pathétique pourriture salaud stupide "
    "abschaum arschloch depp dumm dummkopf ekelhaft erbärmlich trottel versager wertlos widerlich "
    "asqueroso basura escoria estúpido idiota imbécil inútil patético payaso perdedor"
).split()

_listed: list[np.ndarray] = []
_SPLIT = np.arange(256, dtype=np.uint8)
_SPLIT[[b for b in range(128) if not (97 <= b <= 122 or 48 <= b <= 57)]] = 32


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs, sorted, and a hash of the smallest run of four words of each row."""
    body, offsets = T.as_bytes(pc.utf8_lower(column))
    body = _SPLIT[body]
    starts, ends, hashes = T.word_spans(body, offsets)
    at = np.searchsorted(starts, offsets, "left")
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    long = ends - starts > PREFIX
    head = np.zeros(int(long.sum()), np.uint64)
    for k in range(PREFIX):
        head = head << np.uint64(8) | body[starts[long] + k]
    feature = np.concatenate([hashes, T.mix(head + np.uint64(0xA5A5A5A5A5A5))]) & np.uint64(0x7FFFFFFF)
    pairs = np.unique(np.concatenate([rows, rows[long]]).astype(np.uint64) << np.uint64(31) | feature)
    runs = T.window_hashes(hashes, 4)
    least = np.zeros(len(offsets) - 1, np.uint64)
    for k in range(len(least)):
        own = runs[at[k] : max(at[k + 1] - 3, at[k])]
        least[k] = own.min() if len(own) else T.mix(hashes[at[k] : at[k + 1]].sum(keepdims=True))[0]
    return (pairs >> np.uint64(31)).astype(np.int64), (pairs & np.uint64(0x7FFFFFFF)).astype(np.int64), least


def insults() -> np.ndarray:
    """Features of the word list, sorted."""
    rows, feature, _ = features(pa.array(INSULTS))
    whole = (T.hash_words(INSULTS) & np.uint64(0x7FFFFFFF)).astype(np.int64)
    return np.unique(whole[np.isin(whole, feature)])


def patterns(column: pa.Array, rows: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters, one column each; (row, feature): as features() gives them."""
    if not _listed:
        _listed.append(insults())
    body, offsets = T.as_bytes(column)
    size = np.maximum(np.diff(offsets), 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    kind = np.isin(body, np.frombuffer(b"%&$#*@", np.uint8))
    again = np.append(False, body[1:] == body[:-1]) & ~np.isin(body, np.frombuffer(b" \n", np.uint8))
    insulting = np.zeros(len(size), bool)
    insulting[rows[np.isin(feature, _listed[0])]] = True
    return np.stack([share(kind) > 0.05, share((body >= 65) & (body <= 90)) > 0.3, share(body == 33) > 0.02, share(again) > 0.15, np.diff(offsets) < 80, insulting], 1)


def _train_rows(ws: Workspace, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, least, feats): labelled rows with their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch):
                rows, feature, least = features(part.column(2))
                at = np.searchsorted(rows, np.arange(part.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature.astype(np.int32)))
                votes = pa.FixedSizeListArray.from_arrays(pa.array(patterns(part.column(2), rows, feature).ravel()), len(PATTERNS)).cast(pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least.view(np.int64)), lists, votes], ["doc_id", "toxic", "least", "feats", "votes"])

    # labels grow with the documents, so they are merged at every size and never broadcast
    one = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic")).hint("merge")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").join(one, F.col("doc_id") == F.col("label_id"))
    return ws.table(rows.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, least long, feats array<int>, votes array<boolean>"), "train")


@dataclass
class ToxicityModel:
    """bias, pattern weights, and the weights of the sorted features."""

    bias: float
    pattern: np.ndarray
    known: np.ndarray
    weight: np.ndarray

    def score(self, column: pa.Array) -> np.ndarray:
        rows, feature, _ = features(column)
        total = self.bias + patterns(column, rows, feature) @ self.pattern
        if len(self.known):
            seen = np.zeros(1 << 20, bool)
            seen[self.known & 0xFFFFF] = True
            maybe = seen[feature & 0xFFFFF]
            rows, feature = rows[maybe], feature[maybe]
            at = np.minimum(np.searchsorted(self.known, feature), len(self.known) - 1)
            total += np.bincount(rows, np.where(self.known[at] == feature, self.weight[at], 0.0), len(column))
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


@dataclass
class Block:
    """Packed rows: labels, the features of each row and its votes."""

    label: np.ndarray
    at: np.ndarray
    feats: np.ndarray
    vote_at: np.ndarray
    votes: np.ndarray

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.label)), np.diff(self.at))

    @property
    def vote_rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.label)), np.diff(self.vote_at))


PACKED = ("label", "at", "feats", "vote_at", "votes")


def _unpack(table: pa.Table) -> list[Block]:
    return [Block(*(np.frombuffer(table.column(name)[k].as_buffer(), np.int8 if name == "label" else np.int32) for name in PACKED)) for k in range(table.num_rows)]


@dataclass
class LabelModel:
    """P(toxic) of rows by their votes, the last voter being the label that came with a row."""

    base: float
    gain: np.ndarray | None = None

    def posterior(self, block: Block) -> np.ndarray:
        n, rows = len(block.label), block.vote_rows
        if self.gain is None:  # before any round
            return np.clip(0.7 * block.label + 0.3 * (np.diff(block.vote_at) > block.label), 0.02, 0.98)
        return 1 / (1 + np.exp(-np.clip(self.base + np.bincount(rows, self.gain[block.votes], n), -40, 40)))


def _vote_sums(model: LabelModel, width: int) -> Callable[[Block], np.ndarray]:
    """Per voter the posterior and the number of rows where it fires; then the sums of the posterior, the rows and the squared posterior."""

    def sums(block: Block) -> np.ndarray:
        p = model.posterior(block)
        return np.concatenate([np.bincount(block.votes, p[block.vote_rows], width), np.bincount(block.votes, minlength=width), [p.sum(), len(p), p @ p]])

    return sums


def _together(blocks: list[Block], fires: np.ndarray, sums: np.ndarray, width: int) -> np.ndarray:
    """Per voter the sum of its correlations above 0.25 with others within the classes. Voters that never fire together have none, and the label, the last one, is nobody's copy."""
    q, own, (q1, n, q2) = sums[:width], sums[width : 2 * width], sums[2 * width :]
    f0, d = fires[0], fires[1] - fires[0]

    def covariance(i: np.ndarray, j: np.ndarray, both: np.ndarray) -> np.ndarray:
        apart = f0[j] * own[i] + d[j] * q[i] + f0[i] * own[j] + d[i] * q[j]
        return both - apart + n * f0[i] * f0[j] + q1 * (f0[i] * d[j] + d[i] * f0[j]) + q2 * d[i] * d[j]

    each = np.arange(width)
    spread = np.sqrt(np.maximum(covariance(each, each, own), 0)) + 1e-9
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for block in blocks:
        later = np.repeat(block.vote_at[1:], np.diff(block.vote_at)) - np.arange(len(block.votes)) - 1
        done = np.append(0, np.cumsum(later, dtype=np.int64))
        lo = 0
        while lo < len(later):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PAIRS, "right")) - 1)
            first = np.repeat(np.arange(lo, hi), later[lo:hi])
            second = first + 1 + np.arange(len(first)) - (done[first] - done[lo])
            i, j = block.votes[first].astype(np.int64), block.votes[second].astype(np.int64)
            # what does not fire often enough together even if it always did is left out
            near = np.minimum(own[i], own[j]) > 0.25 * spread[i] * spread[j]
            key, count = np.unique(i[near] * width + j[near], return_counts=True)
            both = np.concatenate([keys, key])
            keys, back = np.unique(both, return_inverse=True)
            counts = np.bincount(back, np.concatenate([counts, count]), len(keys)).astype(np.int64)
            lo = hi
    i, j = np.divmod(keys, width)
    corr = covariance(i, j, counts) / (spread[i] * spread[j])
    high = (corr > 0.25) & (j < width - 1)
    return np.bincount(i[high], corr[high], width) + np.bincount(j[high], corr[high], width)


def label_model(blocks: list[Block], width: int, rounds: int = 25) -> LabelModel:
    """The label model of voters that speak for toxicity or are silent, and the row's own label as a voter, by expectation maximisation until the rates stand still."""
    model, trust = LabelModel(0.0), np.ones(width)
    for turn in range(2):
        before = np.zeros((2, width))
        for _ in range(rounds):
            sums = sum(map(_vote_sums(model, width), blocks))
            px, x, p, n = sums[:width], sums[width : 2 * width], sums[2 * width], sums[2 * width + 1]
            fires = np.stack([(x - px + 0.05) / (n - p + 1), (px + 0.5) / (p + 1)])
            gain, miss = np.log(fires[1] / fires[0]) * trust, np.log((1 - fires[1]) / (1 - fires[0])) * trust
            prior = float(np.clip(p / n, 0.005, 0.5))
            model = LabelModel(float(np.log(prior / (1 - prior)) + miss.sum()), gain - miss)
            if (np.abs(fires - before) <= 1e-2 * fires).all():
                break
            before = fires
        if turn == 0:  # what goes together beyond the classes counts once
            trust = 1 / (1 + _together(blocks, fires, sum(map(_vote_sums(model, width), blocks)), width))
    return model


def _logistic(blocks: list[Block], votes: LabelModel, width: int, rounds: int = 60, decay: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and constant of an L2-regularised logistic model on the posterior labels, by L-BFGS scaled per feature."""
    targets = [votes.posterior(block) for block in blocks]

    def look(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def sums(block: Block, target: np.ndarray) -> np.ndarray:
            n, rows = len(block.label), block.rows
            z = w[width] + np.bincount(rows, w[block.feats], n)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            err, bend = p - target, p * (1 - p)
            return np.concatenate([np.bincount(block.feats, err[rows], width), [err.sum()], np.bincount(block.feats, bend[rows], width), [bend.sum(), (np.logaddexp(0, z) - target * z).sum()]])

        got = sum(map(sums, blocks, targets))
        off = np.append(w[:width], 0.0)
        return got[-1] + 0.5 * decay * (off @ off), got[: width + 1] + decay * off, got[width + 1 : -1] + np.append(np.full(width, decay), 1e-3)

    w = np.append(np.zeros(width), -2.0)
    loss, slope, bend = look(w)
    least, past = 5e-3 * np.linalg.norm(slope / np.sqrt(bend)), []
    for _ in range(rounds):
        step, alphas = slope.copy(), []
        for s, y in reversed(past):
            alphas.append((s @ step) / (s @ y))
            step -= alphas[-1] * y
        step /= bend
        if past:
            s, y = past[-1]
            step *= (s @ y) / (y @ (y / bend))
        for (s, y), a in zip(past, reversed(alphas), strict=True):
            step += (a - (y @ step) / (s @ y)) * s
        size = 1.0
        while True:
            then = look(w - size * step)
            if then[0] <= loss - 1e-4 * size * (slope @ step) or size < 1e-9:
                break
            # the parabola through both losses and the slope has its least value here
            size *= min(max(0.5 * size * (slope @ step) / (then[0] - loss + size * (slope @ step)), 1e-3), 0.5)
        if then[0] > loss:
            break
        s, y = -size * step, then[1] - slope
        if s @ y > 0:
            past = [*past, (s, y)][-10:]
        w, (loss, slope, bend) = w + s, then
        if np.linalg.norm(slope / np.sqrt(bend)) <= least:
            break
    return w[:width], float(w[width])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_entries: int = FIT_ENTRIES) -> ToxicityModel:
    """A model from the rows of docs(doc_id, text, ...) that labels(doc_id, toxic, ...) covers."""
    none = np.zeros(0, np.int64)
    with Workspace(docs.sparkSession, "toxicity") as ws:
        train = _train_rows(ws, docs, labels)
        # written, so that the join below deals both sides anew and groups of copies can be split
        sizes = ws.table(train.groupBy("toxic", "least").agg(F.count("*").alias("copies")), "sizes", SLIM)
        totals = {r.toxic: (r.n, float(r.w)) for r in sizes.groupBy("toxic").agg(F.sum("copies").alias("n"), F.count("*").alias("w")).collect()}
        n, share = sum(x[0] for x in totals.values()), totals.get(1, (0, 0))[0]
        if not totals.get(0) or not totals.get(1):
            rate = share / n if n else 0.0
            return ToxicityModel(float(np.clip(np.log((rate + 1e-18) / (1 - rate + 1e-18)), -40, 40)), np.zeros(len(PATTERNS)), none, np.zeros(0))
        w1, w0 = totals[1][1], totals[0][1]
        weighed = train.join(sizes, ["toxic", "least"]).select("toxic", (1 / F.col("copies")).alias("w"), F.explode("feats").alias("f"))
        stats = weighed.groupBy("f").agg(F.sum(F.col("w") * F.col("toxic")).alias("a"), F.sum(F.col("w") * (1 - F.col("toxic"))).alias("b"), F.count("*").alias("rows")).where("a + b >= 2")
        odds = F.log((F.col("a") + 0.5) / (w1 + 1)) - F.log((F.col("b") + 0.5) / (w0 + 1))
        z = odds / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
        top = stats.withColumn("z", z).where(F.abs("z") >= WORTH).toPandas()
        top = top.sort_values("f").reset_index(drop=True)
        known = top.f.to_numpy(np.int64)
        mostly = top.a.to_numpy() >= 0.5 * (top.a + top.b).to_numpy()
        sure = np.flatnonzero((top.z.to_numpy(np.float64) >= SURE) & mostly)
        # patterns are features and voters behind the others, the label is the last voter
        voters = len(sure) + len(PATTERNS) + 1
        spot = np.full(len(known) + len(PATTERNS), -1, np.int32)
        spot[sure] = np.arange(len(sure))
        spot[len(known) :] = len(sure) + np.arange(len(PATTERNS))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ends = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
                lo = 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK, "right")))
                    part = batch.slice(lo, hi - lo)
                    lo, n = hi, part.num_rows
                    own, feat_rows = part.column(1).flatten().to_numpy(), np.repeat(np.arange(n), pc.list_value_length(part.column(1)).to_numpy())
                    near = np.searchsorted(known, own)
                    hit = np.append(known, -1)[near] == own
                    label = part.column(0).to_numpy()
                    pattern_row, pattern = np.nonzero(part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(n, len(PATTERNS)))
                    rows, cols = np.concatenate([feat_rows[hit], pattern_row]), np.concatenate([near[hit], pattern + len(known)])
                    order = np.lexsort((cols, rows))
                    rows, cols = rows[order], cols[order]
                    votes = spot[cols]
                    told = np.flatnonzero(label)
                    vote_rows, votes = np.concatenate([rows[votes >= 0], told]), np.concatenate([votes[votes >= 0], np.full(len(told), voters - 1)])
                    order = np.lexsort((votes, vote_rows))
                    cells = (label.astype(np.int8), np.searchsorted(rows, np.arange(n + 1)), cols, np.searchsorted(vote_rows[order], np.arange(n + 1)), votes[order])
                    yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int8 if k == 0 else np.int32).tobytes()], pa.binary()) for k, x in enumerate(cells)], list(PACKED))

        share = min(1.0, fit_rows / n, fit_entries / max(int(top.rows.sum()), 1))
        drawn = train if share == 1 else train.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 40)) < int(share * (1 << 40)))
        blocks = _unpack(drawn.select("toxic", "feats", "votes").mapInArrow(pack, ", ".join(f"{x} binary" for x in PACKED)).toArrow())
    w, b = _logistic(blocks, label_model(blocks, voters), len(known) + len(PATTERNS))
    return ToxicityModel(b, w[len(known) :], known, w[: len(known)])


def score(docs: DataFrame, model: ToxicityModel, extra: Column | None = None) -> DataFrame:
    """docs with its column text scored: all columns of docs, then held_out (extra) and score, from 0 to 1, in place of columns of docs with these names."""
    names = [c for c in docs.columns if c.lower() not in ("held_out", "score")]
    rows = docs.select(*names, (F.lit(False) if extra is None else extra).alias("held_out"), F.col("text").cast("string").alias("_scored_text"))
    schema = rows.drop("_scored_text").schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.rename_columns([*(f"c{k}" for k in range(batch.num_columns - 1)), "text"])
            for part in T.slices(texts):
                columns = part.columns
                yield pa.RecordBatch.from_arrays([*columns[:-1], pa.array(model.score(columns[-1]))], [*batch.schema.names[:-1], "score"])

    return rows.mapInArrow(run, schema)
