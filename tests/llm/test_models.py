"""Language identification and toxicity on held-out rows, and their edges."""

import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kineplate.llm import language as G
from kineplate.llm import toxicity as X
from kineplate.llm.queries import fold
from kineplate.llm.workspace import Workspace

from .conftest import documents

SYLLABLES = {"en": ["th", "er", "on", "an", "re", "he"], "fr": ["eau", "é", "que", "oi", "è"], "de": ["sch", "ung", "ü", "ein", "ß"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(0)
    rows = [(k, prose(rng, lang, rng.choice([1, 5, 80])), lang) for k in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    odd = [(300, None, "en"), (301, "", None), (302, "12 %", "de"), (303, "É", None), (304, "the the " * 9000, "en"), (305, "漢字", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("held_out", F.lit("x"))
    with Workspace(spark, "language") as ws:
        model = G.learn(ws, docs.where(~fold(4, 2)))
        got = {r.doc_id: r for r in G.identify(docs, model, fold(4, 2)).collect()}
        assert G.identify(docs.limit(0), model).count() == 0
        again = G.identify(docs.limit(3).union(docs.limit(3)), model).collect()
        assert len(again) == 6 and all(got[r.doc_id].lang_pred == r.lang_pred and got[r.doc_id].score == r.score for r in again)
    truth = {k: lang for k, t, lang in rows if got[k].held_out}
    assert sum(got[k].lang_pred == lang for k, lang in truth.items()) >= 0.97 * len(truth)
    assert [got[k].lang_pred for k in (300, 301, 302)] == ["und"] * 3 and got[304].lang_pred == "en" and got[305].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got.values())
    with Workspace(spark, "language") as ws:
        none = G.identify(docs, G.learn(ws, docs.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}


def text_grams(text):
    """Windows of four bytes over lower-cased letters with single spaces, by regular expressions."""
    body = b" " + re.sub(rb"[\x00-\x7f]+", lambda m: re.sub(rb"[^a-z]", b" ", m[0]), (text or "").lower().encode()) + b" "
    body = re.sub(rb" +", b" ", body)
    return [body[k : k + 4] for k in range(len(body) - 3)]


def test_masks_match_counts_of_every_ngram(spark, monkeypatch):
    """The filter against n-gram counts in dictionaries, in pieces and with more languages than a mask has bits."""
    monkeypatch.setattr(G, "PIECE", 256)
    rng = random.Random(4)
    langs = [f"l{k:03}" for k in range(70)]
    rows = [(k, "".join(rng.choices("abcdé fgh", k=rng.randint(0, 60))), rng.choice(langs)) for k in range(400)]
    docs = spark.createDataFrame(rows + [(900, None, "l000"), (901, "abcd", None)], "doc_id long, text string, lang string")
    count, total = {}, {}
    for _, t, lang in rows:
        for g in text_grams(t):
            count.setdefault(g, {}).setdefault(lang, 0)
            count[g][lang] += 1
            total[lang] = total.get(lang, 0) + 1
    with Workspace(spark, "language") as ws:
        model = G.learn(ws, docs)
        assert model.languages == sorted(total) and model.count >= G.SLOTS * len(count) and model.count > 4 * G.PIECE
        grams = sorted(count)
        masks = model.masks(np.array([int.from_bytes(g, "big") for g in grams], np.uint32))
        extra = 0
        for g, mask in zip(grams, masks, strict=True):
            rate = {lang: c / total[lang] for lang, c in count[g].items()}
            want = {lang for lang in rate if rate[lang] >= G.SHARE * max(rate.values())}
            have = {lang for k, lang in enumerate(model.languages) if int(mask[k // G.PLANE]) >> (k % G.PLANE) & 1}
            assert want <= have
            extra += len(have - want)
        assert extra <= 3 * (model.rates.sum() * len(grams) + 1)
        code, _ = G.grams(pa.array([t for _, t, _ in rows]))
        assert sorted(code.tolist()) == sorted(int.from_bytes(g, "big") for _, t, _ in rows for g in text_grams(t))


def test_toxicity(spark):
    rng = random.Random(1)
    bad = ["idiotx", "scumbag", "worthlesser", "moronic"]
    rows, labels = [], []
    for k in range(900):
        text = prose(rng, "en", rng.randint(5, 120)).split()
        toxic = k % 8 == 0
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(bad).capitalize() + rng.choice(["", ",", "!!"]))
        rows.append((k, " ".join(text)))
        if k % 3:
            labels.append((k, 1, int(toxic) if rng.random() > 0.04 else int(not toxic), "x"))
    rows += [(k + 1000, rows[16][1]) for k in range(40)] + [(2000, None), (2001, ""), (2002, "the " * 50_000)]
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = X.learn(docs.where(~fold(3, 1)), table)
    got = {r.doc_id: r for r in X.score(docs, model, fold(3, 1)).collect()}
    assert len(got) == len(rows) and set(docs.columns) < set(X.score(docs, model).columns)
    held = [k for k in range(900) if got[k].held_out]
    assert all(got[k].score < 0.7 for k in held if k % 8) and sum(got[k].score >= 0.7 for k in held if k % 8 == 0) >= 0.9 * sum(k % 8 == 0 for k in held)
    assert got[2000].score == got[2001].score < 0.5 and all(0 <= r.score <= 1 for r in got.values())
    assert {r.score for r in X.score(docs, X.learn(docs, table.limit(0))).collect()} == {X.ToxicityModel(-40.0, np.zeros(len(X.PATTERNS)), np.zeros(0, np.int64), np.zeros(0)).score(pa.array([""]))[0]}
    assert max(r.score for r in X.score(docs, X.learn(docs, table.where("toxic = 0"))).collect()) < 1e-6
    assert X.score(docs.limit(0), model).count() == 0
    # columns of the operator's names are replaced, whatever their case
    clash = docs.where("doc_id < 50").withColumn("Score", F.lit("x")).withColumn("held_out", F.lit("y"))
    again = X.score(clash, model, fold(3, 1)).collect()
    assert len(again) == 50 and all(r.score == got[r.doc_id].score and r.held_out == got[r.doc_id].held_out for r in again)
    # ties: equal texts score alike; a fit on a drawn part of the rows is a model as well
    assert len({round(got[k + 1000].score, 12) for k in range(40)} | {round(got[16].score, 12)}) == 1
    small = X.learn(docs.where(~fold(3, 1)), table, fit_rows=250)
    part = {r.doc_id: r.score for r in X.score(docs, small).collect()}
    assert (small.known == model.known).all() and sum(part[k] >= 0.7 for k in held if k % 8 == 0) >= 0.8 * sum(k % 8 == 0 for k in held)


def test_null_ids_and_repeated_labels(spark):
    rows = [(k, f"own{k} {'zork' if k % 2 else 'fine'} other{k}") for k in range(60)] + [(None, "zork"), (61, "zork zork"), (61, "zork zork")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 0) for k in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = documents(spark, rows)
    got = X.score(docs, X.learn(docs, labels)).collect()
    by = {(r.doc_id, r.text): r.score for r in got}
    assert len(got) == len(rows) and min(s for (k, t), s in by.items() if "zork" in t) > max(s for (k, t), s in by.items() if "fine" in t)


def brute_label_model(votes, width, rounds=25):
    """The label model row by row with Python numbers."""
    p = [min(max(0.7 * (width - 1 in v) + 0.3 * (len(v) > (width - 1 in v)), 0.02), 0.98) for v in votes]
    n, trust = len(votes), [1.0] * width
    for turn in range(2):
        before = [[0.0] * width, [0.0] * width]
        for _ in range(rounds):
            total = sum(p)
            fires = [[(sum(1 - q for q, v in zip(p, votes) if k in v) + 0.05) / (n - total + 1) for k in range(width)], [(sum(q for q, v in zip(p, votes) if k in v) + 0.5) / (total + 1) for k in range(width)]]
            prior = min(max(total / n, 0.005), 0.5)
            odds = [math.log(prior / (1 - prior)) + sum(trust[k] * (math.log(fires[1][k] / fires[0][k]) if k in v else math.log((1 - fires[1][k]) / (1 - fires[0][k]))) for k in range(width)) for v in votes]
            p = [1 / (1 + math.exp(-o)) for o in odds]
            if all(abs(a - b) <= 1e-2 * a for x, y in zip(fires, before) for a, b in zip(x, y)):
                break
            before = fires
        if turn == 0:
            expect = [[(1 - q) * fires[0][k] + q * fires[1][k] for k in range(width)] for q in p]
            cov = [[sum(((i in v) - e[i]) * ((j in v) - e[j]) for v, e in zip(votes, expect)) for j in range(width)] for i in range(width)]
            together = [[sum(1 for v in votes if i in v and j in v) for j in range(width)] for i in range(width)]
            own = [sum(k in v for v in votes) for k in range(width)]
            var = [sum((k in v) - 2 * (k in v) * e[k] + e[k] ** 2 for v, e in zip(votes, expect)) for k in range(width)]
            for i in range(width):
                s = 0.0
                for j in range(width):
                    spread = math.sqrt(var[i] * var[j])
                    if i != j and width - 1 not in (i, j) and together[i][j] and min(own[i], own[j]) > 0.25 * spread and cov[i][j] / spread > 0.25:
                        s += cov[i][j] / spread
                trust[i] = 1 / (1 + s)
    return p


def test_label_model_matches_loops():
    rng = random.Random(5)
    votes = []
    for _ in range(400):
        toxic = rng.random() < 0.2
        v = {k for k in range(4) if rng.random() < (0.6 if toxic else 0.03)}
        if 0 in v and rng.random() < 0.9:
            v.add(1)  # goes with voter 0 beyond the classes
        v |= {4} if (toxic if rng.random() > 0.05 else not toxic) else set()
        votes.append(sorted(v))
    blocks = []
    for part in (votes[:150], votes[150:]):
        at = np.cumsum([0, *map(len, part)]).astype(np.int32)
        blocks.append(X.Block(np.array([4 in v for v in part], np.int8), at, np.zeros(0, np.int32), at, np.concatenate(part).astype(np.int32)))
    model = X.label_model(blocks, 5)
    got = np.concatenate([model.posterior(b) for b in blocks])
    assert np.abs(got - np.array(brute_label_model(votes, 5))).max() < 1e-6


def test_toxic_words_are_not_pushed_out_by_topic_words(spark):
    rng = random.Random(2)
    topic = [f"topic{k:05}" for k in range(5000)]
    bad = ["zweeb", "quorp", "blimf", "drask", "vontu"]
    rows = [(k, " ".join(rng.sample(topic, len(topic)))) for k in range(60)]
    rows += [(100 + k, " ".join([bad[k % 5], *(f"own{k}x{j}" for j in range(9))])) for k in range(40)]
    rows += [(50_000 + k, " ".join(f"other{k}x{j}" for j in range(9))) for k in range(40)]
    labels = spark.createDataFrame([(k, int(100 <= k < 50_000)) for k, _ in rows], "doc_id long, toxic int")
    model = X.learn(documents(spark, rows), labels)
    assert len(model.known) > 5000
    decisive = X.features(pa.array(bad))[1]
    assert np.isin(decisive, model.known).all() and (model.weight[np.searchsorted(model.known, decisive)] > 0.5).all()
