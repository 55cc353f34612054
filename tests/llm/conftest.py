from __future__ import annotations

import random
import re

import pytest

WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, width):
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, h1 string, batch string"


def documents(spark, rows):
    """Rows (doc_id, text) with the other columns, among them names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x", "b") for i, t in rows], DOCS)


@pytest.fixture
def corpus():
    """Ids and texts: near copies at many distances, exact copies, shared passages, odd white space, empty, null and long ones."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeéß漢X", k=rng.randint(1, 7))) for _ in range(300)]
    rows = []
    passage = [rng.choice(vocabulary) for _ in range(12)]
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 30, 120, 400]))] + (passage if rng.random() < 0.5 else [])
        for k in range(rng.choice([1, 2, 9])):
            copy = [rng.choice(vocabulary) if rng.random() < 0.02 * k / 2 else w for w in base]
            rows.append((len(rows), rng.choice([" ", "  ", "\t"]).join(copy) if k % 2 else "\n".join(" ".join(copy[i : i + 9]) for i in range(0, len(copy), 9))))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", None, " \n\x0b", "One", "one", "oNE two", "\xa0 a\x1cb", "word " * 40_000, "x" * 300_000])]
    rows += [(1000 + k, rows[5][1]) for k in range(7)]
    return rows
