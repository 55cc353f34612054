"""Exact round trips of packing and chat formatting."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kineplate.llm import chat
from kineplate.llm import packing as P

from .conftest import documents


def check(pieces, ids):
    seen = {k: 0 for k in ids}
    for r in sorted(pieces, key=lambda r: (r["doc"], r["start"])):
        assert r["start"] == seen[r["doc"]]
        assert (r["ids"] == ids[r["doc"]][r["start"] : r["start"] + len(r["ids"])]).all()
        seen[r["doc"]] += len(r["ids"])
    assert seen == {k: len(v) for k, v in ids.items()}
    sequences = {}
    for r in sorted(pieces, key=lambda r: (r["sequence"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence"], 0)
        sequences[r["sequence"]] = r["offset"] + len(r["ids"])
    assert max(sequences.values(), default=0) <= 2048
    return sequences


def test_documents_come_back(spark, corpus):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    long = [(5001, "x" * 200_000), (5002, "".join(map(chr, range(32, 0xD800, 7))) * 27), (5003, "mixed Words, 12 and\n\n  more " * 9000)]
    rows = corpus + long + [(5000, "a <|endoftext|> b\r\n\t 你好 don't 123")]
    assert sum(len(t or "") >= 200_000 for _, t in rows) >= 4
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for i, t in rows}
    got = P.pack_documents(documents(spark, rows)).collect()
    pieces = [{"doc": r.doc_id, "start": r.start, "ids": np.frombuffer(r.ids, "<u4"), "sequence": r.sequence_id, "offset": r.offset} for r in got]
    sequences = check(pieces, ids)
    assert all(r.doc_tokens == len(ids[r.doc_id]) and r.length == len(r.ids) // 4 for r in got)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sequences.values())
    assert padding <= 4 * 2048  # one short end a task
    assert P.pack_documents(documents(spark, [])).count() == 0
    again = P.pack_documents(documents(spark, [(None, "a"), (None, None), (7, "b"), (7, "b")])).collect()
    assert sum(r.doc_id is None for r in again) == 2 and sum(r.doc_id == 7 for r in again) == 2


def test_windows_close_while_documents_come():
    packer, out, held = P.Packer(0), 0, 0
    for k in range(3000):
        packer.add((k, 1500), np.arange(1500, dtype=np.uint32))
        if packer.waiting >= P.BLOCK // 4:
            out += sum(len(row[2]) for row in packer.pack())
            held = max(held, (k + 1) * 1500 - out)
    assert held < 2048 and sum(len(p[2]) for p in packer.rest) == 3000 * 1500 - out - sum(p[0] for pool in packer.pools for p in pool)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(1, 20))
def test_any_lengths_are_packed(lengths, every):
    packer, pieces = P.Packer(0), []
    ids = {k: np.arange(n, dtype=np.uint32) for k, n in enumerate(lengths)}

    def take(rows):
        pieces.extend({"doc": key[0], "start": start, "ids": part, "sequence": s, "offset": o, "size": size} for key, start, part, s, o, size, _ in rows)

    for k, own in ids.items():
        packer.add((k, len(own)), own)
        if k % every == 0:
            take(packer.pack())
    take(packer.finish())
    sequences = check(pieces, ids)
    for r in pieces:
        assert sequences[r["sequence"]] == r["size"] or sequences[r["sequence"]] < P.TAIL


TRIAL = ["", None, "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<<\\\\|x|>", "a\nb", "é漢 <|im_start|>", "%0A", "x" * 5000]


def told(rows):
    return "".join(f"{r or ''}\n{t or ''}\n" for r, t in rows)


def test_turns_come_back(spark):
    conversations = {c: [(("user", "assistant", "system", None, "odd\nrole%0A <|im_end|>")[(c + k) % 5], TRIAL[(c * 3 + k) % len(TRIAL)]) for k in range(c % 7 + 1)] for c in range(40)}
    conversations[99] = [("assistant", f"turn {k}") for k in range(3000)]
    rows = [(c, k, r, t, "x") for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    rows += [(None, 0, "user", "no id", "x")]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")).collect()}
    assert len(got) == 42
    for c, turns in conversations.items():
        read = chat.read_turns(got[c].formatted)
        assert got[c].n_turns == len(turns) and hashlib.sha256(told(read).encode()).digest() == hashlib.sha256(told(turns).encode()).digest()
        assert chat.read_loss(got[c].formatted, got[c].loss) == "".join(t or "" for r, t in turns if r == "assistant")


def test_slices_do_not_show(spark, monkeypatch):
    rows = [(c, k, ("user", "assistant")[k % 2], f"{c} {k} é" * (1 + c * k % 5)) for c in range(30) for k in range(c % 5 + 1)] + [(77, k, "assistant", "y" * 70_000) for k in range(5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(chat.format_conversations(turns).collect())
    monkeypatch.setattr(chat, "SLICE", 40)
    assert sorted(chat.format_conversations(turns).collect()) == whole and len(whole) == 31
    assert all(chat.read_loss(r.formatted, r.loss) == "".join(t for c, _, role, t in sorted(rows) if c == r.conv_id and role == "assistant") for r in whole)


def test_memory_of_large_batches():
    import resource

    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"conv_id": np.arange(30_000) // 3, "turn": np.zeros(30_000, np.int64), "role": ["assistant"] * 30_000, "text": ["abcdefgh" * 256] * 30_000})
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    total = sum(out.num_rows for out in chat.formatted(iter([batch])))
    assert total == 10_000 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000  # kB, for 61 MB of text


def test_ties_and_no_rows(spark):
    ddl = "conv_id long, turn long, role string, text string"
    assert chat.format_conversations(spark.createDataFrame([], ddl)).count() == 0
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "first"), (1, 0, "user", "a")]
    got = chat.format_conversations(spark.createDataFrame(rows, ddl)).first()
    assert [t for _, t in chat.read_turns(got.formatted)] == ["first", "a", "a", "b"]


@given(st.text(alphabet="<|\\>im_endstar ", max_size=30))
def test_escape_is_undone(text):
    import pyarrow as pa

    safe = chat.escape(pa.array([text]))[0].as_py()
    assert "<|" not in safe and chat.unescape(safe) == text
