"""Chat formatting by columnar byte assembly.

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles
every ``<``, backslashes, ``|`` gets one more backslash, so no control string
can occur in them and the step is undone by taking one away; a role's line
breaks and percent signs are percent-coded. All turns of a slice of a batch are
put together at once: segment lengths, their running sums and scatter indices
are numpy arrays, and headers and contents are copied into one buffer that
becomes the Arrow column. Slices hold about SLICE bytes of text, so the indices
stay small whatever the batch; a longer text is copied as one run.

Turns are ordered by turn, then role and text (nulls first); null roles and
texts are empty, and rows with a null conv_id are one conversation. Repeated
turns stay. Rows are shuffled and sorted once by conversation; of a conversation
that goes over several slices only the formatted bytes are held. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import as_bytes, slices

START, BREAK, STOP = b"<|im_start|>", b"\n", b"<|im_end|>\n"
LEARNED = "assistant"
#: Bytes of text assembled at once, and from how many on a run is copied without indices.
SLICE, RUN = 2 << 20, 1 << 14
SCHEMA = "conv_id long, n_turns long, formatted string, loss array<long>"


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _scatter(out: np.ndarray, to: np.ndarray, body: np.ndarray, lengths: np.ndarray) -> None:
    """Copies consecutive runs of body to the places `to`."""
    begin = np.cumsum(lengths) - lengths
    for k in np.flatnonzero(lengths >= RUN).tolist():
        out[to[k] : to[k] + lengths[k]] = body[begin[k] : begin[k] + lengths[k]]
    short = np.where(lengths < RUN, lengths, 0)
    inside = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
    out[np.repeat(to, short) + inside] = body[np.repeat(begin, short) + inside]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted bytes of turns, where conversations start (first: their first turns), and where each text starts and ends."""
    roles = pc.replace_substring(pc.replace_substring(pc.fill_null(roles, ""), "%", "%25"), "\n", "%0A")
    role_body, role_at = as_bytes(escape(roles))
    text_body, text_at = as_bytes(escape(pc.fill_null(texts, "")))
    role_n, text_n = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(role_n + text_n + len(START) + len(BREAK) + len(STOP))
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text_begin = begins + len(START) + role_n + len(BREAK)
    for mark, at in ((START, begins), (BREAK, text_begin - 1), (STOP, text_begin + text_n)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, begins + len(START), role_body, role_n)
    _scatter(out, text_begin, text_body, text_n)
    starts = np.append(begins[first], len(out))
    return out, starts, text_begin, text_begin + text_n


class _Part:
    """Formatted turns in a row: their bytes, where conversations start and end in them, and turns, loss spans (within the conversation) and ids of conversations."""

    def __init__(self, rows: pa.RecordBatch):
        ids = rows.column(0)
        known, value = np.asarray(ids.is_valid()), np.asarray(pc.fill_null(ids, 0))
        new = np.append(True, (value[1:] != value[:-1]) | (known[1:] != known[:-1]))
        first = np.flatnonzero(new)
        self.body, self.starts, begin, end = assemble(rows.column(2), rows.column(3), first)
        self.ids = ids.take(pa.array(first)).to_pylist()
        self.turns = np.diff(np.append(first, len(ids)))
        conv = np.cumsum(new) - 1
        mine = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(rows.column(2), LEARNED), False)))
        self.spans = np.stack([begin[mine], end[mine]], 1) - self.starts[conv[mine]][:, None]
        self.at = np.searchsorted(conv[mine], np.arange(len(first) + 1))


class _Open:
    """The conversation that the last slice ended in."""

    def __init__(self) -> None:
        self.pieces: list[bytes] = []
        self.spans: list[np.ndarray] = []
        self.turns, self.size, self.id = 0, 0, None

    def add(self, part: _Part, k: int) -> None:
        a, b = int(part.starts[k]), int(part.starts[k + 1])
        self.pieces.append(part.body[a:b].tobytes())
        self.spans.append(part.spans[part.at[k] : part.at[k + 1]] + self.size)
        self.turns, self.size, self.id = self.turns + int(part.turns[k]), self.size + b - a, part.ids[k]


def _rows(ids: list, turns: list[int], starts: np.ndarray, body: bytes, spans: list[np.ndarray]) -> pa.RecordBatch:
    at = np.append(0, np.cumsum([2 * len(s) for s in spans]))
    loss = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(spans).ravel(), pa.int64()))
    text = pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(body))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(turns, pa.int64()), text.cast(pa.string()), loss], ["conv_id", "n_turns", "formatted", "loss"])


def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCHEMA from batches (conv_id, turn, role, text) in order of conversations and turns."""
    held = _Open()

    def close(held: _Open) -> pa.RecordBatch:
        return _rows([held.id], [held.turns], np.array([0, held.size]), b"".join(held.pieces), [np.concatenate(held.spans)])

    for batch in batches:
        for rows in slices(batch, "text", SLICE):
            part = _Part(rows)
            if held.pieces and held.id == part.ids[0]:
                held.add(part, 0)
                begin = 1
            else:
                begin = 0
            if begin == len(part.ids):
                continue
            if held.pieces:
                yield close(held)
            last = len(part.ids) - 1
            if last > begin:
                starts = part.starts[begin : last + 1]
                yield _rows(part.ids[begin:last], part.turns[begin:last].tolist(), starts - starts[0], part.body[starts[0] : starts[-1]].tobytes(), [part.spans[part.at[k] : part.at[k + 1]] for k in range(begin, last)])
            held = _Open()
            held.add(part, last)
    if held.pieces:
        yield close(held)


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) of turns(conv_id, turn, role, text, ...).

    loss lists byte offsets into formatted, a start and an end for each
    assistant text in order: these bytes and no others are under the loss mask.
    """

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(formatted, SCHEMA)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts that a formatted conversation was made from."""
    found = re.findall(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", formatted, re.S)
    return [(unescape(role).replace("%0A", "\n").replace("%25", "%"), unescape(text)) for role, text in found]


def read_loss(formatted: str, loss: list[int]) -> str:
    """All text under the loss mask, as it was before formatting."""
    body = formatted.encode()
    return "".join(unescape(body[a:b].decode()) for a, b in zip(loss[::2], loss[1::2], strict=True))
