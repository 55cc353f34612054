"""Connected components of a table of links, in rounds whose number is the logarithm of its size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import Shelf, stored

#: Links that one task joins at the end, and how often pointers are followed to their pointers in a round.
FEW, JUMPS = 1 << 16, 2


def connected(edges: DataFrame, few: int = FEW, told: list[int] | None = None, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """(id, component): the smallest id reachable from every id that has a link in edges(a, b). Ids are of any type that can be ordered; links with a null end and of an id with itself are left out.

    In each round every node points to that one of itself and its neighbours
    which comes first in an order drawn anew, by hash. The pointers make trees,
    which are flat for that order, however the ids lie along a chain; nodes are
    merged with what their pointers, followed to their pointers, lead to. So a
    round leaves about a third of a chain's nodes and fewer of denser graphs,
    and rounds get ever cheaper. Minima are formed before the shuffle; a hub's
    links are many rows of a join, which can be split. What at most `few` links
    hold together is joined by one task. On the way back every round's nodes
    take the component of what they were merged with.

    told gets the links of each round; keep writes the result, which outlives
    the tables of the rounds.
    """
    with Shelf(edges.sparkSession) as shelf:
        return keep(_rounds(edges, shelf.put, few, [] if told is None else told))


def _rounds(edges: DataFrame, save: Callable[[DataFrame], DataFrame], few: int, told: list[int]) -> DataFrame:
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = save(edges.where("a <> b").select(a, b).distinct())
    merged: list[DataFrame] = []
    while (n := pairs.count()) > few:
        told.append(n)
        draw = F.lit(len(merged))
        both = pairs.union(pairs.select("b", "a"))
        first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(draw, "b").alias("h"), F.col("b").alias("to"))).alias("m"))
        own = F.struct(F.xxhash64(draw, "a").alias("h"), F.col("a").alias("to"))
        up = save(first.select(F.col("a").alias("id"), F.least("m", own)["to"].alias("up")))
        for _ in range(JUMPS):
            above = up.select(F.col("id").alias("of"), F.col("up").alias("higher"))
            up = save(up.join(above, up["up"] == above["of"]).select("id", F.col("higher").alias("up")))
        merged.append(up)
        one = up.select(F.col("id").alias("of"), F.col("up").alias("to"))
        moved = pairs.join(one, pairs["a"] == one["of"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(one, moved["b"] == one["of"]).select("a", F.col("to").alias("b"))
        pairs = save(moved.where("a <> b").select(a, b).distinct())
    labels = _joined(pairs) if n else None
    for up in reversed(merged):
        mine = up.withColumnRenamed("up", "component")
        if labels is not None:
            known = labels.select(F.col("id").alias("of"), F.col("component").alias("root"))
            mine = mine.join(known, mine["component"] == known["of"], "left").select("id", F.coalesce("root", "component").alias("component"))
        labels = save(mine)
    if labels is None:
        return pairs.select(F.col("a").alias("id"), F.col("b").alias("component"))  # no links at all
    if not merged:
        return labels
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    return labels.join(least, "component").select("id", F.col("least").alias("component"))


def _joined(pairs: DataFrame) -> DataFrame:
    """Components of a bounded number of links, by one task."""
    kind = pairs.schema["a"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, schema = [], None
        for batch in batches:
            schema = batch.schema
            ends.append(batch)
        if not ends:
            return
        rows = pa.Table.from_batches(ends)
        both = pa.chunked_array([*rows.column(0).chunks, *rows.column(1).chunks])
        known = sorted(set(map(_key, both.to_pylist())))
        place = {x: k for k, x in enumerate(known)}
        root = list(range(len(known)))

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        for x, y in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            p, q = find(place[_key(x)]), find(place[_key(y)])
            root[max(p, q)] = min(p, q)
        tops = [known[find(k)] for k in range(len(known))]
        of = schema.field(0).type
        yield pa.RecordBatch.from_arrays([pa.array(list(map(_value, known)), of), pa.array(list(map(_value, tops)), of)], ["id", "component"])

    return pairs.repartition(1).mapInArrow(run, f"id {kind.simpleString()}, component {kind.simpleString()}")


class _Null:
    """Comes before everything."""

    def __lt__(self, other: object) -> bool:
        return not isinstance(other, _Null)

    def __gt__(self, other: object) -> bool:
        return False

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Null)

    def __hash__(self) -> int:
        return 0


def _key(x: object) -> object:
    """An id as something that can be ordered: structs by their fields, null first."""
    return tuple((k, _Null() if v is None else v) for k, v in x.items()) if isinstance(x, dict) else x


def _value(x: object) -> object:
    return {k: None if isinstance(v, _Null) else v for k, v in x} if isinstance(x, tuple) else x
