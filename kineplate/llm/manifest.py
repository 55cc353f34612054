"""A Merkle manifest of a table: a leaf for every row, a tree for every group of rows, a tree over the groups.

A leaf is the hash of a row's fields, each `-` if null and else its length in
bytes, `:` and its value. Leaves of a group ascend by key; as long as several
nodes remain, every FAN consecutive ones become the hash of their digests. The
last node is the group's root. Group roots in the order of the groups (null
first) likewise give the root of the table. A row's proof lists, from its leaf
up to the root, what stands left and right of its node in each run of siblings.

How it runs:

1.  Spark hashes the rows and numbers them within their groups, by ranges and
    prefix sums, so a group of any size is never in one task.
2.  FAN ** DEPTH consecutive nodes of a group are an aligned block. Blocks come
    to the executors as Arrow batches; there DuckDB gets many blocks at once
    and computes their levels with ordered string_agg and sha256.
3.  Spark combines the roots of blocks: they are the nodes of the next, much
    smaller table, and so on until every group is one block; then the roots of
    groups are the leaves of one more tree.
4.  The way back joins proofs: a block's outer proof comes to it as a row of its
    own, and DuckDB puts each node's inner proof before it.

A task holds CHUNK nodes and one block more, whatever the groups' sizes. Tables
between the steps are written to the shared folder.

Keys are ordered as they compare in Spark, nulls first; rows with equal keys by
leaf, so repeated rows each have a leaf and a proof of their own. Null groups
are a group. Texts of any length are hashed where they are read. An empty table
gives an empty result. Fields are taken by name; other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import numbered
from .workspace import SLIM, Workspace

#: Siblings of a run, levels of a block, nodes that DuckDB gets at once, and rows of an Arrow batch with proofs.
FAN, DEPTH, CHUNK, ROWS = 16, 3, 1 << 14, 2048
BITS = FAN.bit_length() - 1
PROOF = "array<struct<left:string,right:string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def row_hash(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each with its length in bytes."""
    told = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def proof_hash(proof: Column) -> Column:
    """Hash of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def levels(nodes: int, alone: bool, depth: int) -> int:
    """Levels from a block's nodes to its root: all of them, unless the block is its group's only one and ends earlier."""
    return next(n for n in range(depth + 1) if FAN**n >= nodes) if alone else depth


class Blocks:
    """DuckDB over the nodes of whole blocks: a table n0(b, pos, h, i), b a block's number, i the node's row."""

    def __init__(self, db: duckdb.DuckDBPyConnection, nodes: pa.Table, depth: np.ndarray):
        self.db, self.top = db, int(depth.max(initial=0))
        db.register("nodes", nodes)
        db.register("depths", pa.table({"b": pa.array(np.arange(len(depth))), "depth": pa.array(depth)}))
        db.execute("CREATE OR REPLACE TEMP TABLE n0 AS SELECT b, pos, h, i, depth FROM nodes JOIN depths USING (b)")
        for k in range(self.top):
            db.execute(f"CREATE OR REPLACE TEMP TABLE n{k + 1} AS SELECT b, pos // {FAN} AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(depth) AS depth FROM n{k} WHERE depth > {k} GROUP BY ALL")

    def roots(self) -> list[str]:
        return [h for (h,) in self.db.execute(" UNION ALL ".join(f"SELECT b, h FROM n{k} WHERE depth = {k}" for k in range(self.top + 1)).join(("SELECT h FROM (", ") ORDER BY b"))).fetchall()]

    def proofs(self, outer: pa.Table) -> pa.ChunkedArray:
        """Proofs of all nodes in the order of their rows; outer(b, proof) has those of the blocks."""
        self.db.register("outers", outer)
        for k in range(self.top):
            run = f"OVER (PARTITION BY b, pos // {FAN} ORDER BY pos ROWS BETWEEN"
            self.db.execute(
                f"CREATE OR REPLACE TEMP TABLE s{k} AS SELECT b, pos, struct_pack(\"left\" := coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), ''), "
                f"\"right\" := coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '')) AS s FROM n{k} WHERE depth > {k}"
            )
        inner = f"list_filter([{', '.join(f's{k}.s' for k in range(self.top))}], lambda x: x IS NOT NULL)" if self.top else "[]"
        joins = "".join(f" LEFT JOIN s{k} ON s{k}.b = n0.b AND s{k}.pos = n0.pos >> {BITS * k}" for k in range(self.top))
        query = f"SELECT list_concat({inner}, outers.proof) AS proof FROM n0 JOIN outers ON outers.b = n0.b{joins} ORDER BY n0.i"
        return self.db.sql(query).to_arrow_table().column("proof")


def _engine() -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET threads = 1")
    db.execute("SET memory_limit = '512MB'")
    return db


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole blocks of rows (group, block, ...) sorted by block, about CHUNK rows at once, and the block number of each row."""

    def numbers(table: pa.Table) -> np.ndarray:
        group = table.column("group").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        block = table.column("block").to_numpy()
        return np.cumsum(np.r_[0, (group[1:] != group[:-1]) | (block[1:] != block[:-1])])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK:
            table = pa.Table.from_batches(held)
            of = numbers(table)
            last = int(np.searchsorted(of, of[-1]))
            if last:
                yield table.slice(0, last), of[:last]
            held = table.slice(last).combine_chunks().to_batches()
    table = pa.Table.from_batches(held) if held else None
    if table is not None and table.num_rows:
        yield table, numbers(table)


def _load(db: duckdb.DuckDBPyConnection, table: pa.Table, of: np.ndarray, depth: int) -> Blocks:
    pos = table.column("pos").to_numpy()
    nodes = np.flatnonzero(pos >= 0)
    counts = np.bincount(of[nodes], minlength=of[-1] + 1)
    first = np.searchsorted(of, np.arange(of[-1] + 1))
    alone = (table.column("block").to_numpy()[first] == 0) & (counts < FAN**depth)
    tall = np.array([levels(int(n), bool(a), depth) for n, a in zip(counts, alone, strict=True)])
    part = pa.table({"b": pa.array(of[nodes]), "pos": pa.array(pos[nodes] % FAN**depth), "h": table.column("node").take(nodes), "i": pa.array(nodes)})
    return Blocks(db, part, tall)


def _dealt(depth: int, nodes: DataFrame, *more: DataFrame) -> DataFrame:
    """Nodes with their blocks, a block's rows one after the other in one partition."""
    rows = nodes.withColumn("block", F.shiftright("pos", BITS * depth))
    for other in more:
        rows = rows.unionByName(other, allowMissingColumns=True)
    return rows.repartition("group", "block").sortWithinPartitions("group", "block", "pos")


def block_roots(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(group, pos, node): the root of every block of nodes(group, pos, node), numbered within its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _engine()
        for table, of in _chunks(batches):
            first = np.searchsorted(of, np.arange(of[-1] + 1))
            roots = pa.array(_load(db, table, of, depth).roots(), pa.string())
            made = [table.column(c).take(first).combine_chunks() for c in ("group", "block")]
            yield pa.RecordBatch.from_arrays([*made, roots], ["group", "pos", "node"])

    return _dealt(depth, nodes.select("group", "pos", "node")).mapInArrow(run, "group string, pos long, node string")


def node_proofs(nodes: DataFrame, outer: DataFrame, depth: int = DEPTH) -> DataFrame:
    """nodes with `proof` and `subroot`, as every block's outer(group, block, proof, node) has them: node is the root of its group, and the proof goes on above the block."""
    schema = StructType([*nodes.schema.fields, *StructType.fromDDL(f"subroot string, proof {PROOF}").fields])
    own = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _engine()
        for table, of in _chunks(batches):
            pos = table.column("pos").to_numpy()
            above, below = np.flatnonzero(pos < 0), np.flatnonzero(pos >= 0)  # one row above for each block
            outers = pa.table({"b": pa.array(of[above]), "proof": table.column("proof").take(above)})
            proofs = _load(db, table, of, depth).proofs(outers).cast(_PROOF)
            subroots = table.column("node").take(above[of[below]])
            rows = table.take(below).select(own).append_column("subroot", subroots).append_column("proof", proofs)
            for at in range(0, rows.num_rows, ROWS):
                yield from rows.slice(at, ROWS).combine_chunks().to_batches()

    # a block's outer proof comes before its nodes
    return _dealt(depth, nodes, outer.withColumn("pos", F.lit(-1).cast("long"))).mapInArrow(run, schema)


class Forest:
    """The trees over nodes(group, pos, node, ...), one for each group, as tables of nodes of ever fewer blocks."""

    def __init__(self, ws: Workspace, nodes: DataFrame, name: str, depth: int = DEPTH):
        self.ws, self.name, self.depth, self.steps, ended = ws, name, depth, [nodes], []
        while True:
            roots = ws.table(block_roots(self.steps[-1], depth), f"{name}-roots-{len(self.steps)}", SLIM)
            several = roots.where("pos > 0").select(F.col("group").alias("of")).distinct()
            same = roots["group"].eqNullSafe(several["of"])
            ended.append(roots.join(several, same, "left_anti").select("group", F.col("node").alias("root"), F.lit(len(self.steps) - 1).alias("step")))
            if not several.limit(1).count():
                break
            self.steps.append(ws.table(roots.join(several, same, "left_semi"), f"{name}-{len(self.steps)}", SLIM))
        self.roots = ws.table(functools.reduce(DataFrame.unionByName, ended), f"{name}-ended", SLIM)

    def proofs(self, above: DataFrame) -> DataFrame:
        """The first table of nodes with their proofs, above(group, proof) being those of the groups."""
        ended = self.roots.select(F.col("group").alias("of"), F.col("root").alias("node"), "step")
        ends = above.join(ended, above["group"].eqNullSafe(ended["of"])).select("group", F.lit(0).cast("long").alias("block"), "proof", "node", "step")
        inner = None
        for step in reversed(range(len(self.steps))):
            outer = ends.where(F.col("step") == step).drop("step")
            if inner is not None:
                outer = outer.unionByName(inner.select("group", F.col("pos").alias("block"), "proof", F.col("subroot").alias("node")))
            inner = node_proofs(self.steps[step], outer, self.depth)
            inner = self.ws.table(inner, f"{self.name}-proofs-{step}") if step else inner
        return inner


def manifest(ws: Workspace, docs: DataFrame, fields: tuple[str, ...], key: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None, depth: int = DEPTH) -> DataFrame:
    """(key, group, leaf, subroot, root, proof) for every row of docs, and what `carry` names beside it; reads tables of ws.

    folded(leaf, proof) gives the root for a row that is as it was.
    """
    carry = carry or {}
    named = {f: F.col(f"`{f}`") for f in (key, group, *fields)}
    leaves = docs.select(named[key].alias("key"), named[group].cast("string").alias("group"), row_hash(*(named[f] for f in fields)).alias("node"), *(c.alias(f"carried_{k}") for k, c in enumerate(carry.values())))
    leaves = ws.table(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col("group"), F.col("key"), F.col("node"), F.col("row")]
    placed = ws.table(numbered(leaves, order, ["group"], "pos", lambda df: ws.table(df, "sorted")).drop("row"), "placed")
    ws.drop("leaves")
    ws.drop("sorted")
    trees = Forest(ws, placed, "rows", depth)
    groups = numbered(trees.roots, [F.col("group")], None, "pos", lambda df: ws.table(df, "groups-sorted", SLIM))
    groups = ws.table(groups.select(F.lit("").alias("group"), "pos", F.col("root").alias("node"), F.col("group").alias("of")), "groups", SLIM)
    top = Forest(ws, groups, "groups-tree", depth)
    root = [r.root for r in top.roots.collect()]  # one, or none of an empty table
    start = docs.sparkSession.createDataFrame([("", [])], f"group string, proof {PROOF}")
    above = ws.table(top.proofs(start).select(F.col("of").alias("group"), "proof"), "above", SLIM)
    told = [F.col(f"carried_{k}").alias(c) for k, c in enumerate(carry)]
    rows = trees.proofs(above)
    return rows.select(F.col("key").alias(key), F.col("group").alias(group), F.col("node").alias("leaf"), "subroot", F.lit(root[0] if root else "").alias("root"), "proof", *told)
