"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Sources take their weights in
turn, in the order of their names (code points, null last), and share a given
part of all words; no target exceeds `most` times its source, and what is above
is shared anew by weight among the others until none is above.

A document of g times its source's usual share is expected to be taken e times,
e in proportion to g, at most `most`, so that the expected words of a source
are its target. It is taken

1.  floor(e) times for certain, and
2.  once more if it is drawn, with the inclusion probability p = e - floor(e):
    documents are ranked by (u / (1 - u)) / (p / (1 - p)), random odds over
    inclusion odds, and a source takes documents in that order as long as its
    words stay within what the target leaves: a sample of fixed size, counted
    in words. One change at most then brings the source closer to its target:
    a document in the place of the words still missing, or the first one left
    out in the place of a drawn one.

u is a hash of doc_id, size and a seed, so reruns agree. The place where a
source's sample ends is found by counting words in BINS ranges of the rank,
then in BINS ranges of the one in which it ends, and so on until few documents
are left to be sorted; a source of any size is nowhere in one task.

Rows that agree in doc_id, source and size are one unit with a number of rows,
as nothing tells them apart, and each of them gets a row of its own in the
result. Null and empty texts have size 0 and are taken with 0 words; a null
source is a source; null ids are an id; ties in the rank go to the smaller id
(null first), then to the smaller size. Very long texts are counted whole. An
empty table gives an empty result. Columns other than doc_id, text, source and
the weight aren't read. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import numbered
from .workspace import SLIM, Workspace

#: A word, as text between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a rank, bits told apart by one count, and units that may be sorted at the end of a source's sample.
RANK, BINS, SORTED = 52, 8, 2048
WHOLE = "decimal(38,0)"


def source_targets(ws: Workspace, sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """(source, source_size, target) of sizes(source, source_size), one row a source."""
    if percent > 100 * most:
        raise ValueError("no mix takes more than `most` times all words")
    order = numbered(sizes, [F.col("source").asc_nulls_last()], save=lambda df: ws.table(df, "sources-sorted", SLIM))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))
    sources = ws.table(order.withColumn("weight", turn.cast("long")), "sources", SLIM)
    all_words = sources.agg(F.sum("source_size").alias("n")).first().n or 0
    level, capped = 0.0, -1
    while True:  # what is capped stays so, as the level only rises
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
        now = sources.agg(
            F.coalesce(F.sum(F.when(full, most * F.col("source_size"))), F.lit(0)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("capped")
        ).first()
        if now.capped == capped or not now.open:
            break
        level, capped = (percent * int(all_words) / 100 - int(now.held)) / int(now.open), now.capped
    target = F.when(full, (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    return sources.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def _factors(ws: Workspace, units: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """sources with the factor by which a document's share becomes its expected number of copies; shares that reach `most` are held there and the others rise."""
    words = (F.col("size") * F.col("rows")).cast(WHOLE)
    shared = units.groupBy("source").agg(F.sum(F.col("share") * words).alias("open"))
    level = sources.join(shared, sources["source"].eqNullSafe(shared["source"]), "left").drop(shared["source"])
    level = ws.table(level.withColumn("factor", F.when(F.col("open") > 0, F.col("target") / F.col("open").cast("double")).otherwise(0.0)), "factor-0", SLIM)
    step, capped = 0, 0
    while True:
        full = F.col("share") * F.col("factor") > most
        joined = units.join(level, units["source"].eqNullSafe(level["source"])).drop(level["source"])
        held = joined.groupBy("source").agg(F.sum(F.when(full, most * words)).alias("held"), F.sum(F.when(~full, F.col("share") * words)).alias("rest"), F.count_if(full).alias("full"))
        held = ws.table(held.withColumnRenamed("source", "of"), f"held-{step}", SLIM)
        now = held.agg(F.sum("full").alias("n")).first().n or 0
        if now == capped:
            return level.select("source", "source_size", "target", "factor")
        capped, step = now, step + 1
        risen = (F.col("target") - F.coalesce("held", F.lit(0)).cast("double")) / F.col("rest").cast("double")
        level = level.join(held, level["source"].eqNullSafe(held["of"]), "left")
        level = ws.table(level.select("source", "source_size", "target", F.when(F.col("rest") > 0, risen).otherwise(F.col("factor")).alias("factor")), f"factor-{step}", SLIM)


def _unit() -> Column:
    """What orders units within a source."""
    return F.struct("rank", "doc_id", "size")


def _ends(ws: Workspace, units: DataFrame) -> DataFrame:
    """(of, end, part, rest): where the sample of each source ends: the first unit that is not drawn whole, how many of its rows are drawn, and the words then missing. Sources whose drawn units all fit have no row."""
    words = F.col("size") * F.col("rows")
    sampled = units.where("rank is not null")
    edge = units.groupBy("source").agg(F.first("target").alias("target"), F.sum(F.col("whole") * words).alias("certain"))
    edge = edge.select(F.col("source").alias("of"), F.lit(0).cast("long").alias("bin"), (F.col("target") - F.col("certain")).alias("need"))
    bits = 0
    while True:
        inside = sampled.join(edge, sampled["source"].eqNullSafe(edge["of"]) & (F.shiftright("rank", RANK - bits) == edge["bin"]))
        if bits and (not edge.where(F.col("units") > SORTED).limit(1).count() or bits + BINS > RANK):
            break
        bits += BINS
        binned = inside.groupBy("of", F.shiftright("rank", RANK - bits).alias("at")).agg(F.first("need").alias("need"), F.sum(words).alias("words"), F.count("*").alias("units"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("of").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        binned = binned.withColumn("before", before).where("before <= need and need < before + words")
        edge = ws.table(binned.select("of", F.col("at").alias("bin"), (F.col("need") - F.col("before")).alias("need"), "units"), f"edge-{bits}", SLIM)
    place = Window.partitionBy("of").orderBy("rank", F.col("doc_id").asc_nulls_first(), "size")
    inside = inside.withColumn("before", F.coalesce(F.sum(words).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("before <= need and need < before + size * rows")
    part = F.floor((F.col("need") - F.col("before")) / F.col("size"))
    return inside.select("of", _unit().alias("end"), part.alias("part"), (F.col("need") - F.col("before") - part * F.col("size")).alias("rest"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), percent: int = 150, most: int = 2, seed: int = 0, weight: str | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source, ...).

    weight: a column of whole numbers, a document's share beside others of its
    source (null: 0); without it all documents of a source count alike. Words
    that no share can take, as all that have one are held at `most`, are lost.
    """
    with Workspace(docs.sparkSession, "mixing") as ws:
        size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
        share = F.greatest(F.coalesce(F.col(f"`{weight}`").cast("long"), F.lit(0)), F.lit(0)) if weight else F.lit(1).cast("long")
        units = docs.select("doc_id", "source", size.alias("size"), share.alias("share")).groupBy("doc_id", "source", "size", "share").agg(F.count("*").alias("rows"))
        units = ws.table(units, "counted")
        sizes = ws.table(units.groupBy("source").agg(F.sum((F.col("size") * F.col("rows")).cast(WHOLE)).alias("source_size")), "sizes", SLIM)
        sources = source_targets(ws, sizes, weights, percent, most)
        sources = _factors(ws, units, sources, most) if weight else sources.withColumn("factor", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
        expected = units.join(sources, units["source"].eqNullSafe(sources["source"])).drop(sources["source"])
        expected = expected.withColumn("copies", F.least(F.col("share") * F.col("factor"), F.lit(float(most)))).withColumn("whole", F.floor("copies")).withColumn("p", F.col("copies") - F.col("whole"))
        name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "size")
        u = (F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << RANK)
        odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
        rank = F.when((F.col("p") > 0) & (F.col("size") > 0), F.floor(odds / (1 + odds) * float(1 << RANK)).cast("long"))
        expected = expected.withColumn("u", u).withColumn("rank", rank)
        units = ws.table(expected.select("doc_id", "source", "size", "rows", "source_size", "target", "whole", "rank"), "units")
        ends = ws.table(_ends(ws, units), "ends", SLIM)
        ended = units.join(ends, units["source"].eqNullSafe(ends["of"]), "left")
        after = _unit() >= F.col("end")
        off = F.abs(F.when(after, F.col("size") - F.col("rest")).otherwise(F.col("rest") - F.col("end.size") + F.col("size")))
        best = ended.where("rank is not null").where(off < F.col("rest")).groupBy("of").agg(F.min(F.struct(off.alias("off"), (~after).alias("swap"), _unit().alias("unit"))).alias("best"))
        best = ws.table(best.select(F.col("of").alias("best_of"), "best.swap", "best.unit"), "best", SLIM)
        ended = ended.join(best, units["source"].eqNullSafe(best["best_of"]), "left")
        drawn = F.when(F.col("end").isNull() | (_unit() < F.col("end")), F.col("rows")).when(_unit() == F.col("end"), F.col("part")).otherwise(0)
        drawn += F.when(_unit() == F.col("unit"), F.when(F.col("swap"), -1).otherwise(1)).otherwise(0) + F.when(F.col("swap") & (_unit() == F.col("end")), 1).otherwise(0)
        drawn = F.when(F.col("rank").isNull(), 0).otherwise(drawn)
        each = ended.select("doc_id", "source", "size", "source_size", "target", "whole", drawn.alias("drawn"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
        copies = (F.col("whole") + (F.col("row") <= F.col("drawn")).cast("long")).alias("copies")
        out = each.select("doc_id", "source", "size", "source_size", "target", copies)
        return ws.keep(out.withColumn("taken", F.col("copies") * F.col("size")))
