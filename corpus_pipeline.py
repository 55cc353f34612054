"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. run() writes every stage's rows to the
shared folder and reads them again for the next one; the tables of the stages
stay there, as the result reads the last of them.

toxicity     documents that score 0.7 or more go; learned from labelled
             documents outside the held-out fold.
line_dedup   a line found in 10 documents or more stays in the one with the
             smallest id and goes from all others; a document of which nothing
             but white space is left goes too. n_chars follows the text.
near_dedup   of each group at 0.8 of 5-word shingles the smallest id stays; of
             equal rows with one id, one.
decontaminate documents that hold 0.8 or more of a benchmark item's 5-word
             shingles go.
packing      pieces of sequences of at most 2048 tokens, with their ids.

All stages take null and empty texts, which are never toxic, near duplicates or
contaminated and stay as they are (one end token in packing); very long texts,
which are read whole; and empty tables, which give empty results. Rows with a
null id train nothing, link with nothing and stay. Repeated rows: ties go to the
smallest id, and of equal rows with one id near_dedup keeps one; rows with one
id and different texts stay or go by their own texts. Columns beyond those of
documents stay, also where they have names that a stage uses itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kineplate.llm import decontaminate as leaks
from kineplate.llm import line_dedup as lines
from kineplate.llm import near_dedup as near
from kineplate.llm import packing as packs
from kineplate.llm import toxicity as toxic
from kineplate.llm.queries import fold
from kineplate.llm.workspace import Workspace, read_table, set_aside


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, own = set_aside(docs, "held_out", "score")
    model = toxic.learn(docs.where(~fold(3, 1)), read_table(spark, sf_dir, "labels"))
    return toxic.score(docs, model).where("score < 0.7").select(*own)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs, own = set_aside(docs, "n_lines", "n_dropped", "kept_text")
    out = lines.drop_common_lines(docs, least=1, documents=10, keep_first=True)
    out = out.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(new).select(*own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near.near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("times")).where("times > 1 and doc_id is not null").select(F.col("doc_id").alias("twice_id"))
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, kept["doc_id"] == twice["twice_id"], "left_anti")
    return once.unionByName(kept.join(twice, kept["doc_id"] == twice["twice_id"], "left_semi").dropDuplicates(["doc_id", "text"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return leaks.decontaminated(docs, read_table(spark, sf_dir, "benchmark"), width=5, percent=80)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packs.pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("packing", packing)]

#: The first stage is a learned classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = read_table(spark, sf_dir, "documents"), Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
