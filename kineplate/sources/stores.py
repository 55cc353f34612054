"""Stores that are written more than once: manual labels, reference collections, cached embeddings.

All are Parquet tables partitioned by what a write touches, so that a write
replaces or adds whole folders and leaves the others' files alone. Spark's
commit makes a write visible at its end or not at all; a repeated one changes
nothing. Two writers of one folder at a time are the caller's to avoid: the last
one stands.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import overlapping_groups
from ..operators.scoring import Scorer, encode_new
from ..shared import opened
from .tables import upserted

LABELS = "roi_id long, death_frame int, labeled_at string, position string"
COLLECTION = "ref_idx long, id string, label string, group string, vector array<float>, name string"
CACHE = "sha string, vector array<float>, identity string, bucket string"
#: Rows of an archive of vectors that a task reads at once.
ROWS = 4096


def _there(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if _there(spark, path) else spark.createDataFrame([], schema)


# ----------------------------------------------------------------- labels


def label_store(spark: SparkSession, path: str) -> DataFrame:
    """(position, roi_id, death_frame, labeled_at) of a store, none where there is no store yet."""
    return _read(spark, path, LABELS).select("position", "roi_id", "death_frame", "labeled_at")


def put_labels(spark: SparkSession, path: str, changes: DataFrame, frame_count: int, now: datetime | None = None) -> None:
    """Puts changes(position, roi_id, death_frame) into a store; frames outside 0..frame_count are errors and write nothing.

    Only the folders of positions that changes name are read and written anew.
    """
    touched = changes.select("position").distinct()
    old = label_store(spark, path).join(touched, "position", "left_semi")
    rows = upserted(old, changes, frame_count, now).select("roi_id", "death_frame", "labeled_at", "position")
    rows.repartition("position").sortWithinPartitions("position", "roi_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("position").parquet(path)


# ------------------------------------------------------------ collections


def vector_archive(spark: SparkSession, path: str) -> DataFrame:
    """(i, vector) of a two-dimensional array file of little-endian floats in row order (.npy); tasks read ranges of rows."""
    system, at = opened(path)
    with system.open_input_file(at) as f:
        head = f.read(12)
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is no array file")
        wide = head[6] > 1
        size = struct.unpack("<I", head[8:12])[0] if wide else struct.unpack("<H", head[8:10])[0]
        start = (12 if wide else 10) + size
        f.seek(12 if wide else 10)
        import ast

        told = ast.literal_eval(f.read(size).decode())
    if told["fortran_order"] or told["descr"] not in ("<f4", "<f8") or len(told["shape"]) != 2:
        raise ValueError(f"{path} must hold rows of floats")
    (n, d), kind = told["shape"], np.dtype(told["descr"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner, name = opened(path)
        for batch in batches:
            for first in batch.column(0).to_pylist():
                rows = min(ROWS, n - first)
                with inner.open_input_file(name) as f:
                    f.seek(start + first * d * kind.itemsize)
                    raw = f.read(rows * d * kind.itemsize)
                if len(raw) != rows * d * kind.itemsize:
                    raise ValueError(f"{path} ends early")
                x = np.frombuffer(raw, kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * d, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + rows)), vectors], ["i", "vector"])

    return spark.range(0, n, ROWS).mapInArrow(run, "i long, vector array<float>")


def read_collection(spark: SparkSession, folder: str, model: str, revision: str, dimensions: int) -> DataFrame:
    """(ref_idx, id, label, group, vector) of a folder's viable and dead references, from manifest.json, embeddings.json and embeddings.npy.

    Errors: another model or revision, embeddings in another order than the
    manifest, another shape, non-finite or zero vectors, groups that occur in
    references and evaluation, no example of either label.
    """
    row = "id string, `group` string, split string, label string"
    manifest = spark.read.schema(f"rows array<struct<{row.replace(' string', ': string')}>>").option("multiLine", "true").option("mode", "FAILFAST").json(f"{folder}/manifest.json")
    rows = manifest.select(F.posexplode("rows").alias("i", "r")).select(F.col("i").cast("long").alias("i"), "r.*")
    about = spark.read.schema("model_id string, revision string, ids array<string>").option("multiLine", "true").option("mode", "FAILFAST").json(f"{folder}/embeddings.json")
    if about.where((F.col("model_id") == model) & (F.col("revision") == revision)).count() != 1:
        raise ValueError("the embeddings are of another model or revision")
    ids = about.select(F.posexplode("ids").alias("j", "told"))
    if rows.join(ids, F.col("i") == F.col("j"), "full").where(~F.col("id").eqNullSafe(F.col("told"))).limit(1).count():
        raise ValueError("the embeddings' order is not the manifest's")
    vectors = vector_archive(spark, f"{folder}/embeddings.npy")
    bad = (F.size("vector") != dimensions) | F.exists("vector", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("vector", lambda x: x != 0)
    both = rows.join(vectors.select(F.col("i").alias("k"), "vector"), F.col("i") == F.col("k"), "full")
    wrong = both.agg(F.count_if(F.col("i").isNull() | F.col("k").isNull()).alias("shape"), F.count_if(bad).alias("bad")).first()
    if wrong.shape:
        raise ValueError("the array has another number of rows than the manifest")
    if wrong.bad:
        raise ValueError(f"vectors must have {dimensions} components, be finite and not zero")
    if overlapping_groups(rows).limit(1).count():
        raise ValueError("a group occurs in references and evaluation")
    good = both.where((F.col("split") == "reference") & F.col("label").isin("viable", "dead"))
    if good.select("label").distinct().count() != 2:
        raise ValueError("references need viable and dead examples")
    # places in the manifest rise, so they serve as indices
    return good.select(F.col("i").alias("ref_idx"), "id", "label", "group", "vector")


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored collection, empty where there is none of that name."""
    return _read(spark, path, COLLECTION).where(F.col("name") == name)


def add_collection(spark: SparkSession, path: str, name: str, rows: DataFrame) -> bool:
    """Stores a collection under a name; True if it is new, False if it is there with equal rows; other rows under the name are an error."""
    names = [f.split()[0] for f in COLLECTION.split(", ")]
    new = rows.withColumn("name", F.lit(name)).select(*names)
    old = collection(spark, path, name).select(*names)
    if old.limit(1).count():
        both = old.withColumn("n", F.lit(1)).unionByName(new.withColumn("n", F.lit(-1)))
        if both.groupBy(*names).agg(F.sum("n").alias("n")).where("n <> 0").limit(1).count():
            raise ValueError(f"a collection {name} with other contents exists")
        return False
    new.write.mode("append").partitionBy("name").parquet(path)
    return True


# ------------------------------------------------------------------ cache


def embedding_cache(spark: SparkSession, path: str, identity: str) -> DataFrame:
    """(identity, sha, vector) of one encoder's cached vectors."""
    rows = _read(spark, path, CACHE).where(F.col("identity") == identity)
    return rows.dropDuplicates(["sha"]).select("identity", "sha", "vector")


def embed_images(spark: SparkSession, images: DataFrame, path: str, encoder: Scorer, identity: str, batch: int = 8) -> DataFrame:
    """V7: (id, sha, vector) of images(id, content); contents that the cache lacks are encoded once each, written to it, and read from there.

    The cache is partitioned by encoder and the first byte of the contents'
    hash; a run adds files to the folders of new contents only. A run that is
    repeated finds all its contents and encodes nothing; one that broke off
    before its end has added nothing.
    """
    named = images.withColumn("sha", F.sha2("content", 256))
    made = encode_new(named, embedding_cache(spark, path, identity), encoder, batch)
    rows = made.select("sha", "vector", F.lit(identity).alias("identity"), F.substring("sha", 1, 2).alias("bucket"))
    rows.write.mode("append").partitionBy("identity", "bucket").parquet(path)
    return named.join(embedding_cache(spark, path, identity), "sha").select("id", "sha", "vector")
