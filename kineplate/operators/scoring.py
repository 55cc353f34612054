"""Model scoring behind one protocol: batches of images in, one result per image out."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, wait
from itertools import islice
from typing import Protocol, TypeVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from ..functions.columns import dead_probability, is_alive


T = TypeVar("T")


class Scorer(Protocol):
    """What a model must offer: arrays of images to an array of logits or vectors, one row per image."""

    def __call__(self, images: np.ndarray) -> np.ndarray: ...


class Cancelled(Exception):
    """A run was told to stop; done and total say how many of its tasks had ended."""

    def __init__(self, done: int, total: int):
        super().__init__(f"cancelled after {done} of {total} tasks")
        self.done, self.total = done, total


def batch_numbers(frames: DataFrame, keys: list[str], limit: int, order: str = "t") -> DataFrame:
    """Frames with `batch`, numbered from 0: `limit` frames of each key in order, and a shorter tail."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    w = Window.partitionBy(*keys).orderBy(order)
    return frames.withColumn("batch", F.floor((F.row_number().over(w) - 1) / limit).cast("int"))


def batched(items: Iterable, limit: int) -> Iterator[list]:
    """E1 within a task: lists of `limit` items and a shorter tail."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    held = iter(items)
    while part := list(islice(held, limit)):
        yield part


def run_cancellable(spark: SparkSession, job: Callable[[], T], progress: Callable[[int, int], None] | None = None, cancelled: Callable[[], bool] | None = None, poll: float = 0.1) -> T:
    """The result of a function that runs Spark jobs, such as writing scored frames; nothing is started once cancelled, and running jobs are taken back by their tag. progress hears of tasks that have ended and of all tasks known."""
    if cancelled and cancelled():
        raise Cancelled(0, 0)
    context, tag = spark.sparkContext, f"run-{uuid.uuid4().hex}"

    def tagged() -> T:
        context.addJobTag(tag)
        return job()

    def told() -> tuple[int, int]:
        tracker = context._jsc.sc().statusTracker()
        stages = {s for j in tracker.getJobIdsForTag(tag) for info in [tracker.getJobInfo(j)] if info.isDefined() for s in info.get().stageIds()}
        infos = [i.get() for i in map(tracker.getStageInfo, stages) if i.isDefined()]
        return sum(i.numCompletedTasks() for i in infos), sum(i.numTasks() for i in infos)

    done = None
    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(tagged)
        while not running.done():
            wait([running], poll)
            if progress and told() != done:
                done = told()
                progress(*done)
            if cancelled and not running.done() and cancelled():
                seen = told()
                while not running.done():  # a job may just be starting
                    context.cancelJobsWithTag(tag)
                    wait([running], poll)
                if running.exception():
                    raise Cancelled(*seen)
        return running.result()


def as_logits(output: np.ndarray, images: int) -> np.ndarray:
    """Two logits per image from outputs of shape [2], [n, 2] or [n, 2, 1, 1]."""
    out = np.asarray(output, np.float64)
    if out.ndim == 1:
        out = out[None]
    if out.ndim == 4:
        out = out.reshape(out.shape[0], -1)
    if out.ndim != 2 or out.shape != (images, 2):
        raise ValueError(f"unexpected logits of shape {np.shape(output)} for {images} images")
    return out


def score_planes(planes: DataFrame, scorer: Scorer, prepare: Callable[[DataFrame], DataFrame], batch: int = 32) -> DataFrame:
    """Planes without their pixels, with p_dead and label (true is alive). prepare adds the array `input` (frames.model_input, frames.network_input); images of a batch meet the model together, batch after batch, as an array (images, values). A wrong number of results is an error."""
    rows = prepare(planes)
    rows = rows.select(*(c for c in rows.columns if c not in ("pixels", "input")), "input")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            logits = [as_logits(scorer(np.stack([np.asarray(x, np.float32) for x in part])), len(part)) for part in batched(pdf.input, batch)]
            both = np.concatenate(logits) if logits else np.zeros((0, 2))
            yield pdf.drop(columns="input").assign(_absent=both[:, 0], _present=both[:, 1])

    schema = rows.drop("input").schema.add("_absent", DoubleType()).add("_present", DoubleType())
    scored = rows.mapInPandas(run, schema).withColumn("p_dead", dead_probability("_absent", "_present"))
    return scored.withColumn("label", is_alive("p_dead")).drop("_absent", "_present")


def cache_key(model: str, revision: str, preprocessing: str, dtype: str = "float32") -> str:
    """V7: identity of an encoder's output, labels not regarded."""
    return hashlib.sha256("\n".join((model, revision, preprocessing, dtype)).encode()).hexdigest()


def embed_with_cache(images: DataFrame, cache: DataFrame, encoder: Scorer, identity: str, batch: int = 8) -> tuple[DataFrame, DataFrame]:
    """V7: (vectors of all images, rows to add to the cache).

    images(id, content binary); cache(identity, sha, vector). Contents that the
    cache lacks are encoded once each, whatever the number of images with them.
    """
    named = images.withColumn("sha", F.sha2("content", 256))
    known = cache.where(F.col("identity") == identity).select("sha", "vector")
    made = encode_new(named, known, encoder, batch).withColumn("identity", F.lit(identity)).select("identity", "sha", "vector")
    both = known.unionByName(made.select("sha", "vector"))
    return named.join(both, "sha").select("id", "sha", "vector"), made


def encode_new(named: DataFrame, known: DataFrame, encoder: Scorer, batch: int = 8) -> DataFrame:
    """(sha, vector) of contents in named(sha, content, ...) that known(sha, ...) lacks, each encoded once."""
    new = named.join(known.select("sha"), "sha", "left_anti").dropDuplicates(["sha"]).select("sha", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in batched(list(zip(pdf.sha, pdf.content, strict=True)), batch):
                vectors = np.asarray(encoder([bytes(c) for _, c in part]), np.float32)
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} images")
                yield pd.DataFrame({"sha": [s for s, _ in part], "vector": list(vectors)})

    return new.mapInPandas(run, "sha string, vector array<float>")


def check_digests(images: DataFrame, manifest: DataFrame) -> DataFrame:
    """V6: ids whose stored digest is not that of their content, or that lack a partner; must be empty."""
    now = images.select("id", F.sha2("content", 256).alias("now"))
    return manifest.select("id", "sha").join(now, "id", "full").where(~F.col("sha").eqNullSafe(F.col("now")))


def compare_sample(images: DataFrame, manifest: DataFrame, cache: DataFrame, identity: str, k: int = 3) -> dict[str, DataFrame]:
    """V6: the evaluation of a sample from cached vectors alone, nothing being encoded: manifest(id, sha, group, split, label) against the contents of images and a cache of one identity; changed images or missing vectors are errors."""
    from .vectors import evaluate

    if check_digests(images, manifest).limit(1).count():
        raise ValueError("images don't match the manifest's digests")
    known = cache.where(F.col("identity") == identity).select("sha", "vector")
    rows = manifest.join(known, "sha", "left")
    if rows.where("vector is null").limit(1).count():
        raise ValueError("the cache lacks vectors of this identity")
    return evaluate(rows, k)


def newest_checkpoint(spark: SparkSession, folder: str) -> str | None:
    """Path of the checkpoint to use: the newest whose name begins with best-, else the newest, else none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.ckpt")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
    files = [(s.getPath().getName().startswith("best-"), s.getModificationTime(), s.getPath().toString()) for s in found]
    return max(files)[2] if files else None
