"""Work tables in the folder that the whole cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one is made only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not (folder := spark.sparkContext.getCheckpointDir()):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kineplate-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Shuffle partitions to a file of tables with a few bytes per document, and of those with more or with work in Python before them.
SLIM, FAIR = 8, 4


class Workspace:
    """A folder of Parquet tables that lives as long as one operator call.

    Tables written here cut the lineage: a lost executor costs only the tasks
    it was running, never a recomputation from the input.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop("")

    def table(self, df: DataFrame, name: str, share: int = 1, by: str | None = None) -> DataFrame:
        """Writes df and returns a reader of what was written.

        share: shuffle partitions that make one file. Tables that hold a few
        bytes per document need fewer files than those that hold texts.
        by: a column by whose values the table is cut into folders.
        """
        if share > 1:
            df = df.coalesce(-(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // share))
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def keep(self, df: DataFrame) -> DataFrame:
        """A checkpoint of a result; it outlives the workspace."""
        return df.checkpoint(eager=True)


def local_path(spark: SparkSession, folder: str) -> str:
    """A shared folder as a path that tasks can map into memory; the cluster's default file system counts where the path names none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    full = urlparse(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString())
    if full.scheme != "file":
        raise ValueError(f"these files are mapped into memory and need a mounted shared folder, not {full.scheme}:")
    return unquote(full.path)


def save(path: str, array: np.ndarray) -> None:
    """Writes under a passing name and renames, so a repeated task does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    passing = f"{path}.{uuid.uuid4().hex}"
    with open(passing, "wb") as f:
        np.save(f, array)
    os.replace(passing, path)


def set_aside(docs: DataFrame, *taken: str) -> tuple[DataFrame, list[Column]]:
    """docs with every column renamed whose name is among the taken ones, whatever its case, and the columns that select docs' own ones from a result."""
    names = [f"{c}_{uuid.uuid4().hex}" if c.lower() in taken else c for c in docs.columns]
    return docs.toDF(*names), [F.col(f"`{a}`").alias(b) for a, b in zip(names, docs.columns, strict=True)]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
