"""Tables that cut the lineage, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder spark.checkpoint.dir; a temporary one is made only where none is set and Spark runs in one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="kineplate-"))
    return context.getCheckpointDir().rstrip("/")


def lasting(df: DataFrame) -> DataFrame:
    """df written and read again, so what is built on it neither computes it anew nor is lost with an executor."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As lasting, by a Parquet table: df is computed once, where a checkpoint computes it twice, but how it was dealt out is forgotten."""
    path = fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Shelf:
    """Parquet tables of one call in a folder of their own, which goes when the call ends.

    Unlike checkpoints, tables read again carry nothing of the plan that made
    them, so loops may build on them for many rounds.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.made = spark, fresh_folder(spark), 0

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_: object) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    def put(self, df: DataFrame) -> DataFrame:
        """df written and read again, in one file for eight shuffle partitions."""
        self.made += 1
        files = -(-int(self.spark.conf.get("spark.sql.shuffle.partitions")) // 8)
        df.coalesce(files).write.parquet(f"{self.path}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.made}")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it, for tasks that read files of their own."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def put_bytes(path: str, *parts: bytes) -> None:
    """Writes a file under a passing name and renames it, so a repeated task does no harm."""
    system, at = opened(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    passing = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(passing) as f:
        for part in parts:
            f.write(part)
    system.move(passing, at)


def get_bytes(path: str) -> pa.Buffer:
    """A file's bytes, mapped into memory where it is local."""
    system, at = opened(path)
    if isinstance(system, pafs.LocalFileSystem):
        return pa.memory_map(at).read_buffer()
    with system.open_input_file(at) as f:
        return f.read_buffer()


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def put_file(spark: SparkSession, path: str, content: bytes, modified: int | None = None) -> None:
    """Writes a small file where all executors see it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = system.create(target, True)
    out.write(bytearray(content))
    out.close()
    if modified is not None:
        system.setTimes(target, modified, -1)


def numbered(df: DataFrame, order: list[Column], within: list[str] | None = None, name: str = "number", save: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """df with the place (from 0) of every row in the given order, counted anew in each group of `within`, which the order must begin with.

    Rows are dealt out by ranges of the order and sorted there; a row's place is
    its place in the partition and the sum of what earlier partitions hold, so
    no task sees a whole group. Only one number for each partition (and group
    that it holds) is added up. Rows that are equal by the order should be told
    apart by a last key where they may be many. save writes the sorted rows.
    """
    within, own = within or [], df.columns
    at, part, first, many, before = (f"{x}_{uuid.uuid4().hex}" for x in ("at", "part", "first", "many", "before"))
    rows = save(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    rows = rows.withColumn(part, F.shiftright(at, 33))
    held = rows.groupBy(part, *within).agg(F.min(at).alias(first), F.count("*").alias(many))
    if within:
        earlier = Window.partitionBy(*within).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        held = held.select(F.col(part).alias(before), *(F.col(c).alias(f"{c}_{before}") for c in within), (F.coalesce(F.sum(many).over(earlier), F.lit(0)) - F.col(first)).alias(many))
    else:  # one row for each partition
        starts, total = [], 0
        for r in sorted(held.collect(), key=lambda r: r[part]):
            starts.append((r[part], total - r[first]))
            total += r[many]
        held = F.broadcast(df.sparkSession.createDataFrame(starts, f"`{before}` long, `{many}` long"))
    same = rows[part] == held[before]
    for c in within:
        same &= rows[c].eqNullSafe(held[f"{c}_{before}"])
    return rows.join(held, same).select(*own, (F.col(at) + F.col(many)).alias(name))
