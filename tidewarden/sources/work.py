"""Intermediate tables, row numbers and the spread of small inputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without it."""
    told, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not told and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="tidewarden-"))
        _until_the_end(spark, sc.getCheckpointDir())
    return told or sc.getCheckpointDir()


def _until_the_end(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def new_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the session's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/tidewarden-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    _until_the_end(spark, folder)
    return folder


def materialised(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that later steps, or a lost executor, cost no second pass."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def numbered(df: DataFrame, start: int = 0, column: str = "seq") -> DataFrame:
    """df, materialised, with the numbers start, start + 1, ... in the order of its partitions and rows; no row moves."""
    made = materialised(df.withColumn(column, F.monotonically_increasing_id()))
    part = F.shiftright(column, 33)
    rows = dict(made.groupBy(part.alias("p")).count().collect())  # one number a partition
    first, at = [], start
    for p in range(max(rows, default=-1) + 1):
        first.append(at)
        at += rows.get(p, 0)
    before = F.element_at(F.split(F.lit(",".join(map(str, first)) or "0"), ",").cast("array<long>"), part.cast("int") + 1)
    return made.withColumn(column, before + F.col(column).bitwiseAND(F.lit((1 << 33) - 1)))


def spread(df: DataFrame) -> DataFrame:
    """df dealt over all cores if it comes from fewer files than there are cores; a file's row group is one task however large."""
    if df.isStreaming or "Repartition" in df._jdf.queryExecution().analyzed().toString():
        return df  # dealt out already
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores, materialised, if it has fewer partitions: what a micro-batch reads, or a checkpoint holds, tells no files.

    Without the checkpoint Spark would put Python functions that follow before the exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return materialised(df.repartition(cores)) if 0 < df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
