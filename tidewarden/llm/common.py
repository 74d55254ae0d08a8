"""Shared helpers of the corpus operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here, and its complement, for Java and RE2.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]++"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir.

    A session on one machine (local tests) may do without that setting and gets a temporary folder.
    """
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not told and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(told or tempfile.mkdtemp(prefix="tidewarden-"))
        passing(spark, sc.getCheckpointDir())
    return told or sc.getCheckpointDir()


def passing(spark: SparkSession, folder: str) -> None:
    """Have the folder deleted when the session's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def passing_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the session's JVM ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    passing(spark, folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: like cut(), but compressed and read by columns."""
    spark = df.sparkSession
    out = f"{passing_folder(spark, 'tidewarden')}/table"
    df.write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 32 << 20) -> DataFrame:
    """df, to be broadcast if what it holds is measured to be under `most` bytes; else joins shuffle.

    df has to be cut: it is read once for the measure.
    """
    wide = [F.coalesce(F.length(F.to_json(c) if t.startswith("array") else F.col(c).cast("string")), F.lit(0)) for c, t in df.dtypes]
    held = df.agg(F.sum(sum(wide, F.lit(32)))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def trim() -> None:
    """Give memory that a finished task no longer uses back to the system: Python workers live on for the next tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def sliced(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of at most about `most` bytes of one column; a longer row stands alone."""
    for batch in batches:
        sizes = batch.column(column)
        sizes = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total + size > most and i > start:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
    trim()
