"""Message lines: one JSON-RPC message a line, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "direction string, program string, raw string, seq long"


def _lines(read: DataFrame, direction: str, program: str) -> DataFrame:
    if direction not in ("inbound", "outbound"):
        raise ValueError(f"direction must be inbound|outbound, got {direction}")
    return read.select(F.lit(direction).alias("direction"), F.lit(program).alias("program"), F.col("value").alias("raw"))


def read_lines(spark: SparkSession, path: str, direction: str, program: str) -> DataFrame:
    """Lines of text files, numbered in the order of files and lines (gaps between tasks)."""
    return _lines(spark.read.text(path), direction, program).withColumn("seq", F.monotonically_increasing_id())


def stream_lines(spark: SparkSession, path: str, direction: str, program: str, files_per_batch: int = 100) -> DataFrame:
    """The same as files arrive. Each micro-batch takes `files_per_batch` files at most."""
    return _lines(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path), direction, program)


def read_manifests(spark: SparkSession, path: str, program: str) -> DataFrame:
    """Whole files, one manifest each: (program, raw)."""
    return spark.read.text(path, wholetext=True).select(F.lit(program).alias("program"), F.col("value").alias("raw"))


def payloads(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in texts], "text string")


def write_forwarded(decided: DataFrame, path: str) -> None:
    """The lines that go on, in order of arrival within each file: stamped lists as they were stamped, replaced ones as their reply."""
    forwarded(decided).write.mode("append").text(path)


def forwarded(decided: DataFrame) -> DataFrame:
    stamped = [F.col("stamped")] if "stamped" in decided.columns else []
    return decided.where(~F.col("action").isin("drop", "block", "refuse")).select(F.coalesce(*stamped, "reply", "raw").alias("value"))


def write_replies(decided: DataFrame, path: str) -> None:
    """The replies to the sender."""
    decided.where("reply IS NOT NULL").select(F.col("reply").alias("value")).write.mode("append").text(path)
