"""The audit log of blocks: an append-only table, read as a bounded view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.sources.work import materialised

COLUMNS = ["seq", "ts_iso", "direction", "matched_patterns", "cve_refs"]


def entries(decided: DataFrame, seq: str = "seq", iso: str = "ts_iso") -> DataFrame:
    """What of decided messages the log gets."""
    return decided.where("recorded").select(F.col(seq).alias("seq"), F.col(iso).alias("ts_iso"), "direction", "matched_patterns", "cve_refs")


def view(log: DataFrame, cap: int = 10_000, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Of the last `cap` entries those from `since` on, the oldest `limit` of them, in order of arrival.

    Both cuts are top-k operators: each task keeps its own best, and only those meet.
    """
    kept = log.orderBy(F.desc("seq")).limit(cap)
    if since is not None:
        kept = kept.where(F.col("ts_iso") >= since)
    kept = kept.orderBy("seq")
    return kept if limit is None else kept.limit(limit)


def total(log: DataFrame) -> DataFrame:
    """How many blocks there ever were."""
    return log.agg(F.count(F.lit(1)).alias("total"))


def report(log: DataFrame) -> DataFrame:
    """Blocks by direction, pattern and day."""
    each = log.select("direction", F.substring("ts_iso", 1, 10).alias("day"), F.explode("matched_patterns").alias("pattern"))
    return each.groupBy("direction", "day", "pattern").agg(F.count(F.lit(1)).alias("blocks"))


def nearest_rank(df: DataFrame, column: str, ranks: tuple[float, ...] = (0.5, 0.99, 0.999, 1.0)) -> DataFrame:
    """(p, value): the element at index round((n - 1) * p) of the sorted column, halves away from zero.

    Exact, without a sort of the rows: value counts are dealt out by range, one total a
    range goes to the driver, and only the ranges that hold an asked index are walked.
    """
    counts = df.select(F.col(column).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    ranged = materialised(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = sorted(ranged.groupBy("part").agg(F.sum("c")).collect())
    n, asked = sum(t for _, t in totals), []
    for p in ranks if n else ():
        index, before = int((n - 1) * p + 0.5), 0
        for part, total_ in totals:
            if index < before + total_:
                asked.append((float(p), part, index - before))
                break
            before += total_
    wanted = df.sparkSession.createDataFrame(asked, "p double, part int, rest long")  # one row a rank
    up_to = F.sum("c").over(W.partitionBy("part").orderBy("v"))
    walked = ranged.where(F.col("part").isin(sorted({a[1] for a in asked}))).withColumn("up_to", up_to)
    return walked.join(F.broadcast(wanted), "part").where(F.col("up_to") > F.col("rest")).groupBy("p").agg(F.min("v").cast("double").alias("value")).orderBy("p")


def measured(decided: DataFrame, observation: Observation) -> DataFrame:
    """decided, counting as it is read: messages, blocks, warnings, refusals and replaced lists."""
    counts = {"messages": F.lit(True), "blocked": F.col("action") == "block", "warned": F.col("action") == "warn", "refused": F.col("action") == "refuse", "recorded": F.col("recorded")}
    return decided.observe(observation, *(F.sum(F.when(c, 1).otherwise(0)).alias(k) for k, c in counts.items()))
