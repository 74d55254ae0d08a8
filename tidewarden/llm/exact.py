"""Exact duplicates by progressive refinement.

Texts are equal when they are identical after each run of white space is
replaced by one blank. Groups are refined in three steps, each over the rows
that the step before left in groups of two or more: by length, by the hash of a
prefix, by the SHA-256 of the whole. The refinement moves narrow rows (id,
length, hashes) only. Whole contents are read for their SHA-256 only in groups that
survive the prefix step. Where every row's SHA-256 is wanted as a result
(`digest_all`), it is taken in the scan that measures the length instead.

Hot groups: counts have map-side partial sums. What holds a thousandth of all rows or
more (a length, a prefix, a text: at most a thousand of each) is joined by broadcast,
so its rows stay where they are; the rest is joined by broadcast where its measured size
allows it, else by a shuffle.

Defined results: a null text counts as empty; of equal texts the row with the
smallest id stays (null ids last), of rows with that id the one with the smallest
`tie`; of repeated rows with that id exactly one stays; a null id's group has a null
keep_id only if all its ids are null. An empty table gives no row; columns other than
those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import SPACE, cut, small, text_or_empty


def normalised(text_col: str) -> Column:
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def joined(rows: DataFrame, groups: DataFrame, on: list[str], total: int, how: str) -> DataFrame:
    """rows joined with groups (one row for each value of `on`, and its count n; written)."""
    hot, cold = groups.where(F.col("n") * 1000 >= total), groups.where(F.col("n") * 1000 < total)
    if small(groups) is not groups:  # all groups together are small enough to be broadcast
        return rows.join(F.broadcast(groups), on, how)
    few = rows.join(F.broadcast(hot), on, "left_semi" if how == "left_semi" else "inner")
    rest = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return few.unionByName(rest.join(cold, on, how))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = 64, digest_all: bool = True, tie: Column | None = None) -> DataFrame:
    """id, keep_id, group_size, kept and, with digest_all, text_sha256 (lowercase hex), and tie if it is given."""
    norm = df.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm"), (F.lit(0) if tie is None else tie).cast("long").alias("tie"))
    whole = F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha")
    steps = [F.length(F.col("norm").cast("binary")).alias("len"), F.xxhash64(F.substring("norm", 1, prefix)).alias("head")]
    rows = cut(norm.select("id", "tie", *steps, *([whole] if digest_all else [])).withColumn("row", F.monotonically_increasing_id()))
    total = rows.count()

    def repeated(found: DataFrame, on: list[str]) -> DataFrame:
        return cut(found.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))

    by_length = joined(rows, repeated(rows, ["len"]), ["len"], total, "left_semi")
    pairs = repeated(by_length, ["len", "head"])
    if digest_all:
        by_head = joined(by_length, pairs, ["len", "head"], total, "left_semi")
    else:
        again = norm.select("id", "tie", *steps, "norm")
        by_head = joined(again, pairs, ["len", "head"], total, "left_semi").select("id", "tie", "len", "head", whole)
        by_head = cut(by_head.withColumn("row", F.monotonically_increasing_id()))
        # Rows outside surviving groups are alone; the others carry their hash.
        alone = joined(rows, pairs, ["len", "head"], total, "left").where("n IS NULL").drop("n")
        rows = alone.withColumn("sha", F.lit(None).cast("binary")).unionByName(by_head)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie", "row")).alias("first")
    keys = ["len", "head", "sha"]
    groups = cut(by_head.groupBy(*keys).agg(first, F.count(F.lit(1)).alias("n")).where("n > 1"))
    out = joined(rows, groups, keys, total, "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("first.id"))
    kept = F.col("n").isNull() | (F.col("row") == F.col("first.row"))
    hexed = [F.lower(F.hex("sha")).alias("text_sha256")] if digest_all else []
    return out.select(F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), kept.alias("kept"), *hexed, *([] if tie is None else ["tie"]))
