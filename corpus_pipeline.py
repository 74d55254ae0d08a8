"""A corpus pipeline: language ID, exact dedup, near-dedup, source mixing, packing.

Each stage gets what its predecessor kept, read back from Parquet, and all but
the last return the columns of documents. Rows that share id and text are one
document; null ids never drop a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import exact, langid, minhash, mixing, packing
from tidewarden.llm.common import cut, passing_folder, small
from tidewarden.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter in it (`und`), or no more known n-grams than false positives explain (score 0)."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, model).where("lang_pred <> 'und' AND score > 0").select(*COLUMNS)


def _without(docs: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """docs without those that agree with one of the rows (written) in all keys, null with null. Texts stay where they are if the rows are few enough to be broadcast."""
    other = rows.select(*(F.col(k).alias(f"_other{i}") for i, k in enumerate(keys)))
    same = [F.col(k).eqNullSafe(F.col(f"_other{i}")) for i, k in enumerate(keys)]
    return docs.join(small(other), same, "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id stays, once."""
    docs = docs.select(*COLUMNS)
    own = F.xxhash64(*COLUMNS, *(F.col(c).isNull() for c in COLUMNS))
    found = exact.exact_duplicates(docs, digest_all=False, tie=own).where("group_size > 1")
    found = cut(found.groupBy("doc_id", F.col("tie").alias("_tie")).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"))
    left = _without(docs.withColumn("_tie", own), found.where("NOT kept"), "doc_id", "_tie")
    twins = found.where("kept")  # rows that are alike in every column
    if not twins.isEmpty():
        once = left.join(small(twins.select(F.col("doc_id").alias("_id"), F.col("_tie").alias("_twin"))), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_tie") == F.col("_twin")), "left_semi")
        left = _without(left, twins, "doc_id", "_tie").unionByName(once.dropDuplicates(["doc_id", "_tie"]))
    return left.select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id: five-word shingles, similarity 0.8.

    Id and text make a document, so rows that share an id, or have none, are judged each by its own text.
    """
    docs = docs.select(*COLUMNS)
    gone = cut(minhash.near_duplicates(docs, shingle=5).where("NOT first").select("node").distinct())
    return _without(docs.withColumn("node", minhash.node("doc_id", "text")), gone, "node").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out as the mix takes them.

    Rows that share id and text are taken together: the first, by its columns, stands for all.
    """
    found = mixing.mix(docs).groupBy(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_sum")).agg(F.sum("times").alias("_times"), F.count(F.lit(1)).alias("_rows"))
    found = cut(found.withColumn("_key", F.xxhash64(F.col("_id").isNull(), "_id", "_sum")))
    docs = docs.select(*COLUMNS).withColumn("_crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    docs = docs.withColumn("_own", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "_crc"))

    def taken(found: DataFrame) -> DataFrame:
        return docs.join(small(found), (F.col("_own") == F.col("_key")) & (F.col("_crc") == F.col("_sum")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    rows = taken(found.where("_times > 0 AND _rows = 1"))
    more = found.where("_times > 0 AND _rows > 1")
    if not more.isEmpty():
        least = F.min(F.struct(*(F.col(c) for c in COLUMNS))).alias("_least")  # with map-side partial minima, however many copies there are
        rows = rows.unionByName(taken(more).groupBy("_own", "_id", "_sum", "_times").agg(least).select("_times", "_least.*"), allowMissingColumns=True)
    return rows.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences without padding."""
    made = packing.pack(docs, tokenizer_path())
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language_id", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("packing", pack)]

#: Signatures, n-gram models and token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = passing_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(out := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
