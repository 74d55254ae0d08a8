"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import exact, extract, langid, media, minhash, mixing, packing, sharding, urls, warc

Query = Callable[[SparkSession, str], DataFrame]

#: The rules that the URL query is asked for.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = media.media_features(media.text_media(table(spark, sf_dir, "documents")), ["doc_id", "n_bytes"])
    return made.select(
        "doc_id", "n_bytes",
        F.length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.substring("samples", -16, 16)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.col("dhash").alias("feature"), "width", "height", F.sha2("tile_npy", 256).alias("tile_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = mixing.mix(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"), "source", "times")


def op6_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = extract.main_text(table(spark, sf_dir, "pages"))
    return made.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.shard_rows(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.Judge(RULES)).select("page_id", "host", "path", "rule", "verdict")


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derive(warc.responses(table(spark, sf_dir, "pages")))
    return made.withColumns({
        "block_length": F.length("block").cast("long"), "block_sha256": F.sha2("block", 256),
        "record_length": F.length("record").cast("long"), "record_sha256": F.sha2("record", 256),
    }).drop("block", "record")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_media, op2_packing, op3_langid, op4_minhash, op5_mixing, op6_extract, op7_sharding, op8_urls, op9_exact, op10_warc)}

ORACLE_SQL: dict[str, str] = {
    "op8_urls": urls.duck_sql(urls.Judge(RULES)),
    "op9_exact": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM h""",
}
