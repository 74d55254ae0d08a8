"""Signatures: verification, trust on first use, transparency-log bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewarden.functions import crypto, text
from tidewarden.functions.jsons import canonical_json

PIN = "server_name string, key_fingerprint string, public_key_b64 string, pinned_at_iso string"
MOST_BUNDLE_BYTES = 1 << 20
SHAPE_ONLY = "shape-only check: the signed entry timestamp has the shape of a 64 byte signature, its signature was not verified"


def verify(manifests: DataFrame) -> DataFrame:
    """manifests (raw, public_key_b64, signature_b64, ...) with valid, key_fingerprint and error.

    The signature is over the canonical JSON. Rows whose key, signature or
    manifest cannot be read have a null fingerprint and the reason in error.
    """
    key, sig = text.base64_bytes(F.col("public_key_b64")), text.base64_bytes(F.col("signature_b64"))
    df = manifests.withColumns({"_key": key, "_sig": sig, "_text": canonical_json("raw").cast("binary")})
    df = df.withColumns({"_usable": crypto.usable_key("_key"), "_ok": crypto.signature_holds("_key", "_text", "_sig"), "_print": crypto.blake3_256("_key")})
    fault = (
        F.when(F.col("_key").isNull(), "public key is no base64")
        .when(F.length("_key") != 32, F.concat(F.lit("key: expected 32 bytes, got "), F.length("_key")))
        .when(~F.col("_usable"), "key is no point of the curve")
        .when(F.col("_sig").isNull(), "signature is no base64")
        .when(F.length("_sig") != 64, F.concat(F.lit("signature: expected 64 bytes, got "), F.length("_sig")))
        .when(F.col("_text").isNull(), "manifest is no JSON")
    )
    df = df.withColumn("_fault", fault)
    return df.withColumns({
        "valid": F.col("_fault").isNull() & F.col("_ok"),
        "key_fingerprint": F.when(F.col("_fault").isNull(), text.hex_short(F.col("_print"), 16)),
        "error": F.coalesce("_fault", F.when(~F.col("_ok"), F.lit("signature did not verify"))),
    }).drop("_key", "_sig", "_text", "_usable", "_ok", "_print", "_fault")


def verify_with_pins(manifests: DataFrame, pins: DataFrame, pin_on_first_use: bool, now: str, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(outcomes, pins after) of manifests (server_name, order, raw, public_key_b64, signature_b64).

    A pinned key must be presented again. An unknown server is refused, or, on
    first use, gets the key of its first manifest whose signature holds. A key
    that differs from the pinned one is always refused.
    """
    done = verify(manifests).withColumnRenamed("valid", "crypto_valid").withColumnRenamed("error", "_error")
    fresh = done.where("crypto_valid").join(pins.select("server_name"), "server_name", "left_anti")
    firsts = fresh.groupBy("server_name").agg(F.min_by(F.struct("key_fingerprint", "public_key_b64", F.col(order).alias("seq")), order).alias("f")).select("server_name", "f.*")
    firsts = firsts if pin_on_first_use else firsts.limit(0)
    known = pins.select("server_name", F.col("key_fingerprint").alias("_pin"), F.lit(None).cast(dict(done.dtypes)[order]).alias("_since")).unionByName(firsts.select("server_name", F.col("key_fingerprint").alias("_pin"), F.col("seq").alias("_since")))
    both = done.join(known, "server_name", "left")
    # Before the pinning manifest the server is unknown yet.
    before = F.col("_since").isNotNull() & (F.col(order) < F.col("_since"))
    pinned = F.col("_pin").isNotNull() & ~before
    newly = F.col("_since").isNotNull() & (F.col(order) == F.col("_since"))
    same = pinned & (F.col("_pin") == F.col("key_fingerprint"))
    unread = F.col("key_fingerprint").isNull()
    mismatch = F.concat(F.lit("fingerprint mismatch for server="), F.col("server_name"), F.lit(": pinned="), F.col("_pin"), F.lit(", presented="), F.col("key_fingerprint"))
    unknown = F.concat(F.lit("server="), F.col("server_name"), F.lit(" is not pinned; check fingerprint="), F.col("key_fingerprint"), F.lit(" and pin it"))
    out = both.withColumns({
        "valid": ~unread & F.col("crypto_valid") & same,
        "pin_outcome": F.when(unread, None).when(newly, "newly_pinned").when(same, "already_pinned"),
        "previously_pinned_fingerprint": F.when(pinned & ~newly & ~unread, F.col("_pin")),
        "error": F.when(unread, F.col("_error")).when(newly, None).when(same, F.col("_error")).when(pinned, mismatch).otherwise(unknown),
    }).drop("_pin", "_since", "_error")
    after = pins.unionByName(firsts.select("server_name", "key_fingerprint", "public_key_b64", F.lit(now).alias("pinned_at_iso")))
    return out, after


def pin(pins: DataFrame, server: str, public_key_b64: str, now: str) -> DataFrame:
    """pins with one more; pinning the same key again changes nothing, another key is an error."""
    spark = pins.sparkSession
    row = spark.createDataFrame([(server, public_key_b64)], "server_name string, public_key_b64 string").withColumn("_key", text.base64_bytes(F.col("public_key_b64")))
    new = row.select("server_name", text.hex_short(crypto.blake3_256("_key"), 16).alias("key_fingerprint"), "public_key_b64", F.lit(now).alias("pinned_at_iso"), (F.length("_key") == 32).alias("_ok")).first()
    if not new["_ok"]:
        raise ValueError("a public key has 32 bytes")
    held = pins.where(F.col("server_name") == server).select("key_fingerprint").first()
    if held and held[0] != new["key_fingerprint"]:
        raise ValueError(f"server_name={server} is pinned to fingerprint={held[0]}: unpin it first")
    return pins if held else pins.unionByName(spark.createDataFrame([tuple(new)[:4]], PIN))


def unpin(pins: DataFrame, server: str) -> DataFrame:
    return pins.where(F.col("server_name") != server)


def check_bundles(bundles: DataFrame, raw: str = "raw") -> DataFrame:
    """What a signature bundle in JSON holds, and whether its log timestamp has the right shape. Nothing is verified.

    error tells why a bundle cannot be read; such rows have no other results.
    """
    text_of = F.when(F.octet_length(raw) <= MOST_BUNDLE_BYTES, F.col(raw))
    df = bundles.withColumn("_v", F.try_parse_json(text_of))
    get = lambda path, kind="string": F.try_variant_get(F.col("_v"), path, kind)
    is_text = lambda path: F.schema_of_variant(F.try_variant_get(F.col("_v"), path, "variant")) == "STRING"
    rekor = F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.rekorBundle", "variant"))
    has_rekor = F.coalesce(rekor != "VOID", F.lit(False))
    stamp = text.base64_bytes(get("$.rekorBundle.SignedEntryTimestamp"))
    malformed = has_rekor & ~F.coalesce(is_text("$.rekorBundle.SignedEntryTimestamp") & F.schema_of_variant(F.try_variant_get(F.col("_v"), "$.rekorBundle.Payload", "variant")).startswith("OBJECT"), F.lit(False))
    fault = (
        F.when(F.octet_length(raw) > MOST_BUNDLE_BYTES, F.concat(F.lit(f"bundle exceeds {MOST_BUNDLE_BYTES} bytes: "), F.octet_length(raw)))
        .when(F.col("_v").isNull(), "bundle is no JSON")
        .when(~F.coalesce(is_text("$.base64Signature"), F.lit(False)) | (F.trim(F.coalesce(get("$.base64Signature"), F.lit("")), F.lit(text.WHITE_SPACE)) == ""), "base64Signature is missing")
        .when(malformed, "rekorBundle is malformed")
        .when(has_rekor & stamp.isNull(), "timestamp is no base64")
    )
    df = df.withColumns({"error": fault, "_has": has_rekor, "_bytes": F.when(has_rekor, F.length(stamp)).otherwise(F.lit(0))})
    ok = F.col("error").isNull()
    return df.withColumns({
        "bundle_parsed": ok,
        "has_cert": F.when(ok, F.coalesce(is_text("$.cert"), F.lit(False))),
        "has_rekor_bundle": F.when(ok, F.col("_has")),
        "set_bytes": F.when(ok, F.col("_bytes")),
        "shape_only_ok": F.when(ok, F.col("_has") & (F.col("_bytes") == 64)),
        "partial": F.when(ok, F.lit(True)),
        "note": F.when(ok, F.when(~F.col("_has"), "bundle has no rekorBundle field").when(F.col("_bytes") == 64, "timestamp has the shape of a 64 byte signature").otherwise(F.concat(F.lit("timestamp has "), F.col("_bytes"), F.lit(" bytes, not 64")))),
        "warning": F.when(ok, F.lit(SHAPE_ONLY)),
        "log_index": F.when(ok & F.col("_has"), get("$.rekorBundle.Payload.logIndex", "long")),
        "integrated_time": F.when(ok & F.col("_has"), get("$.rekorBundle.Payload.integratedTime", "long")),
    }).drop("_v", "_has", "_bytes")


def artifact_hash(manifests: DataFrame, raw: str = "raw") -> DataFrame:
    """manifests with artifact_sha256, the hash of the canonical JSON."""
    return manifests.withColumn("artifact_sha256", F.sha2(canonical_json(raw).cast("binary"), 256))


def log_lookup(manifests: DataFrame, log: DataFrame, raw: str = "raw") -> DataFrame:
    """Entries of a transparency log table (artifact_sha256, uuid, log_index) for each manifest; nulls if there are none."""
    return artifact_hash(manifests, raw).join(log, "artifact_sha256", "left")
