"""Command line: scan, verify, policy, keystore, bundle, drift, decide, control.

Exit codes: 2 for a manifest that does not verify, 3 for a blocked payload.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewarden import __version__
from tidewarden.api import Inspector, ToolError
from tidewarden.operators import audit, manifest, trust
from tidewarden.operators.policy import Policy, enforce
from tidewarden.sources import lines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidewarden", description=__doc__)
    top.add_argument("--home", default=str(Path.home() / ".local/share/tidewarden"), help="folder of the tables")
    top.add_argument("--policy", help="policy file (TOML)")
    verbs = top.add_subparsers(dest="verb", required=True)
    scan = verbs.add_parser("scan", help="scan a payload, or standard input")
    scan.add_argument("payload", nargs="?")
    scan.add_argument("--direction", default="inbound")
    verify = verbs.add_parser("verify", help="verify a signed manifest")
    for name in ("manifest", "public_key_b64", "signature_b64"):
        verify.add_argument(name)
    verify.add_argument("--signed-at-iso")
    verify.add_argument("--server")
    verify.add_argument("--pin-on-first-use", action="store_true")
    verbs.add_parser("policy", help="show or check the policy").add_argument("action", choices=["show", "reload"])
    keys = verbs.add_parser("keystore").add_subparsers(dest="action", required=True)
    keys.add_parser("list")
    keys.add_parser("path")
    pin = keys.add_parser("pin")
    pin.add_argument("server_name")
    pin.add_argument("--pubkey-b64", required=True)
    keys.add_parser("unpin").add_argument("server_name")
    bundle = verbs.add_parser("sigstore").add_subparsers(dest="action", required=True)
    bundle.add_parser("verify").add_argument("bundle")
    bundle.add_parser("rekor-lookup").add_argument("manifest")
    drift = verbs.add_parser("drift").add_subparsers(dest="action", required=True)
    drift.add_parser("list")
    drift.add_parser("path")
    for name in ("show", "clear", "trust"):
        drift.add_parser(name).add_argument("program")
    drift.choices["trust"].add_argument("manifest")
    drift.choices["trust"].add_argument("--hash", default="blake3", choices=["blake3", "sha256"])
    drift.choices["trust"].add_argument("--jcs", action="store_true")
    drift.add_parser("prune").add_argument("--older-than-days", type=int, default=180)
    wrap = verbs.add_parser("decide", help="decide on files of messages")
    wrap.add_argument("program")
    wrap.add_argument("path")
    wrap.add_argument("out")
    wrap.add_argument("--direction", default="inbound")
    verbs.add_parser("control", help="answer JSON-RPC lines on standard input")
    verbs.add_parser("version")
    return top


def _show(value: Any) -> None:
    print(json.dumps(value, indent=2, ensure_ascii=False, default=str))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    given = parser().parse_args(args)
    if given.verb == "version":
        print(f"tidewarden {__version__}")
        return 0
    spark = spark or SparkSession.builder.appName("tidewarden").getOrCreate()
    tools = Inspector(spark, given.home, Policy.load(given.policy))
    action = getattr(given, "action", None)
    try:
        return {"scan": _scan, "verify": _verify, "policy": _policy, "keystore": _keystore, "sigstore": _sigstore, "drift": _drift, "decide": _decide, "control": _control}[given.verb](tools, given, action)
    except (ToolError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _scan(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    out = tools.scan_payload(sys.stdin.read() if given.payload is None else given.payload, given.direction)
    _show(out)
    return 3 if out["verdict"] == "block" else 0


def _verify(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    raw = Path(given.manifest).read_text()
    if given.server is None:
        out = tools.verify_manifest(json.loads(raw), given.public_key_b64, given.signature_b64, given.signed_at_iso)
    else:
        row = tools._row(server_name=given.server, raw=raw, public_key_b64=given.public_key_b64, signature_b64=given.signature_b64).withColumn("seq", F.lit(0))
        found = {}

        def change(pins):
            done, after = trust.verify_with_pins(row, pins, given.pin_on_first_use, tools.now())
            found.update(done.drop("raw", "seq").first().asDict())
            return after

        tools.pins.update(change)
        out = found
    _show(out)
    return 0 if out["valid"] else 2


def _policy(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    _show(tools.get_policy())
    return 0


def _keystore(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    if action == "path":
        print(tools.pins.path)
    elif action == "list":
        _show(tools.get_keystore())
    elif action == "pin":
        tools.pins.update(lambda old: trust.pin(old, given.server_name, given.pubkey_b64, tools.now()))
    else:
        tools.pins.update(lambda old: trust.unpin(old, given.server_name))
    return 0


def _sigstore(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    _show(tools.verify_bundle(Path(given.bundle).read_text()) if action == "verify" else tools.rekor_lookup(json.loads(Path(given.manifest).read_text())))
    return 0


def _drift(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    table, spark = tools.baselines, tools.spark
    if action == "path":
        print(table.path)
    elif action == "list":
        _show(tools.get_drift_history())
    elif action == "show":
        _show(tools.get_drift_history(given.program))
    elif action == "clear":
        table.update(lambda old: manifest.forget(old, given.program))
    elif action == "trust":
        raw = Path(given.manifest).read_text()
        if manifest.fingerprint(given.program, raw) is None:
            raise ToolError("no tool list to read")
        new = spark.createDataFrame([(given.program, raw)], "program string, raw string")
        table.update(lambda old: manifest.re_baseline(old, new, tools.now(), given.hash, given.jcs))
    else:
        cut = spark.sql(f"SELECT date_format(current_timestamp() - INTERVAL {int(given.older_than_days)} DAYS, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")").first()[0]
        table.update(lambda old: manifest.prune(old, cut))
    return 0


def _decide(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    """Decide a file of lines, check its tool lists against the baselines, and keep baselines and audit log up to date."""
    rows = lines.read_lines(tools.spark, given.path, given.direction, given.program).withColumn("ts_iso", F.lit(tools.now()))
    done, after = enforce(rows, tools.policy, tools.baselines.read())
    done.write.mode("overwrite").parquet(given.out)
    decided = tools.spark.read.parquet(given.out)
    tools.audit.append(audit.entries(decided), order="seq")
    if tools.policy.tools_list_drift_detection != "off":
        tools.baselines.update(lambda _: after)
    _show([r.asDict() for r in decided.groupBy("action").count().orderBy("action").collect()])
    return 0


def _control(tools: Inspector, given: argparse.Namespace, action: str | None) -> int:
    for line in sys.stdin:
        if line.strip() and (answer := tools.handle(line)) is not None:
            print(json.dumps(answer, ensure_ascii=False), flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main())
