"""Policy: configuration, allowlists and the decision on every message."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import asdict, dataclass, field, fields
from functools import reduce
from operator import or_
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden import __version__
from tidewarden.functions import rules, text
from tidewarden.functions.messages import message
from tidewarden.operators import identity, manifest
from tidewarden.operators.scan import scan
from tidewarden.sources.work import materialised

FAIL_MODES, DRIFT_MODES, HASH_BACKENDS = ("open", "closed"), ("off", "warn", "block"), ("blake3", "sha256")
#: JSON-RPC error codes of replies.
BLOCKED, REFUSED = -32603, -32001
NAME = "tidewarden"


@dataclass(frozen=True)
class Policy:
    fail_mode: str = "closed"
    scan_unicode: bool = True
    allow_patterns: tuple[str, ...] = ()
    allow_servers: tuple[str, ...] = ()
    allow_patterns_per_tool: dict[str, tuple[str, ...]] = field(default_factory=dict)
    deny_env_keys: tuple[str, ...] = rules.DENIED_ENV
    scan_confusable: bool = True
    tools_list_drift_detection: str = "warn"
    tools_list_drift_inbound_check: bool = False
    tools_list_hash_backend: str = "blake3"
    tools_list_jcs_canonicalize: bool = False
    inject_fingerprint_meta: bool = False
    version: str = "default"

    def __post_init__(self) -> None:
        for name, allowed in (("fail_mode", FAIL_MODES), ("tools_list_drift_detection", DRIFT_MODES), ("tools_list_hash_backend", HASH_BACKENDS)):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name}: {getattr(self, name)!r} is none of {', '.join(allowed)}")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.type == "bool" and not isinstance(value, bool) or f.type == "str" and not isinstance(value, str):
                raise ValueError(f"{f.name}: {value!r}")

    @classmethod
    def parse(cls, source: str) -> Policy:
        """From TOML; fail_mode, scan_unicode and version must be there, unknown keys are ignored."""
        given = tomllib.loads(source)
        if missing := {"fail_mode", "scan_unicode", "version"} - given.keys():
            raise ValueError(f"missing: {', '.join(sorted(missing))}")
        known = {f.name: given[f.name] for f in fields(cls) if f.name in given}
        for name in ("allow_patterns", "allow_servers", "deny_env_keys"):
            if name in known:
                known[name] = _strings(name, known[name])
        if (per_tool := known.get("allow_patterns_per_tool")) is not None:
            if not isinstance(per_tool, dict):
                raise ValueError("allow_patterns_per_tool: a table is needed")
            known["allow_patterns_per_tool"] = {k: _strings(k, v) for k, v in per_tool.items()}
        return cls(**known)

    @classmethod
    def load(cls, path: str | os.PathLike[str] | None) -> Policy:
        """From a file on the driver; without one, the default."""
        return cls.parse(Path(path).read_text()) if path and Path(path).exists() else cls()

    def row(self, spark: SparkSession) -> DataFrame:
        """The policy as a table of one row."""
        values = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}
        values["allow_patterns_per_tool"] = {k: list(v) for k, v in self.allow_patterns_per_tool.items()}
        kinds = {"bool": "boolean", "str": "string", "tuple[str, ...]": "array<string>", "dict[str, tuple[str, ...]]": "map<string,array<string>>"}
        return spark.createDataFrame([tuple(values[f.name] for f in fields(self))], ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in fields(self)))

    # ------------------------------------------------------------- predicates

    def allows_patterns(self, hits: Column) -> Column:
        """Something matched, and all of it is allowed everywhere."""
        return (F.size(hits) > 0) & (F.size(F.array_except(hits, _array(self.allow_patterns))) == 0)

    def tool_allows(self, tool: Column, hits: Column) -> Column:
        """Something matched, and all of it is allowed for the tool."""
        each = [(tool == t) & (F.size(F.array_except(hits, _array(p))) == 0) for t, p in sorted(self.allow_patterns_per_tool.items())]
        return (F.size(hits) > 0) & F.coalesce(reduce(or_, each, F.lit(False)), F.lit(False))

    def trusts(self, program: Column) -> Column:
        """The program, as given or by the last part of its path, is allowed."""
        if not self.allow_servers:
            return F.lit(False)
        return F.coalesce(program.isin(*self.allow_servers) | text.basename(program).isin(*self.allow_servers), F.lit(False))

    def denies_env(self, key: Column) -> Column:
        return text.ascii_lower(key).isin(*[k.translate(str.maketrans(text.UPPER, text.LOWER)) for k in self.deny_env_keys]) if self.deny_env_keys else F.lit(False)


def _strings(name: str, value: Any) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise ValueError(f"{name}: a list of strings is needed")
    return tuple(value)


def _array(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def leaked_env(keys: DataFrame, policy: Policy, column: str = "key") -> DataFrame:
    """Distinct denied keys, in order."""
    return keys.where(policy.denies_env(F.col(column))).select(column).distinct().orderBy(column)


def block_reply(id: Column, hits: Column, refs: Column) -> Column:
    """The JSON-RPC error that answers a blocked call; id is JSON text. Keys are in order."""
    return F.concat(F.lit(f'{{"error":{{"code":{BLOCKED},"data":{{"cve_refs":'), F.to_json(refs), F.lit(',"matched_patterns":'), F.to_json(hits), F.lit(f'}},"message":"blocked by {NAME}"}},"id":'), id, F.lit(',"jsonrpc":"2.0"}'))


def refuse_reply(id: Column, program: Column) -> Column:
    """The JSON-RPC error that answers a refused request for the tool list."""
    said = json.dumps("a baseline is pinned and the policy checks requests: lower the policy, clear the baseline or switch the check off")
    return F.concat(F.lit(f'{{"error":{{"code":{REFUSED},"data":{{"program":'), _quoted(program), F.lit(f',"remediation":{said}}},"message":"tools/list refused by {NAME}: inbound drift gate active"}},"id":'), id, F.lit(',"jsonrpc":"2.0"}'))


def drift_reply(id: Column, program: Column, detail: Column) -> Column:
    """The JSON-RPC error that replaces a drifted tool list; detail is the struct of a drift."""
    said = json.dumps("review the difference, then trust the new manifest or clear the baseline")
    return F.concat(F.lit(f'{{"error":{{"code":{REFUSED},"data":{{"drift":'), F.to_json(detail), F.lit(',"program":'), _quoted(program), F.lit(f',"remediation":{said}}},"message":"tools/list drift detected by {NAME}: policy violation"}},"id":'), id, F.lit(',"jsonrpc":"2.0"}'))


def _quoted(value: Column) -> Column:
    one = F.to_json(F.array(value))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def decide(lines: DataFrame, policy: Policy, baselines: DataFrame | None = None) -> DataFrame:
    """The action on every message of lines (direction, program, raw and any other columns).

    Adds tool, kind, verdict, matched_patterns, cve_refs, collision (the tool that
    is impersonated), recorded (whether the audit log gets it), action and reply.
    Actions: drop (a blank inbound line), forward_unparsed, refuse, forward_trusted,
    block, warn, forward. baselines has program and tools; it is broadcast only if
    Spark measures it as small.
    """
    columns = lines.columns
    inbound, line = F.col("direction") == "inbound", F.trim(F.col("raw"), F.lit(text.WHITE_SPACE))
    df = lines.withColumn("_line", F.coalesce(line, F.lit(""))).withColumn("_m", message("_line"))
    df = df.withColumn("_trusted", policy.trusts(F.col("program")))
    # Inbound, name and arguments of parsed messages are scanned; outbound, the whole line.
    scanned = F.when(~F.col("_trusted"), F.when(inbound, F.col("_m.target")).otherwise(F.col("_line")))
    df = scan(df.withColumn("_target", scanned), "_target", policy.scan_unicode, policy.scan_confusable)
    df = df.withColumns({"tool": F.when(inbound, F.col("_m.tool")), "kind": F.col("_m.kind")})
    gate = F.lit(False)
    if baselines is not None and policy.tools_list_drift_detection != "off":
        pinned = baselines.select(F.col("program").alias("_program"), F.lit(True).alias("_pinned"))
        df = identity.with_collisions(df, baselines, "program", "tool").join(pinned, F.col("program") == F.col("_program"), "left")
        if policy.tools_list_drift_detection == "block" and policy.tools_list_drift_inbound_check:
            gate = inbound & (F.col("kind") == "tools_list_request") & F.col("_pinned")
    else:
        df = df.withColumn("collision", F.lit(None).cast("string"))
    collided = F.col("collision").isNotNull() & ~F.col("_trusted")
    hits, refs = F.col("matched_patterns"), F.col("cve_refs")
    allowed = policy.allows_patterns(hits) | (inbound & policy.tool_allows(F.col("tool"), hits))
    df = df.withColumn("_blocked", collided | ((F.col("verdict") == "block") & ~allowed))
    df = df.withColumn("collision", F.when(collided, F.col("collision")))
    df = df.withColumns({
        "matched_patterns": F.when(collided, F.array_union(hits, F.array(F.lit(rules.COLLISION_PATTERN)))).otherwise(hits),
        "cve_refs": F.when(collided, F.array_union(refs, F.array(F.lit(rules.COLLISION_ADVISORY)))).otherwise(refs),
        "verdict": F.when(collided, F.lit("block")).otherwise(F.col("verdict")),
        "_gate": F.coalesce(gate, F.lit(False)),
    })
    action = (
        F.when(inbound & (F.col("_line") == ""), "drop")
        .when(inbound & ~F.col("_m.parsed"), "forward_unparsed")
        .when(F.col("_gate"), "refuse")
        .when(F.col("_trusted"), "forward_trusted")
        .when(inbound & F.col("_blocked"), "block" if policy.fail_mode == "closed" else "warn")
        .otherwise("forward")
    )
    df = df.withColumn("action", action)
    reply = F.when(F.col("action") == "block", block_reply(F.col("_m.id"), hits, refs)).when(F.col("action") == "refuse", refuse_reply(F.col("_m.id"), F.col("program")))
    recorded = F.col("_blocked") & ~F.col("action").isin("drop", "forward_unparsed", "refuse", "forward_trusted")
    out = df.withColumns({"reply": reply, "recorded": recorded})
    made = ["tool", "kind", "verdict", "matched_patterns", "cve_refs", "collision", "recorded", "action", "reply"]
    return out.select(*[c for c in columns if c not in made], *made)


def enforce(lines: DataFrame, policy: Policy, baselines: DataFrame, order: str = "seq", iso: str = "ts_iso") -> tuple[DataFrame, DataFrame]:
    """(decisions, baselines after): decide(), and the drift check on outbound tool lists.

    Adds drift (unknown, match, drift, error; null for other messages). A drifted
    list is replaced by an error reply where the policy says block; where it asks
    for it, lists that are accepted carry their baseline's fingerprint in `stamped`.
    Trusted servers' lists are checked as well. What cannot be read passes.
    """
    decided = decide(lines, policy, baselines).drop("drift", "stamped")
    if policy.tools_list_drift_detection == "off":
        return decided.withColumns({"drift": F.lit(None).cast("string"), "stamped": F.lit(None).cast("string")}), baselines
    columns, decided = decided.columns, materialised(decided.withColumn("_line", F.monotonically_increasing_id()))
    lists = decided.where((F.col("direction") == "outbound") & (F.col("kind") == "tools_list_response"))
    found, after = manifest.observe(lists, baselines, order, iso, policy.tools_list_hash_backend, policy.tools_list_jcs_canonicalize, ("_line",))
    df = decided.join(found.select("_line", F.col("kind").alias("drift"), "detail"), "_line", "left")
    replaced = (F.col("drift") == "drift") & F.lit(policy.tools_list_drift_detection == "block")
    # Only lists that are replaced are parsed for their id once more.
    ident = message(F.when(replaced, F.col("raw")))["id"]
    df = df.withColumns({
        "action": F.when(replaced, "replace").otherwise(F.col("action")),
        "reply": F.when(replaced, drift_reply(ident, F.col("program"), F.col("detail"))).otherwise(F.col("reply")),
    })
    if policy.inject_fingerprint_meta:
        base = after.select(F.col("program").alias("_b"), F.struct(*manifest.FINGERPRINT[:-1], "baseline_iso").alias("_base"))
        accepted = F.col("drift").isin("unknown", "match")
        df = df.join(base, F.col("program") == F.col("_b"), "left").withColumn("stamped", manifest.stamped(F.when(accepted, F.col("raw")), F.col("_base"), f"{NAME}/fingerprint", __version__))
    else:
        df = df.withColumn("stamped", F.lit(None).cast("string"))
    return df.select(*columns, "drift", "stamped"), after
