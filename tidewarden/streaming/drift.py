"""Drift of tool manifests as keyed state: one baseline a program, kept in the state store.

Within a micro-batch a program's snapshots are taken in order of seq: the first
readable one becomes the baseline if there is none, the others are compared with
it. A match moves its last_seen_iso; drift changes nothing. With `ttl_days` a program's
state expires that long after its last match.

A call of the processor costs far more than a snapshot, so it takes a bucket of programs
at once; the state maps each of the bucket's programs to its baseline.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewarden.operators import manifest

OUT = "program string, seq long, ts_iso string, kind string, aggregate_hash string, detail string, baseline_iso string"
KEY = T.StructType([T.StructField("program", T.StringType())])
STATE = T.StructType([T.StructField("baseline", T.StringType())])
#: Part of the state's layout: a checkpoint holds for this number only.
BUCKETS = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def step(program: str, row: dict[str, Any], base: dict[str, Any] | None, backend: str, jcs: bool) -> tuple[dict[str, Any], dict[str, Any] | None]:
    """(outcome, baseline after) of one snapshot."""
    return judged(program, row, manifest.fingerprint(program, row["raw"], *kind(base, backend, jcs)), base)


def kind(base: dict[str, Any] | None, backend: str, jcs: bool) -> tuple[str, bool]:
    """How a program's snapshots are hashed: like its baseline, if it has one."""
    return (base["hash_backend"], base["jcs_canonical"]) if base else (backend, jcs)


def judged(program: str, row: dict[str, Any], made: dict[str, Any] | None, base: dict[str, Any] | None) -> tuple[dict[str, Any], dict[str, Any] | None]:
    """The same of a snapshot whose fingerprint is made."""
    out: dict[str, Any] = {"program": program, "seq": row["seq"], "ts_iso": row["ts_iso"], "kind": "error", "aggregate_hash": None, "detail": None, "baseline_iso": None}
    if made is None:
        return out, base
    out["aggregate_hash"] = made["aggregate_hash"]
    if base is None:
        return out | {"kind": "unknown"}, made | {"baseline_iso": row["ts_iso"], "last_seen_iso": row["ts_iso"]}
    if base["aggregate_hash"] == made["aggregate_hash"]:
        return out | {"kind": "match"}, base | {"last_seen_iso": row["ts_iso"]}
    detail = json.dumps(manifest.difference(base["tools"], made["tools"]), ensure_ascii=False, separators=(",", ":"))
    return out | {"kind": "drift", "detail": detail, "baseline_iso": base["baseline_iso"]}, base


class Drift(StatefulProcessor):
    def __init__(self, backend: str = "blake3", jcs: bool = False, ttl_days: int | None = None):
        self.backend, self.jcs, self.ttl = backend, jcs, ttl_days and ttl_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("baselines", KEY, STATE, self.ttl)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        # One micro-batch's snapshots of one bucket; sources bound how much a batch takes.
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable").to_dict("records")
        bases: dict[str, Any] = {}
        for program in dict.fromkeys(row["program"] for row in batch):
            held = self.state.getValue((program,))
            bases[program] = json.loads(held[0]) if held and held[0] else None
        # A baseline made on the way is hashed like the snapshots of programs without one.
        kinds = [kind(bases[row["program"]], self.backend, self.jcs) for row in batch]
        made: list[dict[str, Any] | None] = [None] * len(batch)
        for k in dict.fromkeys(kinds):
            at = [i for i, x in enumerate(kinds) if x == k]
            for i, m in zip(at, manifest.whole_fingerprints([batch[i]["program"] for i in at], [batch[i]["raw"] for i in at], *k), strict=True):
                made[i] = m
        out, moved = [], {}
        for row, m in zip(batch, made, strict=True):
            program = row["program"]
            said, bases[program] = judged(program, row, m, bases[program])
            if said["kind"] in ("unknown", "match"):
                moved[program] = bases[program]
            out.append(said)
        for program, base in moved.items():
            self.state.updateValue((program,), (json.dumps(base),))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUT.split(", ")])

    def close(self) -> None:
        pass


def outcomes(snapshots: DataFrame, backend: str = "blake3", jcs: bool = False, ttl_days: int | None = None) -> DataFrame:
    """Outcomes of a stream of snapshots (program, seq, ts_iso, raw); the session needs the RocksDB state store (PROVIDER)."""
    bucket = F.pmod(F.xxhash64("program"), F.lit(BUCKETS)).alias("bucket")
    return snapshots.select(bucket, "program", "seq", "ts_iso", "raw").groupBy("bucket").transformWithStateInPandas(Drift(backend, jcs, ttl_days), OUT, "Append", "ProcessingTime" if ttl_days else "None")
