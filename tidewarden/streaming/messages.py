"""Decisions on a stream of messages.

Every micro-batch is decided like a batch, under the policy as it is then, and
written to the sinks with the batch's number, so that a batch that is tried
again replaces what it wrote before. Where a table of baselines is given, the batch's tool
lists are checked against it, replaced or stamped, and it is updated last; programs not seen
for `keep_days` are forgotten. Blocks go to the audit log, which batch jobs share; what each
batch did goes to the log of this module as one JSON line.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewarden.functions.messages import message
from tidewarden.operators import audit
from tidewarden.operators.policy import Policy, decide, enforce
from tidewarden.sources.lines import forwarded
from tidewarden.sources.store import AUDIT, Log, Table
from tidewarden.sources.work import dealt, numbered

LOG = logging.getLogger("tidewarden.streaming")


class PolicySource:
    """A policy file that is read anew for each micro-batch; one that cannot be read leaves the last in force."""

    def __init__(self, path: str | None):
        self.path, self.error, self.policy = path, None, Policy.load(path)

    def __call__(self) -> Policy:
        try:
            self.policy, self.error = Policy.load(self.path), None
        except (OSError, ValueError) as e:
            self.error = str(e)
        return self.policy


def changes(lines: DataFrame) -> DataFrame:
    """The notes that a server's tools, prompts or resources have changed, as an event stream: the lines with `kind`."""
    kind = message(F.coalesce("raw", F.lit("")))["kind"]
    return lines.withColumn("kind", kind).where(F.col("kind").isin("tools_changed", "prompts_changed", "resources_changed"))


def run(lines: DataFrame, policy: Callable[[], Policy], out: str, checkpoint: str, now: Callable[[], str], baselines: Table | None = None, audit_log: Log | None = None, keep_days: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Write decided messages to out/messages (Parquet) and what goes on to out/forwarded (text), by batch; blocks to the audit log, out/audit unless one is given."""
    spark = lines.sparkSession
    log = audit_log or Log(spark, f"{out}/audit", AUDIT)

    def batch(df: DataFrame, number: int) -> None:
        ruled, seen = policy(), Observation()
        # Numbers of a batch lie above those of the batches before it.
        rows = dealt(numbered(df, number << 40)).withColumn("ts_iso", F.lit(now()))
        after = None
        if baselines is not None:
            decided, after = enforce(rows, ruled, baselines.read())
        else:
            decided = decide(rows, ruled)
        decided, written = audit.measured(decided, seen), f"{out}/messages/batch={number}"
        decided.write.mode("overwrite").parquet(written)
        decided = decided.sparkSession.read.schema(decided.schema).parquet(written).orderBy("seq")  # decided once
        forwarded(decided).write.mode("overwrite").text(f"{out}/forwarded/batch={number}")
        log.append(audit.entries(decided), f"batch-{number}")
        if after is not None and ruled.tools_list_drift_detection != "off":
            since = F.date_format(F.to_timestamp(F.lit(now())) - F.expr(f"INTERVAL {int(keep_days or 0)} DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
            baselines.update(lambda _: after.where(F.col("last_seen_iso") >= since) if keep_days else after)
        LOG.info(json.dumps({"event": "batch", "batch": number} | {k: v or 0 for k, v in seen.get.items()}))

    writer = lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
