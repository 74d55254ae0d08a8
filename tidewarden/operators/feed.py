"""The advisory feed: lookup by server name and version, simulation, age."""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.functions import rules, semver, text
from tidewarden.operators.scan import scan

SCHEMA = "id string, severity string, title string, fixed_in string, affected_versions string, simulate_payload string, expected_pattern_id string"


def parse_feed(source: str) -> list[dict[str, Any]]:
    """Rows of a feed in TOML: a table `cves`, in order."""
    rows = []
    for given in tomllib.loads(source).get("cves", []):
        row = {k: given.get(k) for k in rules.FEED_FIELDS}
        if missing := [k for k, v in row.items() if v is None and k != "affected_versions"]:
            raise ValueError(f"{row['id']}: missing {', '.join(missing)}")
        if row["severity"] not in rules.SEVERITIES:
            raise ValueError(f"{row['id']}: severity {row['severity']!r}")
        rows.append(row)
    return rows


def feed_df(spark: SparkSession, feed: list[dict[str, Any]] | None = None) -> DataFrame:
    """The feed as a table, with its order as pos. A handful of rows, fixed by the file."""
    rows = feed or rules.feed_rows()
    return spark.createDataFrame([(i, *(r[k] for k in rules.FEED_FIELDS)) for i, r in enumerate(rows)], f"pos int, {SCHEMA}")


def find(feed: DataFrame, advisory: str) -> DataFrame:
    """The row of an id, in any ASCII case."""
    return feed.where(text.ascii_lower(F.col("id")) == advisory.translate(str.maketrans(text.UPPER, text.LOWER)))


def by_pattern(feed: DataFrame) -> DataFrame:
    """pattern -> its advisories, in feed order."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"])
    return feed.groupBy(F.col("expected_pattern_id").alias("pattern")).agg(listed.alias("cve_refs"))


def check(servers: DataFrame, name: str = "server_name", version: str = "server_version", feed: list[dict[str, Any]] | None = None) -> DataFrame:
    """One row for each server and advisory that may concern it: the server's columns and the advisory's.

    The name has to occur in fixed_in, in any ASCII case. A range narrows that
    down where both it and the version can be read. The feed is a list on the
    driver, so the join is one condition for each of its rows and no shuffle.
    """
    known = semver.parsed(F.col(version).cast("string"))
    needle = text.ascii_lower(F.col(name))
    found = []
    for row in feed or rules.feed_rows():
        hit = F.contains(F.lit(row["fixed_in"].translate(str.maketrans(text.UPPER, text.LOWER))), needle)
        parts = semver.requirement(row["affected_versions"]) if row["affected_versions"] else None
        if parts is not None:
            hit = hit & (known.isNull() | F.coalesce(semver.covers(known, parts), F.lit(False)))
        fields = [F.lit(row[k]).cast("string").alias(k) for k in ("id", "severity", "title", "fixed_in", "affected_versions")]
        found.append(F.when(hit, F.struct(*fields)))
    keep = [c for c in servers.columns if c not in ("id", "severity", "title", "fixed_in", "affected_versions")]
    return servers.select(*keep, F.explode(F.array_compact(F.array(*found))).alias("_a")).select(*keep, "_a.*")


def simulate(spark: SparkSession, feed: list[dict[str, Any]] | None = None) -> DataFrame:
    """Each advisory's payload scanned: whether it is blocked, for the expected pattern, naming the advisory."""
    done = scan(feed_df(spark, feed), "simulate_payload", feed=feed)
    return done.withColumns({
        "pattern_ok": F.array_contains("matched_patterns", F.col("expected_pattern_id")),
        "advisory_ok": F.array_contains("cve_refs", F.col("id")),
    })


def age_days(today: Column, generated: str = rules.FEED_DATE) -> Column:
    """Days since the feed was made; -1 if that is no date."""
    made = F.try_to_date(F.lit(generated), "yyyy-MM-dd")
    return F.coalesce(F.datediff(today, made), F.lit(-1))
