"""Payload scan: text -> verdict, matched patterns, advisories.

A text is matched in up to three forms: raw; normalised, where that changes it;
with look-alikes resolved, where that changes it. In each form the patterns
count only if some needle occurs in that form.

One Arrow pass does all of it over whole columns, with linear-time regular
expressions: needles first, then the patterns on what has a needle. Only texts
with a character that normalising can change are looked at one by one.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import rules, text
from tidewarden.sources.work import spread

_NONE = "array<string>"
FORMS = T.StructType([T.StructField("norm", T.StringType()), T.StructField("skel", T.StringType())])
Lists = tuple[list[str | None], list[str | None]]


@functools.cache
def _tools() -> tuple[re.Pattern[str], re.Pattern[str], np.ndarray]:
    """What finds escapes and invisible characters, and for each code point the letter it looks like, or itself."""
    letters = np.arange(0x110000, dtype="<u4")
    for odd, plain in zip(*rules.lookalikes(), strict=True):
        letters[ord(odd)] = ord(plain)
    return re.compile(text.python_regex(rules.ESCAPES)), re.compile(text.python_regex(rules.INVISIBLE)), letters


def _rows(raw: pa.Array, pattern: str) -> pa.Array:
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(raw, pattern), False))


def _changed(raw: pa.Array, unicode: bool, confusable: bool) -> Lists:
    """The normalised form, null where it is the raw text, and the look-alike form, null where it is the form before."""
    norm: list[str | None] = [None] * len(raw)
    skel: list[str | None] = [None] * len(raw)
    escapes, hidden, letters = _tools()
    if unicode or confusable:
        odd = _rows(raw, text.MAY_CHANGE)
        some = raw.take(odd)
        # Which of them hold what begins an escape, or an invisible character, is asked of the whole column.
        escaped, veiled = (set(_rows(some, p).to_pylist()) if unicode else set() for p in ("[\x1b\u0080-\u009f]", rules.INVISIBLE))
        for k, (i, data) in enumerate(zip(odd.to_pylist(), some.cast(pa.binary()).to_pylist(), strict=True)):
            now = data.decode("utf-8", "replace")
            if unicode:
                plain = escapes.sub("", now) if k in escaped else now
                plain = hidden.sub("", plain) if k in veiled or plain is not now else plain
                if (plain := unicodedata.normalize("NFKC", plain)) != now:
                    norm[i] = now = plain
            if confusable:
                codes = np.frombuffer(now.encode("utf-32-le", "surrogatepass"), "<u4")
                alike = letters[codes]
                if not np.array_equal(alike, codes):
                    skel[i] = alike.tobytes().decode("utf-32-le", "surrogatepass")
    return norm, skel


def forms(payload: Column, unicode: bool = True, confusable: bool = True) -> Column:
    """The struct FORMS of a text column."""

    def run(raw: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(f, pa.string()) for f in _changed(raw, unicode, confusable)], FORMS.names)

    run.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, FORMS)(payload)


def patterns(payload: Column, unicode: bool = True, confusable: bool = True, feed: list[dict[str, Any]] | None = None) -> Column:
    """Ids of the patterns that match a text, as an array: those of the raw form in evaluation order, then what the other forms add."""
    needles = "|".join(re.escape(n) for n in rules.needles(feed))
    table = [(p, [rules.linear_regex(r) for r in rules.PATTERNS.get(p, ())]) for p in rules.pattern_ids(feed)]

    def run(raw: pa.Array) -> pa.Array:
        norm, skel = _changed(raw, unicode, confusable)
        found: list[list[str]] = [[] for _ in range(len(raw))]
        for form in (raw, pa.array(norm, pa.string()), pa.array(skel, pa.string())):
            # ASCII case only: characters that fold to ASCII letters elsewhere are none here
            held = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(pc.ascii_lower(form), needles), False))
            rows, some = held.to_pylist(), form.take(held)
            for pattern, sources in table if rows else ():
                hit = reduce(pc.or_, [pc.match_substring_regex(some, r) for r in sources])
                for k in pc.indices_nonzero(hit).to_pylist():
                    found[rows[k]].append(pattern)
        return pa.array([list(dict.fromkeys(f)) for f in found], pa.list_(pa.string()))

    run.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, T.ArrayType(T.StringType()))(payload)


def advisories(hits: Column, feed: list[dict[str, Any]] | None = None) -> Column:
    """Distinct advisory ids of the hits, in the hits' order, then the feed's."""
    pairs = [x for p, ids in rules.advisories_of(feed).items() for x in (F.lit(p), F.array(*map(F.lit, ids)))]
    table = F.create_map(*pairs)
    return F.when(F.size(hits) > 0, F.array_distinct(F.flatten(F.transform(hits, lambda p: F.coalesce(F.element_at(table, p), F.array().cast(_NONE)))))).otherwise(F.array().cast(_NONE))


def scan(df: DataFrame, column: str = "text", unicode: bool = True, confusable: bool = True, feed: list[dict[str, Any]] | None = None) -> DataFrame:
    """df with verdict, matched_patterns and cve_refs. A null payload counts as empty. Inputs of few files are dealt over all cores."""
    df = spread(df.drop("verdict", "matched_patterns", "cve_refs"))
    df = df.withColumn("matched_patterns", patterns(F.coalesce(F.col(column), F.lit("")), unicode, confusable, feed))
    df = df.withColumn("cve_refs", advisories(F.col("matched_patterns"), feed))
    return df.withColumn("verdict", F.when(F.size("matched_patterns") > 0, F.lit("block")).otherwise(F.lit("allow")))


def pattern_counts(scanned: DataFrame) -> DataFrame:
    """How many payloads matched each pattern."""
    return scanned.select(F.explode("matched_patterns").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("payloads"))
