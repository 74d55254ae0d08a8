"""Semantic versions and version requirements, as Python and as column expressions."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION = r"^(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)\.(0|[1-9][0-9]*)(?:-((?:0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*)(?:\.(?:0|[1-9][0-9]*|[0-9]*[a-zA-Z-][0-9a-zA-Z-]*))*))?(?:\+[0-9a-zA-Z-]+(?:\.[0-9a-zA-Z-]+)*)?$"
_PART = re.compile(r"^(=|>=|>|<=|<|~|\^)?\s*(0|[1-9][0-9]*|[*xX])(?:\.(0|[1-9][0-9]*|[*xX]))?(?:\.(0|[1-9][0-9]*|[*xX])(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?)?$")

Comparator = tuple[str, int, int | None, int | None, str]


def requirement(source: str) -> list[Comparator] | None:
    """(operator, major, minor, patch, pre) of each comma-separated part; None if it is none. `*` is an empty list."""
    if source.strip() in ("*", "x", "X"):
        return []
    out: list[Comparator] = []
    for part in source.split(","):
        found = _PART.match(part.strip())
        if not found:
            return None
        op, *numbers, pre = found.groups()
        wild = [n in ("*", "x", "X") for n in numbers]
        if wild[0] or wild[1] and numbers[2] is not None and not wild[2]:
            return None
        values = [int(n) if n and not w else None for n, w in zip(numbers, wild, strict=True)]
        out.append((op or ("=" if any(wild) else "^"), values[0] or 0, values[1], values[2], pre or ""))
    return out


def _key(pre: Column) -> Column:
    """A text that sorts pre-releases in order; none at all sorts last. Numbers count below words."""
    parts = F.transform(F.split(pre, r"\."), lambda p: F.when(p.rlike("^[0-9]+$"), F.concat(F.lit("0"), F.lpad(p, 20, "0"))).otherwise(F.concat(F.lit("1"), p)))
    return F.when(pre == "", F.lit("~")).otherwise(F.array_join(parts, "\x01"))


def parsed(version: Column) -> Column:
    """struct(major, minor, patch, pre) of a version with any leading v; null if it is none."""
    bare = F.ltrim(version, F.lit("v"))
    number = [F.regexp_extract(bare, VERSION, k).cast("long") for k in (1, 2, 3)]
    return F.when(bare.rlike(VERSION), F.struct(*[n.alias(a) for n, a in zip(number, ("major", "minor", "patch"), strict=True)], F.regexp_extract(bare, VERSION, 4).alias("pre")))


def _below(version: Column, major: int, minor: int, patch: int, pre: str) -> Column:
    low = F.struct(version["major"], version["minor"], version["patch"], _key(version["pre"]))
    return low < F.struct(F.lit(major).cast("long"), F.lit(minor).cast("long"), F.lit(patch).cast("long"), _key(F.lit(pre)))


def _same(version: Column, major: int, minor: int, patch: int, pre: str) -> Column:
    return (version["major"] == major) & (version["minor"] == minor) & (version["patch"] == patch) & (version["pre"] == pre)


def _holds(version: Column, part: Comparator) -> Column:
    op, major, minor, patch, pre = part
    low = (major, minor or 0, patch or 0, pre)
    if minor is None:
        above = (major + 1, 0, 0, "0")
    elif patch is None:
        above = (major, minor + 1, 0, "0")
    else:
        above = (major, minor, patch + 1, "0")
    from_low, to_above = ~_below(version, *low), _below(version, *above)
    if op == "=":
        return _same(version, *low) if patch is not None else from_low & to_above
    if op == ">":
        return ~_below(version, *above) if patch is None else from_low & ~_same(version, *low)
    if op == ">=":
        return from_low
    if op == "<":
        return _below(version, *low)
    if op == "<=":
        return to_above if patch is None else _below(version, *low) | _same(version, *low)
    if op == "~":
        return from_low & _below(version, *((major + 1, 0, 0, "0") if minor is None else (major, minor + 1, 0, "0")))
    if major or minor is None:
        return from_low & _below(version, major + 1, 0, 0, "0")
    if minor or patch is None:
        return from_low & _below(version, 0, minor + 1, 0, "0")
    return from_low & _below(version, 0, 0, patch + 1, "0")


def covers(version: Column, parts: list[Comparator]) -> Column:
    """Whether the requirement holds for a parsed version, null for none. A pre-release needs a part that names one of the same release."""
    holds = reduce(and_, [_holds(version, p) for p in parts], F.lit(True))
    named = [(version["major"] == p[1]) & (version["minor"] == (p[2] or 0)) & (version["patch"] == (p[3] or 0)) for p in parts if p[4]]
    return F.when(version.isNotNull(), holds & ((version["pre"] == "") | reduce(lambda a, b: a | b, named, F.lit(False))))
