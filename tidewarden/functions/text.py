"""Text forms: what a payload looks like with escapes, invisible characters and look-alikes undone."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import rules

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that trim() of identifiers takes off: Unicode's White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def python_regex(source: str) -> str:
    """A pattern of the rules as Python writes it."""
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", source).replace(r"\z", r"\Z")


def strip_escapes(text: Column) -> Column:
    return F.regexp_replace(text, rules.ESCAPES, "")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, rules.INVISIBLE, "")


@F.pandas_udf(T.StringType())
def nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Compatibility composition; null stays null. Spark has no function for it."""
    for batch in batches:
        yield pd.Series([None if x is None else unicodedata.normalize("NFKC", x) for x in batch], dtype=object)


def skeleton(text: Column) -> Column:
    """Look-alike letters replaced by the ASCII letters they stand for."""
    return F.translate(text, *rules.lookalikes())


#: Any other character may change in normalising or be a look-alike; ASCII but for ESC, and Latin-1 letters, are not.
MAY_CHANGE = r"[^\x00-\x1A\x1C-\x7F\xC0-\xFF]"
def may_change(text: Column) -> Column:
    """Cheap tests first: ASCII texts are told by their length in bytes."""
    return F.contains(text, F.lit("\x1b")) | ((F.octet_length(text) > F.length(text)) & text.rlike(MAY_CHANGE))


def normalised(text: Column) -> Column:
    """Escapes and invisible characters out, then NFKC; null where the text has nothing to change."""
    return nfkc(F.when(may_change(text), strip_invisible(strip_escapes(text))))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def canonical_identifier(name: Column) -> Column:
    """Invisible characters out, NFKC, outer white space off."""
    return F.trim(nfkc(strip_invisible(name)), F.lit(WHITE_SPACE))


def fold_identifier(name: Column) -> Column:
    """What a reader takes the name for: canonical, look-alikes resolved, small ASCII letters."""
    return ascii_lower(skeleton(canonical_identifier(name)))


def hex_short(data: Column, count: int) -> Column:
    return F.lower(F.hex(F.substring(data, 1, count)))


def base64_bytes(text: Column) -> Column:
    """Strictly padded standard base64; null for anything else."""
    strict = text.rlike(r"\A(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?\z")
    bare = F.when(strict, text)
    # Bits beyond the last whole byte have to be zero: encoding again must give the same text.
    return F.when(to_base64(F.unbase64(bare)) == bare, F.unbase64(bare))


def to_base64(data: Column) -> Column:
    """Without the line breaks that Spark may put in."""
    return F.translate(F.base64(data), "\r\n", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.rtrim(path, F.lit("/")), "/"), -1)


def utc_text(seconds: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DDTHH:MM:SSZ, whatever the session's time zone."""
    day, rest = F.floor(seconds / 86400), F.pmod(seconds, F.lit(86400))
    clock = [F.lpad((F.floor(rest / d) % m).cast("string"), 2, "0") for d, m in ((3600, 24), (60, 60), (1, 60))]
    date = F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))
    # Years beyond four digits carry no sign, unlike Spark's own text of a date.
    plain = F.year(date).between(0, 9999) | date.isNull()
    date = F.when(plain, date.cast("string")).otherwise(F.format_string("%04d-%02d-%02d", F.year(date), F.month(date), F.day(date)))
    return F.concat(date, F.lit("T"), F.concat_ws(":", *clock), F.lit("Z"))
