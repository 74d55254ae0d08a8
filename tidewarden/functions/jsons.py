"""Exact JSON serialisations that hashes and scans depend on.

canonical: keys by code point, integers as they are, floats in positional
notation without exponent, short escapes. compact: the same order, floats in
shortest form. jcs: RFC 8785, keys by UTF-16 units, numbers as ECMAScript prints
them. All three read JSON strictly: no NaN, the last of repeated keys counts.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from decimal import Decimal
from json.decoder import WHITESPACE
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOW, HIGH = -(1 << 63), (1 << 64) - 1


def _refuse(token: str) -> Any:
    raise ValueError(f"no JSON number: {token}")


def _integer(token: str) -> int | float:
    value = int(token)
    if token.startswith("-") and value == 0:
        return -0.0
    return value if LOW <= value <= HIGH else _float(token)


def _float(token: str) -> float:
    value = float(token)
    if value in (float("inf"), float("-inf")):
        raise ValueError("number out of range")
    return value


def loads(raw: str) -> Any:
    return json.loads(raw, parse_constant=_refuse, parse_int=_integer, parse_float=_float)


_scan = json.JSONDecoder(parse_constant=_refuse, parse_int=_integer, parse_float=_float).scan_once


class _Reader:
    """A place in a JSON text that comes in pieces; what has been read is dropped when the next piece is taken."""

    def __init__(self, pieces: Iterable[str]):
        self.pieces, self.text, self.at = iter(pieces), "", 0

    def more(self, least: int = 1) -> bool:
        """Takes pieces of `least` characters or more in all; False at the end."""
        held = [rest] if (rest := self.text[self.at :]) else []
        self.text, self.at, got = "", 0, 0
        for piece in self.pieces:
            held.append(piece)
            got += len(piece)
            if got >= least:
                break
        self.text = "".join(held)
        return got > 0

    def next(self) -> str:
        """The next character that is no white space; empty at the end."""
        while True:
            self.at = WHITESPACE.match(self.text, self.at).end()
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def value(self) -> Any:
        """The value at this place, parsed again with twice the text while only the end of a piece may have broken it."""
        whole = False
        while True:
            try:
                value, end = _scan(self.text, self.at)
                if whole or end + 4 <= len(self.text):  # a number may go on
                    self.at = end
                    return value
            except StopIteration as e:
                if whole or e.value < len(self.text) - 16:
                    raise ValueError("no JSON value") from e
            except json.JSONDecodeError as e:
                if whole or (e.pos < len(self.text) - 16 and not e.msg.startswith("Unterminated string")):
                    raise
            except ValueError:
                if whole:
                    raise
            whole = not self.more(max(1, len(self.text) - self.at))

    def within(self, closing: str) -> Iterator[str | None]:
        """At each value of the array or object that begins here, its key (None in arrays); the caller reads the value."""
        self.at += 1
        if self.next() == closing:
            self.at += 1
            return
        while True:
            key = None
            if closing == "}":
                if self.next() != '"':
                    raise ValueError("no key")
                key = self.value()
                if self.next() != ":":
                    raise ValueError("no colon")
                self.at += 1
            self.next()
            yield key
            end = self.next()
            self.at += 1
            if end == closing:
                return
            if end != ",":
                raise ValueError("no comma")


#: An array begins, and what came before no longer counts; a key of the path came (again), so nothing counts as yet.
START, GONE = object(), object()


def items_in(pieces: Iterable[str], *path: str) -> Iterator[Any]:
    """START, GONE and the items of the array under the path of a JSON text in pieces, parsed one at a time.

    Of repeated keys the last counts, as in loads(); so does only what follows the last START or GONE. ValueError, at the
    end at the latest, for what is no JSON. Held are the largest item or other value beside the path, and two pieces.
    """
    reader = _Reader(pieces)

    def walk(keys: tuple[str, ...]) -> Iterator[Any]:
        if reader.next() != ("{" if keys else "["):
            reader.value()
        elif not keys:
            yield START
            for _ in reader.within("]"):
                yield reader.value()
        else:
            for key in reader.within("}"):
                if key == keys[0]:
                    yield GONE
                    yield from walk(keys[1:])
                else:
                    reader.value()

    yield from walk(path)
    if reader.next():
        raise ValueError("more than one value")


def items(raw: str, *path: str) -> Iterator[Any]:
    """The items of the only array under the path; ValueError, at the end at the latest, where there is none or a key comes again."""
    began = False
    for item in items_in([raw], *path):
        if item is START:
            began = True
        elif item is not GONE:
            yield item
        elif began:
            raise ValueError("repeated keys")
    if not began:
        raise ValueError("no array")


def positional(value: float) -> str:
    """Shortest digits that read back as the same float, without exponent; integral values without a point."""
    text = format(Decimal(repr(value)), "f")
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return text


def _digits(value: float) -> tuple[str, str, int]:
    """Sign, shortest digits, and how many of them stand before the decimal point."""
    sign, digits, exponent = Decimal(repr(value)).normalize().as_tuple()
    return "-" * sign, "".join(map(str, digits)), len(digits) + int(exponent)


def _pointed(text: str, point: int) -> str:
    if point <= 0:
        return "0." + "0" * -point + text
    return text.ljust(point, "0") if len(text) <= point else f"{text[:point]}.{text[point:]}"


def _scientific(text: str, point: int) -> str:
    return text[0] + ("." + text[1:] if len(text) > 1 else "") + f"e{point - 1}"


def shortest(value: float) -> str:
    """Shortest digits; integral values end in `.0`, an exponent is used from 1e16 and below 1e-5."""
    if value == 0:
        return "-0.0" if str(value).startswith("-") else "0.0"
    sign, text, point = _digits(value)
    if not -5 < point <= 16:
        return sign + _scientific(text, point)
    return sign + _pointed(text, point) + ".0" * (len(text) <= point)


def ecma(value: float) -> str:
    """A number as ECMAScript prints it."""
    if value == 0:
        return "0"
    sign, text, point = _digits(value)
    if -6 < point <= 21:
        return sign + _pointed(text, point)
    return sign + _scientific(text, point).replace("e", "e" if point < 1 else "e+")


def dumps(value: Any, number: Callable[[float], str] = positional, order: Callable[[str], Any] = str) -> str:
    out: list[str] = []
    todo: list[Any] = [(value,)]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        (x,) = item
        if x is None or isinstance(x, bool):
            out.append({None: "null", True: "true", False: "false"}[x])
        elif isinstance(x, int):
            out.append(ecma(float(x)) if number is ecma else str(x))
        elif isinstance(x, float):
            out.append(number(x))
        elif isinstance(x, str):
            out.append(json.dumps(x, ensure_ascii=False))
        else:
            pairs = isinstance(x, dict)
            keys = sorted(x, key=order) if pairs else range(len(x))
            parts: list[Any] = ["{" if pairs else "["]
            for i, k in enumerate(keys):
                parts += [","] * (i > 0)
                parts += [json.dumps(k, ensure_ascii=False) + ":"] if pairs else []
                parts.append((x[k],))
            parts.append("}" if pairs else "]")
            todo += reversed(parts)
    return "".join(out)


def canonical(value: Any) -> str:
    return dumps(value, positional)


def compact(value: Any) -> str:
    return dumps(value, shortest)


def jcs(value: Any) -> str:
    return dumps(value, ecma, lambda k: k.encode("utf-16-be", "surrogatepass"))


def scan_target(raw: str) -> str:
    """What of a message is scanned: its tool name and arguments, else its params, else all of it."""
    message = loads(raw)
    if not isinstance(message, dict) or "params" not in message:
        return compact(message)
    params = message["params"]
    named = params if isinstance(params, dict) else {}
    name = named.get("name")
    head = f"{name}\n" if isinstance(name, str) else ""
    return head + compact(named["arguments"] if "arguments" in named else params)


def _column(convert: Callable[[str], str | None]) -> Callable[[Column], Column]:
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(raw: str | None) -> str | None:
            try:
                return None if raw is None else convert(raw)
            except (ValueError, RecursionError):
                return None

        for batch in batches:
            yield pd.Series([one(x) for x in batch], dtype=object)

    each.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(each, T.StringType())


#: Column functions; null for what is no JSON.
canonical_json = _column(lambda raw: canonical(loads(raw)))
compact_json = _column(lambda raw: compact(loads(raw)))
jcs_json = _column(lambda raw: jcs(loads(raw)))
scan_target_of = _column(scan_target)
