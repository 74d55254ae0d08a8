"""URL filters: host and path rules, then a weighted vocabulary.

One Aho-Corasick automaton counts the vocabulary's terms in the lower-cased URL
in one pass. A term counts where no letter or digit adjoins it. One strict
term, or `soft_limit` distinct soft terms, blocks. A rule `host/path` fits its
host and all subdomains where the URL's path starts with the rule's; the longest
fitting rule overrules the vocabulary.

Rows are judged one by one within Arrow batches, without a shuffle; automaton
and rules are parameters, sent with the task.

Defined results: a null URL, or one without `://`, has an empty host and path;
no rule fits it; null is allowed, and the vocabulary judges the rest. Rules equally long (possible
only for equal text) are settled for the first. Repeated rows get equal results,
an empty table none; columns other than those named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Default vocabulary of a crawl filter: (strict terms, soft terms).
STRICT = ("adult", "camgirls", "casino", "cialis", "escort", "escorts", "hentai", "porn", "porno", "viagra", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "dating", "farm", "free", "gambling", "jackpot", "loan", "loans", "lottery", "pharmacy", "pills", "poker", "sex", "sexy", "slots", "spam", "torrent", "track", "win")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: str | None) -> tuple[str, str]:
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_UPPER), path[:stop]


@dataclass
class Judge:
    rules: tuple[tuple[str, str], ...]
    strict: tuple[str, ...] = STRICT
    soft: tuple[str, ...] = SOFT
    soft_limit: int = 2
    _machine: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_machine": None}

    def rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(verdict, rule) of the longest rule that fits."""
        best = None
        for verdict, rule in self.rules:
            own, slash, rest = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith(slash + rest) and (best is None or len(rule) > len(best[1])):
                best = verdict, rule
        return best

    def terms(self, url: str | None) -> tuple[int, int]:
        """How many strict terms occur, and how many distinct soft ones."""
        if self._machine is None:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for term in {*self.strict, *self.soft}:
                machine.add_word(term, term)
            machine.make_automaton()
            self._machine, self._strict, self._soft = machine, frozenset(self.strict), frozenset(self.soft)
        if not url:
            return 0, 0
        text = url.translate(_UPPER)
        strict, soft = 0, set()
        for end, term in self._machine.iter(text):
            first = end + 1 - len(term)
            if (first and text[first - 1].isalnum()) or (end + 1 < len(text) and text[end + 1].isalnum()):
                continue
            strict += term in self._strict
            if term in self._soft:
                soft.add(term)
        return strict, len(soft)

    def __call__(self, url: str | None) -> tuple:
        host, path = host_and_path(url)
        strict, soft = self.terms(url)
        rule = self.rule(host, path)
        method = "block" if strict or soft >= self.soft_limit else "allow"
        return host, path, rule[1] if rule else None, rule[0] if rule else method, strict, soft


def judge_urls(df: DataFrame, judge: Judge, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, url, host, path, rule, verdict, strict_hits and soft_hits (distinct soft terms)."""
    kind = df.schema[id_col].dataType.simpleString()
    kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32())
    names = [id_col, "url", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(u) for u in batch.column(url_col).to_pylist()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(url_col).cast(pa.string()), *made], names)

    return df.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, url string, host string, path string, rule string, verdict string, strict_hits int, soft_hits int")


def duck_sql(judge: Judge, table: str = "pages", id_col: str = "page_id") -> str:
    """The same judgement in DuckDB SQL, for tests (ASCII URLs)."""
    low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def hit(term: str) -> str:
        return f"regexp_matches(low, '(^|[^a-z0-9]){re.escape(term)}($|[^a-z0-9])')"

    fits = []
    for verdict, rule in sorted(judge.rules, key=lambda r: -len(r[1])):
        own, slash, rest = rule.partition("/")
        fits.append((f"(host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '{slash}{rest}')", rule, verdict))
    rules = " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)
    said = " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)
    strict = " OR ".join(map(hit, judge.strict))
    soft = " + ".join(f"CAST({hit(t)} AS INT)" for t in judge.soft)
    return f"""
WITH a AS (SELECT {id_col}, coalesce({low}, '') AS low, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM {table}),
b AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM a)
SELECT {id_col}, host, path, CASE {rules} END AS rule,
  CASE {said} WHEN {strict} OR ({soft}) >= {judge.soft_limit} THEN 'block' ELSE 'allow' END AS verdict
FROM b"""
