"""DuckDB SQL for the operators' expressions, built from the same rules."""

from __future__ import annotations

from tidewarden.functions import rules


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def needle(col: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {quoted(n)})" for n in rules.needles()) + ")"


def hits(col: str) -> str:
    """List of pattern ids, in order; empty for null."""
    each = [f"CASE WHEN {' OR '.join(f'regexp_matches({col}, {quoted(r)})' for r in rules.PATTERNS[p])} THEN {quoted(p)} END" for p in rules.pattern_ids()]
    return f"CASE WHEN {needle(col)} THEN list_filter([{', '.join(each)}], lambda x: x IS NOT NULL) ELSE CAST([] AS VARCHAR[]) END"


def refs(col: str) -> str:
    """Distinct advisories of a list of patterns, in order, joined by commas."""
    table = "MAP {" + ", ".join(f"{quoted(p)}: [{', '.join(map(quoted, ids))}]" for p, ids in rules.advisories_of().items()) + "}"
    flat = f"flatten(list_transform({col}, lambda p: {table}[p]))"
    return f"array_to_string(list_filter({flat}, lambda x, i: list_position({flat}, x) = i), ',')"


def stripped(col: str) -> str:
    return f"regexp_replace(regexp_replace({col}, {quoted(rules.ESCAPES)}, '', 'g'), {quoted(rules.INVISIBLE)}, '', 'g')"


def skeleton(col: str) -> str:
    a, b = rules.lookalikes()
    return f"translate({col}, {quoted(a)}, {quoted(b)})"


FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF = "".join(map(chr, range(0x21, 0x7F)))


def half_width(col: str) -> str:
    """NFKC of texts whose only compatibility characters are full-width ASCII."""
    return f"translate({col}, {quoted(FULL)}, {quoted(HALF)})"


def staged(source: str, keys: str, col: str = "payload") -> str:
    """keys, verdict, patterns and refs of a scan in all forms."""
    return f"""
WITH s AS ({source}), n AS (SELECT *, {half_width(stripped(col))} AS norm FROM s),
k AS (SELECT *, {skeleton('norm')} AS skel FROM n),
h AS (SELECT *, {hits(col)} AS h0, CASE WHEN norm <> {col} THEN {hits('norm')} ELSE CAST([] AS VARCHAR[]) END AS h1,
  CASE WHEN skel <> norm THEN {hits('skel')} ELSE CAST([] AS VARCHAR[]) END AS h2 FROM k),
c AS (SELECT *, list_concat(h0, list_concat(h1, h2)) AS hx FROM h),
d AS (SELECT *, list_filter(hx, lambda x, i: list_position(hx, x) = i) AS hits FROM c)
SELECT {keys}, CASE WHEN len(hits) > 0 THEN 'block' ELSE 'allow' END AS verdict, array_to_string(hits, ',') AS patterns, {refs('hits')} AS refs FROM d"""


def raw_only(source: str, keys: str, col: str = "payload") -> str:
    return f"""
WITH s AS ({source}), d AS (SELECT *, {hits(col)} AS hits FROM s)
SELECT {keys}, CASE WHEN len(hits) > 0 THEN 'block' ELSE 'allow' END AS verdict, array_to_string(hits, ',') AS patterns, {refs('hits')} AS refs FROM d"""


def feed_values() -> str:
    rows = ", ".join(f"({i}, {quoted(r['id'])}, {quoted(r['severity'])}, {quoted(r['fixed_in'])}, {quoted(r['affected_versions'])}, {quoted(r['simulate_payload'])}, {quoted(r['expected_pattern_id'])})" for i, r in enumerate(rules.feed_rows()))
    return f"(VALUES {rows}) AS feed(pos, id, severity, fixed_in, affected_versions, payload, pattern)"
