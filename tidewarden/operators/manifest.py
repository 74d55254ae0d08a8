"""Tool manifests: fingerprints, differences and drift from the first accepted snapshot."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import pickle
import tempfile
from collections.abc import Iterable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewarden.functions import crypto, jsons
from tidewarden.functions.text import WHITE_SPACE
from tidewarden.sources.work import materialised

_HIDDEN = {c: None for a, b in ((0x200B, 0x200F), (0x2060, 0x2064), (0xFEFF, 0xFEFF), (0x202A, 0x202E), (0x2066, 0x2069), (0xE0000, 0xE007F)) for c in range(a, b + 1)}
TOOL = "struct<name:string,description_hash:string,param_names:array<string>,required_set_hash:string>"
#: The columns of a fingerprint, without its program.
FINGERPRINT = ("tools_count", "aggregate_hash", "hash_backend", "jcs_canonical", "tools")

MADE = f"struct<tools:array<{TOOL}>,aggregate_hash:string>"
#: Bytes of a manifest that go to Python in a row (10,000 rows are an Arrow batch), and tools that come back in one.
PIECE, TOOLS = 1 << 11, 4096


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def canonical_name(raw: str) -> str:
    import unicodedata

    return unicodedata.normalize("NFKC", raw.translate(_HIDDEN)).strip(WHITE_SPACE)


def _schema(tool: dict[str, Any]) -> tuple[list[str], list[str]]:
    """Parameter names, and required names in order, from inputSchema or the older parameters."""
    params: list[str] = []
    for key in ("inputSchema", "parameters"):
        part = tool.get(key)
        if isinstance(part, dict) and isinstance(part.get("properties"), dict):
            params = list(part["properties"])
            break
    source = tool["inputSchema"] if "inputSchema" in tool else tool.get("parameters")
    listed = source.get("required") if isinstance(source, dict) else None
    return params, sorted((x for x in listed if isinstance(x, str)), key=_bytes) if isinstance(listed, list) else []


def parts(tool: dict[str, Any], jcs: bool) -> tuple[str, bytes, tuple[str, ...], bytes]:
    """Name, described, parameter names and required names of a tool, as they are hashed."""
    text = tool.get("description")
    described = jsons.jcs(tool) if jcs else text if isinstance(text, str) else ""
    params, required = _schema(tool)
    names = tuple(sorted({canonical_name(p) for p in params}, key=_bytes))
    return canonical_name(tool["name"]), _bytes(described), names, _bytes("".join(canonical_name(r) + "," for r in required))


def tools_of(raw: str) -> list[dict[str, Any]] | None:
    """The tools of a manifest, parsed whole; None where there is no tool list or a tool without a name."""
    try:
        tools = jsons.loads(raw)["result"]["tools"]
        return tools if isinstance(tools, list) and all(isinstance(t["name"], str) for t in tools) else None
    except (ValueError, KeyError, TypeError, RecursionError):
        return None


#: A line of a fingerprint: name, description hash, parameter names, hash of the required names.
Line = list[Any]


class _Hashes:
    """Short hashes, taken side by side for up to `most` texts or `size` bytes at a time."""

    def __init__(self, backend: str, most: int = 4096, size: int = 1 << 22):
        self.backend, self.most, self.size = backend, most, size
        self.texts: list[bytes] = []
        self.places: list[tuple[Line, int]] = []
        self.held = 0

    def put(self, line: Line, slot: int, text: bytes) -> None:
        self.texts.append(text)
        self.places.append((line, slot))
        self.held += len(text)
        if len(self.texts) >= self.most or self.held >= self.size:
            self.flush()

    def flush(self) -> None:
        for (line, slot), made in zip(self.places, _short(self.texts, self.backend), strict=True):
            line[slot] = made
        self.texts, self.places, self.held = [], [], 0


def _short(texts: list[bytes], backend: str) -> Iterator[str]:
    sums = crypto.blake3_many(texts) if backend == "blake3" else (hashlib.sha256(t).digest() for t in texts)
    return (f"{backend}:{x[:16].hex()}" for x in sums)


def _name(line: Line) -> bytes:
    return _bytes(line[0])


class _Sorted:
    """Lines that come back in the order of their names; `most` are held and, at the end, a block of each sorted run, which are in a file."""

    def __init__(self, hashes: _Hashes, most: int = 1 << 14, block: int = 256):
        self.hashes, self.most, self.block, self.file = hashes, most, block, tempfile.TemporaryFile()
        self.clear()

    def clear(self) -> None:
        self.held: list[Line] = []
        self.runs: list[tuple[int, int]] = []  # where they begin, and their blocks
        self.count = 0
        self.file.seek(0)
        self.file.truncate()

    def append(self, line: Line) -> None:
        self.held.append(line)
        self.count += 1
        if len(self.held) >= self.most:
            lines = self._rest()
            self.runs.append((self.file.tell(), -(-len(lines) // self.block)))
            for k in range(0, len(lines), self.block):
                pickle.dump(lines[k : k + self.block], self.file)
            self.held = []

    def _rest(self) -> list[Line]:
        self.hashes.flush()
        return sorted(self.held, key=_name)

    def _run(self, at: int, blocks: int) -> Iterator[Line]:
        for _ in range(blocks):
            self.file.seek(at)
            lines = pickle.load(self.file)
            at = self.file.tell()
            yield from lines

    def __iter__(self) -> Iterator[Line]:
        return heapq.merge(*(self._run(*r) for r in self.runs), self._rest(), key=_name)


def _take(pieces: Iterable[str], jcs: bool, hashes: _Hashes, lines: list[Line] | _Sorted) -> bool:
    """Puts the lines of a manifest, whose hashes will be there once `hashes` are flushed, into `lines`; tools are parsed one at a time.

    False where there is no tool list or a tool without a name.
    """
    same: dict[tuple[str, ...], tuple[str, ...]] = {}
    found = False
    try:
        for tool in jsons.items_in(pieces, "result", "tools"):
            if tool is jsons.START or tool is jsons.GONE:
                lines.clear()
                found = tool is jsons.START
            elif found and isinstance(tool, dict) and isinstance(tool.get("name"), str):
                name, described, params, required = parts(tool, jcs)
                if len(same) > TOOLS:
                    same.clear()
                line = [name, None, same.setdefault(params, params), None]
                hashes.put(line, 1, described)
                hashes.put(line, 3, required)
                lines.append(line)
            else:
                found = False
    except (ValueError, RecursionError):
        return False
    return found


def _lines(raw: str | None, jcs: bool, hashes: _Hashes) -> list[Line] | None:
    """The lines of a manifest that is held, in the order of their names."""
    lines: list[Line] = []
    return sorted(lines, key=_name) if _take([raw or ""], jcs, hashes, lines) else None


def _hashed(line: Line) -> bytes:
    """A line as it goes into the aggregate hash."""
    name, described, params, required = line
    return _bytes("\0".join((name, described, "".join(p + "," for p in params), required)) + "\n")


def _head(program: str, count: int) -> bytes:
    return _bytes(program) + count.to_bytes(8, "little")


def line_lists(programs: Sequence[str], raws: Sequence[str | None], backend: str, jcs: bool) -> list[tuple[list[Line], str] | None]:
    """Lines and aggregate hash of each manifest; the hashes of all of them are taken side by side."""
    hashes = _Hashes(backend)
    lists = [_lines(r, jcs, hashes) for r in raws]
    hashes.flush()
    whole = []
    for program, tools in zip(programs, lists, strict=True):
        if tools is not None:
            whole.append(_head(program, len(tools)) + b"".join(map(_hashed, tools)))
    sums = _short(whole, backend)
    return [None if tools is None else (tools, next(sums)) for tools in lists]


def fingerprint_many(programs: list[str], raws: list[str | None], backend: str = "blake3", jcs: bool = False) -> list[dict[str, Any] | None]:
    """Tools and aggregate hash of each manifest."""
    names = ("name", "description_hash", "param_names", "required_set_hash")
    made = line_lists(programs, raws, backend, jcs)
    return [m and {"tools": [dict(zip(names, (n, d, list(p), r), strict=True)) for n, d, p, r in m[0]], "aggregate_hash": m[1]} for m in made]


def _tools(lines: Sequence[Line]) -> pa.Array:
    """Lines as an array of TOOL, column by column."""
    column = lambda k, t: pa.array((line[k] for line in lines), t)
    return pa.StructArray.from_arrays([column(0, pa.string()), column(1, pa.string()), column(2, pa.list_(pa.string())), column(3, pa.string())], ["name", "description_hash", "param_names", "required_set_hash"])


#: What is read of a manifest: its row, count and aggregate hash (null where it is unreadable), and tools.
Read = tuple[pa.Array, Sequence[int | None], Sequence[str | None], pa.Array]


def _lists(tools: pa.Array, sizes: Sequence[int | None]) -> pa.Array:
    ends = list(itertools.accumulate((n or 0 for n in sizes), initial=0))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tools, mask=pa.array([n is None for n in sizes]))


def _read_together(rows: list[pa.Array], programs: list[str], texts: list[str | None], backend: str, jcs: bool) -> Read:
    made = line_lists(programs, texts, backend, jcs)
    sizes = [m and len(m[0]) for m in made]
    return pa.concat_arrays(rows), sizes, [m and m[1] for m in made], _lists(_tools([line for m in made if m for line in m[0]]), sizes)


def _read_alone(row: pa.Array, program: str, texts: Iterable[str], backend: str, jcs: bool, form: str) -> Iterator[Read]:
    """A large manifest, of which Python holds some pieces, some lines and, where `tools` are to be in one row, those."""
    hashes = _Hashes(backend)
    lines = _Sorted(hashes)
    if not _take(texts, jcs, hashes, lines):
        yield row, [None], [None], _lists(_tools([]), [None])
        return
    whole = crypto.hasher(backend)
    whole.update(_head(program, lines.count))
    for line in lines:
        whole.update(_hashed(line))
    found = f"{backend}:{whole.digest()[:16].hex()}"
    if form == "count":
        yield row, [lines.count], [found], _lists(_tools([]), [0])
        return
    blocks = (_tools(block) for block in itertools.batched(lines, TOOLS))
    if form == "tools":
        blocks = [pa.concat_arrays([_tools([]), *blocks])]
    for block in blocks:
        yield row, [lines.count], [found], _lists(block, [len(block)])


def _pieces(batches: Iterator[pa.RecordBatch], most: int = 32) -> Iterator[tuple[int, int | None, pa.Array | None, str | None, bytes]]:
    """Number, and of its first piece the size, row and program of a manifest, with up to `most` pieces of its text."""
    number = 0
    for batch in batches:
        row, program, piece, size = (batch.column(c) for c in ("_row", "_program", "_piece", "_size"))
        sizes = size.to_pylist()
        at = 0
        while at < len(sizes):
            end = at + 1
            while end < min(len(sizes), at + most) and sizes[end] is None:
                end += 1
            begins = sizes[at] is not None
            number += begins
            yield number, sizes[at], row.take([at]) if begins else None, program[at].as_py(), b"".join(filter(None, piece[at:end].to_pylist()))
            at = end


def _decoded(pieces: Iterable[bytes]) -> Iterator[str]:
    decode = codecs.getincrementaldecoder("utf-8")().decode
    yield from map(decode, pieces)
    yield decode(b"", True)


def _read(batches: Iterator[pa.RecordBatch], backend: str, jcs: bool, form: str, size: int = 1 << 20) -> Iterator[Read]:
    """Manifests are read in groups of about `size` bytes, larger ones alone."""
    rows: list[pa.Array] = []
    programs: list[str] = []
    texts: list[str | None] = []
    held = 0
    for _, manifest in itertools.groupby(_pieces(batches), key=lambda p: p[0]):
        _, long, row, program, piece = next(manifest)
        if rows and held + long > size:
            yield _read_together(rows, programs, texts, backend, jcs)
            rows, programs, texts, held = [], [], [], 0
        data = itertools.chain([piece], (p[-1] for p in manifest))
        if long > size:
            yield from _read_alone(row, program, _decoded(data), backend, jcs, form)
            continue
        try:
            texts.append(b"".join(data).decode())
        except UnicodeDecodeError:
            texts.append(None)
        rows.append(row)
        programs.append(program)
        held += long + 256
    if rows:
        yield _read_together(rows, programs, texts, backend, jcs)


def fingerprint(program: str, raw: str, backend: str = "blake3", jcs: bool = False) -> dict[str, Any] | None:
    """The columns of FINGERPRINT for one manifest."""
    return whole_fingerprints([program], [raw], backend, jcs)[0]


def whole_fingerprints(programs: list[str], raws: list[str | None], backend: str = "blake3", jcs: bool = False) -> list[dict[str, Any] | None]:
    """The same for many."""
    return [m and m | {"tools_count": len(m["tools"]), "hash_backend": backend, "jcs_canonical": jcs} for m in fingerprint_many(programs, raws, backend, jcs)]


def _made(form: str, manifests: DataFrame, raw: str, program: str, backend: str, jcs: bool, keep: Sequence[str] | None) -> DataFrame:
    """The kept columns, tools_count, aggregate_hash and, but for the form `count`, tools: all in one row, or by the form `blocks` up to TOOLS of them.

    Parsing needs Python, so the hashes are taken there too. Texts go there in pieces of PIECE bytes, in order,
    with a manifest's kept columns beside its first piece.
    """
    if backend not in crypto.BACKENDS:
        raise ValueError(f"hash backend {backend!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, sizes, hashes, tools in _read(batches, backend, jcs, form):
            columns = {"_row": row, "tools_count": pa.array(sizes, pa.int32()), "aggregate_hash": pa.array(hashes, pa.string())}
            yield pa.RecordBatch.from_pydict(columns if form == "count" else columns | {"tools": tools})

    kept = F.struct(*(F.col(f"`{c}`") for c in (manifests.columns if keep is None else keep)), F.lit(0).alias("_"))
    size = F.coalesce(F.length("_data"), F.lit(0))
    texts = manifests.select(kept.alias("_row"), F.coalesce(program, F.lit("")).alias("_program"), F.col(raw).cast("binary").alias("_data"))
    pieces = texts.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(size, F.lit(1)) - 1) / PIECE).cast("int"))).alias("_at"))
    pieces = pieces.select(
        *(F.when(F.col("_at") == 0, c).alias(n) for c, n in ((F.col("_row"), "_row"), (F.col("_program"), "_program"), (size, "_size"))),
        F.substring("_data", F.col("_at") * PIECE + 1, F.lit(PIECE)).alias("_piece"),
    )
    out = pieces.mapInArrow(run, T.StructType([pieces.schema["_row"], *T.StructType.fromDDL("tools_count int, aggregate_hash string" + f", tools array<{TOOL}>" * (form != "count"))]))
    return out.select("_row.*", *out.columns[1:]).drop("_")


def fingerprints(manifests: DataFrame, raw: str = "raw", program: str = "program", backend: str = "blake3", jcs: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """manifests, or their columns `keep`, with the columns of FINGERPRINT; tools is null where the manifest has none to read.

    A manifest's tools are one value here, and so is its text if it is kept; tool_rows and aggregates hold neither in Python.
    """
    return _finished(_made("tools", manifests, raw, program, backend, jcs, keep), backend, jcs)


def aggregates(manifests: DataFrame, raw: str = "raw", program: str = "program", backend: str = "blake3", jcs: bool = False, keep: Sequence[str] = ("program",)) -> DataFrame:
    """The same without tools."""
    return _finished(_made("count", manifests, raw, program, backend, jcs, keep), backend, jcs)


def _finished(made: DataFrame, backend: str, jcs: bool) -> DataFrame:
    made = made.withColumns({"hash_backend": F.lit(backend), "jcs_canonical": F.lit(jcs)})
    last = [c for c in FINGERPRINT if c in made.columns]
    return made.select(*(f"`{c}`" for c in made.columns if c not in last), *last)


def tool_rows(manifests: DataFrame, raw: str = "raw", program: str = "program", backend: str = "blake3", jcs: bool = False, keep: Sequence[str] = ("program",)) -> DataFrame:
    """A row for each tool of each readable manifest: the columns `keep` and those of TOOL."""
    made = _made("blocks", manifests, raw, program, backend, jcs, keep)
    return made.select(*(f"`{c}`" for c in keep), F.inline("tools"))


def difference(base: list[dict[str, Any]], current: list[dict[str, Any]]) -> dict[str, Any]:
    """added, removed, description_changed, params_changed; of equal names the last counts."""
    old, new = {t["name"]: t for t in base}, {t["name"]: t for t in current}
    both = sorted(old.keys() & new.keys(), key=_bytes)
    order = {"key": _bytes}
    moved = [n for n in both if old[n]["param_names"] != new[n]["param_names"] or old[n]["required_set_hash"] != new[n]["required_set_hash"]]
    return {
        "added": sorted(new.keys() - old.keys(), **order), "removed": sorted(old.keys() - new.keys(), **order),
        "description_changed": [n for n in both if old[n]["description_hash"] != new[n]["description_hash"]],
        "params_changed": [{"tool": n, "from": old[n]["param_names"], "to": new[n]["param_names"]} for n in moved],
    }


def difference_of(base: Column, current: Column) -> Column:
    """The same as a struct column of higher-order functions."""

    def last(tools: Column, name: Column) -> Column:
        return F.element_at(F.filter(tools, lambda t: t["name"] == name), -1)

    old, new = base["name"], current["name"]
    both = F.array_sort(F.array_intersect(new, old))
    moved = F.filter(both, lambda n: (last(base, n)["param_names"] != last(current, n)["param_names"]) | (last(base, n)["required_set_hash"] != last(current, n)["required_set_hash"]))
    return F.struct(
        F.array_sort(F.array_except(new, old)).alias("added"),
        F.array_sort(F.array_except(old, new)).alias("removed"),
        F.filter(both, lambda n: last(base, n)["description_hash"] != last(current, n)["description_hash"]).alias("description_changed"),
        F.transform(moved, lambda n: F.struct(n.alias("tool"), last(base, n)["param_names"].alias("from"), last(current, n)["param_names"].alias("to"))).alias("params_changed"),
    )


def every_fingerprint(kinds: list[tuple[str, bool]], raw: str, program: str) -> Column:
    """For each (backend, jcs) the tools and the aggregate hash of a manifest, as an array; all in one Python pass."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        none = {"tools": None, "aggregate_hash": None}
        for programs, raws in batches:
            each = [fingerprint_many([p or "" for p in programs], list(raws), b, j) for b, j in kinds]
            yield pd.Series([[m or none for m in row] for row in zip(*each, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, f"array<{MADE}>")(program, raw)


def observe(snapshots: DataFrame, baselines: DataFrame | None = None, order: str = "seq", iso: str = "ts_iso", backend: str = "blake3", jcs: bool = False, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(outcomes, baselines after): each snapshot (program, raw, order, iso) against its program's baseline.

    A program without a baseline gets its first readable snapshot as one. That
    snapshot is `unknown`; the others `match`, or `drift` with the difference; an
    unreadable one is an `error` and changes nothing. A match moves last_seen_iso,
    drift moves nothing. Of snapshots of one program and order the one with the smallest hash
    comes first, then the earliest stamp; every snapshot has one outcome, which carries the columns `keep`.
    Manifests are parsed once. Baselines are found by a hash aggregate with map-side
    partials, so a program with most of the rows is no hot task.
    """
    kinds = [(backend, jcs)]
    if baselines is not None:
        known = baselines.select("program", "baseline_iso", "last_seen_iso", *FINGERPRINT)
        kinds += [x for b in crypto.BACKENDS for j in (False, True) if (x := (b, j)) not in kinds]
        kinds = kinds[:1] + [tuple(r) for r in known.select("hash_backend", "jcs_canonical").distinct().collect() if tuple(r) != kinds[0]]  # four at most
    if any(b not in crypto.BACKENDS for b, _ in kinds):
        raise ValueError(f"hash backend {kinds!r}")
    each = snapshots.select("program", F.col(order).alias("_seq"), F.col(iso).alias("_iso"), *keep, every_fingerprint(kinds, "raw", "program").alias("_made"), F.monotonically_increasing_id().alias("_row"))
    made = materialised(each)
    own = F.col("_made")[0]
    made = made.withColumns({"tools": own["tools"], "aggregate_hash": own["aggregate_hash"], "tools_count": F.when(own["tools"].isNotNull(), F.size(own["tools"])), "hash_backend": F.lit(backend), "jcs_canonical": F.lit(jcs)})
    readable, arrival = made.where("tools IS NOT NULL"), F.struct("_seq", "aggregate_hash", "_iso", "_row")
    first = readable.groupBy("program").agg(F.min_by(F.struct(F.col("_iso").alias("baseline_iso"), F.col("_iso").alias("last_seen_iso"), *FINGERPRINT, "_row"), arrival).alias("b")).select("program", "b.*")
    if baselines is not None:
        fresh = first.join(known.select("program"), "program", "left_anti")
        pins = known.withColumn("_row", F.lit(None).cast("long")).unionByName(fresh)
    else:
        pins = first
    pins = materialised(pins)
    base = pins.select("program", F.struct(*[c for c in pins.columns if c != "program"]).alias("_base"))
    both = made.join(base, "program", "left")
    current = own
    for k, (b, j) in enumerate(kinds[1:], 1):
        current = F.when((F.col("_base.hash_backend") == b) & (F.col("_base.jcs_canonical") == j), F.col("_made")[k]).otherwise(current)
    both = both.withColumn("_now", current)
    kind = F.when(F.col("tools").isNull(), "error").when(F.col("_base._row") == F.col("_row"), "unknown").when(F.col("_base.aggregate_hash") == F.col("_now.aggregate_hash"), "match").otherwise("drift")
    both = both.withColumn("kind", kind)
    drifted = F.col("kind") == "drift"
    out = both.select("program", F.col("_seq").alias(order), F.col("_iso").alias(iso), *keep, "kind", F.col("_now.aggregate_hash").alias("aggregate_hash"), F.when(drifted, difference_of(F.col("_base.tools"), F.col("_now.tools"))).alias("detail"), F.when(drifted, F.col("_base.baseline_iso")).alias("baseline_iso"))
    # Arrival order counts: the last match, not the latest stamp.
    seen = both.where("kind = 'match'").groupBy("program").agg(F.max_by("_iso", arrival).alias("_seen"))
    after = pins.drop("_row").join(seen, "program", "left").withColumn("last_seen_iso", F.coalesce("_seen", "last_seen_iso")).drop("_seen")
    return out, after


def re_baseline(baselines: DataFrame, manifests: DataFrame, now: str, backend: str = "blake3", jcs: bool = False) -> DataFrame:
    """Baselines with those of the manifests' (program, raw) programs replaced or added."""
    new = fingerprints(manifests, backend=backend, jcs=jcs, keep=("program",)).where("tools IS NOT NULL").select("program", F.lit(now).alias("baseline_iso"), F.lit(now).alias("last_seen_iso"), *FINGERPRINT)
    return baselines.join(new.select("program"), "program", "left_anti").select(*new.columns).unionByName(new)


def merge(mine: DataFrame, theirs: DataFrame, key: str = "program") -> DataFrame:
    """mine, and those rows of theirs whose key mine has not."""
    return mine.unionByName(theirs.join(mine.select(key), key, "left_anti"))


def forget(baselines: DataFrame, program: str) -> DataFrame:
    return baselines.where(F.col("program") != program)


def prune(baselines: DataFrame, before_iso: str) -> DataFrame:
    """Without the programs last seen before that time."""
    return baselines.where(F.col("last_seen_iso") >= before_iso)


def stamp(raw: str, baseline: dict[str, Any], key: str, version: str) -> str:
    """The tool list with the baseline's fingerprint in result._meta[key]; anything else as it is."""
    try:
        message = jsons.loads(raw)
        result = message["result"]
        if not isinstance(result["tools"], list):
            return raw
    except (ValueError, KeyError, TypeError):
        return raw
    meta = result.setdefault("_meta", {})
    if isinstance(meta, dict):
        meta[key] = {k: baseline[k] for k in ("aggregate_hash", "hash_backend", "jcs_canonical", "tools_count", "baseline_iso")} | {"pinned_by": "tidewarden", "pin_version": version}
    return jsons.compact(message)




def stamped(raw: Column, baseline: Column, key: str, version: str) -> Column:
    """stamp() of a column of lists, each with the struct of its baseline; null stays null."""

    def run(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.Series]:
        for raws, bases in batches:
            rows = bases.to_dict("records")
            yield pd.Series([None if r is None else stamp(r, b, key, version) for r, b in zip(raws, rows, strict=True)], dtype=object)

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.DataFrame]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")(raw, baseline)
