"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

A document's set holds the hashes of its distinct word shingles. Under each of
`bands * rows / 2` permutations both the least and the greatest value are kept,
so every hash evaluation gives two signature values; `rows` of them make a band.
With 50 bands of 6 a pair at similarity 0.8 shares a band with probability
1 - 2e-7.

1. Equal sets form one class, represented by one of its rows (a hash aggregate
   with map-side partial minima, however many copies there are).
2. Representatives meet in buckets of equal bands. A bucket's smallest node is its
   hub. Each member is paired with the hub it shares most bands with, and the
   pair is confirmed on the full sets. Confirmed links give components.
3. Buckets that still hold more than one component are worked through in blocks of
   `block` members. Members with a partner in another component whose signature
   agrees in `loose` of the values (six standard errors below the threshold) go on
   with their full sets; within a block such pairs are confirmed one by one, but no
   pair of components that the block has joined already. So a block gives no more
   links than components, and no pair is passed between tasks. Pairs within a
   component need no test: they cannot change the result.
4. Components of the links of both steps, by alternating large and small stars.

Hot keys: hubs are dealt out in parts of `part` members, the hub's set going to
each part; joins back to buckets and classes are equi-joins that adaptive
execution splits. Nothing of the size of the corpus goes to the driver.

Defined results: a null text counts as empty; an empty set (no word) is linked
with nothing; a text shorter than a shingle is one shingle, its whole word
sequence; ids may be of any type that has an order; unless ids are unique, id and text make a node of the
graph, so texts that share an id are linked each on its own; null ids are linked like others, come last in a component, and are
kept where it has no other id; an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewarden.llm.common import cut, sliced, small, trim

_K = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    """Word -> its 64 bit hash; forgets everything when it has grown to `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingle_set(text: str | None, size: int, words: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles of `size` words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b" ".join(found))], np.uint64)
    each = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    count = len(each) - size + 1
    code = each[:count].copy()
    for k in range(1, size):
        code ^= code >> np.uint64(29)
        code *= _K
        code += each[k : k + count]
    code ^= code >> np.uint64(32)
    code *= _M
    code ^= code >> np.uint64(29)
    return np.unique(code)


class MinMax:
    """Signatures: for each permutation the least and the greatest value of the set, as 16 bits of a hash each."""

    def __init__(self, permutations: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 32, permutations, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, permutations, dtype=np.uint32)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.a), np.uint32)
        short = (codes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(short), 1024):
            value = short[at : at + 1024, None] * self.a + self.b
            np.minimum(low, value.min(axis=0), out=low)
            np.maximum(high, value.max(axis=0), out=high)
        both = np.stack([low, high], axis=1).reshape(-1)
        both ^= both >> np.uint32(15)
        both *= np.uint32(0x2C1B3C6D)
        return (both >> np.uint32(16)).astype("<u2")


def features(df: DataFrame, size: int, permutations: int) -> DataFrame:
    """id, own, n (set size), d1 and d2 (the set's digest), sig; df has id, own and text."""
    kind = df.schema["own"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, signed = WordHashes(), MinMax(permutations)
        for batch in sliced(batches, "text", 4 << 20):
            n, digests, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                codes = shingle_set(text, size, words)
                n.append(len(codes))
                digests.append(xxhash.xxh3_128_digest(codes.tobytes()))
                sigs.append(signed(codes).tobytes() if len(codes) else None)
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(n, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(sigs, pa.binary())], ["id", "own", "n", "d1", "d2", "sig"])

    return df.mapInArrow(run, f"id long, own {kind}, n long, d1 long, d2 long, sig binary")


def with_sets(df: DataFrame, wanted: DataFrame, size: int, schema: str, order: list[str]) -> DataFrame:
    """wanted (id and the columns of schema) with `codes`, the set of the id's text; dealt by and sorted by `order`, whose last column only sorts.

    Each text is read once, however many rows ask for its set.
    """
    fields = [f.split()[0] for f in schema.split(", ")]
    uses = cut(wanted.groupBy("id").agg(F.collect_list(F.struct(*fields)).alias("uses")))
    kinds = [{"long": pa.int64(), "int": pa.int32()}[f.split()[1]] for f in schema.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*kinds, pa.int64(), pa.binary()], strict=True)], [*fields, "id", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in sliced(batches, "text", 2 << 20):
            rows, held = [], 0
            for own, text, asked in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), batch.column("uses").to_pylist(), strict=True):
                codes = shingle_set(text, size, words).tobytes()
                for use in asked:
                    rows.append((*(use[f] for f in fields), own, codes))
                    held += len(codes)
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
            if rows:
                yield batch_of(rows)

    texts = df.join(small(uses), "id").select("id", "text", "uses")
    return texts.mapInArrow(run, f"{schema}, id long, codes binary").repartition(*order[:-1]).sortWithinPartitions(*order)


def _links(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many values of own each of the others has; all sorted, none empty."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(own, every), len(own) - 1)
    starts = np.cumsum([0, *map(len, others[:-1])])
    return np.add.reduceat((own[at] == every).astype(np.int64), starts)


def confirm(df: DataFrame, pairs: DataFrame, size: int, similarity: int, part: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= similarity * union."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    members = pairs.join(parts, "a").select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    hubs = parts.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    dealt = with_sets(df, members.unionByName(hubs), size, "a long, part int, member int", ["a", "part", "member"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, []
        for batch in batches:
            found = []
            for a, p, member, own, codes in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "member", "id", "codes")), strict=True):
                if now != (a, p):
                    now, hub = (a, p), []
                mine = np.frombuffer(codes, np.uint64)
                if not member:
                    hub.append(mine)
                elif len(mine):
                    both = shared(mine, hub)
                    if any(100 * n >= similarity * (len(mine) + len(h) - n) for n, h in zip(both.tolist(), hub, strict=True)):
                        found.append((a, own))
            yield _links(found)
        trim()

    return cut(dealt.mapInArrow(compare, "a long, b long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the least node it is connected with."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    while True:
        nodes = now.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("m")).first()
        if nodes["n"] == nodes["m"] and now.select(F.col("v").alias("u")).distinct().join(now, "u", "left_semi").isEmpty():
            break  # every node hangs on a root
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(down.union(least).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def blocks_of(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], key: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first `key` of the named columns, however batches cut them."""
    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if group and group[0][:key] != row[:key]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group
    trim()


def near(sigs: np.ndarray, sides: np.ndarray, comps: np.ndarray, i: int, cross: bool, band: int, per_band: int, loose: float) -> np.ndarray:
    """The later members of a block that are to be compared with member i.

    They are in other components, on the other side where two blocks meet, agree in
    `loose` of the signature, and this band is the first that the two share.
    """
    others = np.flatnonzero(comps[i + 1 :] != comps[i]) + i + 1
    if cross:
        others = others[sides[others] != sides[i]]
    if not len(others):
        return others
    same = sigs[others] == sigs[i]
    close = same.sum(axis=1) >= loose * sigs.shape[1]
    others, same = others[close], same[close]
    if not len(others):
        return others
    return others[same.reshape(len(others), sigs.shape[1] // per_band, per_band).all(axis=2).argmax(axis=1) == band]


def candidates(rows: DataFrame, per_band: int, loose: float) -> DataFrame:
    """Those of the rows (key, band, x, y, side, comp, id, sig) with a partner to be compared with in their block."""
    names = ("key", "band", "x", "y", "side", "comp", "id", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], list(names[:-1]))

        for group in blocks_of(batches, names, 4):
            if len(group) < 2:
                continue
            sigs = np.frombuffer(b"".join(r[7] for r in group), "<u2").reshape(len(group), -1)
            sides, comps = np.array([r[4] for r in group]), np.array([r[5] for r in group])
            _, band, x, y = group[0][:4]
            hit = np.zeros(len(group), bool)
            for i in range(len(group) - 1):
                if len(got := near(sigs, sides, comps, i, x != y, band, per_band, loose)):
                    hit[got] = hit[i] = True
            out += [group[i][:7] for i in np.flatnonzero(hit)]
            if len(out) > 10_000:
                yield made()
                out.clear()
        yield made()

    dealt = rows.select(*names).repartition(*names[:4]).sortWithinPartitions(*names[:4])
    return dealt.mapInArrow(run, "key long, band int, x int, y int, side int, comp long, id long")


def settle(df: DataFrame, rows: DataFrame, size: int, similarity: int, signed: MinMax, per_band: int, loose: float) -> DataFrame:
    """Links (a, b) between different components in the blocks of `rows`, confirmed on full sets."""
    schema = "key long, band int, x int, y int, side int, comp long"
    dealt = with_sets(df, rows, size, schema, ["key", "band", "x", "y", "side"])
    names = ("key", "band", "x", "y", "side", "comp", "id", "codes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in blocks_of(batches, names, 4):
            sets = [np.frombuffer(r[7], np.uint64) for r in group]
            sides, comps = np.array([r[4] for r in group]), np.array([r[5] for r in group])
            sigs = np.stack([signed(x) for x in sets])
            _, band, x, y = group[0][:4]
            found = []
            for i in range(len(group) - 1):
                # comps changes as links are found: what is joined already is left out
                left = near(sigs, sides, comps, i, x != y, band, per_band, loose)
                if not len(left):
                    continue
                both = shared(sets[i], [sets[j] for j in left])
                for j, n in zip(left.tolist(), both.tolist(), strict=True):
                    if comps[j] != comps[i] and 100 * n >= similarity * (len(sets[i]) + len(sets[j]) - n):
                        found.append((group[i][6], group[j][6]))
                        comps[comps == comps[j]] = comps[i]
            yield _links(found)

    return cut(dealt.mapInArrow(run, "a long, b long").distinct())


def node(id_col: str, text_col: str) -> Column:
    """The hash of id and text that stands for a document."""
    return F.xxhash64(F.lit(5), F.col(id_col).isNull(), F.col(id_col), F.col(text_col))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: int = 80, bands: int = 50, per_band: int = 6, loose: float = 0.66, part: int = 128, block: int = 1024) -> DataFrame:
    """id, n_shingles, component_id, kept (the id is the component's), node (hash of id and text), first (the node is the component's first); similarity in hundredths."""
    docs = df.select(node(id_col, text_col).alias("id"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    made = cut(features(docs, shingle, bands * per_band // 2)).withColumns({"row": F.monotonically_increasing_id(), "node": F.col("id")})
    if df.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long") and made.groupBy("own").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR own IS NULL").isEmpty():
        # Whole ids that are unique are nodes themselves: the hub of a bucket is then its first document, which the others most often come from.
        made, docs = (x.withColumn("id", F.col("own").cast("long")) for x in (made, docs))
    docs = docs.drop("own")
    real = made.where("n > 0")
    least_own = F.min(F.struct(F.col("own").isNull().alias("none"), "own", "id"))
    classes = cut(real.groupBy("d1", "d2").agg(F.min(F.struct("id", "row")).alias("rep"), least_own.alias("first")))
    classes = classes.select("d1", "d2", F.col("rep.id").alias("id"), F.col("rep.row").alias("row"), "first")
    reps = real.join(classes.select("d1", "d2", "row"), ["d1", "d2", "row"], "left_semi").select("id", "sig")
    slices = [F.xxhash64(F.lit(j), F.substring("sig", 1 + 2 * per_band * j, 2 * per_band)) for j in range(bands)]
    banded = reps.select("id", F.posexplode(F.array(*slices)).alias("band", "key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last").select("key", "hub")
    members = cut(banded.join(shared, "key").select("key", F.col("band").cast("byte").alias("band"), "id", "hub"))

    votes = members.where("id > hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy("id").agg(F.max_by("hub", F.struct("n", F.bitwise_not("hub"))).alias("hub"))
    stars = cut(best.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    first = components(confirm(docs, stars, shingle, similarity, part))

    seen = members.join(first.withColumnRenamed("node", "id"), "id", "left").select("key", F.col("band").cast("int").alias("band"), "id", F.coalesce("comp", "id").alias("comp"))

    mixed = seen.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")).where("c1 < c2").select("key", "blocks")
    rest = seen.join(mixed, "key").join(reps, "id")
    side = F.pmod(F.xxhash64(F.lit(11), "id"), F.col("blocks")).cast("int")
    rest = rest.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumns({"x": F.least("side", "other"), "y": F.greatest("side", "other")})
    open_ = cut(candidates(rest, per_band, loose))
    more = settle(docs, open_, shingle, similarity, MinMax(bands * per_band // 2), per_band, loose)

    # Links of the second step join components of the first.
    lifted = more
    for end in ("a", "b"):
        lifted = lifted.join(first.select(F.col("node").alias(end), F.col("comp").alias("c")), end, "left").withColumn(end, F.coalesce("c", end)).drop("c")
    second = components(lifted)
    joined = first.join(second.select(F.col("node").alias("comp"), F.col("comp").alias("root")), "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    alone = second.select("node", "comp").join(first.select("node"), "node", "left_anti")
    linked = classes.join(joined.union(alone).withColumnRenamed("node", "id"), "id").select("id", "comp", "first")
    roots = linked.groupBy("comp").agg(F.min("first").alias("root"))
    tree = classes.join(linked.select("id", "comp").join(roots, "comp").select("id", "root"), "id", "left").select("d1", "d2", F.coalesce("root", "first").alias("root"))
    out = made.drop("sig", "row").join(tree, ["d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("root.own")).otherwise(F.col("own"))
    return out.select(
        F.col("own").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("own") == component, component.isNull()).alias("kept"),
        "node", ((F.col("n") == 0) | (F.col("id") == F.col("root.id"))).alias("first"),
    )
