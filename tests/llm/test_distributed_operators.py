"""Operators that shuffle: exact and near dedup, mixing, sharding, and the pipeline."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_local_operators import EDGE, LONG, SCHEMA, edge, empty
from tidewarden.llm import exact, minhash, mixing, queries, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, sf: str) -> pd.DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


# -------------------------------------------------------------------------- exact


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (doc, _), n in zip(rows, norm, strict=True):
        groups[n].append(doc)
    for (doc, _), n in zip(rows, norm, strict=True):
        own = [x for x in groups[n] if x is not None]
        yield doc, min(own) if own else None, len(groups[n]), hashlib.sha256(n.encode()).hexdigest()


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("digest_all", [True, False])
def test_exact_edges(spark, digest_all, small, monkeypatch):
    if not small:
        monkeypatch.setattr(exact, "small", lambda df: df)
    same_head = "x" * 100
    rows = [(r[0], r[1]) for r in EDGE] + [(20, "a  b"), (21, "a\tb"), (22, "a b "), (23, same_head + "p"), (24, same_head + "q"), (25, same_head + "p"), (26, " "), (27, "\n\n"), (None, "no id"), (30, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS len", "2 AS head", "3 AS sha", "4 AS row", "5 AS n", "6 AS first")
    out = exact.exact_duplicates(df, digest_all=digest_all).collect()
    want = Counter(x[:3] for x in brute_exact(rows))
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in out) == want
    if digest_all:
        assert {(r.doc_id, r.text_sha256) for r in out} == {(x[0], x[3]) for x in brute_exact(rows)}
    assert sum(r.kept for r in out) == len({x[3] for x in brute_exact(rows)})
    assert exact.exact_duplicates(df.limit(0), digest_all=digest_all).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_oracles(spark, tiny, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want, got = con.execute(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, tiny).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda x: sorted(tuple(map(str, r)) for r in x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False))
    assert rows(want) == rows(got)


# ------------------------------------------------------------------------ minhash


def sets_of(texts: dict, size: int) -> dict:
    out = {}
    for doc, text in texts.items():
        w = (text or "").encode().lower().split()
        out[doc] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets: dict) -> dict:
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 80 * (len(x) + len(y) - n):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {d: root(d) for d in docs}


def near_corpus() -> list[tuple[int, str]]:
    """Groups of copies with edits of graded size, chains, and texts that share long passages."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(400)]
    rows, passage = [], " ".join(rng.choice(vocab, 60))
    for g in range(12):
        base = list(rng.choice(vocab, 80))
        for _ in range(6):
            text = list(base)
            for _ in range(int(rng.integers(0, 9))):
                text[int(rng.integers(0, len(text)))] = str(rng.choice(vocab))
            rows.append(" ".join(text))
    chain = list(rng.choice(vocab, 60))
    for k in range(10):
        chain[5 * k] = f"new{k}"
        rows.append(" ".join(chain))
    rows += [passage + " " + " ".join(rng.choice(vocab, 20)) for _ in range(15)]
    rows += ["one", "ONE", "one two", "Ünï ünï", "ÜNï ünï", "", " \n", "one two three", "one two", "a b c d e f", "a b c d e g"]
    order = rng.permutation(len(rows))
    return [(int(i) * 3, rows[k]) for i, k in zip(order, range(len(rows)), strict=True)]


@pytest.mark.parametrize("size", [2, 5])
@pytest.mark.parametrize("block", [1024, 4])
def test_components_by_brute_force(spark, size, block):
    rows = near_corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS sig", "3 AS comp", "4 AS key")
    out = {r.doc_id: r for r in minhash.near_duplicates(df, shingle=size, block=block, part=3).collect()}
    sets = sets_of(dict(rows), size)
    want = brute_components(sets)
    assert {d: r.component_id for d, r in out.items()} == want
    assert {d: r.n_shingles for d, r in out.items()} == {d: len(s) for d, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.values())


def test_near_edges(spark):
    out = minhash.near_duplicates(edge(spark)).collect()
    assert len(out) == len(EDGE)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}
    assert got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[1] == (1, 1, True) and got[5] == (1, 1, False)
    assert got[None] == (1, None, True)
    assert got[4][0] == 3
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_ids_of_any_type_and_shared_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [("b", base), ("a", base + " x"), ("c", "quite other words stand in this text"), ("c", base + " y"), (None, base + " z"), (None, None)]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), shingle=5).collect()
    assert Counter((r.doc_id, r.component_id, r.kept, r.first) for r in out) == Counter([("b", "a", False, False), ("a", "a", True, True), ("c", "c", True, True), ("c", "a", False, False), (None, "a", False, False), (None, None, True, True)])


def test_long_chain_of_stars(spark):
    rng = np.random.default_rng(4)
    nodes = rng.permutation(300).tolist()
    edges = [(a, b) for a, b in zip(nodes, nodes[1:], strict=False)] + [(1000, 1001), (1002, 1001), (1003, 1003)]
    out = dict(minhash.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert all(out[n] == 0 for n in nodes)
    assert out[1002] == out[1001] == 1000
    assert minhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_signature_estimates_similarity():
    signed = minhash.MinMax(2000)
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    b = a[200:]
    agree = (signed(a) == signed(b)).mean()
    assert abs(agree - 0.8) < 0.04


# ------------------------------------------------------------------------- mixing


def brute_targets(sizes: dict, order: list, weights=(3, 1, 2)) -> dict:
    """Water filling, source by source: fix whatever is above its cap, share again."""
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 2 * sizes[s] + 1e-9]
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def check_mix(out: pd.DataFrame, sizes: dict, targets: dict, slack: float) -> None:
    assert (out.taken <= 2 * out["size"]).all() and (out.taken >= 0).all()
    for source, rows in out.groupby(out.source.fillna("~null")):
        assert rows.target.iloc[0] == pytest.approx(targets[source])
        assert rows.source_size.iloc[0] == sizes[source]
        assert abs(rows.taken.sum() - targets[source]) <= slack * max(1, targets[source]) + 1, source


@pytest.mark.parametrize(("block", "slack"), [(1024, 0.005), (64, 0.02), (16, 0.1)])
def test_mix_reaches_targets(spark, block, slack):
    """Sizes have a heavy tail; a block of 16 documents cannot make up for every giant."""
    rng = np.random.default_rng(9)
    rows = []
    for k in range(900):
        source = [None, "a", "b", "é", "z", "B"][min(5, int(rng.integers(0, 12)))]
        rows.append((k, " ".join(["w"] * int(rng.pareto(1.2) * 20)), source))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df, block=block).toPandas()
    out["taken"] = out.times * out["size"]
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes["~null" if source is None else source] += len(WORDS.findall(text))
    order = [*sorted((s for s in sizes if s != "~null"), key=lambda s: [ord(c) for c in s]), "~null"]
    check_mix(out, sizes, brute_targets(sizes, order), slack)
    again = mixing.mix(df.repartition(7), block=block).toPandas()
    assert out.sort_values("doc_id").times.tolist() == again.sort_values("doc_id").times.tolist()


def test_mix_deals_out_hot_rows(spark):
    """A third of all rows are one row: its copies are dealt out like others, whatever the order of the input."""
    rows = [(7, "x y z", "a")] * 700 + [(100 + k, " ".join(["w"] * (1 + k % 50)), "ab"[k % 2]) for k in range(1400)]
    rows += [(None, None, None)] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = df.select(F.col("doc_id").alias("id"), "source", mixing.words("text").alias("size"), F.lit(0).cast("long").alias("crc"))
    docs = mixing.cut(docs.withColumn("place", F.xxhash64("id", "crc")))
    told = mixing.apart(docs, 64)
    assert told.columns == docs.columns
    key = lambda rows: Counter((r.id, r.source, r["size"], r.crc) for r in rows)
    assert key(told.collect()) == key(docs.collect())
    assert told.select("place").distinct().count() == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes["~null" if source is None else source] += len(WORDS.findall(text or ""))
    made = mixing.mix(df, block=64).toPandas()
    made["taken"] = made.times * made["size"]
    assert len(made) == len(rows)
    check_mix(made, sizes, brute_targets(sizes, ["a", "b", "~null"]), 0.02)
    again = mixing.mix(df.repartition(5), block=64).toPandas()
    assert Counter(zip(made.doc_id.fillna(-1), made.times)) == Counter(zip(again.doc_id.fillna(-1), again.times))


def test_flight_keeps_totals_and_probabilities():
    size = np.array([5, 9, 9, 2, 7, 1, 30, 4, 4, 12], float)
    chance = np.full(10, 0.3)
    seen = np.zeros(10)
    for seed in range(3000):
        got = mixing.fly(size, chance, np.random.default_rng(seed))
        assert got.sum() == pytest.approx(3.0) and (got * size).sum() == pytest.approx(0.3 * size.sum())
        assert ((got > 1e-9) & (got < 1 - 1e-9)).sum() <= 2
        seen += got
    assert np.abs(seen / 3000 - 0.3).max() < 0.04


def test_mix_edges(spark):
    out = mixing.mix(edge(spark)).toPandas()
    assert len(out) == len(EDGE)
    assert out[out.doc_id == 2]["size"].tolist() == [0]
    assert mixing.mix(empty(spark)).count() == 0
    only_empty = spark.createDataFrame([(1, "", "a"), (2, None, "a")], "doc_id long, text string, source string")
    assert [r.times for r in mixing.mix(only_empty).collect()] == [0, 0]


# ----------------------------------------------------------------------- sharding


def brute_ring(rows: list[int], shards: int, vnodes: int) -> list[int]:
    """How many rows each shard holds, row by row: every shard takes its own arcs' rows first, the rest walk on clockwise."""
    owners = [s for _, s in sharding.ring(shards, vnodes)]
    most, held = sharding.bounds(sum(rows), shards), [0] * shards
    over = []
    for arc, n in enumerate(rows):
        for _ in range(n):
            if held[owners[arc]] < most[owners[arc]]:
                held[owners[arc]] += 1
            else:
                over.append(arc)
    for step in range(1, len(owners)):
        rest = []
        for arc in over:
            shard = owners[(arc + step) % len(owners)]
            if held[shard] < most[shard]:
                held[shard] += 1
            else:
                rest.append(arc)
        over = rest
    assert not over
    return held


def test_routes_by_brute_force():
    rng = np.random.default_rng(6)
    for shards in (1, 3, 8):
        owners = [s for _, s in sharding.ring(shards, 5)]
        rows = rng.integers(0, 40, len(owners)).tolist()
        plan = sharding.route(owners, rows, sharding.bounds(sum(rows), shards))
        spans = defaultdict(list)
        slots = defaultdict(list)
        for arc, low, high, shard, first in plan:
            spans[arc].append((low, high))
            slots[shard] += range(first, first + high - low)
        for arc, n in enumerate(rows):
            assert [x for low, high in sorted(spans[arc]) for x in range(low, high)] == list(range(n))
        held = brute_ring(rows, shards, 5)
        assert all(sorted(slots[s]) == list(range(held[s])) for s in range(shards))


def check_shards(out: pd.DataFrame, rows: int) -> None:
    assert len(out) == rows
    counts = out.groupby("shard").size().reindex(range(8), fill_value=0)
    assert counts.max() - counts.min() <= 1
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_shards(spark, tiny):
    docs = docs_of(spark, tiny).set_index("doc_id").text
    out = queries.op7_sharding(spark, tiny).toPandas()
    check_shards(out, len(docs))
    for r in out.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    assert set(out.law) == {"rows"} and out.grown_shard.isna().all()


def test_shards_with_hot_and_odd_keys(spark):
    rows = EDGE + [(None, "same", None, None)] * 300 + [(77, "copy", None, None)] * 500
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS cell", "3 AS place", "4 AS n", "5 AS rank")
    check_shards(sharding.shard_rows(df, most=20).toPandas(), len(rows))
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_every_row_lies_on_its_own_arc(spark):
    """Against a plain walk round the ring: the point at or behind each position."""
    points = sharding.ring(40, 16)
    places = [p for p, _ in points]
    rng = np.random.default_rng(4)
    asked = [0, (1 << 63) - 1, *rng.integers(0, 1 << 63, 3000).tolist(), *(p + d for p in places for d in (-1, 0, 1))]
    got = spark.createDataFrame([(x,) for x in asked], "place long").select("place", sharding.arc_of(places, F.col("place")).alias("arc")).collect()
    assert all(r.arc == sum(p < r.place for p in places) for r in got)


def test_no_point_is_lost_on_a_large_ring(spark):
    points = sharding.ring(1000, 64)
    assert len(points) == 64_000 and len({p for p, _ in points}) == 64_000 and Counter(s for _, s in points) == dict.fromkeys(range(1000), 64)
    out = sharding.shard_rows(spark.range(30_500).selectExpr("id AS doc_id", "'x' AS text"), 1000).toPandas()
    counts = out.groupby("shard").size()
    assert len(counts) == 1000 and set(counts) == {30, 31} and out.doc_id.is_unique
    assert all(sorted(p.slot) == list(range(len(p))) for _, p in out.groupby("shard"))


def moved(spark, epsilon: float, rows: int = 20_000) -> float:
    df = spark.range(rows).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    before, after = ({r.doc_id: r.shard for r in sharding.shard_rows(df, n, epsilon=epsilon).collect()} for n in (8, 9))
    assert all(n <= max(sharding.bounds(rows, 8, epsilon)) for n in Counter(before.values()).values())
    return sum(before[d] != after[d] for d in before) / rows


def test_few_rows_move_when_a_shard_is_added(spark):
    """A ninth of the rows has to move to the new shard; a hash modulo the shards would move eight ninths."""
    assert 1 / 9 <= moved(spark, 0.0) < 0.35  # the bound the query uses
    assert moved(spark, 0.25) < 0.25


# ----------------------------------------------------------------------- pipeline


def back(spark, rows: pd.DataFrame, schema):
    """Rows of a stage as Spark has them: nulls, and ids that are whole numbers."""
    made = [tuple(None if pd.isna(v) else int(v) if c in ("doc_id", "n_chars") else v for c, v in zip(rows.columns, r, strict=True)) for r in rows.itertuples(index=False)]
    return spark.createDataFrame(made, schema)


def test_stages_by_brute_force(spark, tiny):
    """Each stage against a plain version on its own input."""
    from tidewarden.llm import langid

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    extra = spark.createDataFrame([(900_001, None, None, "src1", 0), (900_002, "12 !!", "en", "src1", 5), (900_003, docs.first().text, "en", None, 7), (900_003, docs.first().text, "en", None, 7), (None, "a text without an id", "en", "src2", 3)], docs.schema)
    frame = docs.unionByName(extra).toPandas()
    spark_docs = docs.unionByName(extra).selectExpr("*", "1 AS _id", "2 AS times").cache()
    names = corpus_pipeline.COLUMNS
    # language ID
    one = corpus_pipeline.language(spark, spark_docs, tiny)
    assert one.columns == names
    got = one.toPandas()
    letters = frame.text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert Counter(got.text) == Counter(frame[letters].text)
    assert langid.held_out is not None
    # exact dedup
    two = corpus_pipeline.exact_dedup(spark, one, tiny).toPandas()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t)
    first = {}
    for r in got.sort_values("doc_id", na_position="last").itertuples():
        first.setdefault(norm(r.text), r.doc_id)
    assert Counter(map(norm, two.text)) == Counter(list(first))
    assert all(first[norm(r.text)] == r.doc_id or pd.isna(r.doc_id) for r in two.itertuples())
    # near dedup
    near = corpus_pipeline.near_dedup(spark, back(spark, two, docs.schema), tiny).toPandas()
    known = two[two.doc_id.notna()]
    want = brute_components(sets_of(dict(zip(known.doc_id.astype(int), known.text, strict=True)), 5))
    assert sorted(near.doc_id.dropna().astype(int)) == sorted(d for d, c in want.items() if d == c)
    assert near.doc_id.isna().sum() == two.doc_id.isna().sum()
    # mixing
    mixed = corpus_pipeline.mix(spark, back(spark, near, docs.schema), tiny).toPandas()
    size = lambda t: len(WORDS.findall(t))
    sizes = near.groupby(near.source.fillna("~null")).text.apply(lambda x: x.map(size).sum()).to_dict()
    order = [*sorted((s for s in sizes if s != "~null"), key=lambda s: [ord(c) for c in s]), *[s for s in sizes if s == "~null"]]
    targets = brute_targets(sizes, order)
    for source, rows in mixed.groupby(mixed.source.fillna("~null")):
        assert abs(rows.text.map(size).sum() - targets[source]) <= max(size(t) for t in near.text)
    assert Counter(mixed.doc_id.dropna()).most_common(1)[0][1] <= 2


def test_language_stage_drops_what_no_language_knows(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    odd = spark.createDataFrame([(900_001, "日本語の文章です", None, "src1", 8), (900_002, "ᚠᚢᚦᚨᚱᚲ ᚷᚹᚺᚾ", None, "src1", 11)], docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(odd), tiny).collect()}
    letters = docs.toPandas().set_index("doc_id").text.fillna("").map(lambda t: any(c.isalpha() for c in t))
    assert got == set(letters[letters].index)


def test_near_dedup_keeps_rows_that_share_an_id_apart(spark, tiny):
    first, second, third = (" ".join(f"{w}{k}" for k in range(80)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, first), (2, first + " end"), (2, second), (None, third), (None, third + " end"), (None, second + " end"), (4, "quite another text of its own")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, tiny).collect()]
    assert len(got) == 4 and {(1, first), (2, second), rows[6]} <= set(got)
    assert sum(i is None and t.startswith("gamma") for i, t in got) == 1


@pytest.mark.parametrize("small", [True, False])
def test_stages_with_repeated_rows(spark, tiny, small, monkeypatch):
    if not small:
        monkeypatch.setattr(corpus_pipeline, "small", lambda df: df)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(2, "one  two", "en", "a", 1)] * 3 + [(2, "one two", "en", "a", 1), (1, "three four", "en", "a", 1), (None, "three four", "de", "b", 1), (5, "alone", "en", None, 1), (None, None, None, None, None), (None, None, None, None, None), (6, "", "en", "a", 1), (7, "alone here", "en", "a", 1)]
    docs = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in corpus_pipeline.exact_dedup(spark, docs, tiny).collect()]
    assert len(got) == len(set(got)) == 5 and set(got) <= set(rows)
    assert {r[0] for r in got} == {1, 2, 5, 6, 7} and sum(r[0] == 2 for r in got) == 1
    mixed = [tuple(r) for r in corpus_pipeline.mix(spark, docs.where("text <> ''"), tiny).collect()]
    assert mixed and set(mixed) <= set(rows)
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.near_dedup, corpus_pipeline.mix):
        assert stage(spark, docs.limit(0), tiny).count() == 0


def test_pipeline_runs(spark, tiny):
    out = corpus_pipeline.run(spark, tiny).toPandas()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and len(out)
    # copies of a document are packed whole, each on its own
    whole = out.groupby("doc_id").agg(got=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (whole.got % whole.tokens == 0).all()
