"""Mixing sources to target weights by the cube method of balanced sampling.

Sources get targets by weight (water filling: no target is above `most` times
the source's size; the excess is shared again by weight). A source's documents
are then taken target / size times: the whole part of that ratio for each, and
once more with the fraction as inclusion probability. The inclusions are
balanced on two totals, tokens (words) and documents: the flight moves the
vector of probabilities along the null space of both constraints, until each
block of documents has at most two undecided ones. Those of many blocks form
the blocks of the next flight, and so on, until each source is one block. A
first block of each source waits for that last flight. The landing then rounds
its last two or so documents to the nearest token total and makes up for the
rest by a few exchanges within the block.

Blocks are dealt out by a hash of the document's id and text, about `block` documents
each, whatever the source's size; rows that more than a block agree in are told apart by
number, so they are dealt out like others. Texts are not moved. Every decision is drawn
from a generator seeded by the block's name, so reruns agree.

Defined results: null texts have size 0 and are balanced as documents; a null
source is a source of its own, last in order; repeated rows are documents of
their own; an empty table gives no row; columns other than those named are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.llm.common import WORD, cut, small, text_or_empty

EPS = 1e-9


def words(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: one row per source (source, source_size, docs). Adds target.

    With the sources in order of cap / weight, the first k are at their caps,
    where k is the least number that leaves a level no further cap is below; levels
    only fall from there on. The windows run over one row per source.
    """
    order = W.orderBy(F.col("source").cast("binary").asc_nulls_last())  # bytes of UTF-8 sort by code point
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(order) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * float(most))
    up = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").cast("binary").asc_nulls_last())
    rest = ranked.withColumns({
        "before": F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "still": F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)),
        "whole": F.sum("source_size").over(W.partitionBy()) * float(share),
    })
    rest = rest.withColumn("level", (F.col("whole") - F.col("before")) / F.col("still"))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(W.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(level * F.col("weight"), F.col("cap")))
    return rest.withColumn("target", target).select("source", "source_size", "docs", "target")


def fly(size: np.ndarray, chance: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight: chances of 0, 1 or, for the last few, between, with sum(chance) and sum(chance * size) kept."""
    chance = chance.copy()
    draws = iter(rng.random(3 * len(size) + 8).tolist())
    s, p, held = size.tolist(), chance.tolist(), []
    for i in range(len(s)):
        if EPS < p[i] < 1 - EPS:
            held.append(i)
        while len(held) >= 2:
            a, b = held[-2], held[-1]
            if s[a] == s[b]:  # two alike: their difference alone spans the null space
                move = ((a, 1.0), (b, -1.0))
            elif len(held) >= 3:
                a, b, c = held[-3:]
                move = ((a, s[b] - s[c]), (b, s[c] - s[a]), (c, s[a] - s[b]))
            else:
                break
            up = min(((1 - p[k]) / u if u > 0 else p[k] / -u) for k, u in move if u)
            down = min((p[k] / u if u > 0 else (1 - p[k]) / -u) for k, u in move if u)
            step = up if next(draws, 0.5) * (up + down) < down else -down
            for k, u in move:
                p[k] += step * u
                p[k] = 0.0 if p[k] <= EPS else 1.0 if p[k] >= 1 - EPS else p[k]
            held = [k for k in held if 0.0 < p[k] < 1.0]
    return np.array(p)


def land(size: np.ndarray, chance: np.ndarray, swaps: int = 4) -> np.ndarray:
    """Round the last open chances so that the token total comes nearest to what they promise.

    What is then missing or too much is made good by exchanges of one taken for
    one untaken document, which keep the document total.
    """
    open_ = np.flatnonzero((chance > EPS) & (chance < 1 - EPS))
    out, goal = chance.copy(), float((chance * size).sum())
    rest = goal - float((chance * size)[chance >= 1 - EPS].sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(float(size[k]) for j, k in enumerate(open_) if m >> j & 1) - rest), m))
    for j, k in enumerate(open_):
        out[k] = float(best >> j & 1)
    for _ in range(swaps):
        short = goal - float((out * size).sum())
        taken, free = np.flatnonzero(out > 0.5), np.flatnonzero(out < 0.5)
        if not len(taken) or not len(free):
            break
        free = free[np.argsort(size[free], kind="stable")]
        at = np.searchsorted(size[free], size[taken] + short)
        near = np.stack([np.clip(at - 1, 0, len(free) - 1), np.clip(at, 0, len(free) - 1)])
        left = np.abs(short - (size[free[near]] - size[taken]))
        row, col = np.unravel_index(int(left.argmin()), left.shape)
        if left[row, col] >= abs(short) - EPS:
            break
        out[taken[col]], out[free[near[row, col]]] = 0.0, 1.0
    return out


def apart(docs: DataFrame, most: int) -> DataFrame:
    """docs (cut), where rows that share their place with more than `most` others get places of their own.

    Such rows are counted, with map-side partials, and made again from their counts in parts of `most`,
    so no task gets all of them and their places do not hang on the order of the input.
    """
    crowds = cut(docs.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("place"))
    if crowds.isEmpty():
        return docs
    crowds = small(crowds)
    counted = docs.join(crowds, "place", "left_semi").groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("n"))
    parts = counted.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(most).cast("long")))).repartition("place", "first")
    each = parts.withColumn("number", F.explode(F.sequence(F.col("first"), F.least(F.col("first") + most, F.col("n")) - 1)))
    others = docs.join(crowds, "place", "left_anti")
    return others.unionByName(each.withColumn("place", F.xxhash64("place", "number")).select(*others.columns)).select(*docs.columns)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 1024) -> DataFrame:
    """id, source, size, source_size, target, times (how often the mix takes the document), text_crc32."""
    docs = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), F.crc32(text_or_empty(text_col).cast("binary")).alias("crc"))
    docs = apart(cut(docs.withColumn("place", F.xxhash64(F.lit(5), "id", "crc"))), block)
    goals = cut(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, share, most))
    largest = goals.agg(F.max("docs")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = docs.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source")), "left").select("d.*", "g.source_size", "g.docs", "g.target")
    known = known.withColumn("sure", F.floor(ratio + EPS)).withColumn("chance", F.greatest(F.lit(0.0), ratio - F.col("sure")))
    known = known.withColumn("blocks", F.ceil(F.col("docs") / block))
    schema = known.schema

    def flight(last: bool):
        def run(key: tuple, rows: pa.Table) -> pa.Table:
            rows = rows.sort_by([("size", "descending"), ("place", "ascending"), ("crc", "ascending")])
            size = rows.column("size").to_numpy().astype(np.float64)
            rng = np.random.default_rng(zlib.crc32(repr([x.as_py() for x in key]).encode()))
            chance = fly(size, rows.column("chance").to_numpy().astype(np.float64), rng)
            return rows.set_column(rows.column_names.index("chance"), "chance", pa.array(land(size, chance) if last else chance))

        return run

    part = F.pmod(F.xxhash64(F.lit(0), "place"), F.col("blocks"))
    # One block of each source waits for the last flight, so that the landing has documents of all sizes to exchange.
    waiting = known.where(part == 0)
    open_, settled, level = known.where(part != 0), [], 0
    undecided = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
    left = largest
    while left > block:
        done = cut(open_.groupBy("source", part.alias("part"), F.lit(level).alias("level")).applyInArrow(flight(False), schema))
        settled.append(done.where(~undecided))
        # A block leaves two or so: the next level's blocks follow from this one's.
        left, level = 3 * -(-left // block), level + 1
        open_ = done.where(undecided).withColumn("blocks", F.ceil(3 * F.col("blocks") / block))
        part = F.pmod(F.xxhash64(F.lit(level), "place"), F.col("blocks"))
    settled.append(cut(open_.union(waiting).groupBy("source").applyInArrow(flight(True), schema)))
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("sure") + F.round("chance").cast("long")).alias("times"), F.col("crc").alias("text_crc32"))
