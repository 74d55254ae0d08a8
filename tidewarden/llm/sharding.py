"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of 2^63 positions. A row's position is a
hash of its id; it belongs to the first point at or clockwise of it. Shards hold at
most their bound of rows: with epsilon 0 the row counts of any two shards differ
by one at most, else the bound is ceil((1 + epsilon) * rows / shards). Rows that
overflow a full shard go on clockwise to the next point whose shard has room.

Within an arc (what belongs to one point) rows are ranked by ring position, so what
overflows is an interval of ranks, and the routing needs only the row count of
each arc: shards * vnodes numbers, whatever the input's size. The routing itself
is arithmetic over those few numbers on the driver; ranks are window functions
over parts of an arc, and every other step is DataFrame code as well.

A row's arc is looked up by the leading bits of its position: the ring is cut into
at least four times as many cells as it has points, and the points in the row's own
cell are compared one by one. Cells are divided by further bits of the hash until
about `most` rows fall to each part; parts that one repeated id (or null) fills are
dealt out by row number, so no window grows with the input.

Defined results: null ids hash like any other value; a null text has size 1 and
crc 0; repeated rows get slots of their own; an empty table gives no row; columns
other than the two named are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewarden.llm.common import cut, text_or_empty

RING = 63


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(position, shard) of every point, in ring order."""
    return sorted((int.from_bytes(hashlib.md5(f"{shard}/{k}".encode()).digest()[:8], "big") >> 64 - RING, shard) for shard in range(shards) for k in range(vnodes))


def bounds(rows: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """How many rows each shard may hold; with epsilon 0 they sum to `rows` and differ by one at most."""
    if epsilon:
        return [math.ceil((1 + epsilon) * rows / shards)] * shards
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def route(owners: list[int], rows: list[int], most: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot): where each arc's rows go.

    Every shard first takes rows of its own arcs, in ring order; what is left
    moves on clockwise, arc by arc, to the next shard with room.
    """
    room, slot, out = list(most), [0] * len(most), []

    def place(arc: int, low: int, high: int, shard: int) -> int:
        take = min(high - low, room[shard])
        if take:
            out.append((arc, low, low + take, shard, slot[shard]))
            room[shard] -= take
            slot[shard] += take
        return low + take

    count = len(owners)
    over = [(0, arc, low) for arc, n in enumerate(rows) if (low := place(arc, 0, n, owners[arc])) < n]
    heapq.heapify(over)
    skip = list(range(1, 2 * count + 1))  # behind an arc whose shard is full, the next that may have room

    def open_from(at: int) -> int:
        path = []
        while at < 2 * count and not room[owners[at % count]]:
            path.append(at)
            at = skip[at]
        for k in path:
            skip[k] = at
        return at

    while over:
        step, arc, low = heapq.heappop(over)
        if step:
            low = place(arc, low, rows[arc], owners[(arc + step) % count])
        if low < rows[arc]:
            step = open_from(arc + step + 1) - arc
            if step >= count:
                raise ValueError("the bounds are below the number of rows")
            heapq.heappush(over, (step, arc, low))
    return out


def _looked_up(values: list[int], index: Column) -> Column:
    """values[index], from one literal."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>"), index + 1)


def arc_of(points: list[int], place: Column) -> Column:
    """The number of points before a position."""
    bits = max(8, (4 * len(points) - 1).bit_length())
    edges = [bisect.bisect_left(points, c << RING - bits) for c in range((1 << bits) + 1)]
    cell = F.shiftrightunsigned(place, RING - bits).cast("int")
    first, end = _looked_up(edges, cell), _looked_up(edges, cell + 1)
    every = F.split(F.lit(",".join(map(str, points))), ",").cast("array<long>")
    own = F.slice(every, (first + 1).cast("int"), (end - first).cast("int"))
    return (first + F.size(F.filter(own, lambda p: p < place))).cast("int")


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", vnodes: int = 64, epsilon: float = 0.0, most: int = 100_000) -> DataFrame:
    """id, size, text_crc32, shard, slot (gapless from 0 within the shard)."""
    spark = df.sparkSession
    text = text_or_empty(text_col).cast("binary")
    place = F.shiftrightunsigned(F.xxhash64("id"), 64 - RING)
    points = ring(shards, vnodes)
    places, owners = [p for p, _ in points], [s for _, s in points]
    base = df.select(F.col(id_col).alias("id"), (F.length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("crc"))
    base = base.withColumn("place", place).withColumn("passed", arc_of(places, F.col("place")))
    base = cut(base.withColumn("seq", F.monotonically_increasing_id()))
    total = base.count()
    depth = max(8, (total // most).bit_length())  # leading bits by which the ring is divided
    # What lies behind the last point belongs to the first, and comes before what the first point's arc has at the ring's start.
    base = base.withColumns({"arc": F.col("passed") % len(points), "turn": F.when(F.col("passed") == len(points), 0).otherwise(1), "fine": F.shiftrightunsigned("place", RING - depth)})
    hot = base.groupBy("fine").count().where(F.col("count") > 2 * most).select("fine", F.ceil(F.col("count") / most).alias("parts"))
    base = base.join(hot, "fine", "left").withColumn("part", F.pmod("seq", F.coalesce("parts", F.lit(1))))
    own = ["arc", "turn", "fine", "part"]
    groups = cut(base.groupBy(*own).agg(F.count(F.lit(1)).alias("n")))
    rows = dict(groups.groupBy("arc").agg(F.sum("n").alias("n")).collect())
    plan = route(owners, [rows.get(a, 0) for a in range(len(owners))], bounds(total, shards, epsilon))
    kind = "array<struct<arc:int,low:long,high:long,shard:int,first:long>>"
    plan = json.dumps([dict(zip(("arc", "low", "high", "shard", "first"), x, strict=True)) for x in plan])
    ways = spark.range(1).select(F.inline(F.from_json(F.lit(plan), kind)))  # a few intervals an arc: bounded by shards and vnodes
    before = F.coalesce(F.sum("n").over(W.partitionBy("arc").orderBy("turn", "fine", "part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = base.join(groups.withColumn("before", before).drop("n"), own)
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy(*own).orderBy("place", "seq")) - 1)
    placed = ranked.alias("r").join(F.broadcast(ways.alias("w")), F.expr("r.arc = w.arc AND r.rank >= w.low AND r.rank < w.high"))
    slot = F.col("w.first") + F.col("r.rank") - F.col("w.low")
    return placed.select(F.col("r.id").alias(id_col), "r.size", F.col("r.crc").alias("text_crc32"), "w.shard", slot.alias("slot"))
