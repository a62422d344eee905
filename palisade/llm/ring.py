"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard stands at many places of a ring; a document goes to the next place clockwise from the
hash of its text. No shard takes more than ``slack`` times the mean number of bytes: what overflows
a full shard goes on clockwise to the next place whose shard has room. So shards are near equal
whatever the data, equal texts stay together as far as the bound allows, and a changed number of
shards moves little but its share.

Loads are known per arc (a few thousand rows, whatever the input), so the overflow is planned on arcs:
which stretch of an arc's bytes goes to which shard. A document finds its stretch by its position in
the arc, a running sum over ranges of bounded size. A hot text is just a long run of such positions.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections import deque

from pyspark.sql import DataFrame, Window, functions as F

from palisade.session import write_through

SHARDS, PLACES = 40, 256
#: Most bytes of a shard as a multiple of the mean. The lowest shard then has at least 1 - 39 * 0.0005 of it.
SLACK = 1.0005
EXTRA = 16
#: Rows whose positions are summed up in one task.
RANGE_ROWS = 20_000
_SPACE = 1 << 32


def ring_places(shards: int, places: int = PLACES) -> list[tuple[int, int]]:
    """(position, shard) in ring order; a shard's places depend on nothing but its number."""
    return sorted((zlib.crc32(f"shard-{s}:{p}".encode()) * 2654435761 % _SPACE, s) for s in range(shards) for p in range(places))


def plan_overflow(loads: dict[int, int], owners: list[int], shards: int, slack: float = SLACK) -> list[tuple[int, int, int]]:
    """(arc, first byte inside the arc, shard): the stretches of every arc with bytes, in order.

    ``loads`` has the bytes of each arc, ``owners`` the shard at its end. Arcs keep their first bytes
    at home; overflow walks on clockwise, past full shards, until all of it has a place.
    """
    total = sum(loads.values())
    room = [math.ceil(total / shards * slack)] * shards
    stretches: dict[int, list[tuple[int, int, int]]] = {}
    moving: deque[tuple[int, int, int]] = deque()  # (arc, first byte, bytes) under way
    arcs = len(owners)
    for step in range(2 * arcs):  # the second round places what overflowed the first
        arc = step % arcs
        if step < arcs and loads.get(arc):
            moving.append((arc, 0, loads[arc]))
        elif step >= arcs and not moving:
            break
        shard = owners[arc]
        # Whoever is at home goes first, then those who have walked longest.
        queue = sorted(moving, key=lambda m: m[0] != arc)
        moving.clear()
        for home, first, n in queue:
            take = min(n, room[shard])
            if take:
                stretches.setdefault(home, []).append((first, take, shard))
                room[shard] -= take
            if n > take:
                moving.append((home, first + take, n - take))
    return sorted((arc, first, shard) for arc, parts in stretches.items() for first, _, shard in parts)


def plan_evening(held: dict[int, int]) -> dict[int, list[tuple[int, int]]]:
    """Per shard (first byte, shard it goes to), by first byte: bytes above the mean go on to the next shards below it."""
    mean = sum(held.values()) // max(1, len(held))
    below = deque([k, mean - n] for k, n in sorted(held.items()) if n < mean)
    out = {}
    for k, n in sorted(held.items()):
        parts, at = [], 0
        while n - at > mean and below:
            step = min(n - at - mean, below[0][1])
            parts.append((at, below[0][0]))
            at, below[0][1] = at + step, below[0][1] - step
            if not below[0][1]:
                below.popleft()
        out[k] = [*parts, (at, k)]
    return out


def _positions(rows: DataFrame, keys: list[str], amount: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over all rows before, in the order of ``keys``. ``rows`` come with ``part``."""
    sums = rows.groupBy("part").agg(F.sum(amount).alias("s"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select("part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(starts, "part").withColumn(
        out, F.col("inside") + F.col("start")
    ).drop("inside", "start")


def _in_ranges(rows: DataFrame, keys: list[str], label: str, n: int) -> DataFrame:
    """Rows in ranges of ``keys``, numbered by ``part`` in order, written.

    About RANGE_ROWS rows each, and of many rows as many ranges as a range has rows, so that neither a range nor what
    is summed up over all ranges outgrows a task.
    """
    dealt = rows.repartitionByRange(max(1, min(math.ceil(n / RANGE_ROWS), math.isqrt(n))), *keys)
    return write_through(dealt.withColumn("part", F.spark_partition_id()), label)


def shard(
    docs: DataFrame, shards: int = SHARDS, places: int = PLACES, slack: float = SLACK, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot``, ``grown_shard`` (null): a row per row of ``docs``.

    Size is the UTF-8 length plus 16; a null text counts as an empty one. Slots number a shard's rows
    from 0 without a gap. Equal rows are interchangeable, null doc_ids are values like any other, and
    an empty table gives an empty one. Other columns are not read.
    """
    spark = docs.sparkSession
    ring = ring_places(shards, places)
    starts = [p for p, _ in ring]
    owners = [s for _, s in ring]
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    at = F.pmod(F.xxhash64(F.lit(40), value), F.lit(_SPACE))
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), (F.octet_length(value) + EXTRA).cast("long").alias("size"),
        F.crc32(value.cast("binary")).alias("text_crc32"), at.alias("at"),
    )
    # The arc of a position: all places before it, around the ring. A lookup by the position's leading bits keeps it short.
    bits = 16
    cuts = [(b, bisect.bisect_left(starts, b << (32 - bits)), bisect.bisect_left(starts, (b + 1) << (32 - bits))) for b in range(1 << bits)]
    near = spark.createDataFrame([(b, i, starts[i:j]) for b, i, j in cuts], "head int, first int, points array<bigint>")
    rows = rows.withColumn("head", F.shiftright("at", 32 - bits).cast("int")).join(F.broadcast(near), "head")
    arc = F.col("first") + F.size(F.filter("points", lambda p: p < F.col("at")))
    rows = rows.select("doc_id", "size", "text_crc32", "at", F.pmod(arc, F.lit(len(ring))).cast("int").alias("arc"), F.monotonically_increasing_id().alias("tie"))
    # Large documents first inside an arc, so that a stretch ends among small ones; equal texts side by side.
    keys = ["arc", "back", "at", "doc_id", "tie"]
    rows = write_through(rows.withColumn("back", -F.col("size")), "documents")
    n = rows.count()
    rows = _in_ranges(rows, keys, "ring", n)
    loads = {r["arc"]: r["s"] for r in rows.groupBy("arc").agg(F.sum("size").alias("s")).collect()}  # shards * places rows at most
    before, offset = {}, 0
    for a in sorted(loads):
        before[a], offset = offset, offset + loads[a]
    stretches: dict[int, list[tuple[int, int]]] = {}
    for a, first, to in plan_overflow(loads, owners, shards, slack):
        stretches.setdefault(a, []).append((first + before[a], to))
    plan = spark.createDataFrame(
        list(stretches.items()), "arc int, stretches array<struct<first: bigint, shard: int>>"
    )
    placed = _positions(rows, keys, "size", "position").join(F.broadcast(plan), "arc")
    # A document belongs to the stretch that holds its middle.
    middle = F.col("position") + F.floor(F.col("size") / 2)
    mine = F.element_at(F.filter("stretches", lambda s: s["first"] <= middle), -1)["shard"]
    placed = placed.select("doc_id", "size", "text_crc32", mine.alias("shard"), "at", "tie")
    # Stretches cut at whole documents, so shards are some bytes off; their smallest documents make up for it.
    order = ["shard", "size", "at", "doc_id", "tie"]
    placed = _in_ranges(placed, order, "shards", n).withColumn("one", F.lit(1).cast("long"))
    held = {r["shard"]: (r["s"], r["n"]) for r in placed.groupBy("shard").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    first_byte, first_row, bytes_, rows_ = {}, {}, 0, 0
    for k in sorted(held):
        first_byte[k], first_row[k] = bytes_, rows_
        bytes_, rows_ = bytes_ + held[k][0], rows_ + held[k][1]
    moves = plan_evening({k: held[k][0] if k in held else 0 for k in range(shards)})
    parts = [(k, [(first_byte[k] + at, to) for at, to in moves[k]]) for k in held]
    plan = spark.createDataFrame(parts, "shard int, parts array<struct<first: bigint, to: int>>")
    placed = _positions(_positions(placed, order, "size", "position"), order, "one", "row")
    placed = placed.join(F.broadcast(plan), "shard")
    part = F.size(F.filter("parts", lambda x: x["first"] <= middle))
    placed = write_through(
        placed.select("doc_id", "size", "text_crc32", "row", F.col("shard").alias("from"), part.alias("part"), F.get("parts", part - 1)["to"].alias("shard")),
        "rows",
    )
    # Each part is a run of rows; the runs of a shard are laid end to end. A few rows for each shard.
    runs = placed.groupBy("shard", "from", "part").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("from", "part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    return placed.join(F.broadcast(runs), ["shard", "from", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first") + F.col("ahead")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
