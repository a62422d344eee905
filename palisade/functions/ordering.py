"""Order-dependent results without one big group: chunked text and tiered numbering."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.session import write_through

#: Pieces that are sorted and joined at once.
CHUNK = 512


def _joined(order: Sequence[str], text: str, separator: str) -> Column:
    rows = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, text]))))
    return F.array_join(F.transform(rows, lambda r: r[text]), separator)


def ordered_text(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    separator: str,
    out: str,
    chunk: Column | None = None,
) -> DataFrame:
    """One text per key, its pieces in ``order``.

    ``chunk`` must grow with ``order``. Pieces are first sorted and joined per
    (key, chunk), so the sorting of a hot key is spread over many tasks and its
    last task only strings finished chunks together.
    """
    keys = list(keys)
    if chunk is None:
        return df.groupBy(*keys).agg(_joined(order, text, separator).alias(out))
    parts = df.groupBy(*keys, chunk.alias("__chunk")).agg(_joined(order, text, separator).alias("__part"))
    return parts.groupBy(*keys).agg(_joined(["__chunk"], "__part", separator).alias(out))


def numbered(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    tiers: Sequence[str],
    out: str,
    total: str | None = None,
) -> DataFrame:
    """1-based row number per key, with no window over a whole key.

    ``tiers`` are non-null columns of ``df``, coarse to fine, that agree with ``order``.
    Rows are counted per tier, the counts are summed up tier by tier, and
    ``row_number`` runs only inside the finest tier. The counts need none of the
    wide columns, so Catalyst prunes them from that branch.
    """
    keys, tiers = list(keys), list(tiers)
    offsets = None
    for depth in range(len(tiers), 0, -1):
        inner = keys + tiers[:depth]
        counts = df.groupBy(*inner).agg(F.count(F.lit(1)).alias("__n"))
        before = (
            Window.partitionBy(*(keys + tiers[: depth - 1]))
            .orderBy(tiers[depth - 1])
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        level = counts.select(*inner, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias(f"__o{depth}"))
        offsets = level if offsets is None else offsets.join(level, inner)
    start = sum((F.col(f"__o{d}") for d in range(1, len(tiers) + 1)), F.lit(0))
    offsets = offsets.select(*keys, *tiers, start.alias("__start"))
    if total is not None:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(total))
        offsets = offsets.join(sizes, keys)
    inside = Window.partitionBy(*keys, *tiers).orderBy(*order)
    placed = df.join(offsets, keys + tiers)
    return placed.withColumn(out, F.row_number().over(inside) + F.col("__start")).drop("__start")


def numbered_by_range(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, ranges: int | None = None) -> DataFrame:
    """1-based row number per key in ``order``, for keys of any size and orders of any distribution.

    Rows are dealt out by ranges of (keys, order), sorted there, and written; the number of rows of each key in the ranges
    before is added. There are as many ranges as a range holds 64 times as many rows: both grow with the square root. What one
    task sums up are the ranges of one key. Rows that are equal in ``order`` come in any order.
    """
    keys, order = list(keys), list(order)
    rows = write_through(df, "unnumbered")
    ranges = ranges or max(1, math.isqrt(rows.count() // 64))
    place = [F.col(c).asc_nulls_first() for c in (*keys, *order)]
    # Also rows that are equal in all of these are spread out.
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(ranges, *place, "__tie").sortWithinPartitions(*place, "__tie").drop("__tie")
    dealt = write_through(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33).alias("__part")
    held = dealt.groupBy(*keys, part).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1
    starts = held.select(*[F.col(k).alias(f"__{k}") for k in keys], "__part", shift.alias("__shift"))
    same = F.shiftright(dealt["__at"], 33) == starts["__part"]
    for k in keys:
        same = same & dealt[k].eqNullSafe(starts[f"__{k}"])
    placed = dealt.join(starts, same).withColumn(out, F.col("__at") + F.col("__shift"))
    return placed.select(*df.columns, out)


def ordered_text_of_any(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, separator: str, out: str, chunk: int = CHUNK
) -> DataFrame:
    """``ordered_text`` where no column of ``order`` grows evenly: the chunks of a hot key are cut by counting.

    Keys of more than ``chunk`` pieces are numbered (one look at the counts decides whether there are any) and joined
    ``chunk`` pieces at a time; all others in one step.
    """
    keys = list(keys)
    hot = write_through(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > chunk).drop("__n"), "hot_keys")
    if hot.isEmpty():
        return ordered_text(df, keys, order, text, separator, out)
    few = df.join(hot, keys, "left_anti")
    many = numbered_by_range(df.join(hot, keys, "left_semi"), keys, order, "__number")
    counted = ordered_text(many, keys, ["__number"], text, separator, out, F.floor((F.col("__number") - 1) / chunk))
    return ordered_text(few, keys, order, text, separator, out).unionByName(counted)
