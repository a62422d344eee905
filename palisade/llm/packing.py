"""Vector best-fit packing of token sequences.

A piece of a document asks for three things of the sequence it goes into: tokens, one place among
its documents, and attention cost (its length squared). All three follow from the length, so pieces
of one length are interchangeable, and a corpus is, for packing, a histogram of at most ``capacity``
counts. Best-fit decreasing runs on that histogram: lengths in falling order, and for each the open
sequence that it fits under every constraint and whose residual, after it, has the smallest weighted
norm (or the largest weighted dot product with the piece before it). Sequences in the same state are
handled as ranges, so the plan's size depends on the capacity, not on the corpus.

The pieces themselves are only numbered within their length (counts per bucket, then ranks inside
buckets) and look their place up in the plan.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.llm.tokens import encoder
from palisade.session import write_through

CAPACITY, END = 2048, 0
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, deal int"


@dataclass(frozen=True)
class Limits:
    """What a sequence can hold. Without other limits only tokens bind."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.25)
    select: str = "norm"  # or "dot"

    def vector(self) -> tuple[int, int, int]:
        return (
            self.tokens, self.tokens if self.documents is None else self.documents,
            self.tokens**2 if self.attention is None else self.attention,
        )


def _cut(capacity: int, end_id: int, tokenizer: str | None, ranks: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, rows = encoder(tokenizer, ranks), 0
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(encode.ids(text or ""), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                for piece, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
                    rows += 1
                    deal = zlib.crc32(b"%d" % rows) >> 1
                    for column, value in zip(out, (doc_id, piece, i, j - i, zlib.crc32(ids[i:j].tobytes()), deal)):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "deal"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, end_id: int = END, tokenizer: str | None = None, ranks: str | None = None,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Token pieces of at most ``capacity``: a longer document is cut, its first piece being the shorter one.

    A null text is an empty one and gives one piece, the end id alone. Rows are cut one by one:
    repeated rows and null doc_ids stay as they are, an empty table gives an empty one.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(_cut(capacity, end_id, tokenizer, ranks), _PIECES)


def plan(histogram: dict[int, int], limits: Limits) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, in_each, first_sequence, offset), by length and rank.

    Ranks from first_rank on go ``in_each`` to a sequence, from first_sequence on, from ``offset`` on.
    """
    empty = limits.vector()
    caps, weights = np.array(empty, float), np.array(limits.weights)
    open_: dict[tuple[int, ...], list[tuple[int, int]]] = {}  # residual vector: ranges (first sequence, number)
    rows, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        item, left, rank = (length, 1, length * length), histogram[length], 0
        if any(i > c for i, c in zip(item, caps)):
            raise ValueError(f"a piece of {length} tokens fits no sequence")

        def put(state: tuple[int, ...], first: int, bins: int, each: int) -> None:
            nonlocal left, rank
            rows.append((length, rank, each, first, limits.tokens - state[0]))
            open_.setdefault(tuple(s - each * i for s, i in zip(state, item)), []).append((first, bins))
            rank, left = rank + bins * each, left - bins * each

        for state in _by_fit(list(open_), item, caps, weights, limits.select):
            if not left:
                break
            ranges, each = open_.pop(state), min(s // i for s, i in zip(state, item))
            while ranges and left:
                first, n = ranges.pop()
                if full := min(n, left // each):
                    put(state, first, full, each)
                if full < n and left:  # the last few go into one more
                    put(state, first + full, 1, left)
                    full += 1
                if full < n:
                    ranges.append((first + full, n - full))
            if ranges:
                open_.setdefault(state, []).extend(ranges)
        if left:
            each = min(s // i for s, i in zip(empty, item))
            if full := left // each:
                put(empty, sequences, full, each)
                sequences += full
            if left:
                put(empty, sequences, 1, left)
                sequences += 1
    return sorted(rows)


def _by_fit(states: list, item: tuple[int, ...], caps: np.ndarray, weights: np.ndarray, select: str) -> list:
    """The states that ``item`` fits under every constraint, best first."""
    if not states:
        return []
    residual = np.array(states, float)
    index = np.flatnonzero((residual >= item).all(axis=1))
    r = residual[index]
    if select == "norm":
        score = (weights * ((r - item) / caps) ** 2).sum(axis=1)
    else:
        score = -(weights * (r / caps) * (np.array(item) / caps)).sum(axis=1)
    return [states[i] for i in index[np.lexsort((*r.T, score))]]


def _ranked(rows: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """``rank`` from 0 within each length, without a window over all pieces of a length."""
    spark = rows.sparkSession
    # Buckets of at least 256 rows; their number and their size grow alike.
    buckets = [(k, math.ceil(n / max(256, math.isqrt(n)))) for k, n in histogram.items()]
    per = spark.createDataFrame(buckets or [(0, 1)], "length bigint, buckets bigint")
    rows = rows.join(F.broadcast(per), "length").withColumn("bucket", F.col("deal") % F.col("buckets")).drop("buckets")
    counts = rows.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "deal")
    return rows.withColumn("inside", F.row_number().over(inside) - 1).join(starts, ["length", "bucket"]).withColumn(
        "rank", F.col("first") + F.col("inside")
    ).drop("first", "inside", "bucket", "deal")


def _placed(table: np.ndarray):
    lengths, ranks, each, sequences, offsets = (table[:, i].copy() for i in range(5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            # By bisection: the last row of the plan of that length that starts at or before the rank.
            at, high = np.searchsorted(lengths, length, "left"), np.searchsorted(lengths, length, "right")
            step = 1 << int((high - at).max(initial=1)).bit_length()
            while step:
                there = np.minimum(at + step, len(ranks) - 1)
                at = np.where((at + step < high) & (ranks[there] <= rank), there, at)
                step >>= 1
            past, k = rank - ranks[at], each[at]
            names = [c for c in batch.schema.names if c != "rank"]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array(sequences[at] + past // k), pa.array(offsets[at] + past % k * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return run


def pack(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``.

    Sequences are filled from offset 0 without a gap. Pieces of equal length are ordered by a number
    dealt when they were cut, then by doc_id and piece; which of two equal pieces goes where is open.
    """
    rows = write_through(rows, "pieces")
    # At most one count per length up to the capacity.
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.array(plan(histogram, limits), np.int64).reshape(-1, 5)
    kept = [f for f in rows.schema.fields if f.name != "deal"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    ranked = _ranked(rows, histogram).select(*[f.name for f in kept], "rank")
    return ranked.mapInArrow(_placed(table), schema)
