"""Benchmark passages in training documents, found by winnowing.

A *window* is ``span`` consecutive words of an item (all words of a shorter item). Of the hashes of all ``gram``-word grams,
winnowing keeps the smallest of every ``span - gram + 1`` neighbours, the last one of equals. A window holds exactly that many
grams, so wherever it occurs, the same gram of it is kept on both sides: every shared span of ``span`` words shares a kept
fingerprint. Items of fewer words have windows of their own length, of which every gram is a fingerprint.

Documents are read once, narrowly: each keeps those fingerprints that a bit filter of the benchmark lets through, with the words
around them. The filter has a fixed largest size and only saves work. What is left is joined with the benchmark's
fingerprints, extended to the windows that hold it, and these are joined with the benchmark's windows word by word. Items of
the same words are one class until the end.

Defined results: null and empty texts have no words, no hits and no items. Repeated documents are rows of their own. Items
are told apart by id: equal ids are one item, a null id is an item shown as ``null``. Very long texts are hashed in
segments. Of both tables only id and text are read, so other columns may have any name. Without documents the result is
empty; without a benchmark nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palisade.llm.shingles import WordHashes
from palisade.session import write_through

SPAN, GRAM = 10, 5
#: Bits of the filter per fingerprint of the benchmark, and in all: 16 MB.
FILTER_BITS, FILTER_MOST = 256, 1 << 27
#: Rows of the benchmark's tables up to which they are sent to all tasks.
BROADCAST_ROWS = 200_000
_SEGMENT = 1 << 22
_PRIME, _PRIME2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: ASCII letters and digits and all bytes of other signs are kept, A-Z lower-cased; the rest are spaces.
_SIGNS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())

_HITS = "array<struct<need int, print bigint, start bigint, context string>>"


def plain(text: str | None) -> bytes:
    """The text with one space or more between its words and nothing else."""
    return (text or "").encode().translate(_SIGNS)


def word_hashes(data: bytes, known: WordHashes) -> np.ndarray:
    out, at = [np.empty(0, np.uint64)], 0
    while at < len(data):
        end = data.find(b" ", at + _SEGMENT)
        words = data[at : end if end >= 0 else len(data)].split()
        out.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
        at = end if end >= 0 else len(data)
    return np.concatenate(out)


def grams(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mixed = hashes[:n] + np.uint64(width)
    for j in range(1, width):
        mixed *= _PRIME
        mixed ^= mixed >> np.uint64(29)
        mixed += hashes[j : j + n]
    mixed *= _PRIME2
    return mixed ^ (mixed >> np.uint64(32))


def kept(prints: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest (the last of equals) of every ``window`` neighbours, ascending."""
    n = len(prints) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, at = prints[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        lower = prints[j : j + n] <= best
        np.copyto(best, prints[j : j + n], where=lower)
        at[lower] = j
    return np.unique(at + np.arange(n))


def fingerprints(hashes: np.ndarray, span: int, gram: int, lengths: Sequence[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(need, words of the gram, places, hashes): winnowed for ``span``, all of them for shorter ``lengths``."""
    prints = grams(hashes, gram)
    places = kept(prints, span - gram + 1)
    yield span, gram, places, prints[places]
    for length in lengths:
        prints = grams(hashes, length)
        yield length, length, np.arange(len(prints)), prints


def _benchmark(span: int, gram: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct windows and fingerprints of each text."""
    known = WordHashes()
    for batch in batches:
        out = {"class": [], "need": [], "print": [], "window": []}
        for name, text in zip(batch["class"].to_pylist(), batch["words"].to_pylist()):
            words = text.split(" ")
            need = min(span, len(words))
            hashes = word_hashes(text.encode(), known)
            found = next(p for n, _, _, p in fingerprints(hashes, span, gram, [] if need == span else [need]) if n == need)
            marks = [(int(p), None) for p in np.unique(found).view(np.int64)]
            windows = [(None, w) for w in dict.fromkeys(" ".join(words[i : i + need]) for i in range(len(words) - need + 1))]
            for mark, window in marks + windows:
                for column, value in zip(out.values(), (name, need, mark, window)):
                    column.append(value)
        yield pa.RecordBatch.from_pydict(
            {k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.string(), pa.int32(), pa.int64(), pa.string()))}
        )


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [" ".join(plain(t).decode().split(" ")).strip() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"item": batch["item"], "words": [" ".join(filter(None, w.split(" "))) for w in words]})


def _places(print_: Column, bits: int) -> Column:
    """The leading bits of a fingerprint, as a place in the filter."""
    return F.shiftrightunsigned(print_, 64 - bits)


def bit_filter(prints: DataFrame, count: int) -> np.ndarray:
    """Bits for the fingerprints, as many as ``count`` of them need, FILTER_MOST at most."""
    bits = min(max(16, (count * FILTER_BITS).bit_length()), FILTER_MOST.bit_length() - 1)
    place = _places(F.col("print"), bits)
    one = F.expr("shiftleft(1L, cast(place & 63 as int))")
    words = prints.select(place.alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(one).alias("word"))
    rows = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["at"].to_numpy()] = rows["word"].to_numpy().view(np.uint64)
    return out


def _may_hold(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    place = prints >> np.uint64(64 - (len(bits).bit_length() - 1 + 6))
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _marked(span: int, gram: int, lengths: Sequence[int], filter_, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_words, hits): fingerprints that pass the filter, each with the words of all windows that hold it."""
    known, bits = WordHashes(), filter_.value
    for batch in batches:
        n_words, sizes, flat = [], [0], {"need": [], "print": [], "start": [], "context": []}
        for text in batch["text"].to_pylist():
            data = plain(text)
            hashes = word_hashes(data, known)
            n_words.append(len(hashes))
            edges = None
            for need, width, places, prints in fingerprints(hashes, span, gram, lengths):
                hit = np.flatnonzero(_may_hold(bits, prints))
                if not len(hit):
                    continue
                if edges is None:
                    edges = np.flatnonzero(np.diff(np.frombuffer(data, np.uint8) != 32, prepend=False, append=False))
                first = np.maximum(places[hit] - (need - width), 0)
                last = np.minimum(places[hit] + need, len(hashes))
                flat["need"].append(np.full(len(hit), need, np.int32))
                flat["print"].append(prints[hit].view(np.int64))
                flat["start"].append(first)
                spans = zip(edges[2 * first].tolist(), edges[2 * last - 1].tolist())
                flat["context"] += [b" ".join(data[i:j].split()).decode() for i, j in spans]
            sizes.append(len(flat["context"]))
        kinds = {"need": np.int32, "print": np.int64, "start": np.int64}
        columns = [pa.array(np.concatenate([np.empty(0, t), *flat[k]]).astype(t)) for k, t in kinds.items()]
        hits = pa.StructArray.from_arrays([*columns, pa.array(flat["context"], pa.string())], list(flat))
        yield pa.RecordBatch.from_pydict({
            "row": batch["row"], "doc_id": batch["doc_id"], "n_words": pa.array(n_words, pa.int64()),
            "hits": pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), hits),
        })


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS,
    doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) per row: words inside a window, ids of items as text, sorted, and
    the windows found as stretches [start, end) of words, sorted."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text"))
    items = items.mapInArrow(_worded, "item string, words string").filter("words <> ''")
    items = write_through(items.withColumn("class", F.sha2("words", 256)), "items")
    parts = items.select("class", "words").dropDuplicates(["class"])
    parts = parts.mapInArrow(lambda b: _benchmark(span, gram, b), "class string, need int, print bigint, window string")
    parts = write_through(parts, "benchmark")
    prints = parts.filter("print is not null").select("need", "print").distinct()
    windows = parts.filter("window is not null").select("window", "class")
    counted = parts.agg(F.count("print").alias("prints"), F.count("window").alias("windows"), F.collect_set("need").alias("needs")).first()
    lengths = sorted(n for n in counted["needs"] if n < span)  # of ``span`` values at most
    few = lambda frame, n: F.broadcast(frame) if n <= broadcast_rows else frame

    bits = spark.sparkContext.broadcast(bit_filter(prints, counted["prints"]))
    given = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = f"row bigint, doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words bigint, hits {_HITS}"
    marked = write_through(given.mapInArrow(lambda b: _marked(span, gram, lengths, bits, b), kind), "marked")

    met = marked.select("row", F.inline("hits")).join(few(prints, counted["prints"]), ["need", "print"], "left_semi")
    words = F.split("context", " ")
    each = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("need") + 1), lambda i: F.array_join(F.slice("words", i, F.col("need")), " "))
    met = met.select("row", "need", "start", words.alias("words")).filter(F.size("words") >= F.col("need"))
    met = met.select("row", "need", "start", F.posexplode(each).alias("ahead", "window"))
    met = met.join(few(windows.select("window").distinct(), counted["windows"]), "window", "left_semi")
    met = write_through(met.select("row", (F.col("start") + F.col("ahead")).alias("start"), "need", "window"), "windows_met")

    ends = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("need")).alias("end"))))
    spans = met.groupBy("row").agg(ends.alias("spans"))
    held = met.select("row", "window").distinct().join(few(windows, counted["windows"]), "window").select("row", "class").distinct()
    held = held.join(items.select("class", "item"), "class").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    none = {"spans": F.lit(None).cast(spans.schema["spans"].dataType), "items": F.lit(None).cast("array<string>")}
    clean = marked.filter(F.size("hits") == 0).withColumns(none).select("doc_id", "n_words", "spans", "items")
    doubted = marked.filter(F.size("hits") > 0).join(spans, "row", "left").join(held, "row", "left")
    rows = clean.unionByName(doubted.select("doc_id", "n_words", "spans", "items"))
    return rows.select(
        "doc_id", "n_words", F.coalesce(_covered("spans"), F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans"),
    )


def _covered(spans: str) -> Column:
    """Words inside any of the sorted stretches."""
    zero = F.lit(0).cast("bigint")

    def add(done: Column, s: Column) -> Column:
        new = F.greatest(s["end"] - F.greatest(s["start"], done["reach"]), zero)
        return F.struct((done["words"] + new).alias("words"), F.greatest(done["reach"], s["end"]).alias("reach"))

    return F.aggregate(spans, F.struct(zero.alias("words"), zero.alias("reach")), add, lambda done: done["words"])
