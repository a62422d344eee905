"""Language identification by rank-order n-gram profiles.

A profile is the list of the most frequent n-grams (of one to three characters, words padded with a
space) of a language, by falling frequency. A document is ranked the same way, and its distance to a
language is the sum over its n-grams of how far out of place they are there; an n-gram that a profile
lacks counts as its full length. The nearest profile wins.

Counting for training is a map over batches (a few thousand n-grams per language and batch) and a sum
per n-gram; profiles are ``top`` rows per language. Predicting is a map over rows.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.text import free_names
from palisade.session import write_through

TOP = 300
#: Languages whose profiles are sent to the tasks at once; more are compared in several passes.
LANGUAGES_PER_PASS = 2000


def _class_of(*categories: str) -> str:
    """All characters of these Unicode categories as ranges of a regular expression."""
    marks = [unicodedata.category(chr(i))[0] in categories for i in range(sys.maxunicode + 1)] + [False]
    starts = [i for i, m in enumerate(marks) if m and not marks[i - 1]]
    return "".join(f"\\U{i:08x}-\\U{marks.index(False, i) - 1:08x}" for i in starts)


#: Letters and the marks that combine with them; digits, also superscripts, fractions and numerals, are none.
_NOT_LETTERS = re.compile(f"[^{_class_of('L', 'M')}]+")
#: The same for texts without any of the second kind, and several times faster.
_NOT_LATIN_LETTERS, _MARKS_AND_NUMERALS = re.compile(r"[\W\d_]+"), re.compile("[²³¹¼-¾\u0300-\U0010ffff]")
#: Characters are 21 bits wide, so three of them are one 63-bit number.
_BITS = np.int64(21)
#: Texts are counted in stretches of this many characters.
_STRETCH = 1 << 16


def letters(text: str) -> str:
    """Lower-cased words of letters, one space around each; empty where there is none."""
    low = text.lower()
    words = (_NOT_LETTERS if _MARKS_AND_NUMERALS.search(low) else _NOT_LATIN_LETTERS).sub(" ", low).strip(" ")
    return f" {words} " if words and any(map(str.isalpha, words)) else ""


def _codes(c: np.ndarray, n: int) -> np.ndarray:
    """One number for each n-gram that starts in the first ``n`` characters, but for lone spaces."""
    two = (c[:-1] << _BITS) | c[1:]
    three = (two[:-1] << _BITS) | c[2:]
    one = c[:n]
    return np.concatenate([one[one != 32], two[:n], three[:n]])


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes, counts = np.unique(_codes(c[: _STRETCH + 2], _STRETCH), return_counts=True)
    for at in range(_STRETCH, len(c), _STRETCH):
        k, n = np.unique(_codes(c[at : at + _STRETCH + 2], _STRETCH), return_counts=True)
        codes, inverse = np.unique(np.concatenate([codes, k]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([counts, n])).astype(np.int64)
    return codes, counts


def _most_frequent(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    return codes[np.lexsort((codes, -counts))[:top]]


def _train_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words := letters(text):
                by_lang.setdefault(lang, []).append(words[1:])
        for lang, texts in by_lang.items():
            codes, counts = _counts(" " + "".join(texts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"]
            )


def profiles(labelled: DataFrame, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``rank`` (from 0), ``gram``: the ``top`` most frequent n-grams of every language, ties by n-gram.

    Rows with a null text or language, or without a letter, teach nothing. An empty table gives an empty one.
    """
    rows = labelled.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_train_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Rank limits are applied before the shuffle as well, so no task gets a whole language.
    order = Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", (F.col("rank") - 1).alias("rank"), "gram")


class Model:
    """All profiles as sorted arrays."""

    def __init__(self, rows: Sequence[tuple[str, int, int]], top: int) -> None:
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        place = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([r[2] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for lang, rank, gram in rows:
            self.ranks[np.searchsorted(self.grams, gram), place[lang]] = rank

    def nearest(self, text: str | None) -> tuple[str, int, int, int] | None:
        """(language, its distance, that of the next one or -1, n-grams): the nearest; ties: the first by name."""
        words = letters(text or "")
        if not words or not self.langs:
            return None
        own = _most_frequent(*_counts(words), self.top)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(own))[:, None])
        away[~known[:, None] | (ranks < 0)] = self.top
        distance = away.sum(axis=0)
        best = int(distance.argmin())
        second = int(np.partition(distance, 1)[1]) if len(distance) > 1 else -1
        return self.langs[best], int(distance[best]), second, len(own)


def _nearest(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            found = [model.nearest(t) or (None,) * 4 for t in batch.column(3).to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=_NEAREST.replace(",", "").split()[::2])

    return run


_NEAREST = "row bigint, doc_id bigint, held_out boolean, near string, distance bigint, second bigint, grams bigint"


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text, modulo 3, is 1. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def identify(
    docs: DataFrame, top: int = TOP, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    languages_per_pass: int = LANGUAGES_PER_PASS,
) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` for every row of ``docs``, learned from those not held out.

    A null text or one without a letter is ``und`` with score 0; so is everything where there is no
    labelled text to learn from. Whole texts are read; repeated rows repeat their answer.
    """
    (out,) = free_names(docs, "__held_out")
    rows = docs.withColumn(out, held_out(F.col(f"`{doc_id}`")))
    learned = write_through(profiles(rows.filter(~F.col(out)), top, text, lang), "profiles")
    names = [r["lang"] for r in learned.filter("rank = 0").select("lang").orderBy("lang").collect()]  # the labels, once each
    asked = rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.col(out).alias("held_out"), F.col(f"`{text}`").alias("text")
    )
    found = None
    for at in range(0, max(1, len(names)), languages_per_pass):
        some = names[at : at + languages_per_pass]
        # ``top`` rows per language, a model whose size does not depend on the number of documents.
        model = learned.filter(F.col("lang").between(some[0], some[-1])).collect() if some else []
        part = asked.mapInArrow(_nearest(Model([(r["lang"], r["rank"], r["gram"]) for r in model], top)), _NEAREST)
        found = part if found is None else found.unionByName(part)
    if len(names) > languages_per_pass:
        # Two distances per pass; the first two of all are the answer.
        both = F.array_sort(F.flatten(F.collect_list(F.array("distance", F.when(F.col("second") >= 0, F.col("second"))))))
        found = found.groupBy("row", "doc_id", "held_out").agg(
            F.min(F.struct("distance", "near")).alias("best"), F.get(both, F.lit(1)).alias("second"), F.max("grams").alias("grams")
        ).select("doc_id", "held_out", "best.near", "best.distance", "second", "grams")
    # The lead over the next language; with a single language, how much of its profile is there.
    far, one = F.col("second"), 1 - F.col("distance") / (top * F.col("grams"))
    score = F.when(F.col("near").isNull(), 0.0).when(far < 0, one).when(far == 0, 0.0).otherwise((far - F.col("distance")) / far)
    return found.select("doc_id", "held_out", F.coalesce("near", F.lit("und")).alias("lang_pred"), score.cast("double").alias("score"))
