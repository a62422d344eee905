"""Benchmark passages against a search of every window in every document."""

import random
import re

import numpy as np
import pytest

from palisade.llm import winnowing

DOCS = "doc_id bigint, text string, row bigint, window string, need int"
ITEMS = "item_id bigint, text string, class string, print bigint"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, hit, met = words_of(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    met |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), tuple(sorted(met))))
    return sorted(out, key=repr)


def found(spark, docs, items, **more):
    docs = spark.createDataFrame([(*d, 1, "x", 2) for d in docs], DOCS).repartition(3)
    items = spark.createDataFrame([(*i, "x", 3) for i in items], ITEMS)
    rows = winnowing.decontaminate(docs, items, **more).collect()
    for r in rows:
        inside = {k for s in r.spans for k in range(s.start, s.end)}
        assert len(inside) == r.n_hit and list(r.spans) == sorted(r.spans)
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in rows), key=repr)


def corpus(seed, letters):
    """Few different words, so that windows meet by chance, begin anew and repeat."""
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choices(letters, k=n))
    items = [(i, text(rng.choice([1, 3, 9, 10, 11, 14, 30]))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = rng.choice(items)[1].split(" ")
            parts += [" ".join(w[rng.randint(0, 3) :][: rng.randint(1, 40)]), text(rng.randint(0, 15))]
        docs.append((i, " ".join(parts)))
    return docs, items


ODD_DOCS = [
    (1, None), (2, ""), (3, " \t!?"), (4, "One TWO three four five six seven eight nine ten"), (4, "One TWO three four five six seven eight nine ten"),
    (None, "zero one, two; three (four) five-six seven eight nine ten eleven"), (5, "ÉTÉ été naïve 漢字 one two three four five six"),
    (6, "filler " * 30_000 + "one two three four five six seven eight nine ten" + " filler" * 1000), (7, "short item"), (8, "a short item b short item"),
    (9, "nine words are here and not a single more"), (10, "x" * 100_000),
]
ODD_ITEMS = [
    (1, "one two three four five six seven eight nine ten"), (2, "One. Two. Three. Four. Five. Six. Seven. Eight. Nine. Ten."), (2, "short  ITEM"),
    (3, None), (4, ""), (5, "..."), (None, "漢字"), (6, "nine words are here and not a single more"), (7, "été NAÏVE 漢字"),
]


@pytest.mark.parametrize("bound", [0, 10**6])
def test_odd_rows(spark, bound):
    assert found(spark, ODD_DOCS, ODD_ITEMS, broadcast_rows=bound) == by_hand(ODD_DOCS, ODD_ITEMS)


@pytest.mark.parametrize("seed, letters", [(1, "a b c d e f g".split()), (2, "ab"), (3, [f"w{i}" for i in range(200)])])
def test_chance_meetings(spark, seed, letters):
    docs, items = corpus(seed, letters)
    assert found(spark, docs, items) == by_hand(docs, items)


def test_a_passage_of_many_documents_and_items(spark):
    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(i, f"{rng.random()} {passage} {rng.random()}" if i % 3 else f"clean {i}") for i in range(600)]
    items = [(i, passage if i % 2 else f"item {i} {passage}") for i in range(40)]
    assert found(spark, docs, items, broadcast_rows=0) == by_hand(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(5, "a b c".split())
    assert found(spark, [], items) == []
    assert found(spark, docs, []) == by_hand(docs, [])
    assert found(spark, docs, [(1, ""), (2, None)]) == by_hand(docs, [])


def test_every_long_shared_span_shares_a_fingerprint():
    rng = np.random.default_rng(6)
    for few in (2, 3, 10**6):
        a = rng.integers(0, few, 400).astype(np.uint64)
        b = np.concatenate([rng.integers(0, few, 77).astype(np.uint64), a[100:110], rng.integers(0, few, 50).astype(np.uint64)])
        (_, _, at_a, print_a), (_, _, at_b, print_b) = (next(winnowing.fingerprints(x, 10, 5, [])) for x in (a, b))
        in_a, in_b = {(int(p), int(k) - 100) for p, k in zip(print_a, at_a)}, {(int(p), int(k) - 77) for p, k in zip(print_b, at_b)}
        assert {x for x in in_a if 0 <= x[1] <= 5} & {x for x in in_b if 0 <= x[1] <= 5}


def test_segments_do_not_change_the_words(monkeypatch):
    known = winnowing.WordHashes()
    data = winnowing.plain("one  two three " * 500 + "x" * 5000 + " end ")
    want = winnowing.word_hashes(data, known)
    monkeypatch.setattr(winnowing, "_SEGMENT", 7)
    assert (winnowing.word_hashes(data, known) == want).all() and len(want) == 1502
