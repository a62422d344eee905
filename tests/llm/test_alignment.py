"""Groups and links of two tokenizers against a pair-by-pair count over whole texts."""

import hashlib
import re
import random
from collections import Counter, defaultdict

import pytest

from palisade.llm import alignment
from palisade.llm.corpus_queries import op13

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spell():
    return alignment.spellings()


def by_pairs(s, text):
    """(n_a, n_b, n_groups, groups, links) of a whole text, token by token."""
    if not text:
        return 0, 0, 0, "", Counter()
    a = s._a.full.encode(" " + text, add_special_tokens=False).ids
    b = s._b.encode(text)
    if not (b"".join(s.bytes_a[i] for i in a) == b"".join(s.bytes_b[i] for i in b) == (" " + text).encode()):
        return 0, 0, 0, "", Counter()

    def spans(ids, known):
        at, out = 0, []
        for i in ids:
            out.append((at, at := at + len(known[i])))
        return out

    in_a, in_b = spans(a, s.bytes_a), spans(b, s.bytes_b)
    cuts = sorted({e for _, e in in_a} & {e for _, e in in_b})
    groups = [
        ",".join(str(i) for i, (_, e) in zip(a, in_a) if low < e <= high) + "|" + ",".join(str(i) for i, (_, e) in zip(b, in_b) if low < e <= high)
        for low, high in zip([0, *cuts], cuts)
    ]
    links = Counter((x, y) for x, (i, j) in zip(a, in_a) for y, (k, m) in zip(b, in_b) if max(i, k) < min(j, m))
    return len(a), len(b), len(cuts), ";".join(groups), links


def texts():
    rng = random.Random(13)
    signs = ["a", "b ", " ", "the ", "Straße ", "漢", "\n", "12", "é", " x", "﷽", " ", "'s ", "　y"]
    odd = [
        "", "x", " ", "   ", "hello world", "  a  b\n c ▁x", "ｆｉ 漢字 🙂 <|endoftext|> <s> naïve Ünïcode", "\n\n", "नमस्ते दुनिया कैसे हैं आप",
        "it's they'll 1234 5678 " * 5, "noblanksinthisatall" * 20, "\x00\x1f \x7f",
    ]
    return odd + ["".join(rng.choices(signs, k=rng.randint(1, 120))) for _ in range(50)]


@pytest.mark.parametrize("chunk", [1, 7, 64, 10**9])
def test_fragments_in_any_order_give_the_whole_text(spell, chunk):
    rng = random.Random(chunk)
    for text in texts():
        if not text:
            continue
        data = b" " + text.encode()
        parts = [alignment.fragment(spell, stretch, at, low, high) for at, low, high, stretch in alignment.ranges(data, chunk)]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            j = i + rng.randint(2, 4)
            parts[i:j] = [alignment.joined(spell, parts[i:j])]
        whole = alignment.finished(spell, parts[0])
        links = {(int(k >> 32), int(k & 0xFFFFFFFF)): int(n) for k, n in zip(whole.keys, whole.times)}
        assert (whole.n_a, whole.n_b, whole.n_groups, whole.groups, links) == by_pairs(spell, text), text


def test_joining_is_associative_and_has_a_neutral_element(spell):
    data = b" " + ("the quick brown Straße 漢字 fox " * 30).encode()
    a, b, c = (alignment.fragment(spell, s, at, low, high) for at, low, high, s in list(alignment.ranges(data, 50))[:3])
    same = lambda x, y: all(repr(getattr(x, k)) == repr(getattr(y, k)) for k in x.__dataclass_fields__)
    join = lambda *parts: alignment.joined(spell, list(parts))
    assert same(join(join(a, b), c), join(a, join(b, c))) and same(join(a, b, c), join(a, join(b, c)))
    assert same(join(alignment.Fragment(), a), join(a)) and same(join(a, alignment.Fragment()), join(a))


def test_no_entry_reaches_over_a_safe_place(spell):
    for known in (spell.bytes_a, spell.bytes_b):
        assert not [x for x in known if re.search(r"\S \S", x.decode(errors="replace"))]


def test_a_stretch_without_a_safe_place_is_one_range():
    data = b" " + b"x" * 1000 + b" y z " + b"w" * 50
    parts = list(alignment.ranges(data, 16))
    assert [p[1] for p in parts][0] == 0 and parts[0][2] >= 1001
    assert [p[2] for p in parts[:-1]] == [p[1] for p in parts[1:]] and parts[-1][2] == len(data)
    assert sum(len(p[3]) for p in parts) < 3 * len(data)


def test_long_texts_are_put_together_by_the_tree(spark, spell):
    rows = [(i, t) for i, t in enumerate([*texts(), "many words in one very long text, Straße " * 300, None])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r for r in alignment.aligned(docs, chunk=100, fan=2).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        r = found[i]
        links = Counter({(x.a, x.b): x.n for x in r.links})
        assert (r.n_a, r.n_b, r.n_groups, r.groups, links) == by_pairs(spell, text), text


@pytest.mark.parametrize("bound", [0, 10**6])
def test_scores_count_documents_and_not_occurrences(spark, spell, bound):
    rows = [(1, "a b a b"), (2, "a b"), (2, "a b"), (None, "Straße Straße"), (3, None), (4, ""), (5, "▁"), (6, "a c" * 40)]
    rows = [(i, t, 7, "x") for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row bigint, links string")
    found = alignment.aligned(docs, chunk=30)
    scores = {r.row: r for r in alignment.link_scores(found, alignment.pair_counts(found), bound).collect()}
    held, links = Counter(), [by_pairs(spell, r[1])[4] for r in rows]
    for x in links:
        held.update(x.keys())
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    want = Counter()
    for (doc_id, *_), x in zip(rows, links):
        want[doc_id, sum(n for p, n in x.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in x.items())] += 1
    got = Counter((r.doc_id, getattr(scores.get(r.row), "n_best", 0), getattr(scores.get(r.row), "count_sum", 0)) for r in found.collect())
    assert got == want


def test_query_against_brute_force(spark, spell):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    known = {r.doc_id: by_pairs(spell, r.text) for r in docs}
    held = Counter(p for x in known.values() for p in x[4])
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    rows = op13(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n_a, n_b, n_groups, groups, links = known[r.doc_id]
        sha = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (n_a, n_b, n_groups, sum(links.values()), sha)
        assert r.n_best == sum(n for p, n in links.items() if held[p] == best[p[0]])
        assert r.count_sum == sum(n * held[p] for p, n in links.items())


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.aligned(none).count() == 0
