"""Operators over whole tables, held against brute force or what must hold of every result."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import mixing, near_dup, packing, preference, ring, topk
from palisade.llm.components import components
from palisade.llm.shingles import minima, mismatches, sketch
from palisade.llm.tokens import Encoder
from tests.llm.conftest import ODD

# --- packing -----------------------------------------------------------------------------------


def whole(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_tokenizer(spark):
    import public_tokenizers as public

    fast = Encoder(public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"))
    texts = [t for _, t, _, _ in ODD if t] + ["a  b\n\n c", "it's  <|endoftext|> x", "\x1c\x1d a", "don't  stop\t\n", "ɐ漢 字", " \n \n", "x" * 5000]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text in texts:
        assert fast.ids(text).tolist() == whole(text)[:-1], text[:50]


@pytest.mark.parametrize("limits", [packing.Limits(tokens=64), packing.Limits(64, 3, 2500), packing.Limits(64, 5, 4096, select="dot")])
def test_packing_obeys_every_limit(odd_docs, limits):
    cut = packing.pieces(odd_docs, capacity=50)
    rows = packing.pack(cut, limits).collect()
    ids = defaultdict(list)
    for d, t, _, _ in ODD:
        ids[d].append(whole(t))
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append(r)
    tokens, documents, attention = limits.vector()
    for held in bins.values():
        held.sort(key=lambda r: r.offset)
        assert [r.offset for r in held] == [sum(x.length for x in held[:i]) for i in range(len(held))]
        assert sum(r.length for r in held) <= tokens and len(held) <= documents and sum(r.length**2 for r in held) <= attention


def best_fit(lengths, limits):
    """One piece after the other, into the open sequence with the smallest residual norm."""
    caps, bins = np.array(limits.vector(), float), []
    for n in sorted(lengths, reverse=True):
        item = np.array([n, 1, n * n], float)
        fits = [b for b in bins if (b >= item).all()]
        if fits:
            best = min(fits, key=lambda b: (np.array(limits.weights) * ((b - item) / caps) ** 2).sum())
            best -= item
        else:
            bins.append(caps - item)
    return len(bins)


def test_plan_is_as_good_as_one_piece_at_a_time():
    rng = np.random.default_rng(4)
    for limits in (packing.Limits(128), packing.Limits(128, 4, 9000)):
        lengths = np.minimum(rng.geometric(0.03, 1500), 94)
        rows = packing.plan(dict(Counter(lengths.tolist())), limits)
        used = max(first for _, _, _, first, _ in rows) + 1
        assert used <= best_fit(lengths, limits) * 1.01 + 1
    with pytest.raises(ValueError):
        packing.plan({200: 1}, packing.Limits(128))
    assert packing.plan({}, packing.Limits()) == []


def test_packing_an_empty_table_and_a_hot_length(no_docs, make_docs):
    assert packing.pack(packing.pieces(no_docs)).count() == 0
    rows = packing.pack(packing.pieces(make_docs([(7, "same text here", "s", "en")] * 3000)), packing.Limits(tokens=16)).collect()
    n = len(whole("same text here"))
    places = {(r.sequence_id, r.offset) for r in rows}
    assert len(places) == 3000 and len({s for s, _ in places}) == math.ceil(3000 / (16 // n))


# --- preferences --------------------------------------------------------------------------------------


def shown(turns):
    out, spans = "", []
    for _, role, text in turns:
        head = f"<|im_start|>{role or ''}\n"
        out += head
        start = len(out)
        out += f"{text or ''}<|im_end|>\n"
        if role == "assistant":
            spans.append(f"{start}:{len(out)}")
    return out, ",".join(spans)


def test_preferences_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(preference, "TURNS_PER_CHUNK", 4)
    rng, rows, pairs = random.Random(2), [], {}
    for p in range(40):
        shared = [(i, rng.choice(["user", "assistant", "system"]), rng.choice(["hi", "", None, "été 🙂"])) for i in range(rng.randint(0, 11))]
        tail = lambda: [(len(shared) + i, rng.choice(["user", "assistant", None]), rng.choice("ab")) for i in range(rng.randint(0, 9))]
        sides = {"chosen": shared + tail(), "rejected": shared + tail()}
        if p % 9 == 0:
            sides["rejected"] = []
        pairs[p] = sides
        rows += [(p, s, t, r, x, 1) for s, turns in sides.items() for t, r, x in turns]
    rows += [(None, "chosen", 0, "user", "x", 1), (1, "other", 0, "user", "x", 1)]
    rng.shuffle(rows)
    turns = spark.createDataFrame(rows, "pair_id bigint, side string, turn bigint, role string, text string, prompt int")
    got = {r.pair_id: r for r in preference.preferences(turns).collect()}
    for p, sides in pairs.items():
        c, r = sides["chosen"], sides["rejected"]
        if not c and not r:
            assert p not in got
            continue
        k = next((i for i, (a, b) in enumerate(zip(c, r)) if a != b), min(len(c), len(r)))
        g = got[p]
        assert (g.prompt_turns, g.prompt) == (k, shown(c[:k])[0])
        assert (g.chosen, g.chosen_mask) == shown(c[k:]) and (g.rejected, g.rejected_mask) == shown(r[k:])
        assert (g.chosen_turns, g.rejected_turns) == (len(c) - k, len(r) - k)
    assert preference.preferences(turns.limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------------------------


def water(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        above = {s for s in free if w[s] * level >= cap * sizes[s]}
        if not above:
            return out | {s: w[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in above}
        free -= above
    return out


def test_mixing_hits_its_targets(make_docs):
    rng = random.Random(8)
    sources = ["b", "a", "", None, "é", "Z"]
    rows = [(i, " ".join("w" * rng.randint(1, 9) for _ in range(int(rng.paretovariate(1.2)) % 400)), rng.choices(sources, [9, 3, 3, 3, 1, 1])[0], "en") for i in range(3000)]
    rows += [(5000, "one two three four five", "a", "en")] * 30 + [(None, None, "b", "en"), (None, "null id", "b", "en")]
    docs = make_docs(rows)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in got)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    want = water(sizes)
    largest = max(r.size for r in got)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest and len({r.copies for r in got if r.source == s and r.size}) <= 2
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns and mix.count() == sum(r.copies for r in got if r.size) + mix.filter("text is null").count()
    assert Counter(r.doc_id for r in mix.collect() if r.text) == Counter({d: n for d, n in _copies(got).items() if n})


def _copies(got):
    out = Counter()
    for r in got:
        if r.size:
            out[r.doc_id] += r.copies
    return out


def test_mixing_odd_rows(odd_docs, no_docs):
    got = mixing.mixed(odd_docs).collect()
    assert len(got) == len(ODD) and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_rounding_leaves_expectations_alone(spark):
    items = spark.createDataFrame([("s", i, i, 1 + i % 7, 1) for i in range(60)], "source string, id bigint, h bigint, size bigint, times bigint")
    total = sum(1 + i % 7 for i in range(60))
    targets = spark.createDataFrame([("s", total, 0.4 * total)], "source string, source_size bigint, target double")
    n = Counter()
    for seed in range(12):
        rows = mixing.copies(items, targets, seed=1000 * seed).collect()
        assert abs(sum(r.size * r.copies for r in rows) - 0.4 * total) <= 7
        n.update(r.id for r in rows if r.copies)
    assert abs(sum(n.values()) / (12 * 60) - 0.4) < 0.06 and max(n.values()) < 12


# --- near-duplicates ----------------------------------------------------------------------------------


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_copies(rng, n):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for base in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(3, 90))]
        for _ in range(rng.choice([1, 1, 2, 5, 14])):
            copy = list(text)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy).upper() if rng.random() < 0.1 else " ".join(copy))
    rng.shuffle(rows)
    return rows


def components_of(sets, threshold):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_against_all_pairs(make_docs, odd_docs, monkeypatch, small):
    if small:  # every path: nodes that stay large, block pairs, groups that go by their nodes
        for name, value in (("LEAF", 6), ("BLOCK", 2), ("WIDE", 4), ("DEPTH", 3)):
            monkeypatch.setattr(near_dup, name, value)
    texts = near_copies(random.Random(5), 70)
    rows = [(i * 7 % 10_007, t, "s", "en") for i, t in enumerate(texts, 100)]
    docs = make_docs(rows).unionByName(odd_docs)
    every = rows + ODD
    ids = [r[0] for r in every]
    roots = components_of([shingles(r[1]) for r in every], 85)
    smallest = {}
    for i, root in enumerate(roots):
        if ids[i] is not None:
            smallest[root] = min(smallest.get(root, ids[i]), ids[i])
    want = sorted(((ids[i], len(shingles(every[i][1])), smallest.get(roots[i])) for i in range(len(every))), key=repr)
    got = near_dup.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dup.one_per_group(docs)
    assert left.columns == docs.columns
    wordless = sum(not shingles(r[1]) for r in every)
    assert left.count() == len({r for i, r in enumerate(roots) if shingles(every[i][1])}) + wordless


def test_near_duplicates_of_nothing(no_docs, make_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0 and near_dup.one_per_group(no_docs).count() == 0
    alone = make_docs([(1, None, "s", "en"), (2, "", "s", "en"), (2, "", "s", "en")])
    assert [r.component_id for r in near_dup.near_duplicates(alone).orderBy("doc_id").collect()] == [1, 2, 2]


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (60, 59)]
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}}


# --- sharding -----------------------------------------------------------------------------------------


def test_shards_are_near_equal_and_gapless(make_docs, odd_docs, no_docs):
    rng = random.Random(6)
    rows = [(i, "x" * min(900, int(20 * rng.paretovariate(1.1))), "s", "en") for i in range(4000)] + [(9999, "hot text", "s", "en")] * 2000
    got = ring.shard(make_docs(rows), shards=10, places=32).collect()
    size, slots = Counter(), defaultdict(list)
    for r in got:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert len(got) == len(rows) and max(size.values()) - min(size.values()) < 0.02 * sum(size.values()) / 10
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    odd = ring.shard(odd_docs).collect()
    assert sorted((r.doc_id or -1, r.size, r.text_crc32) for r in odd) == sorted(
        (d or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _, _ in ODD
    )
    assert ring.shard(no_docs).count() == 0


def test_overflow_walks_on_to_the_next_place_with_room():
    owners = [0, 1, 0, 2]
    plan = ring.plan_overflow({0: 90, 1: 0, 2: 10, 3: 20}, owners, 3, slack=1.0)
    assert plan == [(0, 0, 0), (0, 40, 1), (0, 80, 2), (2, 0, 2), (3, 0, 2)]
    held = Counter()
    for (arc, first, shard), nxt in zip(plan, [(0, 40), (0, 80), (0, 90), (2, 10), (3, 20)]):
        held[shard] += nxt[1] - first
    assert held == {0: 40, 1: 40, 2: 40}


def test_a_new_shard_moves_little_before_overflow():
    a, b = ring.ring_places(40), ring.ring_places(41)
    assert [x for x in b if x[1] < 40] == a


def test_sketches_estimate_similarity():
    rng, errors = np.random.default_rng(0), []
    for _ in range(200):
        base = rng.integers(0, 2**63, 46, dtype=np.uint64) * np.uint64(2)
        a, b = (sketch(minima(np.unique(x)))[None] for x in (base[:43], base[3:]))
        errors.append(int(mismatches(a, b)[0, 0]) - 256 * 0.75 * (1 - 40 / 46))
    assert abs(np.mean(errors)) < 2 and np.std(errors) < 7


# --- top k --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("small", [False, True])
def test_top_k_against_all_pairs(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_VALUES", 200), ("BLOCK_VALUES", 30), ("LEAF", 4)):
            monkeypatch.setattr(topk, name, value)
            if name == "LEAF":
                monkeypatch.setattr(topk, "build", lambda p, i, leaf=4: _build(p, i, leaf))
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.3, 0.0, 0.26, 0.5]) for _ in range(3 if i % 10 else 2)], 1) for i in range(240)]
    rows += [(500, None, 1), (None, [0.1, 0.2, 0.3], 1), (520, [float("nan"), 0.0, 1.0], 1), (540, [float("inf"), 0.0, 1.0], 1), (560, [None, 1.0, 1.0], 1), (7, rows[7][1], 1)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    ints = [(i, [math.floor(np.float32(x) * 64.0) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    want = []
    for q, v in {i: v for i, v in ints if i % 20 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ints if i != q and len(v) == len(w))[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(found, 1)]
    assert sorted(map(tuple, topk.top_k(vectors, k=5).collect())) == sorted(want)
    assert topk.top_k(vectors.limit(0)).count() == 0


_build = topk.build


def test_boxes_are_tight_and_bound_every_score():
    rng = np.random.default_rng(1)
    points = rng.integers(-50, 50, (333, 4)).astype(float)
    tree = topk.build(points, np.arange(333), leaf=10)
    q = rng.integers(-50, 50, (20, 4)).astype(float)
    for cuts, low, high in zip(tree.bounds, tree.low, tree.high):
        for n, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            assert (tree.points[i:j].min(axis=0) == low[n]).all() and (tree.points[i:j].max(axis=0) == high[n]).all()
            bound = np.maximum(q, 0) @ high[n] + np.minimum(q, 0) @ low[n]
            assert (q @ tree.points[i:j].T <= bound[:, None] + 1e-9).all()
    assert sorted(tree.ids) == list(range(333))


def test_vectors_of_the_test_tables_have_whole_answers(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n = vectors.filter(F.col("vec_id") % 20 == 0).count()
    assert topk.top_k(vectors).count() == n * min(20, vectors.count() - 1)


def test_a_large_group_is_held_against_its_hubs_first(spark, make_docs):
    """6,000 variants of one long text, some linked only through others, and as many that are candidates but no links."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(3000):
        far = i % 10 == 0
        at = rng.sample(range(0, 400, 20), 4 if far else 1)
        rows.append((i, " ".join(f"x{i}" if j in at else w for j, w in enumerate(base)), "s", "en"))
    other = base[:346] + [f"v{i}" for i in range(54)]  # 342 shingles of 396 + 54: 0.76
    rows += [(10_000 + i, " ".join([*other[:i % 300], f"y{i}", *other[i % 300 + 1 :]]), "s", "en") for i in range(3000)]
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    sets = {d: shingles(t) for d, t, _, _ in rows}
    first = {d for d in sets if d < 10_000}
    linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    assert all(linked(1, d) for d in first)
    assert {got[d] for d in first} == {0}
    assert not any(linked(rng.choice(sorted(first)), d) for d in rng.sample(sorted(sets.keys() - first), 500))
    assert {got[d] for d in sets if d >= 10_000} == {10_000}


def test_members_of_a_large_group_that_link_to_no_hub(spark, make_docs, monkeypatch):
    """Chains in one group of candidates: neighbours link, most others do not."""
    for name, value in (("LEAF", 6), ("BLOCK", 8), ("WIDE", 32), ("HUBS", 2)):
        monkeypatch.setattr(near_dup, name, value)
    rows = []
    for chain in range(3):
        words = [f"w{i}" for i in range(300)]
        for step in range(70):
            words[4 * step] = f"c{chain}s{step}"
            rows.append((chain * 1000 + step, " ".join(words), "s", "en"))
    roots = components_of([shingles(r[1]) for r in rows], 85)
    smallest = {root: min(rows[i][0] for i, r in enumerate(roots) if r == root) for root in roots}
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(make_docs(rows)).collect()}
    assert got == {r[0]: smallest[root] for r, root in zip(rows, roots)}
