"""The manifest and its proofs against trees built in plain Python."""

import hashlib
import pathlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import merkle

KINDS = "doc_id bigint, source string, text string, tree string, place bigint, digest string, n int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_of(leaves):
    """All levels, the last of which is one node."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, place, value):
    """(siblings, folded) from a leaf to the last node."""
    siblings = ""
    for level in levels[:-1]:
        run = level[place // 16 * 16 : place // 16 * 16 + 16]
        siblings += "".join(d for i, d in enumerate(run) if i != place % 16)
        value = sha("".join(value if i == place % 16 else d for i, d in enumerate(run)))
        place //= 16
    return siblings, value


def by_hand(rows):
    """Sorted result rows of (doc_id, source, text)."""
    low = lambda t: None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    made = []
    for d, s, t in rows:
        tampered = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
        made.append((s is not None, (s or "").encode(), d is not None, d or 0, leaf_of(d, s, t), leaf_of(d, s, low(t) if tampered else t), d))
    made.sort(key=lambda x: x[:5])
    groups = {}
    for x in made:
        groups.setdefault(x[:2], []).append(x)
    trees = [tree_of([x[4] for x in g]) for g in groups.values()]
    top = tree_of([t[-1][0] for t in trees])
    out = []
    for rank, (g, t) in enumerate(zip(groups.values(), trees)):
        for place, x in enumerate(g):
            s1, v1 = path(t, place, x[5])
            s2, v2 = path(top, rank, v1)
            out.append((x[6], x[4], t[-1][0], top[-1][0], sha(s1 + s2), v2, v2 == top[-1][0]))
    return sorted(out, key=repr)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in rows], KINDS).repartition(3)
    fields = lambda text: [F.col("doc_id"), F.col("source"), text]
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    given = merkle.leaf(*fields(F.when(chosen, low).otherwise(F.col("text"))))
    leaves = docs.select("source", "doc_id", merkle.leaf(*fields(F.col("text"))).alias("leaf"), given.alias("given"))
    return sorted(map(tuple, merkle.climb(merkle.build(leaves)).collect()), key=repr)


def test_sources_of_many_sizes_with_odd_rows(spark):
    rng = random.Random(12)
    rows = [(i, "web", rng.choice(["Some TEXT", "plain", "", None, "ÀÉ Straße 漢 🙂"])) for i in range(600)]
    rows += [(i, f"s{i % 19}", "Few Words") for i in range(40)] + [(5, None, "Null"), (6, None, None), (None, "web", "No Id"), (None, None, "A")]
    rows += [(7, "one", "Alone"), (7, "", "Empty source"), (8, "é", "é"), (9, "web", "Long " * 20_000), (10, "web", "Some TEXT"), (10, "web", "Some TEXT")]
    assert found(spark, rows) == by_hand(rows)


def test_many_copies_of_upper_nodes(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LANE", 2)
    rows = [(i, "hot" if i % 3 else f"s{i % 50}", f"Text {i}") for i in range(900)]
    assert found(spark, rows) == by_hand(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 257])
def test_one_source(spark, n):
    rows = [(i, "web", f"Text {i}") for i in range(n)]
    assert found(spark, rows) == by_hand(rows)


def test_only_lone_leaves(spark):
    rows = [(1, f"s{i}", "Text") for i in range(18)]
    assert found(spark, rows) == by_hand(rows)


def test_tampering_is_seen_and_nothing_else(spark):
    rows = [(i, "a", "Text" if i % 2 else "text") for i in range(100)]
    for doc_id, *_, verified in found(spark, rows):
        assert verified == (doc_id % 2 == 0 or zlib.crc32(str(doc_id).encode()) % 5 != 0)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_one_source_of_several_levels_above_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LANE", 2)
    rows = [(i, "web" if i % 9 else "", f"Text {i}") for i in range(5000)]
    assert found(spark, rows) == by_hand(rows)


def test_paths_are_put_out_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "CLIMB_BYTES", "1k")
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(scratch.glob("climb-*"))
    names = ("spark.sql.cteRecursionRowLimit", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")
    settings = [spark.conf.get(k) for k in names]
    rows = [(i, f"s{i % 150}", f"Text {i}") for i in range(400)]
    assert found(spark, rows) == by_hand(rows)
    assert [spark.conf.get(k) for k in names] == settings
    (climb,) = set(scratch.glob("climb-*")) - before
    assert len(list(climb.glob("*.parquet"))) > 1


def test_little_is_stored_per_leaf(spark):
    """A leaf is 32 bytes, and it is written as a leaf, in its place and in its block; nothing else grows with the leaves."""
    scratch = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    held = lambda: sum(p.stat().st_size for p in scratch.rglob("*.parquet"))
    stored = []
    for n in (2_000, 22_000):
        before = held()
        leaf = F.sha2(F.col("id").cast("string"), 256)
        given = F.when(F.col("id") % 5 == 0, F.sha2(F.concat(F.lit("x"), "id"), 256)).otherwise(leaf)
        leaves = spark.range(n).select((F.col("id") % 3).cast("string").alias("source"), F.col("id").alias("doc_id"), leaf.alias("leaf"), given.alias("given"))
        assert merkle.climb(merkle.build(leaves)).count() == n
        stored.append(held() - before)
    assert (stored[1] - stored[0]) / 20_000 < 250, stored
