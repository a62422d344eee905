"""A Merkle manifest of a dataset, and proofs that climb it by a recursive query.

Every row is a leaf: the SHA-256 of its fields. Per source, leaves ascend by id; sixteen consecutive nodes become their
hash, until one is left (a lone leaf stays as it is): the *subroot* of the source. Subroots, in the order of sources,
become the root in the same way. Digests are lower-case hex, and a hash is taken of their texts one after the other.

``build`` gathers the leaves once, by blocks of 256: the two lowest levels. The levels above are stored as rows linked to their
parents. ``climb`` is a Spark recursive query over these rows: from level to level it appends the siblings to a block's path.
All leaves of a block have that path in common, so of a block only its place climbs; where the path meets the block's leaves, each
leaf's hash, which may be another than the one that was stored, is folded with its own siblings and along the path. Many
rows meet near the root: a node is there once per ``LANE`` blocks below it, and a block asks for the copy of its lane.

Beside its id a leaf is 32 bytes, and what is folded is kept only where it differs from the leaf; hex arises where it is hashed.

Defined results: null fields are hashed as ``-`` and null sources are a source, the first one; null ids come first in it.
Repeated rows and equal ids are leaves of their own, in the order of their hashes. Empty and very long texts are hashed as
they are. Of the input only the named columns are read. An empty table has no leaf and no root.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.session import write_through

FAN_BITS = 4
FAN = 1 << FAN_BITS
#: A block of leaves is two levels of the tree.
BLOCK_BITS = 2 * FAN_BITS
#: Digits of a hash.
DIGITS = 64
#: Blocks of leaves for which there is one copy of each node above them.
LANE = 64
#: Shuffled bytes of blocks' places, some 100 each, that one task climbs with: paths take up many times as much.
CLIMB_BYTES = "128k"
#: The tree of subroots; trees of sources have other names.
TOP = "top"
NAMED = "source "


@dataclass(frozen=True)
class Manifest:
    """``blocks``: leaves of 256 each; ``starts``: a node per block with the link to its parent; ``nodes``: all above, linked likewise.

    ``children`` of nodes, and ``ones`` of blocks, the hashes of its runs of sixteen, are hashes one after the other.
    """

    blocks: DataFrame
    starts: DataFrame
    nodes: DataFrame
    root: str | None


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(*fields: Column) -> Column:
    """Hash of fields, each as its UTF-8 length, a colon and the text, or as ``-`` where it is null."""
    texts = [f.cast("string") for f in fields]
    return hashed(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def _placed(rows: DataFrame, order: Sequence[Column], label: str, tree: Column) -> DataFrame:
    """Adds ``tree``, ``place`` (from 0 in its tree) and ``n`` (rows of the tree); ``order`` begins with what makes a tree.

    Rows are dealt out by ranges, which may cut a tree anywhere, and counted per range and tree. The counts are written, so
    that Spark knows that they are few and does not deal out the rows again to meet them.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = dealt.withColumn("tree", tree).withColumn("at", F.monotonically_increasing_id())
    dealt = write_through(dealt.drop("source", "tie"), label)
    dealt = dealt.withColumn("part", F.shiftright("at", 33))
    counts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    inside = Window.partitionBy("tree")  # a row per range at most
    before = inside.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "tree", "part", (F.coalesce(F.sum("held").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(inside).alias("n"),
    )
    starts = write_through(starts, f"{label}-starts")
    return dealt.join(starts, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _around(children: Column, slot: Column) -> tuple[Column, Column]:
    """The hashes before and after that in ``slot``."""
    return F.left(children, slot * DIGITS), F.substr(children, slot * DIGITS + (DIGITS + 1))


def _runs(leaves: Column) -> Column:
    """The numbers of the runs of sixteen among the leaves of a block."""
    return F.sequence(F.lit(0), F.shiftright(F.size(leaves) - 1, FAN_BITS))


def _run(leaves: Column, i: Column) -> Column:
    return F.slice(leaves, i * FAN + 1, F.lit(FAN))


def _joined(leaves: Column) -> Column:
    return F.array_join(F.transform(leaves, lambda m: _hex(m["leaf"])), "")


def _blocks(placed: DataFrame) -> DataFrame:
    """The leaves of 256 neighbours each, with the hashes of their runs (``ones``) and their own, the last of a small tree."""
    kept = ("doc_id", "leaf", "given")
    block = F.array_sort(F.collect_list(F.struct("place", *kept)))
    made = placed.groupBy("tree", F.shiftright("place", BLOCK_BITS).alias("up")).agg(block.alias("block"), F.max("n").alias("leaves_n"))
    made = made.select("tree", F.col("up").alias("place"), "leaves_n", F.transform("block", lambda m: F.struct(*[m[k].alias(k) for k in kept])).alias("leaves"))
    leaves = F.col("leaves")
    made = made.withColumn("ones", F.array_join(F.transform(_runs(leaves), lambda i: hashed(_joined(_run(leaves, i)))), ""))
    # the only leaf of a source, the only run of one, or a node over runs
    digest = F.when(F.col("leaves_n") == 1, _joined(leaves)).when(F.col("leaves_n") <= FAN, F.col("ones")).otherwise(hashed(F.col("ones")))
    return made.withColumn("digest", digest)


def _parents(rows: DataFrame) -> DataFrame:
    """The hashes of sixteen neighbours each, with what they were made of."""
    run = F.array_sort(F.collect_list(F.struct("place", "digest")))
    made = rows.groupBy("tree", F.shiftright("place", FAN_BITS).alias("up")).agg(
        F.array_join(run["digest"], "").alias("children"), F.max("n").alias("n"), F.sum("width").alias("width")
    )
    made = made.select("tree", F.col("up").alias("place"), F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), "width", "children")
    return made.withColumn("digest", hashed(F.col("children")))


def _linked(rows: DataFrame, tree: Column, level: int, place: str = "place") -> DataFrame:
    """Adds the link to the parent and the number of its lanes."""
    up = F.shiftright(place, FAN_BITS)
    below = F.sum("width").over(Window.partitionBy(tree, up))
    lanes = F.expr(f"({LANE - 1} + below) div {LANE}")
    slot = F.col(place).bitwiseAND(FAN - 1).cast("int")
    rows = rows.withColumn("below", below).withColumn("up_lanes", lanes).drop("below")
    return rows.withColumns({"slot": slot, "up_tree": tree, "up_level": F.lit(level), "up_place": up})


def _levels(rows: DataFrame, most: int, level: int, label: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(nodes with a parent in their tree, last nodes of their trees) from the nodes of ``level`` upwards."""
    inner, last = [], []
    while True:
        nodes = rows.withColumn("level", F.lit(level))
        last.append(nodes.filter("n = 1"))
        if most <= 1:
            return inner, last
        inner.append(_linked(nodes.filter("n > 1"), F.col("tree"), level + 1))
        rows = write_through(_parents(rows.filter("n > 1")), f"{label}{level + 1}")
        most, level = -(-most // FAN), level + 1


def _union(frames: list[DataFrame], *columns: str) -> DataFrame:
    first, *others = [f.select(*columns) for f in frames]
    for other in others:
        first = first.unionByName(other)
    return first


def build(leaves: DataFrame) -> Manifest:
    """The manifest of ``leaves``: (source, doc_id, leaf, given), where ``given`` is what a proof is to be folded with."""
    given = F.when(F.col("given") != F.col("leaf"), F.unhex("given"))
    leaves = leaves.select("source", "doc_id", F.unhex("leaf").alias("leaf"), given.alias("given"))
    leaves = write_through(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("source", "doc_id", "leaf", "tie")]
    named = F.coalesce(F.concat(F.lit(NAMED), "source"), F.lit("no source"))
    blocks = write_through(_blocks(_placed(leaves, order, "ordered", named)), "blocks")
    n = F.expr(f"shiftright(leaves_n + {(1 << BLOCK_BITS) - 1}, {BLOCK_BITS})")
    lowest = blocks.select("tree", "place", n.alias("n"), F.lit(1).cast("bigint").alias("width"), F.lit("").alias("children"), "digest")
    inner, last = _levels(lowest, lowest.agg(F.max("n")).first()[0] or 0, 0, "level")

    source = F.when(F.startswith("tree", F.lit(NAMED)), F.substr("tree", F.lit(len(NAMED) + 1)))
    subroots = _union(last, "tree", "level", "width", "digest", "children").withColumn("source", source)
    subroots = subroots.withColumnsRenamed({"tree": "of", "level": "of_level"})
    ranked = _placed(subroots, [F.col("source").asc_nulls_first()], "subroots", F.lit(TOP))
    top, roots = _levels(ranked, ranked.agg(F.max("n")).first()[0] or 0, 0, "top")

    links = ["slot", "up_tree", "up_level", "up_place", "up_lanes"]
    no_link = {k: F.lit(None).cast(kind) for k, kind in zip(links, ("int", "string", "int", "bigint", "bigint"))}
    ends = [f.withColumns(no_link) for f in roots]
    as_subroot = {"tree": F.col("of"), "level": F.col("of_level"), "place": F.lit(0).cast("bigint")}
    linked = [*inner, *[f.withColumns(as_subroot) for f in (*top[:1], ends[0])], *top[1:], *ends[1:]]
    nodes = _union(linked, "tree", "level", "place", "width", "digest", "children", *links)
    nodes = write_through(nodes, "nodes")
    lowest = (F.col("level") == 0) & (F.col("tree") != TOP)
    lanes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({LANE - 1} + width) div {LANE} - 1")))
    above = nodes.filter(~lowest).withColumn("lane", lanes).drop("width")
    root = _union(roots, "digest").first()
    starts = nodes.filter(lowest).select("tree", "place", "digest", *links)
    return Manifest(blocks, starts, write_through(above, "lanes"), root and root["digest"])


_CLIMB = f"""
WITH RECURSIVE climb(tree, place, up_tree, up_level, up_place, up_lanes, slot, path, subroot) AS (
  SELECT tree, place, up_tree, up_level, up_place, up_lanes, slot, cast(array() AS array<struct<before: string, after: string>>) AS path,
    digest AS subroot FROM {{start}}
  UNION ALL
  SELECT c.tree, c.place, n.up_tree, n.up_level, n.up_place, n.up_lanes, n.slot,
    concat(c.path, array(struct(left(n.children, {DIGITS} * c.slot) AS before, substr(n.children, {DIGITS} * c.slot + {DIGITS + 1}) AS after))),
    if(n.tree = c.tree, n.digest, c.subroot)
  FROM climb c JOIN {{nodes}} n ON n.tree = c.up_tree AND n.level = c.up_level AND n.place = c.up_place
    AND n.lane = pmod(xxhash64(c.tree, c.place), c.up_lanes))
SELECT tree, place, path, subroot FROM climb WHERE up_tree IS NULL
"""
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_PARTITION_BYTES = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize")


def climb(manifest: Manifest) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf.

    The proof is the hash of all siblings, level by level, from left to right; ``folded_root`` is what the given hash becomes with
    them. One recursion is a join of all blocks' places with their parents; the log of the number of blocks is their number.
    Spark puts the rows of all recursions into as many partitions as the first rows fill, which are the shortest.
    """
    blocks, spark = manifest.blocks, manifest.blocks.sparkSession
    settings = {_ROW_LIMIT: "-1", **dict.fromkeys(_PARTITION_BYTES, CLIMB_BYTES)}  # the number of rows follows the input
    kept = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        ends = write_through(spark.sql(_CLIMB, start=manifest.starts, nodes=manifest.nodes), "climb")
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    runs = blocks.select("tree", "place", "leaves_n", "leaves", "ones").join(ends, ["tree", "place"])
    runs = runs.select("leaves_n", "leaves", "ones", "path", "subroot", F.explode(_runs(F.col("leaves"))).alias("i"))
    before, after = _around(F.col("ones"), F.col("i"))
    in_block = F.array(F.struct(before.alias("before"), after.alias("after")))
    runs = runs.withColumn("path", F.when(F.col("leaves_n") > FAN, F.concat(in_block, "path")).otherwise(F.col("path")))
    runs = runs.withColumn("run", _run(F.col("leaves"), F.col("i")))
    tail = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    members = runs.select("leaves_n", "path", "subroot", tail.alias("tail"), _joined(F.col("run")).alias("own"), F.posexplode("run").alias("j", "m"))
    before, after = _around(F.col("own"), F.col("j"))
    leaf_hex = _hex(F.col("m.leaf"))
    given = F.coalesce(_hex(F.col("m.given")), leaf_hex)
    folded = F.when(F.col("leaves_n") == 1, given).otherwise(hashed(before, given, after))
    folded = F.aggregate("path", folded, lambda value, s: hashed(s["before"], value, s["after"]))
    root = F.lit(manifest.root).cast("string")
    members = members.select(
        F.col("m.doc_id").alias("doc_id"), leaf_hex.alias("leaf"), "subroot", root.alias("root"),
        hashed(before, after, F.col("tail")).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return members.withColumn("verified", F.col("folded_root") == F.col("root"))
