"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palisade.session import write_through


def _fingerprint(edges: DataFrame) -> tuple:
    r = edges.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % F.lit(1_000_003)).alias("a"),
        F.sum(F.xxhash64("v", "u") % F.lit(998_244_353)).alias("b"),
    ).first()
    return r["n"], r["a"], r["b"]


def _smallest(edges: DataFrame) -> DataFrame:
    # Written, so that both sides of the next join are plain exchanges that can be split for a hot vertex.
    return write_through(edges.groupBy("u").agg(F.min("v").alias("m")), "star")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``vertex``, ``root`` for every vertex of an edge; ``root`` is the smallest vertex of its component.

    Edges have no direction; repeated edges are welcome, loops and null ends are ignored, an empty
    table gives an empty one. Each step is a minimum per vertex (map-side combined) and one join;
    steps go through the shared folder, so a lost executor costs one step. The number of steps grows
    with the logarithm of the longest path.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = write_through(e.distinct(), "edges")
    before = None
    while True:
        seen = _fingerprint(e)
        if seen == before or seen[0] == 0:
            break
        before = seen
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _smallest(both).select("u", F.least("u", "m").alias("m"))
        # Large star: neighbours above u move to the smallest vertex around u.
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = write_through(large.distinct(), "large_star")
        # Small star: u and its smaller neighbours move to the smallest of them.
        low = _smallest(large)
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = write_through(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small_star")
    # At the end every vertex but the roots has one edge, to its root.
    leaves = e.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
    return leaves.unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
