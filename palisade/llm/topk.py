"""Exact top-k by inner product with KD-trees per shard.

Vectors are dealt into shards; every shard builds a KD-tree by median splits along the widest
dimension, with tight bounding boxes. No vector of a box scores more than the sum over dimensions of
the larger of query * low and query * high, so a query visits boxes in falling order of that bound and
stops where it falls below its k-th score. Queries first search the shard of their own row; the k-th
score found there goes with them to all other shards, many of whose boxes it rules out at the root.

Queries meet shards in blocks: one task holds one shard and one block of queries, both of bounded
size. What is moved grows as shards * queries + blocks * vectors. In many dimensions boxes rule out
little, and the search is then a blocked scan; it stays exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from palisade.session import write_through

#: Components in a shard and in a block of queries.
SHARD_VALUES, BLOCK_VALUES = 1 << 19, 1 << 18
LEAF = 64
#: The largest double that is a 64-bit number.
_LARGEST = float(2**63 - 1024)
_FOUND = "query_id bigint, vec_id bigint, score bigint"


@dataclass
class Tree:
    points: np.ndarray  # in tree order
    ids: np.ndarray
    bounds: list[np.ndarray]  # start of each node's points by level; nodes 2i and 2i + 1 are the halves of node i above
    low: list[np.ndarray]
    high: list[np.ndarray]


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    order, cuts = np.arange(len(points)), np.array([0, len(points)])
    bounds, low, high = [], [], []
    while True:
        spans = [points[order[i:j]] for i, j in zip(cuts[:-1], cuts[1:])]
        bounds.append(cuts)
        low.append(np.array([s.min(axis=0) for s in spans]))
        high.append(np.array([s.max(axis=0) for s in spans]))
        if int(np.diff(cuts).max()) <= leaf or points.shape[1] == 0:
            break
        new = [0]
        for node, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
            widest = int((high[-1][node] - low[-1][node]).argmax())
            half = (j - i) // 2
            order[i:j] = order[i:j][np.argpartition(points[order[i:j], widest], half)]
            new += [i + half, j]
        cuts = np.array(new)
    return Tree(points[order], ids[order], bounds, low, high)


def search(tree: Tree, queries: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids, (queries, k), of the best points; empty places have id -1.

    ``floor`` is a score that k points elsewhere reach already: less is not looked for. Points with
    the id of the query are left out. Ties go to the smaller id.
    """
    # Whole numbers beyond those of doubles stay whole; their least stands for "nothing yet".
    whole = np.issubdtype(queries.dtype, np.integer)
    kind, least_of_all = (np.int64, np.iinfo(np.int64).min) if whole else (np.float64, -np.inf)
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    alive = np.ones((len(queries), 1), bool)
    for level, (low, high) in enumerate(zip(tree.low, tree.high)):
        if level:
            alive = np.repeat(alive, 2, axis=1)
        use = np.flatnonzero(alive.any(axis=0))
        bound = np.full(alive.shape, least_of_all, kind)
        bound[:, use] = up @ high[use].T + down @ low[use].T
        alive &= bound >= floor[:, None]
    bound[~alive] = least_of_all
    falling = (lambda x: ~x) if whole else np.negative  # ~x: as -x, but for the least of all
    visits = np.argsort(falling(bound), axis=1, kind="stable")
    none = np.iinfo(np.int64).max
    scores, ids = np.full((len(queries), k), least_of_all, kind), np.full((len(queries), k), none)
    everyone, cuts = np.arange(len(queries)), tree.bounds[-1]
    for step in range(bound.shape[1]):
        node = visits[:, step]
        least = np.maximum(floor, scores[:, -1])
        go = (bound[everyone, node] >= least) & (bound[everyone, node] > least_of_all)
        if not go.any():
            break
        for n in np.unique(node[go]):
            who = everyone[go & (node == n)]
            i, j = cuts[n], cuts[n + 1]
            got = queries[who] @ tree.points[i:j].T
            got[query_ids[who][:, None] == tree.ids[None, i:j]] = least_of_all
            better = (got >= least[who][:, None]).any(axis=1) & (got > least_of_all).any(axis=1)
            who, got = who[better], got[better]
            if len(who):
                s = np.concatenate([scores[who], got], axis=1)
                d = np.concatenate([ids[who], np.broadcast_to(tree.ids[i:j], got.shape)], axis=1)
                best = np.lexsort((d, falling(s)), axis=1)[:, :k]
                scores[who], ids[who] = np.take_along_axis(s, best, 1), np.take_along_axis(d, best, 1)
    ids[scores == least_of_all] = -1
    return scores, ids


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), dim)


def _searched(k: int):
    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        query_ids, vec_ids, scores = [], [], []
        if len(points) and len(queries):
            dim = queries.column("dim")[0].as_py()
            p, q = _matrix(points.column("v"), dim), _matrix(queries.column("v"), dim)
            most = lambda x: max(abs(float(x.min(initial=0))), float(x.max(initial=0)))
            whole = 2**53 <= most(p) * most(q) * dim < 2**63
            floor = queries.column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
            if not whole:  # exact as doubles below 2**53
                p, q, floor = p.astype(np.float64), q.astype(np.float64), np.where(floor == np.iinfo(np.int64).min, -np.inf, floor)
            own = queries.column("query_id").to_numpy()
            s, i = search(build(p, points.column("vec_id").to_numpy()), q, own, floor, k)
            row, col = np.nonzero(s > (np.iinfo(np.int64).min if whole else -np.inf))
            found = s[row, col] if whole else np.clip(s[row, col], -_LARGEST, _LARGEST)
            query_ids, vec_ids, scores = own[row], i[row, col], found.astype(np.int64)
        return pa.table({c: pa.array(x, pa.int64()) for c, x in (("query_id", query_ids), ("vec_id", vec_ids), ("score", scores))})

    return run


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """``vec_id``, ``v`` (floor(scale * x) of every component), ``dim``; rows that take no part are left out."""
    x = F.col(f"`{embedding}`")
    odd = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    return vectors.filter(F.col(f"`{vec_id}`").isNotNull() & x.isNotNull() & ~F.exists(x, lambda e: F.coalesce(odd(e.cast("double")), F.lit(True)))).select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("bigint")).alias("v"),
        F.size(x).alias("dim"),
    )


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` of the k best partners of every row whose id is divisible by ``every``.

    Only vectors of the same length meet. Rows with a null id, a null vector, or a null, NaN or infinite
    component take no part. Rows with the query's id are its own and no candidates; repeated rows of a
    query ask once, the first by its components where they differ. Ties go to the smaller id. Other
    columns are not read; an empty table gives an empty one. Scores are exact where the largest components times the
    dimension stay below 2^63; beyond, they are doubles, and those that no 64-bit number holds are the largest one.
    """
    rows = scaled(vectors, vec_id, embedding, scale)
    rows = write_through(rows.withColumn("deal", F.xxhash64("vec_id", "v")), "vectors")
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(
        F.min(F.struct("v", "dim", "deal")).alias("q")
    ).select("query_id", "q.*")
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("vec_id") % every == 0, 1)).alias("m"))
    parts = lambda count, values: F.ceil(F.col(count) * F.greatest("dim", F.lit(1)) / F.lit(values)).cast("int")
    sizes = write_through(sizes.select("dim", parts("n", SHARD_VALUES).alias("shards"), F.greatest(F.lit(1), parts("m", BLOCK_VALUES)).alias("blocks")), "sizes")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    sharded = rows.join(sizes, "dim").withColumn("shard", F.pmod("deal", "shards").cast("int"))
    points = sharded.select("vec_id", "v", "dim", "shard", F.explode(upto("blocks")).alias("block"))
    queries = asked.join(sizes, "dim").select(
        "query_id", "v", "dim", F.pmod("deal", "shards").cast("int").alias("home"), "shards",
        F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"),
    )
    queries = write_through(queries, "queries")
    keys = ["dim", "shard", "block"]
    at_home = queries.select("query_id", "v", "dim", F.col("home").alias("shard"), "block", F.lit(None).cast("bigint").alias("floor"))
    search_in = lambda q: points.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInArrow(_searched(k), _FOUND)
    first = write_through(search_in(at_home), "home")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor"))
    away = queries.join(floors, "query_id", "left").select(
        "query_id", "v", "dim", F.explode(upto("shards")).alias("shard"), "block", "floor", "home"
    ).filter("shard <> home").drop("home")
    found = first.unionByName(search_in(away))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
