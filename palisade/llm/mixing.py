"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words. Its documents then carry a fractional number of copies,
the same for all of them; what is to be rounded is the fraction. Two documents meet, and a random
transfer of words between them, which leaves the expectation of both and the sum of words unchanged,
goes on until one of them has a whole number of copies. The other one meets the next document. Each
group of documents so ends with one undecided document; the undecided ones meet in groups again, and
so on up a tree, until a source has one left, which is rounded by itself.

Documents meet others of about their size first (groups lie inside size classes of a source) and in
falling order of size, so the last one left is small. Groups hold some FANOUT rows whatever the
source: a hot source has more of them. Only ids, sizes and hashes move; equal rows are counted
first and move as one. Randomness is a hash of ids, so reruns agree. DataFrame expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.llm.text import free_names, words_of
from palisade.session import write_through

FANOUT = 32
#: Size classes per doubling of the size.
CLASSES = 2
WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2.0


def _ranked(sources: DataFrame) -> DataFrame:
    """``place`` from 0 by code point of the source, null last, without one task for all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = sources.repartitionByRange(max(1, min(64, sources.count() // 1000)), *order)
    dealt = write_through(dealt.withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # at most 64 rows
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return dealt.withColumn("inside", inside).join(F.broadcast(starts), "part").select(
        "source", "source_size", (F.col("start") + F.col("inside") - 1).alias("place")
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows of (source, size).

    Weights repeat over the sources by code point, null last. The targets share ``share`` times all
    sizes by weight; one above ``cap`` times its source's size stops there, and the excess is shared
    again by weight among the others, until none is above. Each round is one small aggregate. If all
    stop, what is left over is not taken. A source of size 0 has target 0.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = _ranked(write_through(sources, "source_sizes"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = write_through(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(cap))), "ranked")
    total = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = None, -1
    while True:
        # A level above every cap means that all stop.
        stops = F.lit(False) if level is None else F.col("most") <= F.col("weight") * F.lit(level)
        r = ranked.agg(
            F.count(F.when(stops, 1)).alias("n"), F.coalesce(F.sum(F.when(stops, F.col("most"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0)).alias("w"),
        ).first()
        if r["n"] == stopped or r["w"] == 0:
            break
        stopped, level = r["n"], (total - r["fixed"]) / r["w"]
    target = F.least(F.col("most"), F.col("weight") * F.lit(float(level or 0.0)))
    return ranked.select("source", "source_size", target.alias("target"))


def _chance(seed: int, *columns: Column) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def _meet(state: Column, x: Column, seed: int) -> Column:
    """One step of the fold: the open document of ``state`` meets ``x``; one of them is decided."""
    o = state["open"]
    up = F.least((1.0 - o["p"]) * o["size"], x["p"] * x["size"])  # words that could go to the open one
    down = F.least(o["p"] * o["size"], (1.0 - x["p"]) * x["size"])
    to_open = _chance(seed, o["id"], o["h"], x["id"], x["h"]) * (up + down) < down
    words = F.when(to_open, up).otherwise(-down)
    p = o["p"] + words / o["size"]
    q = x["p"] - words / x["size"]
    # Whoever moved to its end gets the exact end.
    full = F.when(to_open, (1.0 - o["p"]) * o["size"] <= x["p"] * x["size"]).otherwise(o["p"] * o["size"] <= (1.0 - x["p"]) * x["size"])
    open_done = F.struct(*_item(o, F.when(to_open, 1.0).otherwise(0.0)))
    x_done = F.struct(*_item(x, F.when(to_open, 0.0).otherwise(1.0)))
    return F.struct(
        F.when(full, F.struct(*_item(x, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))))).otherwise(
            F.struct(*_item(o, F.least(F.lit(1.0), F.greatest(F.lit(0.0), p))))
        ).alias("open"),
        F.concat(state["done"], F.array(F.when(full, open_done).otherwise(x_done))).alias("done"),
    )


def _item(x: Column, p: Column) -> list[Column]:
    return [x["neg"].alias("neg"), x["id"].alias("id"), x["h"].alias("h"), x["size"].alias("size"), p.alias("p")]


def _rounded(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Per group of ``keys``: ``open`` (the one document left) and ``done`` (those decided)."""
    item = F.struct((-F.col("size")).alias("neg"), "id", "h", F.col("size").cast("double").alias("size"), "p")
    grouped = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("items"))
    first = F.get("items", F.lit(0))
    start = F.struct(first.alias("open"), F.slice("items", 1, 0).alias("done"))
    folded = F.aggregate(F.slice("items", 2, F.size("items")), start, lambda s, x: _meet(s, x, seed))
    return grouped.select(*keys, folded.alias("f")).select(*keys, F.col("f.open").alias("open"), F.col("f.done").alias("done"))


def copies(
    items: DataFrame, targets: DataFrame, seed: int = 7
) -> DataFrame:
    """(source, id, h, size, copies) for rows of (source, id, h, size, times): copies in all of ``times`` equal documents.

    ``id`` and ``h`` name a document inside its source. Every document of a source expects the same
    number of copies, target / source_size; it gets that number rounded down or up.
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    joined = items.join(targets, items["source"].eqNullSafe(targets["source"])).select(
        items["source"].alias("source"), "id", "h", "size", "times", ratio.alias("ratio")
    )
    # Equal documents decide among themselves but for one fraction.
    due = (F.col("ratio") - F.floor("ratio")) * F.col("times")
    whole = F.floor("ratio") * F.col("times") + F.floor(due)
    rows = joined.select("source", "id", "h", "size", whole.cast("long").alias("whole"), (due - F.floor(due)).alias("p"))
    rows = rows.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * CLASSES)).cast("int"))
    rows = write_through(rows, "fractions")
    # Nothing to decide: a whole number is due, or the size is 0 and any number takes no words.
    plain = rows.filter((F.col("p") <= 0) | (F.col("size") == 0)).select("source", "id", "h", "size", F.col("whole").alias("copies"))
    rest = rows.filter((F.col("p") > 0) & (F.col("size") > 0))
    counts = rest.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n"))
    counts = write_through(counts.withColumn("groups", F.ceil(F.col("n") / FANOUT)), "classes")
    most = counts.agg(F.max("groups")).first()[0] or 1
    c = counts.select(F.col("source").alias("s"), F.col("class").alias("k"), "groups")
    leaf = rest.join(c, rest["source"].eqNullSafe(c["s"]) & (rest["class"] == c["k"])).select(
        "source", "class", F.pmod(F.xxhash64(F.lit(seed), "id", "h"), "groups").alias("b"), "id", "h", "size", "p"
    )
    levels = max(0, math.ceil(math.log(most, FANOUT) - 1e-9)) if most > 1 else 0
    decided = []
    level = _rounded(leaf, ["source", "class", "b"], seed)
    for depth in range(1, levels + 2):
        level = write_through(level, "rounded")
        decided.append(level.select("source", F.explode("done").alias("d")))
        opened = level.select("source", "class", "b", F.col("open.id").alias("id"), F.col("open.h").alias("h"),
                              F.col("open.size").alias("size"), F.col("open.p").alias("p"))
        # A document that ended on a whole number is done as well.
        decided.append(level.filter("open.p IN (0.0D, 1.0D)").select("source", F.col("open").alias("d")))
        opened = opened.filter("p > 0 AND p < 1")
        if depth <= levels:
            opened = opened.withColumn("b", F.floor(F.col("b") / FANOUT))
            level = _rounded(opened, ["source", "class", "b"], seed + depth)
    level = write_through(_rounded(opened, ["source"], seed + 101), "rounded")  # one row per size class
    decided.append(level.select("source", F.explode("done").alias("d")))
    last = F.when(_chance(seed + 102, F.col("open.id"), F.col("open.h")) < F.col("open.p"), 1.0).otherwise(0.0)
    decided.append(level.select("source", F.struct(*_item(F.col("open"), last)).alias("d")))
    done = decided[0]
    for more in decided[1:]:
        done = done.unionByName(more)
    up = done.select("source", "d.id", "d.h", F.col("d.p").cast("long").alias("up"))
    r, u = rest.drop("p"), up
    joined = r.join(
        u.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("h").alias("g"), "up"),
        r["id"].eqNullSafe(F.col("i")) & (r["h"] == F.col("g")) & r["source"].eqNullSafe(F.col("s")),
    )
    return plain.unionByName(joined.select("source", "id", "h", "size", (F.col("whole") + F.col("up")).alias("copies")))


def _items(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    sized = docs.select(
        F.col(f"`{source}`").alias("source"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("h"),
        F.size(words_of(F.col(f"`{text}`"))).cast("long").alias("size"),
    )
    return write_through(sized.groupBy("source", "id", "h", "size").agg(F.count(F.lit(1)).alias("times")), "items")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``: one row per row of ``docs``.

    Size is the number of words; a null text has none and takes nothing. A null source is a source
    of its own, the last one. Repeated rows share their copies as evenly as whole numbers allow. A
    null doc_id is a value like any other. An empty table gives an empty table.
    """
    items = _items(docs, doc_id, text, source)
    targets = write_through(source_targets(items.select("source", (F.col("size") * F.col("times")).alias("size"))), "targets")
    chosen = write_through(copies(items, targets, seed), "copies")
    c = chosen.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("h").alias("g"), "copies")
    rows = items.join(
        c, items["id"].eqNullSafe(F.col("i")) & (items["h"] == F.col("g")) & items["source"].eqNullSafe(F.col("s"))
    ).drop("s", "i", "g")
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("nth")
    rows = rows.select("source", "id", "size", "times", "copies", each)
    share = F.floor(F.col("copies") / F.col("times")) + (F.col("nth") <= F.col("copies") % F.col("times")).cast("long")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    return rows.join(t, rows["source"].eqNullSafe(F.col("s"))).select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", share.alias("copies"),
        (share * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mixture itself: every row of ``docs`` as often as it is taken, with all its columns."""
    items = _items(docs, doc_id, text, source)
    targets = write_through(source_targets(items.select("source", (F.col("size") * F.col("times")).alias("size"))), "targets")
    chosen = copies(items, targets, seed)
    i, g, s, n, mine, nth = free_names(docs, "__i", "__g", "__s", "__n", "__mine", "__nth")
    c = items.join(
        chosen.select(F.col("source").alias("s"), F.col("id").alias("i"), F.col("h").alias("g"), "copies"),
        items["id"].eqNullSafe(F.col("i")) & (items["h"] == F.col("g")) & items["source"].eqNullSafe(F.col("s")),
    )
    c = write_through(c.select(F.col("s").alias(s), F.col("i").alias(i), F.col("g").alias(g), "copies", "times"), "copies")
    c = c.select(s, i, g, F.struct("copies", "times").alias(n)).filter(F.col(n)["copies"] > 0)
    hashed = docs.withColumn(mine, F.xxhash64(f"`{text}`"))
    joined = hashed.join(
        c, hashed[f"`{doc_id}`"].eqNullSafe(F.col(i)) & (hashed[mine] == F.col(g)) & hashed[f"`{source}`"].eqNullSafe(F.col(s))
    )
    names = [f"`{x}`" for x in docs.columns]
    # Equal rows are interchangeable, so each copy of such a row is emitted by whichever comes first.
    single = joined.filter(F.col(n)["times"] == 1).select(*names, F.col(n)["copies"].alias(nth))
    equal = joined.filter(F.col(n)["times"] > 1).dropDuplicates([i, g, s]).select(*names, F.col(n)["copies"].alias(nth))
    return single.unionByName(equal).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(nth)))).select(*names)
