"""Near-duplicate documents by a chosen-path set similarity join.

Documents with the same shingle set are one vertex. In each of ``trees`` independent trees the
vertices branch by one selected minwise token per level. A node with few members is compared
exhaustively on 512-bit minwise sketches; a larger one branches on, and one that is still large at
the last level is taken as one group of candidates. Two sets of similarity s are compared in one
tree with probability at least s^depth, so the number of trees sets the recall; a lower threshold
takes more of them.

The sketches only propose: links are confirmed on full shingle sets. A group of candidates that fits
one task is intersected whole. A larger one is first held against a few of its members (hubs): what
links to a hub, or to another hub through a common member, is one class and needs no comparison inside.
Only members still apart meet the others, by their sketches in pairs of wide blocks, and only those with
a candidate in another class bring their sets together. Groups of every size go the same way.

What moves between tasks per document are its sketch and its tokens. A text is turned into its set where
it is read, if it stands for a member of a group; copies of it are left where they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palisade.llm.components import components
from palisade.llm.shingles import MINHASHES, WordHashes, minima, mismatches, set_id, shingle_set, sketch
from palisade.llm.text import free_names
from palisade.session import write_through

TREES, DEPTH = 16, 6
#: Members of a node that is compared as it is.
LEAF = 384
#: Full sets compared in one task are at most two blocks, sketches two wide blocks.
BLOCK, WIDE = 96, 1536
#: Members of a group larger than two blocks that all others are compared with first.
HUBS = 8
#: Representatives up to which their ids and hashes are sent to all tasks that read texts (some 64 bytes each).
BROADCAST_ROWS = 1_000_000
#: Texts that a Python worker holds as objects at a time.
TEXTS = 256
#: Standard deviations that a sketch may err before a true link is missed.
SLACK = 4.8
assert TREES * DEPTH <= MINHASHES

_SKETCH_TYPE = "doc_id bigint, th bigint, n_shingles bigint, vid binary, tokens array<int>, sketch array<bigint>"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), TEXTS):
            yield batch.slice(at, TEXTS)


def _trees(threshold: int) -> int:
    """Trees that miss a pair at ``threshold`` no more often than TREES miss one at 0.85, as far as there are minima."""
    miss = lambda share: math.log(1 - share**DEPTH)
    wanted = TREES if threshold >= 85 else math.ceil(TREES * miss(0.85) / miss(max(1, threshold) / 100))
    return min(wanted, MINHASHES // DEPTH)


def _sketched(width: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _parts(batches):
            sizes, vids, tokens, sketches = [], [], [], []
            for text in batch.column(2).to_pylist():
                s = shingle_set(text or "", known, width)
                sizes.append(len(s))
                if len(s):
                    m = minima(s)
                    vids.append(set_id(s))
                    tokens.append(m[: trees * DEPTH].view(np.int32))
                    sketches.append(sketch(m))
                else:
                    vids.append(None)
                    tokens.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(vids, pa.binary()),
                    pa.array(tokens, pa.list_(pa.int32())), pa.array(sketches, pa.list_(pa.int64())),
                ],
                names=["doc_id", "th", "n_shingles", "vid", "tokens", "sketch"],
            )

    return run


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    n, edges = len(linked), []
    if n == 2:
        return [(0, 1)] if linked[0, 1] else []
    todo = np.flatnonzero(linked.any(axis=1))
    seen = np.zeros(n, bool)
    for start in todo:
        if seen[start]:
            continue
        seen[start] = True
        front = [start]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            edges += [(at, x) for x in new]
            front += list(new)
    return edges


def _allowed(threshold: int) -> int:
    """Sketch mismatches up to which two sets may reach the threshold."""
    p = 0.75 * (1 - threshold / 100)
    return math.floor(MINHASHES * p + SLACK * math.sqrt(MINHASHES * p * (1 - p)))


def _proposed(threshold: int):
    most = _allowed(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            cuts = members.offsets.to_numpy()
            flat = members.values
            vids = flat.field("vid").to_pylist() if len(flat) else []
            n = flat.field("n").to_numpy(zero_copy_only=False)
            words = flat.field("sketch").values.to_numpy(zero_copy_only=False).reshape(len(flat), -1) if len(flat) else None
            left, right = [], []
            for i, j in zip(cuts[:-1], cuts[1:]):
                size = n[i:j]
                ok = mismatches(words[i:j], words[i:j]) <= most
                ok &= 100 * np.minimum(size[:, None], size[None]) >= threshold * np.maximum(size[:, None], size[None])
                np.fill_diagonal(ok, False)
                for x, y in _forest(ok):
                    left.append(vids[i + x])
                    right.append(vids[i + y])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], names=["a", "b"])

    return run


def _with_sets(width: int):
    """Texts of representatives to their shingle sets; a row whose text is not of its vertex is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in _parts(batches):
            kept, sets = [], []
            for vid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, known, width)
                if set_id(s) == vid:
                    kept.append(vid)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, pa.binary()), pa.array(sets, pa.large_binary()).cast(pa.binary())], names=["vid", "items"]
            )

    return run


def _sets(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``vid``, ``items`` (the full set) for the vertices in ``wanted`` (vid, id, th)."""
    few = wanted.count() <= BROADCAST_ROWS
    keys = wanted.withColumnRenamed("th", "of")
    named = source.filter(F.col("text").isNotNull()).join(
        F.broadcast(keys) if few else keys, (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id"))
    )
    rows = named.select("vid", "text").mapInArrow(_with_sets(width), "vid binary, items binary")
    return rows.groupBy("vid").agg(F.first("items").alias("items"))  # a repeated row is read again


def common_sizes(sets: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs of sorted distinct arrays, by products of 0/1 matrices of bounded width."""
    n = len(sets)
    out = np.zeros((n, n), np.float64)
    items, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = counts > 1
    column = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, column = owner[use], column[inverse[use]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    width = max(64, 2_000_000 // n)
    for start in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(column, [start, start + width])
        block = np.zeros((n, width), np.float32)
        block[owner[i:j], column[i:j] - start] = 1
        out += block @ block.T
    return out


def _verified(threshold: int):
    def run(group: pa.Table) -> pa.Table:
        vids = group.column("vid").to_pylist()
        first = {v: i for i, v in reversed(list(enumerate(vids)))}
        vids, rows = list(first), list(first.values())
        items = group.column("items").to_pylist()
        sets = [np.frombuffer(items[i], np.uint64) for i in rows]
        left, right = [], []
        if len(sets) > 1:
            n = np.array([len(s) for s in sets], np.int64)
            common = common_sizes(sets).astype(np.int64)
            linked = 100 * common >= threshold * (n[:, None] + n[None] - common)
            np.fill_diagonal(linked, False)
            for x, y in _forest(linked):
                left.append(vids[x])
                right.append(vids[y])
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def _starred(threshold: int):
    """Links of hubs to the members beside them."""

    def run(group: pa.Table) -> pa.Table:
        vids, items = group.column("vid").to_pylist(), group.column("items").to_pylist()
        is_hub = group.column("hub").to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in items]
        left, right = [], []
        mine = np.flatnonzero(~is_hub)
        if len(mine):
            n = np.array([len(sets[i]) for i in mine], np.int64)
            flat, starts = np.concatenate([sets[i] for i in mine]), np.cumsum(n) - n
            for h in np.flatnonzero(is_hub):
                hub = sets[h]
                at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
                common = np.add.reduceat((hub[at] == flat).astype(np.int64), starts)
                for i in mine[100 * common >= threshold * (n + len(hub) - common)]:
                    if vids[i] != vids[h]:
                        left.append(vids[h])
                        right.append(vids[i])
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def _crossed(threshold: int, block: int):
    """For two wide blocks, pairs of their blocks with candidates of different classes: (pair, vid) of these candidates."""
    most = _allowed(threshold)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("lead", "ascending"), ("vid", "ascending")])
        key = group.column("pair")[0].as_py()
        vids, side = group.column("vid").to_pylist(), group.column("side").to_numpy()
        _, class_ = np.unique(np.array([c.hex() for c in group.column("class").to_pylist()]), return_inverse=True)
        n = group.column("n").to_numpy()
        words = np.array(group.column("sketch").to_pylist(), np.int64)
        sides = [np.flatnonzero(side == 0), np.flatnonzero(side == 1)]
        itself = not len(sides[1])
        if itself:
            sides[1] = sides[0]
        cut = lambda rows: [rows[i : i + block] for i in range(0, len(rows), block)]
        pairs, found = [], []
        for x, us in enumerate(cut(sides[0])):
            for y, them in enumerate(cut(sides[1])):
                if itself and y < x:
                    continue
                ok = class_[us][:, None] != class_[them][None]
                ok &= 100 * np.minimum(n[us][:, None], n[them][None]) >= threshold * np.maximum(n[us][:, None], n[them][None])
                if ok.any():
                    ok &= mismatches(words[us], words[them]) <= most
                who = np.union1d(us[ok.any(axis=1)], them[ok.any(axis=0)])
                pairs += [xxhash.xxh3_64_intdigest(f"{key} {x} {y}".encode()) - 2**63] * len(who)
                found += [vids[i] for i in who]
        return pa.table({"vid": pa.array(found, pa.binary()), "group": pa.array(pairs, pa.int64())})

    return run


def _stars(hot: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links between hubs of large groups and their members; ``hot`` has vid, root and the group's size."""
    chunks = F.ceil(F.col("size") / F.lit(2 * BLOCK)).cast("int")
    members = hot.select("vid", F.xxhash64("root", F.pmod(F.xxhash64(F.lit(17), "vid"), chunks)).alias("group"), F.lit(False).alias("hub"))
    hubs = hot.groupBy("root", F.pmod(F.xxhash64(F.lit(29), "vid"), F.lit(HUBS)).alias("of")).agg(
        F.min("vid").alias("vid"), F.max("size").alias("size")
    )
    meets = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1), lambda c: F.xxhash64("root", c))
    hubs = hubs.withColumn("chunks", chunks.cast("bigint")).select("vid", F.explode(meets).alias("group"), F.lit(True).alias("hub"))
    rows = members.unionByName(hubs).join(sets, "vid")
    return rows.groupBy("group").applyInArrow(_starred(threshold), "a binary, b binary")


def _still_apart(hot: DataFrame, stars: DataFrame, threshold: int) -> DataFrame:
    """``vid``, ``group`` that bring together all members of large groups that are candidates but not of one class yet.

    ``hot`` has vid, root, n, lead and sketch. The largest class of a group is not compared with itself.
    """
    # A hub's label is the least hub it links to, a member's the least label of its hubs: some links of a class are not
    # followed, which only brings more of it together again.
    links = stars.unionByName(stars.select("a", F.col("a").alias("b")).distinct())
    labels = links.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("label"))
    classes = links.join(labels, "a").groupBy(F.col("b").alias("vid")).agg(F.min("label").alias("class"))
    rows = write_through(hot.join(classes, "vid", "left").withColumn("class", F.coalesce("class", "vid")), "classes")
    counts = rows.groupBy("root", "class").agg(F.count(F.lit(1)).alias("cnt"))
    wide = lambda count: F.ceil(count / F.lit(WIDE)).cast("int")
    plan = write_through(
        counts.groupBy("root").agg(
            F.max_by("class", F.struct("cnt", "class")).alias("settled"), F.max("cnt").alias("most"), F.sum("cnt").alias("all")
        ).filter("all > most").select("root", "settled", wide(F.col("all") - F.col("most")).alias("open"), wide(F.col("most")).alias("closed")),
        "plan",
    )
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    is_open = F.col("class") != F.col("settled")
    mine = F.pmod(F.xxhash64(F.lit(17), "vid"), F.when(is_open, F.col("open")).otherwise(F.col("closed"))).cast("int")
    at = lambda kind, i, j, side: F.struct(F.xxhash64("root", F.lit(kind), i, j).alias("pair"), side.alias("side"))
    among = F.transform(upto("open"), lambda j: at("open", F.least("mine", j), F.greatest("mine", j), (F.col("mine") > j).cast("int")))
    to_closed = F.transform(upto("closed"), lambda j: at("closed", F.col("mine"), j, F.lit(0)))
    to_open = F.transform(upto("open"), lambda i: at("closed", i, F.col("mine"), F.lit(1)))
    dealt = rows.join(plan, "root").withColumn("mine", mine).select(
        "vid", "class", "n", "lead", "sketch", F.explode(F.when(is_open, F.concat(among, to_closed)).otherwise(to_open)).alias("at")
    ).select("vid", "class", "n", "lead", "sketch", "at.pair", "at.side")
    return dealt.groupBy("pair").applyInArrow(_crossed(threshold, BLOCK), "vid binary, group bigint")


def _branched(vertices: DataFrame, trees: int) -> tuple[DataFrame, DataFrame]:
    """Members of small nodes (node, vid) and of nodes that stay large (node, vid, cnt)."""
    rows = vertices.select("vid", "tokens", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t")).select(
        F.xxhash64("t", F.get("tokens", F.col("t") * DEPTH)).alias("node"), "vid",
        F.slice("tokens", F.col("t") * DEPTH + 2, DEPTH - 1).alias("rest"),
    )
    small = []
    for level in range(1, DEPTH + 1):
        if level > 1:
            rows = rows.select(F.xxhash64("node", F.get("rest", F.lit(level - 2))).alias("node"), "vid", "rest")
        counts = write_through(rows.groupBy("node").agg(F.count(F.lit(1)).alias("cnt")).filter("cnt > 1"), "nodes")
        placed = write_through(rows.join(counts, "node"), "branches")
        small.append(placed.filter(F.col("cnt") <= LEAF).select("node", "vid"))
        rows = placed.filter(F.col("cnt") > LEAF).drop("cnt")
        large = placed.filter(F.col("cnt") > LEAF).select("node", "vid", "cnt")
        if large.isEmpty():
            break
    leaves = small[0]
    for more in small[1:]:
        leaves = leaves.unionByName(more)
    return leaves, large


def near_duplicates(docs: DataFrame, threshold: int = 85, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``th`` (64-bit hash of the text), ``n_shingles``, ``component_id``, ``kept``, ``keeper``: one row per row of ``docs``.

    Two documents are linked where 100 * intersection >= threshold * union of their shingle sets.
    ``component_id`` is the smallest doc_id that links reach, its own included, and ``kept`` says
    whether that is the row's own. ``keeper`` holds for the (doc_id, th) that stands for its
    component; a row that repeats both repeats the answer.

    A null or wordless text has an empty set and is linked with nothing, not even its like. Null
    doc_ids take part and lose against any other; in a component of nothing else the id is null.
    Repeated doc_ids with different texts are different documents. An empty table gives an empty
    table. Further columns of ``docs`` are not looked at.
    """
    trees = _trees(threshold)
    source = docs.select(
        F.col(f"`{doc_id}`").cast("bigint").alias("doc_id"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text")
    )
    sketches = write_through(source.mapInArrow(_sketched(width, trees), _SKETCH_TYPE), "sketches")
    with_set = sketches.filter("n_shingles > 0")
    first = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    vertices = write_through(
        with_set.groupBy("vid").agg(
            F.min(first).alias("first"), F.first("n_shingles").alias("n"),
            F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"),
        ),
        "vertices",
    )
    leaves, large = _branched(vertices.select("vid", "tokens"), trees)
    members = leaves.join(vertices.select("vid", "n", "sketch"), "vid").groupBy("node").agg(
        F.collect_list(F.struct("vid", "n", "sketch")).alias("members")
    )
    proposed = members.select("members").mapInArrow(_proposed(threshold), "a binary, b binary")
    hubs = write_through(large.groupBy("node").agg(F.min("vid").alias("hub")), "hubs")
    stars = large.join(hubs, "node").select(F.col("vid").alias("a"), F.col("hub").alias("b")).filter("a <> b")
    clusters = write_through(components(proposed.unionByName(stars)), "candidates")

    sizes = write_through(clusters.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * BLOCK), "sizes")
    sized = clusters.join(sizes, "root", "left").select(F.col("vertex").alias("vid"), "root", "size")
    wanted = clusters.select(F.col("vertex").alias("vid")).join(vertices.select("vid", F.col("first.id"), F.col("first.th")), "vid")
    sets = write_through(_sets(source, write_through(wanted, "wanted"), width), "sets")
    grouped = sized.filter(F.col("size").isNull()).select("vid", F.xxhash64("root").alias("group"))
    some_hot = not sizes.isEmpty()
    if some_hot:
        hot = sized.filter(F.col("size").isNotNull())
        stars = write_through(_stars(hot, sets, threshold), "stars")
        known = hot.join(vertices.select("vid", "n", F.get("tokens", F.lit(0)).alias("lead"), "sketch"), "vid")
        grouped = grouped.unionByName(write_through(_still_apart(known, stars, threshold), "apart"))
    links = grouped.join(sets, "vid").groupBy("group").applyInArrow(_verified(threshold), "a binary, b binary")
    if some_hot:
        links = links.unionByName(stars)
    roots = components(links)

    linked = vertices.select("vid", "first").join(roots.select(F.col("vertex").alias("vid"), "root"), "vid")
    linked = write_through(linked, "linked")
    heads = write_through(linked.groupBy("root").agg(F.min("first").alias("head")), "heads")
    alone = vertices.join(linked.select("vid"), "vid", "left_anti").select("vid", F.col("first").alias("head"))
    answer = write_through(linked.join(heads, "root").select("vid", "head").unionByName(alone), "answer")
    found = with_set.join(answer, "vid").select(
        "doc_id", "th", "n_shingles", F.col("head.id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("head.id")) & (F.col("th") == F.col("head.th"))).alias("keeper"),
    )
    rest = sketches.filter("n_shingles = 0").select(
        "doc_id", "th", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("keeper")
    )
    rows = found.unionByName(rest)
    return rows.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_per_group(docs: DataFrame, threshold: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their near-duplicate group, with all their columns.

    A repeated keeper (same doc_id and text) stays once; wordless documents all stay.
    """
    key, th, times = free_names(docs, "__key", "__th", "__times")
    found = near_duplicates(docs, threshold, doc_id=doc_id, text=text).filter(F.col("keeper"))
    wordless = F.col("n_shingles") == 0
    keepers = found.groupBy(F.col("doc_id").alias(key), F.col("th").alias(th)).agg(
        F.max(F.when(wordless, 1).otherwise(F.lit(0))).alias("wordless"), F.count(F.lit(1)).alias("n")
    ).select(key, th, F.when(F.col("wordless") == 1, 1).otherwise(F.col("n")).alias(times))
    keepers = write_through(keepers, "keepers")
    own, mine = free_names(docs, "__own", "__mine")
    hashed = docs.withColumns({own: F.col(f"`{doc_id}`").cast("bigint"), mine: F.xxhash64(f"`{text}`")})
    stays = hashed.join(keepers, (hashed[mine] == keepers[th]) & hashed[own].eqNullSafe(keepers[key]))
    once = stays.filter(F.col(times) == 1).select(*docs.columns)
    again = stays.filter(F.col(times) > 1).dropDuplicates([own, mine]).select(*docs.columns)
    return once.unionByName(again)
