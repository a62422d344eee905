"""Queries of the operators that compare or place whole tables."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import alignment, merkle, mixing, near_dup, packing, ring, topk, winnowing
from palisade.llm.registry import query, table
from palisade.session import write_through

_NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
p AS (SELECT a.rid AS x, b.rid AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON na.rid = x JOIN n nb ON nb.rid = y WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(x, y) AS (SELECT rid, rid FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT r.x AS rid, min(d.doc_id) AS component_id FROM r JOIN d ON d.rid = r.y GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id IS NOT DISTINCT FROM c.component_id AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


@query("op4_chosen_path_near_dup", _NEAR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), threshold=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op3_pivotal_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


@query("op1_vector_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op7_bounded_load_ring")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=40)


_TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query("op10_kd_tree_top_k", _TOPK_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, every=20)


_WINNOW_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, least(10, len(w)) AS m FROM b WHERE len(w) > 0)),
bw AS (SELECT DISTINCT item, m, array_to_string(w[i : i + m - 1], ' ') AS t FROM bi),
di AS (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw)),
h AS (SELECT DISTINCT rid, m, i, t FROM (SELECT rid, m, i, array_to_string(w[i : i + m - 1], ' ') AS t FROM di) SEMI JOIN bw USING (m, t)),
n AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS pos FROM h) GROUP BY rid),
k AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM h JOIN bw USING (m, t)) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN k USING (rid)
"""


@query("op11_winnowing_decontamination", _WINNOW_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_CRC32 = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda s, b:
  xor(s // 256, list_reduce(list_prepend(xor(s % 256, b), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)))"""
_FIELDS = ", ".join(
    f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")
)
_LEAF_SQL = "sha256(concat(" + _FIELDS + "))"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels_sql(name: str, start: str) -> str:
    """All levels of all trees: (tree, level, place, n, digest)."""
    return f"""{name}(tree, level, place, n, digest) AS (SELECT tree, 0, place, n, digest FROM {start} UNION ALL
  SELECT tree, level + 1, place // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY place)) FROM {name} WHERE n > 1
  GROUP BY tree, level, place // 16, n)"""


_MERKLE_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, *, {_LEAF_SQL.format(text="text")} AS leaf, CASE WHEN xor({_CRC32}, 4294967295::BIGINT) % 5 = 0
    THEN {_LEAF_SQL.format(text=_LOWER_SQL)} ELSE {_LEAF_SQL.format(text="text")} END AS given FROM documents),
l AS (SELECT rid, doc_id, leaf AS digest, given, coalesce('s' || source, '-') AS tree, source,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n FROM d),
{_levels_sql("s", "l")},
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank, count(*) OVER () AS sources
    FROM (SELECT s.tree AS of, s.digest, any_value(l.source) AS source FROM s JOIN l USING (tree) WHERE s.n = 1 GROUP BY ALL)),
t0 AS (SELECT '' AS tree, rank AS place, sources AS n, digest FROM r),
{_levels_sql("t", "t0")},
a AS (SELECT * FROM s UNION ALL SELECT * FROM t),
c(rid, tree, level, place, n, folded, proof) AS (SELECT rid, tree, 0, place, n, given, '' FROM l UNION ALL
  SELECT rid, tree, level, place, n, folded, proof FROM (
    SELECT c.rid, c.tree, c.level + 1 AS level, c.place // 16 AS place, (c.n + 15) // 16 AS n,
      sha256(string_agg(CASE WHEN a.place = c.place THEN c.folded ELSE a.digest END, '' ORDER BY a.place)) AS folded,
      c.proof || coalesce(string_agg(a.digest, '' ORDER BY a.place) FILTER (a.place <> c.place), '') AS proof
    FROM c JOIN a ON a.tree = c.tree AND a.level = c.level AND a.place // 16 = c.place // 16 WHERE c.n > 1
    GROUP BY c.rid, c.tree, c.level, c.place, c.n, c.proof
    UNION ALL SELECT c.rid, '', 0, r.rank, r.sources, c.folded, c.proof FROM c JOIN r ON c.tree = r.of WHERE c.n = 1))
SELECT l.doc_id, l.digest AS leaf, r.digest AS subroot, root.digest AS root, sha256(c.proof) AS proof_sha256, c.folded AS folded_root,
  c.folded = root.digest AS verified
FROM c JOIN l USING (rid) JOIN r ON r.of = l.tree, (SELECT digest FROM t WHERE n = 1) root WHERE c.tree = '' AND c.n = 1
"""


@query("op12_recursive_merkle_manifest", _MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    fields = lambda text: [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    rows = docs.select("source", "doc_id", merkle.leaf(*fields(F.col("text"))).alias("leaf"), F.when(chosen, merkle.leaf(*fields(lower))).alias("given"))
    return merkle.climb(merkle.build(rows.withColumn("given", F.coalesce("given", "leaf"))))


@query("op13_fragment_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alignment.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    n_links = F.aggregate("links", F.lit(0).cast("bigint"), lambda total, x: total + x["n"]).alias("n_links")
    rows = write_through(rows.select("row", "doc_id", "n_a", "n_b", "n_groups", n_links, digest, "links"), "alignment")
    scores = alignment.link_scores(rows, write_through(alignment.pair_counts(rows), "pairs"))
    zero = lambda name: F.coalesce(name, F.lit(0).cast("bigint")).alias(name)
    return rows.drop("links").join(scores, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"
    )
