"""Queries of the operators that judge or transform single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm import html_text, language, preference, quality, secrets
from palisade.llm.registry import query, table

_QUALITY_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
wins AS (SELECT rid, i, ws[i : i + 4] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT rid, sum(least(5, coalesce(nx - i, 5)))::BIGINT AS n FROM
          (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM dup) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
        len(ls)::BIGINT AS n_lines,
        len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutters,
        length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g'))::BIGINT AS n_upper
      FROM w LEFT JOIN rep USING (rid)),
b AS (SELECT *, CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
        + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
        + CASE WHEN 5 * n_stutters > n_words THEN 32 ELSE 0 END + CASE WHEN 3 * n_exclaims > n_words THEN 64 ELSE 0 END
        + CASE WHEN 2 * n_upper > word_chars THEN 128 ELSE 0 END AS bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words
  AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits FROM b
"""


@query("op5_rule_bitmask_ledger", _QUALITY_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("ledger")
    return judged.select(
        "doc_id", *[m[c].alias(c) for c in quality.MEASURES[:5]],
        (~quality.passes("base")).alias("base_failed"), quality.passes(quality.PRODUCTION).alias("kept"),
        m["fail_bits"].alias("fail_bits"),
    )


@query("op8_zstd_novelty_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_rank_order_language")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


@query("op6_composite_text_density")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


_PREFERENCE_SQL = r"""
WITH t AS (SELECT floor(conv_id / 2)::BIGINT AS pair_id, conv_id % 2 = 0 AS chosen, turn, role, text FROM conversations),
b AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen ORDER BY turn, role, text) AS pos,
        '<|im_start|>' || role || chr(10) AS head FROM t),
r AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS shown FROM b),
f AS (SELECT coalesce(c.pair_id, j.pair_id) AS pair_id, coalesce(c.pos, j.pos) AS pos,
        c.turn IS NOT DISTINCT FROM j.turn AND c.role IS NOT DISTINCT FROM j.role AND c.text IS NOT DISTINCT FROM j.text
          AND c.pos IS NOT NULL AND j.pos IS NOT NULL AS same
      FROM (FROM r WHERE chosen) c FULL JOIN (FROM r WHERE NOT chosen) j ON c.pair_id = j.pair_id AND c.pos = j.pos),
n AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT same) - 1, max(pos)) AS k FROM f GROUP BY pair_id),
o AS (SELECT r.*, k, pos <= k AS shared, coalesce(sum(length(shown)) OVER (PARTITION BY r.pair_id, chosen, pos <= k ORDER BY pos
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM r JOIN n ON r.pair_id = n.pair_id),
m AS (SELECT *, (off + length(head))::VARCHAR || ':' || (off + length(shown))::VARCHAR AS span FROM o)
SELECT pair_id, max(k)::BIGINT AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (shared AND chosen), '') AS prompt,
  count(*) FILTER (NOT shared AND chosen)::BIGINT AS chosen_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (NOT shared AND chosen), '') AS chosen,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT shared AND chosen AND role = 'assistant'), '') AS chosen_mask,
  count(*) FILTER (NOT shared AND NOT chosen)::BIGINT AS rejected_turns,
  coalesce(string_agg(shown, '' ORDER BY pos) FILTER (NOT shared AND NOT chosen), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (NOT shared AND NOT chosen AND role = 'assistant'), '') AS rejected_mask
FROM m GROUP BY pair_id
"""


@query("op2_preference_formatting", _PREFERENCE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n and 2n + 1 are the chosen and the rejected one of pair n."""
    return preference.preferences(preference.paired_by_id(table(spark, sf_dir, "conversations")))
