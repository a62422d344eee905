"""Row filters of plain policies: one function per policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from palisade.functions.identifiers import filter_function_name
from palisade.functions.ordering import ordered_text
from palisade.functions.text import case_body, filter_columns, group_test, user_test
from palisade.operators.config import Config
from palisade.operators.privileges import explode_principals, map_principal
from palisade.operators.resources import routed
from palisade.operators.statements import head_of, raw_rows

# Items per sorting step when clauses of one policy are strung together.
ITEMS_PER_CHUNK = 512


def item_chunk():
    return F.floor(F.col("item_pos") / ITEMS_PER_CHUNK)


def principal_chunk():
    return F.floor(F.col("prin_pos") / ITEMS_PER_CHUNK)


def principals_joined(
    rows: DataFrame, items: DataFrame, order: Sequence[str], text: str, separator: str, out: str, section: str | None = None
) -> DataFrame:
    """(policy_key, out): texts of the principals of ``items`` in ``order``, however many an item has.

    Runs of items are joined first. A run with an item of more than ITEMS_PER_CHUNK principals is cut further, by item and
    run of principals; which these are follows from the sizes of the arrays, before anything is exploded.
    """
    sizes = sum((F.coalesce(F.size(c), F.lit(0)) for c in ("users", "groups", "roles") if c in items.columns), F.lit(0))
    hot = items.filter(sizes > ITEMS_PER_CHUNK).select("policy_key", item_chunk().alias("run")).distinct().withColumn("hot", F.lit(True))
    ahead = ["policy_key", *([section] if section else []), "run"]
    rows = rows.withColumn("run", item_chunk()).join(hot, ["policy_key", "run"], "left")
    fine = F.when(F.col("hot"), F.struct("item_pos", principal_chunk()))
    runs = ordered_text(rows, ahead, order, text, separator, "of_run", fine)
    return ordered_text(runs, ["policy_key"], ahead[1:], "of_run", separator, out)


def filter_clauses(items: DataFrame, config: Config) -> DataFrame:
    """One WHEN clause per item and principal: users before groups, item order kept."""
    rows = map_principal(explode_principals(items.filter("filter_expr <> ''"), roles=False), config)
    test = F.when(F.col("ptype") == "user", user_test(F.col("principal"))).otherwise(group_test(F.col("principal")))
    return rows.withColumn("clause", F.concat(test, "filter_expr"))


def ordered_filter_columns(items: DataFrame, session_words: bool = True) -> DataFrame:
    """(policy_key, columns): first-seen distinct columns over all items of a policy."""
    found = (
        items.filter("filter_expr <> ''")
        .select("policy_key", "item_pos", F.posexplode(filter_columns(F.col("filter_expr"), session_words)))
        .groupBy("policy_key", "col")
        .agg(F.min(F.struct("item_pos", "pos")).alias("seen"))
        .select("policy_key", "seen.item_pos", "seen.pos", "col")
    )
    names = ordered_text(found, ["policy_key"], ["item_pos", "pos"], "col", ", ", "columns", item_chunk())
    return names


def merge_row_filters(items: DataFrame, config: Config) -> DataFrame:
    """(policy_key, filter_body): all items of a policy as one CASE, else its first expression."""
    used = items.filter("filter_expr <> ''")
    merged = principals_joined(filter_clauses(items, config), used, ["item_pos", "prin_pos"], "clause", "\n", "whens")
    first = items.groupBy("policy_key").agg(F.min_by("filter_expr", "item_pos").alias("first_expr"))
    plain = F.when(F.length("first_expr") > 0, F.col("first_expr")).otherwise(F.lit("TRUE"))
    body = F.when(F.col("whens").isNotNull(), case_body(F.col("whens"), F.lit("TRUE"))).otherwise(plain)
    return first.join(merged, "policy_key", "left").select("policy_key", body.alias("filter_body"))


def filter_targets(policies: DataFrame, config: Config) -> DataFrame:
    """Row-filter policies with an object; ``parts`` are its dotted parts."""
    return (
        routed(policies, config)
        .filter("route = 'row_filter' AND resource_path IS NOT NULL")
        .select("policy_key", "policy_id", "name", "description", "resource_path", F.split("resource_path", r"\.").alias("parts"))
    )


def row_filter_statements(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    targets = filter_targets(policies, config).filter("size(parts) = 3")
    rows = (
        targets.join(merge_row_filters(items, config), "policy_key")
        .join(ordered_filter_columns(items), "policy_key", "left")
        .withColumn("columns", F.coalesce("columns", F.lit("")))
        .withColumn(
            "function",
            F.concat_ws(
                ".", F.get(F.col("parts"), F.lit(0)), F.get(F.col("parts"), F.lit(1)),
                filter_function_name(F.get(F.col("parts"), F.lit(2)), F.col("policy_id"), F.lit(0)),
            ),
        )
    )
    return filter_statement_pair(rows, "ROW_FILTER", F.col("resource_path"), may_head=F.col("part") == 0, head=head_of())


def filter_statement_pair(rows: DataFrame, policy_type: str, table, **order) -> DataFrame:
    """The function and the ALTER that attaches it, from ``columns``, ``function``, ``filter_body``."""
    parameters = F.when(
        F.col("columns") != "", F.concat(F.replace("columns", F.lit(", "), F.lit(" STRING, ")), F.lit(" STRING"))
    ).otherwise(F.lit(""))
    create = F.concat(
        F.lit("CREATE OR REPLACE FUNCTION "), "function", F.lit("("), parameters,
        F.lit(")\nRETURNS BOOLEAN\nRETURN\n  "), "filter_body",
    )
    attach = F.concat(
        F.lit("ALTER TABLE "), table, F.lit("\nSET ROW FILTER "), "function", F.lit("\nON ("), "columns", F.lit(")")
    )
    both = rows.select("*", F.posexplode(F.array(create, attach)).alias("part", "text"))
    return raw_rows(both, policy_type, F.col("text"), **order)


def filter_errors(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """Row-filter policies whose object is not a three-part path."""
    bad = filter_targets(policies, config).filter("size(parts) <> 3")
    return bad.join(items, "policy_key", "left_semi").select(
        "policy_key", F.concat(F.lit("Invalid table path for row filter: "), "resource_path").alias("message")
    )
