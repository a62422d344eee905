"""Column masks of plain policies: one function per masked column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.identifiers import mask_function_name
from palisade.functions.masks import RESOURCE_FALLBACK, mask_sql_type, mask_text
from palisade.functions.text import case_body, group_test, user_test
from palisade.operators.config import Config
from palisade.operators.filters import principals_joined
from palisade.operators.privileges import explode_principals, map_principal
from palisade.operators.resources import resource_values, routed
from palisade.operators.statements import head_of, raw_rows

# Stands for the column inside clause text until the column is known.
SLOT = "\u0001"


def default_mask(items: DataFrame, default: str | None = RESOURCE_FALLBACK) -> DataFrame:
    """(policy_key, mask_kind): the first mask type that really masks, else the default."""
    real = F.when((F.col("mask_type") != "MASK_NONE") & (F.col("mask_type") != ""), F.col("item_pos"))
    chosen = F.min_by(F.when(real.isNotNull(), F.col("mask_type")), real)
    return items.groupBy("policy_key").agg(
        F.coalesce(chosen, F.lit(default).cast("string")).alias("mask_kind")
    )


def pass_through(items: DataFrame, config: Config, map_users: bool = True) -> DataFrame:
    """(policy_key, whens): clauses of principals that see the real value.

    For tag masks all users come before all groups and users keep their own names
    (``map_users=False``); otherwise the order is item by item.
    """
    shown = items.filter("mask_type = 'MASK_NONE'")
    rows = map_principal(explode_principals(shown, roles=False), config)
    user = F.col("principal") if map_users else F.col("pname")
    clause = F.concat(
        F.when(F.col("ptype") == "user", user_test(user)).otherwise(group_test(F.col("principal"))), F.lit(SLOT)
    )
    rows = rows.withColumn("clause", clause)
    if map_users:
        return principals_joined(rows, shown, ["item_pos", "prin_pos"], "clause", "\n", "whens")
    rank = F.when(F.col("ptype") == "user", F.lit(0)).otherwise(F.lit(1))
    rows = rows.withColumn("rank", rank)
    return principals_joined(rows, shown, ["item_pos", "prin_pos"], "clause", "\n", "whens", section="rank")


def mask_body(kind: Column, whens: Column, column: Column, fallback: str, config: Config) -> Column:
    masked = mask_text(kind, column, fallback, config.masks)
    return F.when(whens.isNotNull(), case_body(F.replace(whens, F.lit(SLOT), column), masked)).otherwise(masked)


def mask_statement_pair(
    rows: DataFrame, policy_type: str, fallback: str, prefix: Column, table_name: Column, table: Column, config: Config, **order
) -> DataFrame:
    """The function and the ALTER that attaches it, from ``column``, ``mask_kind``, ``whens``."""
    kind, column = F.col("mask_kind"), F.col("column")
    function = F.concat(prefix, F.lit("."), mask_function_name(table_name, column, kind))
    sql_type = mask_sql_type(kind)
    create = F.concat(
        F.lit("CREATE OR REPLACE FUNCTION "), function, F.lit("("), column, F.lit(" "), sql_type,
        F.lit(")\nRETURNS "), sql_type, F.lit("\nRETURN\n  "),
        mask_body(kind, F.col("whens"), column, fallback, config),
    )
    attach = F.concat(
        F.lit("ALTER TABLE "), table, F.lit("\nALTER COLUMN "), column, F.lit("\nSET MASK "), function
    )
    both = rows.select("*", F.posexplode(F.array(create, attach)).alias("part", "text"))
    return raw_rows(both, policy_type, F.col("text"), **order)


def mask_targets(policies: DataFrame, config: Config) -> DataFrame:
    return (
        routed(policies, config)
        .filter("route = 'column_mask' AND resource_path IS NOT NULL")
        .select(
            "policy_key", "policy_id", "name", "description", "resource_path", F.split("resource_path", r"\.").alias("parts"),
            resource_values("column").alias("columns"),
        )
    )


def column_mask_statements(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    targets = mask_targets(policies, config).filter("size(parts) = 3 AND size(columns) > 0")
    rows = (
        targets.join(default_mask(items), "policy_key")
        .join(pass_through(items, config), "policy_key", "left")
        .select("*", F.posexplode("columns").alias("obj_pos", "column"))
    )
    parts = F.col("parts")
    return mask_statement_pair(
        rows, "COLUMN_MASK", RESOURCE_FALLBACK,
        F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), F.get(parts, F.lit(2)), F.col("resource_path"), config,
        may_head=(F.col("obj_pos") == 0) & (F.col("part") == 0), head=head_of(),
    )


def mask_errors(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    bad_path = F.size("parts") != 3
    message = F.when(
        bad_path, F.concat(F.lit("Invalid table path for column masking: "), "resource_path")
    ).otherwise(F.concat(F.lit("No columns specified for masking in policy "), "policy_id"))
    bad = mask_targets(policies, config).filter(bad_path | (F.size("columns") == 0))
    return bad.join(items, "policy_key", "left_semi").select("policy_key", message.alias("message"))
