"""Shared shape of generated statements.

A raw statement row is (policy_key, policy_type, ORDER..., may_head, note, body). Order
columns come from list positions, never from a window, so a hot policy stays spread out.
``may_head`` marks the few rows that can be a policy's first statement. Where the first one is known before rows
arise, ``head`` holds what its header says, and ``finish_known`` formats every row where it is. Elsewhere the marked
rows, and only those, are shuffled to find it (``finish``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.text import format_body, format_statement, strip

ORDER = {
    "section": "int",
    "obj_pos": "int",
    "obj_key": "string",
    "obj_sub": "string",
    "item_pos": "bigint",
    "prin_pos": "int",
    "acc_pos": "int",
    "part": "int",
}
COLUMNS = ["policy_key", "policy_type", *ORDER, "sql"]
GRANTS, DENIES, FILTERS, MASKS = 0, 1, 2, 3
HEAD_TYPE = "struct<policy_id: string, name: string, description: string>"


def raw_rows(df: DataFrame, policy_type: str, body: Column, **values: Column | int | bool | str) -> DataFrame:
    """Bring ``df`` into the raw shape; missing order columns are 0 or ''."""

    def order_column(name: str, kind: str) -> Column:
        if name in values:
            value = values[name]
            value = value if isinstance(value, Column) else F.lit(value)
        elif name in df.columns:
            value = F.col(name)
        else:
            value = F.lit("" if kind == "string" else 0)
        return value.cast(kind).alias(name)

    may_head = values.get("may_head", True)
    may_head = may_head if isinstance(may_head, Column) else F.lit(may_head)
    # The first statement is about the first principal and is never the second of a pair.
    for name in ("prin_pos", "part"):
        if name in values or name in df.columns:
            may_head = may_head & (order_column(name, "int") == 0)
    note = values.get("note", F.lit(None).cast("string"))
    head = F.when(may_head, values["head"]) if "head" in values else F.lit(None).cast(HEAD_TYPE)
    return df.select(
        "policy_key",
        F.lit(policy_type).alias("policy_type"),
        *[order_column(n, k) for n, k in ORDER.items()],
        may_head.alias("may_head"),
        note.alias("note"),
        body.alias("body"),
        head.alias("head"),
    )


def head_of(**columns: Column) -> Column:
    """What a policy's header says, from its columns."""
    return F.struct(*[columns.get(n, F.col(n)).cast("string").alias(n) for n in ("policy_id", "name", "description")])


def header_positions(rows: DataFrame) -> DataFrame:
    """(policy_key, first): order of the one statement that carries the header.

    A plain minimum, combined before the shuffle; the text columns are pruned here.
    """
    return (
        rows.filter("may_head").groupBy("policy_key").agg(F.min(F.struct(*ORDER)).alias("first"))
    )


def finish(rows: DataFrame, policies: DataFrame) -> DataFrame:
    """Format every statement; the header goes on each policy's first one."""
    candidates = rows.filter("may_head")
    heads = _head_columns(policies).join(header_positions(rows), "policy_key")
    headed = F.struct(*ORDER) == F.col("first")
    placed = _formatted(candidates.join(heads, "policy_key"), headed)
    return placed.unionByName(_plain(rows.filter("NOT may_head")))


def finish_known(rows: DataFrame) -> DataFrame:
    """The same for rows that carry their header: one pass, no join."""
    return _formatted(rows.select("*", "head.*"), F.col("head").isNotNull())


def _plain(rows: DataFrame) -> DataFrame:
    return rows.select("policy_key", "policy_type", *ORDER, format_body(F.col("body")).alias("sql"))


def _head_columns(policies: DataFrame) -> DataFrame:
    return policies.select("policy_key", "policy_id", "name", "description")


def _formatted(rows: DataFrame, headed: Column) -> DataFrame:
    description = F.when(
        F.col("note").isNotNull(), strip(F.concat(F.coalesce("description", F.lit("")), F.lit("\n"), F.col("note")))
    ).otherwise(F.col("description"))
    sql = format_statement(F.col("body"), F.col("name"), F.col("policy_id"), description, headed)
    return rows.select("policy_key", "policy_type", *ORDER, sql.alias("sql"))
