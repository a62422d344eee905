"""Column masks as Spark expressions and as SQL text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from palisade.constants import MASK_SQL_TYPE_DEFAULT, MASK_SQL_TYPES, MASKS

RESOURCE_FALLBACK = "MASK_REDACT"
TAG_FALLBACK = "MASK_HASH"


def literal_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(part) for pair in values.items() for part in pair])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mask_type(kind: str, custom: Mapping[str, str] | None = None, fallback: str = RESOURCE_FALLBACK) -> str:
    return kind if kind in {**MASKS, **(custom or {})} else fallback


def mask_sql(
    kind: str,
    argument: str,
    custom: Mapping[str, str] | None = None,
    fallback: str = RESOURCE_FALLBACK,
) -> str:
    """SQL text of a mask over ``argument``; ``custom`` adds or replaces templates."""
    templates = {**MASKS, **(custom or {})}
    text = templates[mask_type(kind, custom, fallback)].replace("{column}", argument)
    return "CAST(NULL AS STRING)" if text == "NULL" else text


def mask_expr(
    column: str,
    kind: str,
    custom: Mapping[str, str] | None = None,
    fallback: str = RESOURCE_FALLBACK,
) -> Column:
    """The masked value of ``column``; built-in expressions only, so it stays in codegen."""
    return F.expr(mask_sql(kind, quoted(column), custom, fallback))


def mask_none(column: str) -> Column:
    return mask_expr(column, "MASK_NONE")


def mask_full(column: str) -> Column:
    return mask_expr(column, "MASK")


def mask_show_last_4(column: str) -> Column:
    return mask_expr(column, "MASK_SHOW_LAST_4")


def mask_show_first_4(column: str) -> Column:
    return mask_expr(column, "MASK_SHOW_FIRST_4")


def mask_hash(column: str) -> Column:
    return mask_expr(column, "MASK_HASH")


def mask_null(column: str) -> Column:
    return mask_expr(column, "MASK_NULL")


def mask_date_show_year(column: str) -> Column:
    return mask_expr(column, "MASK_DATE_SHOW_YEAR")


def mask_timestamp_show_date(column: str) -> Column:
    return mask_expr(column, "MASK_TIMESTAMP_SHOW_DATE")


def mask_redact(column: str) -> Column:
    return mask_expr(column, "MASK_REDACT")


# --- the same, over columns of mask type names --------------------------------


def effective_mask(kind: Column, fallback: str) -> Column:
    """Known mask types stay, all others become the fallback."""
    return F.when(kind.isin(*MASKS), kind).otherwise(F.lit(fallback))


def mask_text(kind: Column, argument: Column, fallback: str, custom: Mapping[str, str] | None = None) -> Column:
    """SQL text of the mask body for a mask type held in a column; ``custom`` adds or replaces templates."""
    templates = {**MASKS, **(custom or {})}
    template = F.coalesce(F.element_at(literal_map(templates), kind), F.lit(templates[fallback]))
    return F.replace(template, F.lit("{column}"), argument)


def mask_sql_type(kind: Column) -> Column:
    """SQL type of both the parameter and the result."""
    return F.coalesce(F.element_at(literal_map(MASK_SQL_TYPES), kind), F.lit(MASK_SQL_TYPE_DEFAULT))
