"""Identifiers, object paths and generated function names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade.constants import DEFAULT_CATALOG


def _plain(value: Column) -> Column:
    return F.regexp_replace(value, "[^a-zA-Z0-9_]", "_")


def quote_identifier(name: Column) -> Column:
    """Backticks around a name with any unusual character; ``name`` is read once."""
    return F.regexp_replace(name, r"(?s)\A(?=.*[^a-zA-Z0-9_])(.*)\z", "`$1`")


def sanitize_identifier(name: Column) -> Column:
    """The same, and also when the name starts with a digit."""
    return F.regexp_replace(name, r"(?s)\A(?=[0-9]|.*[^a-zA-Z0-9_])(.*)\z", "`$1`")


def parse_resource_path(path: Column) -> Column:
    """``/a/b/c/d`` -> struct(catalog, schema, table, column); absent parts are NULL."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    names = ("catalog", "schema", "table", "column")
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def build_resource_path(catalog: Column, schema: Column, table: Column, column: Column) -> Column:
    def part(value: Column) -> Column:
        return F.when(F.length(value) > 0, sanitize_identifier(value))

    path = F.concat_ws(".", part(catalog), part(schema), part(table))
    suffix = F.concat(F.lit("("), part(column), F.lit(")"))
    return F.concat(path, F.coalesce(suffix, F.lit("")))


def validate_identifier(name: Column) -> Column:
    """Two or three dotted parts, each a plain word or in backticks."""
    plain = r"`*[a-zA-Z][a-zA-Z0-9_]*`*"
    ticked = r"`|`[^.]*`"
    part = f"(?:{plain}|{ticked})"
    return name.rlike(rf"(?s)\A{part}(?:\.{part}){{1,2}}\z")


def mask_function_name(table: Column, column: Column, kind: Column) -> Column:
    return F.concat(
        F.lit("mask_"), _plain(table), F.lit("_"), _plain(column), F.lit("_"), _plain(F.lower(kind))
    )


def filter_function_name(table: Column, policy_id: Column, index: Column) -> Column:
    parts = [_plain(c.cast("string")) for c in (table, policy_id, index)]
    return F.concat(F.lit("rf_"), parts[0], F.lit("_"), parts[1], F.lit("_"), parts[2])


def path_slug(path: Column) -> Column:
    """Name of the external location that stands for a storage path."""
    inner = F.regexp_replace(path, "^/+|/+$", "")
    for old, new in (("/", "_"), ("*", "all"), ("{USER}", "USER")):
        inner = F.replace(inner, F.lit(old), F.lit(new))
    inner = F.when(inner == "", F.lit("root")).otherwise(inner)
    return F.concat(F.lit("ext_loc_"), _plain(inner))


def map_resource_path(path: Column, override: Column, catalog: str = DEFAULT_CATALOG) -> Column:
    """Override, else the first parts of a slash path under the target catalog."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    head = F.concat_ws(".", F.slice(parts, 1, 3))
    return F.coalesce(override, F.when(F.size(parts) >= 3, head).otherwise(F.concat(F.lit(catalog + "."), head)))
