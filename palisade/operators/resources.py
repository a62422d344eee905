"""Which route a policy takes and which object it governs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.constants import REASONS
from palisade.functions.identifiers import quote_identifier
from palisade.functions.masks import literal_map
from palisade.functions.once import computed_once
from palisade.operators.config import Config


def has_resource(kind: str, resources: str = "resources") -> Column:
    return F.map_contains_key(resources, kind)


def resource_values(kind: str, resources: str = "resources") -> Column:
    return F.coalesce(F.try_element_at(resources, F.lit(kind)), F.array().cast("array<string>"))


def first_value(kind: str, resources: str = "resources") -> Column:
    """First listed value; an empty text counts as absent."""
    return F.nullif(F.get(resource_values(kind, resources), F.lit(0)), F.lit(""))


def is_tag_policy() -> Column:
    return F.size(resource_values("tag")) > 0


def is_path_policy() -> Column:
    return (has_resource("path") | has_resource("url")) & ~has_resource("table")


def policy_route() -> Column:
    """Tag policies first, then storage paths, then by type."""
    return (
        F.when(is_tag_policy() & (F.col("policy_type") == "COLUMN_MASK"), F.lit("tag_mask"))
        .when(is_tag_policy(), F.lit("tag_access"))
        .when(is_path_policy(), F.lit("path"))
        .when(F.col("policy_type") == "COLUMN_MASK", F.lit("column_mask"))
        .when(F.col("policy_type") == "ROW_FILTER", F.lit("row_filter"))
        .otherwise(F.lit("access"))
    )


def resolve_resource(config: Config, tag_rule: bool = True) -> Column:
    """Governed object, or NULL when there is none. Ordered rules over first values."""
    catalog = F.lit(config.catalog)
    db, table = first_value("database"), first_value("table")
    whole = table.isNull() | (table == "*")
    schema = quote_identifier(F.coalesce(db, F.lit(config.schema)))
    function = F.get(resource_values("udf"), F.lit(0))
    rule = (
        F.when(has_resource("url") & ~has_resource("table"), F.lit(None).cast("string"))
        .when(
            (F.size(resource_values("udf")) > 0) & ~has_resource("table"),
            F.concat(F.lit("FUNCTION "), F.concat_ws(".", catalog, schema, quote_identifier(function))),
        )
        .when((db == "*") & whole, F.concat(F.lit("CATALOG "), catalog))
        .when(db.isNotNull() & whole, F.concat(F.lit("SCHEMA "), F.concat_ws(".", catalog, quote_identifier(db))))
        .when(table.rlike(r"[^a-zA-Z0-9_`\-]"), F.concat(F.lit("SCHEMA "), F.concat_ws(".", catalog, schema)))
        .when(table.isNotNull(), F.concat_ws(".", catalog, schema, quote_identifier(table)))
    )
    if not tag_rule:
        return rule
    tags = F.array_join(resource_values("tag"), "_")
    placeholder = F.concat(F.lit(f"{config.catalog}.{config.schema}.<table_with_"), tags, F.lit(">"))
    return F.when(is_tag_policy(), placeholder).otherwise(rule)


def is_table_path(resource: Column) -> Column:
    return ~resource.rlike("^(CATALOG|SCHEMA|FUNCTION|EXTERNAL LOCATION) ")


def object_keyword(resource: Column) -> Column:
    return F.when(is_table_path(resource), F.concat(F.lit("TABLE "), resource)).otherwise(resource)


#: Columns of policies that were routed before.
ROUTED = {"route", "resource_path"}


def with_route(policies: DataFrame) -> DataFrame:
    return policies if ROUTED <= set(policies.columns) else computed_once(policies, route=policy_route())


def routed(policies: DataFrame, config: Config) -> DataFrame:
    """Policies with their route and object; such policies stay as they are."""
    if ROUTED <= set(policies.columns):
        return policies
    return computed_once(policies, route=policy_route(), resource_path=resolve_resource(config, tag_rule=False))


def type_list() -> Column:
    """Resource types the way a script prints them: ``['topic', 'queue']``."""
    listed = F.concat(F.lit("['"), F.array_join(F.map_keys("resources"), "', '"), F.lit("']"))
    return F.when(F.size("resources") > 0, listed).otherwise(F.lit("[]"))


def reason_lines() -> Column:
    def reason(kind: Column) -> Column:
        generic = F.concat(F.lit("'"), kind, F.lit("' has no Unity Catalog equivalent."))
        return F.concat(F.lit("-- "), F.coalesce(F.try_element_at(literal_map(REASONS), kind), generic))

    return F.array_join(F.transform(F.map_keys("resources"), reason), "\n")


def not_translatable(policies: DataFrame, config: Config, present: DataFrame) -> DataFrame:
    """Policies of the three plain routes with items but without an object.

    ``present`` is (policy_key, route): which policies own an item of the route's kind.
    """
    unresolved = routed(policies, config).filter(
        F.col("route").isin("access", "row_filter", "column_mask") & F.col("resource_path").isNull()
    )
    title = F.concat(
        F.lit("-- NOT TRANSLATABLE: Policy '"), "name", F.lit("' (id="), "policy_id", F.lit(")\n")
    )
    generic = F.concat(F.lit("-- Reason: resource types "), type_list(), F.lit(" have no Unity Catalog equivalent."))
    body = F.concat(title, F.when(F.col("route") == "access", reason_lines()).otherwise(generic))
    rows = unresolved.join(present, ["policy_key", "route"], "left_semi")
    return rows.select(
        "policy_key", F.lit("NOT_TRANSLATABLE").alias("policy_type"), body.alias("body"), "policy_id", "name", "description"
    )
