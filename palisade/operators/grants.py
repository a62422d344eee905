"""Grants on objects and on storage locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade.constants import CREATE_NOTE
from palisade.functions.identifiers import path_slug
from palisade.functions.masks import literal_map
from palisade.functions.once import computed_once
from palisade.operators.config import Config
from palisade.operators.privileges import (
    default_privilege, explode_accesses, explode_principals, location_privilege, map_principal, map_privilege,
)
from palisade.operators.resources import (
    has_resource, is_table_path, object_keyword, resource_values, routed,
)
from palisade.operators.statements import head_of, raw_rows
from palisade.sources.mappings import few_overrides

LAST = 2_147_483_647


def expand_grants(items: DataFrame, config: Config) -> DataFrame:
    """Principals x privileges of each access item: two explodes, no cross join."""
    return map_principal(explode_principals(map_privilege(explode_accesses(items), config)), config)


_GRANTS = "array<struct<acc_pos: int, privilege: string, on_schema: boolean>>"


def granting_items(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """Allowed items of plain access policies with the object and ``grants``: (acc_pos, privilege, on_schema) in order.

    CREATE on a table is one schema-level entry at the end of its item. Privileges are mapped inside the row; only where
    there are very many overrides the accesses are exploded, looked up in a join, and put together again.
    """
    targets = (
        routed(policies, config)
        .filter("route = 'access' AND resource_path IS NOT NULL")
        .select("policy_key", "resource_path", is_table_path(F.col("resource_path")).alias("is_table"), "policy_id", "name", "description")
    )
    allow = items.filter("kind = 'allow'").select("policy_key", "item_pos", "users", "groups", "roles", "accesses")
    rows = allow.join(targets, "policy_key")
    overrides = few_overrides(config.mapping, "privilege")
    if overrides is None:
        known = map_privilege(explode_accesses(allow.select("policy_key", "item_pos", "accesses")), config).groupBy("policy_key", "item_pos").agg(
            F.array_sort(F.collect_list(F.struct("acc_pos", "privilege"))).alias("mapped")
        )
        rows = rows.join(known, ["policy_key", "item_pos"], "left")
    else:
        name = lambda a: F.coalesce(F.try_element_at(literal_map(overrides), a), default_privilege(a)) if overrides else default_privilege(a)
        numbered = F.transform("accesses", lambda a, i: F.struct(i.alias("acc_pos"), a["type"].alias("type"), F.coalesce(a["is_allowed"], F.lit(True)).alias("ok")))
        used = F.filter(numbered, lambda a: a["ok"] & a["type"].isNotNull())
        rows = computed_once(rows, mapped=F.transform(used, lambda a: F.struct(a["acc_pos"], name(a["type"]).alias("privilege"))))
    on_table = lambda g: F.col("is_table") & (g["privilege"] == "CREATE")
    kept = F.transform(F.filter("mapped", lambda g: ~on_table(g)), lambda g: F.struct(
        g["acc_pos"].alias("acc_pos"), F.when(g["privilege"] == "CREATE", F.lit("CREATE TABLE")).otherwise(g["privilege"]).alias("privilege"),
        F.lit(False).alias("on_schema"),
    ))
    moved = F.array(F.struct(F.lit(LAST).alias("acc_pos"), F.lit("CREATE TABLE").alias("privilege"), F.lit(True).alias("on_schema")))
    grants = F.when(F.exists("mapped", on_table), F.concat(kept, moved)).otherwise(kept)
    return rows.withColumn("grants", F.coalesce(grants.cast(_GRANTS), F.array().cast(_GRANTS))).drop("accesses", "mapped")


def access_privileges(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """Allowed privileges of plain access policies, next to the object they are for."""
    rows = granting_items(policies, items, config).drop("policy_id", "name", "description")
    return rows.select(*[c for c in rows.columns if c != "grants"], F.inline("grants"))


def with_lead(rows: DataFrame, first_access: Column) -> DataFrame:
    """Adds ``lead``: on the first item of a policy that gives a statement, the place of its first access and the header's texts.

    Found by a minimum over items, before principals and accesses are exploded.
    """
    people = sum((F.coalesce(F.size(c), F.lit(0)) for c in ("users", "groups", "roles")), F.lit(0))
    first = rows.filter((people > 0) & first_access.isNotNull()).groupBy("policy_key").agg(
        F.min(F.struct("item_pos", first_access.alias("acc_pos"))).alias("first")
    )
    placed = rows.join(first, "policy_key", "left")
    lead = F.when(F.col("item_pos") == F.col("first.item_pos"), F.struct(F.col("first.acc_pos").alias("acc_pos"), head_of().alias("head")))
    return placed.withColumn("lead", lead).drop("first", "policy_id", "name", "description")


def _is_lead() -> Column:
    return F.coalesce(F.col("lead.acc_pos") == F.col("acc_pos"), F.lit(False))


def access_grants(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    plain = F.filter("grants", lambda g: ~g["on_schema"])
    rows = with_lead(granting_items(policies, items, config), F.get(plain, F.lit(0))["acc_pos"])
    rows = rows.select(*[c for c in rows.columns if c != "grants"], F.inline("grants"))
    rows = map_principal(explode_principals(rows), config)
    who = F.concat(F.lit(" TO `"), "principal", F.lit("`"))
    grant = F.concat(F.lit("GRANT "), "privilege", F.lit(" ON "), object_keyword(F.col("resource_path")), who)
    schema = F.substring_index("resource_path", ".", 2)
    moved = F.concat(F.lit(CREATE_NOTE + "GRANT CREATE TABLE ON SCHEMA "), schema, who)
    return raw_rows(
        rows, "ACCESS", F.when(F.col("on_schema"), moved).otherwise(grant), may_head=_is_lead() & ~F.col("on_schema"), head=F.col("lead.head")
    )


def location_items(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """Allowed items of storage policies with the policy's ``paths`` and ``grants``: (acc_pos, privilege) in order."""
    values = F.when(has_resource("path"), resource_values("path")).otherwise(resource_values("url"))
    targets = routed(policies, config).filter("route = 'path'").select("policy_key", values.alias("paths"), "policy_id", "name", "description")
    allow = items.filter("kind = 'allow'").select("policy_key", "item_pos", "users", "groups", "roles", "accesses")
    numbered = F.transform("accesses", lambda a, i: F.struct(i.alias("acc_pos"), a["type"].alias("type"), a["is_allowed"].alias("ok")))
    used = F.filter(numbered, lambda a: F.coalesce(a["ok"], F.lit(True)) & (a["type"] != ""))
    grants = F.transform(used, lambda a: F.struct(a["acc_pos"].alias("acc_pos"), location_privilege(a["type"]).alias("privilege")))
    return allow.join(targets.filter(F.size("paths") > 0), "policy_key").withColumn("grants", grants).drop("accesses")


def location_rows(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    """Paths x items x privileges x principals of storage policies, before rendering."""
    rows = with_lead(location_items(policies, items, config), F.get("grants", F.lit(0))["acc_pos"])
    rows = rows.select(*[c for c in rows.columns if c not in ("grants", "paths")], "paths", F.inline("grants"))
    rows = rows.select(*[c for c in rows.columns if c != "paths"], F.posexplode("paths").alias("obj_pos", "path"))
    return map_principal(explode_principals(rows), config)


def external_location_grants(policies: DataFrame, items: DataFrame, config: Config) -> DataFrame:
    rows = location_rows(policies, items, config).withColumn("location", path_slug(F.col("path")))
    body = F.concat(
        F.lit("GRANT "), "privilege", F.lit(" ON EXTERNAL LOCATION `"), "location",
        F.lit("` TO `"), "principal", F.lit("`"),
    )
    note = F.concat(
        F.lit("-- NOTE: Replace '"), "location", F.lit("' with the actual UC External Location name\n"),
        F.lit("-- that corresponds to the Ranger path: "), "path",
    )
    return raw_rows(
        rows, "EXTERNAL_LOCATION", body, note=note, may_head=_is_lead() & (F.col("obj_pos") == 0), head=F.col("lead.head")
    )
