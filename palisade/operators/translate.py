"""The whole translation: every policy on its route, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from palisade.functions.ordering import numbered, ordered_text
from palisade.operators import column_masks, filters, grants, tags
from palisade.operators.config import Config
from palisade.operators.privileges import explode_principals, map_principal
from palisade.operators.resources import not_translatable, reason_lines, resource_values, routed, type_list
from palisade.operators.statements import ORDER, finish_known, head_of, raw_rows
from palisade.session import scratch_dir, write_through


@dataclass
class Inputs:
    """Relations of one translation run. ``policies`` and the tag frames carry ``scope``."""

    policies: DataFrame
    access: DataFrame
    filters: DataFrame
    masks: DataFrame
    definitions: DataFrame
    attributes: DataFrame
    resource_tags: DataFrame


def item_owners(run: Inputs) -> DataFrame:
    """(policy_key, route): policies that own an item of a plain route's kind."""
    owners = [
        (run.access.filter("kind = 'allow'"), "access"), (run.filters, "row_filter"), (run.masks, "column_mask"),
    ]
    frames = [df.select("policy_key", F.lit(route).alias("route")) for df, route in owners]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def untranslatable_rows(run: Inputs, config: Config) -> DataFrame:
    rows = not_translatable(run.policies, config, item_owners(run))
    return raw_rows(rows, "NOT_TRANSLATABLE", F.col("body"), head=head_of())


def by_route(items: DataFrame, policies: DataFrame, label: str) -> DataFrame:
    """Items with the route of their policy, written once so that a branch reads no others."""
    routes = policies.select("policy_key", "route").distinct()
    path = scratch_dir(items.sparkSession, label)
    items.join(routes, "policy_key").write.partitionBy("route").parquet(path)
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in items.schema)}, route string"
    return items.sparkSession.read.schema(schema).parquet(path)


def translate_all(run: Inputs, config: Config, write_rows: bool = True) -> DataFrame:
    """Statements of all policies; policies without any statement have no rows.

    Every route knows its first statement beforehand, so statements are made in one pass. Policies are routed once, and
    they and the items are written by route; ``write_rows=False`` keeps one lazy plan instead.
    """
    if write_rows:
        p = write_through(routed(run.policies, config), "routed")
        run = replace(
            run, policies=p, access=by_route(run.access, p, "access"), filters=by_route(run.filters, p, "filters"),
            masks=by_route(run.masks, p, "masks"),
        )
    p = run.policies
    of = lambda items, *routes: items.filter(F.col("route").isin(*routes)).drop("route") if write_rows else items
    owned = replace(
        run, access=of(run.access, "access"), filters=of(run.filters, "row_filter"), masks=of(run.masks, "column_mask")
    )
    rows = (
        filters.row_filter_statements(p, owned.filters, config)
        .unionByName(column_masks.column_mask_statements(p, owned.masks, config))
        .unionByName(untranslatable_rows(owned, config))
        .unionByName(grants.access_grants(p, owned.access, config))
        .unionByName(grants.external_location_grants(p, of(run.access, "path"), config))
        .unionByName(
            tags.tag_access_rows(
                p, of(run.access, "tag_access"), of(run.filters, "tag_access"), of(run.masks, "tag_access"),
                run.resource_tags, config, write_rows,
            )
        )
        .unionByName(tags.tag_mask_rows(p, of(run.masks, "tag_mask"), run.resource_tags, config))
    )
    return finish_known(rows)


def translate_with_tags(run: Inputs, config: Config) -> DataFrame:
    """Tag statements (phase 0) before policy statements (phase 1)."""
    first = tags.tag_statements(run.definitions, run.attributes, run.resource_tags, config)
    scoped = first.withColumn("scope", F.col("policy_key")).withColumn(
        "policy_key", F.lit(None).cast(run.policies.schema["policy_key"].dataType)
    )
    second = translate_all(run, config).join(run.policies.select("policy_key", "scope"), "policy_key")
    return scoped.withColumn("phase", F.lit(0)).unionByName(second.withColumn("phase", F.lit(1)))


def translation_errors(run: Inputs, config: Config) -> DataFrame:
    """(policy_key, message) for every policy that could not be turned into statements."""
    lost = routed(run.policies, config).filter(
        F.col("route").isin("access", "row_filter", "column_mask") & F.col("resource_path").isNull()
    )
    why = F.replace(F.replace(reason_lines(), F.lit("\n-- "), F.lit("; ")), F.lit("-- "), F.lit(""))
    types = F.concat(F.lit("resource types "), type_list(), F.lit(" have no UC equivalent."))
    message = F.concat(
        F.lit("Not translatable — '"), "name", F.lit("' (id="), "policy_id", F.lit("): "),
        F.when(F.col("route") == "access", why).otherwise(types),
    )
    unresolved = lost.join(item_owners(run), ["policy_key", "route"], "left_semi").select(
        "policy_key", message.alias("message")
    )
    return (
        unresolved.unionByName(filters.filter_errors(run.policies, run.filters, config))
        .unionByName(column_masks.mask_errors(run.policies, run.masks, config))
        .unionByName(tags.tag_mask_errors(run.policies, run.masks, run.resource_tags, config))
    )


def output_policies(run: Inputs, statements: DataFrame) -> DataFrame:
    """(policy_key, policy_type): a tag mask policy counts even without a tagged column."""
    masks = tags._tag_mask_targets(run.policies, run.masks).select(
        "policy_key", F.lit("COLUMN_MASK_TAG").alias("policy_type")
    )
    return statements.select("policy_key", "policy_type").unionByName(masks).distinct()


POLICIES_PER_TIER = 4096
ROWS_PER_TIER = 512


def number_statements(statements: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """``stmt_no`` of ``stmt_total`` per ``keys``: policies by ``place``, statements in their own order.

    The last column of ``place`` is a number. Rows are counted in three tiers: runs of policies; object and
    run of items; item and run of principals. So neither a huge policy nor an item of a million
    users is one window. The input is read once per tier: start from a written table.
    """
    run = F.floor(F.col(place[-1]) / POLICIES_PER_TIER)
    tiers = {
        "__policies": F.struct(*place[:-1], run.alias("run")),
        "__items": F.struct(
            place[-1], *[c for c in ORDER if c not in ("item_pos", "prin_pos", "acc_pos", "part")],
            F.floor(F.col("item_pos") / ROWS_PER_TIER).alias("items"),
        ),
        "__principals": F.struct("item_pos", F.floor(F.col("prin_pos") / ROWS_PER_TIER).alias("principals")),
    }
    order = [F.col(c) for c in (*place, *ORDER)]
    placed = numbered(statements.withColumns(tiers), keys, order, list(tiers), "stmt_no", "stmt_total")
    return placed.drop(*tiers).withColumns({c: F.col(c).cast("bigint") for c in ("stmt_no", "stmt_total")})


def file_statements(statements: DataFrame, policies: DataFrame) -> DataFrame:
    """Statements of ingested policies with ``source`` and their number there, in the order of the file.

    ``policies`` is that of ``documents.policy_tables``: block, section and place say where in the file a policy is.
    """
    places = policies.select(
        "policy_key", "source", F.col("block_pos").alias("file_block"), F.col("section").alias("file_section"), F.col("pos").alias("file_pos")
    )
    rows = write_through(statements.join(places, "policy_key"), "file_order")
    return number_statements(rows, ["source"], ["file_block", "file_section", "file_pos"])


# --- who an output policy is about --------------------------------------------------


def _labels(df: DataFrame, label: Column, section: int, **places: Column) -> DataFrame:
    return df.select(
        "policy_key", F.lit(section).alias("section"),
        places.get("obj_pos", F.lit(0)).cast("int").alias("obj_pos"),
        places.get("obj_key", F.lit("")).alias("obj_key"),
        "item_pos", "prin_pos", label.alias("label"),
    )


def principal_attribution(run: Inputs, config: Config) -> DataFrame:
    """Ordered (policy_key, section, obj_pos, obj_key, item_pos, prin_pos, label) rows.

    Labels are ``user:x``, ``group:x``, ``role:x``, or bare names for storage paths.
    Repeats stay, except that tag access policies list everybody once.
    """
    p = run.policies
    label = F.concat_ws(":", "ptype", "principal")
    pairs = map_principal(
        explode_principals(grants.granting_items(p, run.access, config).filter(F.size("grants") > 0)), config
    )
    stored = grants.location_items(p, run.access, config).filter(F.size("grants") > 0)
    stored = stored.select("policy_key", "item_pos", "users", "groups", "roles", F.posexplode("paths").alias("obj_pos", "path"))
    locations = map_principal(explode_principals(stored), config)
    filter_targets = filters.filter_targets(p, config).filter("size(parts) = 3").select("policy_key")
    filtered = map_principal(
        explode_principals(
            run.filters.filter("filter_expr <> ''").join(filter_targets, "policy_key"), roles=False
        ),
        config,
    )
    masked_items = run.masks.filter("mask_type <> 'MASK_NONE'")
    columns = (
        column_masks.mask_targets(p, config)
        .filter("size(parts) = 3")
        .select("policy_key", F.posexplode("columns").alias("obj_pos", "column"))
    )
    masked = map_principal(explode_principals(masked_items.join(columns, "policy_key"), roles=False), config)
    tag_masked = map_principal(
        explode_principals(
            masked_items.join(tags._of_route(p, "tag_mask").select("policy_key"), "policy_key"), roles=False
        ),
        config,
    )
    plain = (
        _labels(pairs, label, 0)
        .unionByName(_labels(locations, F.col("principal"), 0, obj_pos=F.col("obj_pos")))
        .unionByName(_labels(filtered, label, 0))
        .unionByName(_labels(masked, label, 0, obj_pos=F.col("obj_pos")))
        .unionByName(_labels(tag_masked, label, 0))
    )
    return plain.unionByName(distinct_principals(run, config))


def distinct_principals(run: Inputs, config: Config) -> DataFrame:
    """First-seen distinct labels of tag access policies.

    The table a label was seen for does not change who comes first, so it is left out.
    """
    mine = tags._of_route(run.policies, "tag_access")
    keys = mine.select("policy_key")
    reached = tags.tags_to_tables(mine, run.resource_tags).select("policy_key").distinct()
    label = F.concat_ws(":", "ptype", "principal")
    allow = run.access.filter("kind = 'allow'").join(keys, "policy_key")
    # Unmatched policies list an item's principals even when it allows nothing.
    allowed = allow.join(reached, "policy_key").filter(
        F.exists("accesses", lambda a: F.coalesce(a["is_allowed"], F.lit(True)))
    )
    unmatched = allow.join(reached, "policy_key", "left_anti")
    granted = map_principal(explode_principals(allowed.unionByName(unmatched)), config)
    filtered = map_principal(
        explode_principals(run.filters.filter("filter_expr <> ''").join(reached, "policy_key"), roles=False), config
    )
    masked = map_principal(
        explode_principals(run.masks.filter("mask_type <> 'MASK_NONE'").join(reached, "policy_key"), roles=False), config
    )
    rows = (
        _labels(granted, label, 0).unionByName(_labels(filtered, label, 1)).unionByName(_labels(masked, label, 2))
    )
    place = F.struct("section", "item_pos", "prin_pos")
    return (
        rows.groupBy("policy_key", "label").agg(F.min(place).alias("at"))
        .select(
            "policy_key", "at.section", F.lit(0).alias("obj_pos"), F.lit("").alias("obj_key"),
            "at.item_pos", "at.prin_pos", "label",
        )
    )


def principals_text(attribution: DataFrame) -> DataFrame:
    """(policy_key, principals): the ordered list as one text."""
    # Runs of principals are joined within their item, items within their run.
    finest = ["policy_key", "section", "obj_pos", "item_pos"]
    items = ordered_text(attribution, finest, ["prin_pos"], "label", ", ", "of_item", filters.principal_chunk())
    chunk = F.struct("section", "obj_pos", filters.item_chunk())
    return ordered_text(items, ["policy_key"], ["section", "obj_pos", "item_pos"], "of_item", ", ", "principals", chunk)


# --- the output policies themselves ------------------------------------------------------


def _list_text(values: Column) -> Column:
    """A list the way a script prints it: ``['a', 'b']``."""
    return F.concat(F.lit("['"), F.array_join(values, "', '"), F.lit("']"))


def output_policy_table(run: Inputs, statements: DataFrame, config: Config) -> DataFrame:
    """(policy_key, policy_id, policy_type, description, resource, principals), one row per output policy.

    A policy's own description goes before the one made from its object; paths and policies that can't be
    translated always get a made one. ``principals`` is the ordered list as text, '' for none.
    """
    kinds = output_policies(run, statements)
    paths = _list_text(F.when(F.size(resource_values("path")) > 0, resource_values("path")).otherwise(resource_values("url")))
    tag_list = F.array_join(F.array_sort(F.array_distinct(resource_values("tag"))), ", ")
    tag = F.get(resource_values("tag"), F.lit(0))
    p = routed(run.policies, config).select(
        "policy_key", "policy_id", "name", F.nullif(F.coalesce("description", F.lit("")), F.lit("")).alias("own"), "route",
        "resource_path", paths.alias("paths"), tag_list.alias("tag_list"), tag.alias("tag"), type_list().alias("types"),
    )
    kind = F.col("policy_type")
    lost = F.when(F.col("route") == "row_filter", F.lit("row filter policy")).when(
        F.col("route") == "column_mask", F.lit("column mask policy")
    ).otherwise(F.lit("policy"))
    made = (
        F.when(kind == "EXTERNAL_LOCATION", F.concat(F.lit("External Location grant for path(s): "), "paths"))
        .when(kind == "NOT_TRANSLATABLE", F.concat(F.lit("Cannot translate "), lost, F.lit(" '"), "name", F.lit("' to Unity Catalog")))
        .when(F.col("own").isNotNull(), F.col("own"))
        .when(kind == "ACCESS", F.concat(F.lit("Access policy for "), "resource_path"))
        .when(kind == "ROW_FILTER", F.concat(F.lit("Row filter for "), "resource_path"))
        .when(kind == "COLUMN_MASK", F.concat(F.lit("Column masking for "), "resource_path"))
        .when(kind == "ACCESS_TAG", F.concat(F.lit("Tag-based access for: "), "tag_list"))
        .when(kind == "COLUMN_MASK_TAG", F.concat(F.lit("Tag-based column masking for "), "tag"))
    )
    placeholder = F.concat(F.lit(f"{config.catalog}.{config.schema}.<table_with_"), "tag", F.lit(">"))
    resource = (
        F.when(kind == "EXTERNAL_LOCATION", F.concat(F.lit("EXTERNAL LOCATION "), "paths"))
        .when(kind == "NOT_TRANSLATABLE", F.col("types"))
        .when(kind == "ACCESS_TAG", F.concat(F.lit("TAG "), "tag_list"))
        .when(kind == "COLUMN_MASK_TAG", placeholder)
        .otherwise(F.col("resource_path"))
    )
    who = principals_text(principal_attribution(run, config))
    rows = kinds.join(p, "policy_key").join(who, "policy_key", "left")
    named = F.when(kind == "NOT_TRANSLATABLE", F.lit("")).otherwise(F.coalesce("principals", F.lit("")))
    return rows.select("policy_key", "policy_id", kind, made.alias("description"), resource.alias("resource"), named.alias("principals"))
