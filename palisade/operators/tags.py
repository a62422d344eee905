"""Tag metadata and tag-driven policies.

Tag lookups are equi-joins on (scope, tag). ``scope`` says which policies a set of
tags belongs to: a file's own name, or '' for one catalog-wide set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palisade import constants as C
from palisade.functions.identifiers import filter_function_name, quote_identifier
from palisade.functions.masks import RESOURCE_FALLBACK, TAG_FALLBACK
from palisade.functions.ordering import ordered_text, ordered_text_of_any
from palisade.functions.text import case_body, filter_columns, group_test, user_test
from palisade.operators.column_masks import mask_statement_pair, pass_through
from palisade.operators.config import Config
from palisade.operators.filters import filter_statement_pair, principal_chunk, principals_joined
from palisade.operators.grants import expand_grants
from palisade.operators.privileges import explode_principals, map_principal
from palisade.operators.resources import resource_values, with_route
from palisade.operators.statements import DENIES, FILTERS, GRANTS, HEAD_TYPE, MASKS, finish, head_of, raw_rows
from palisade.session import write_through

TABLES, COLUMNS, ORPHANS = 0, 1, 2


def _parts(path: str = "path") -> Column:
    return F.split(path, r"\.")


def _table_name(table_key: Column, config: Config) -> Column:
    parts = F.split(table_key, r"\.")
    return F.concat_ws(".", F.lit(config.catalog), quote_identifier(F.get(parts, F.lit(0))), quote_identifier(F.get(parts, F.lit(1))))


# --- tag catalog ----------------------------------------------------------------


def split_tag_levels(resource_tags: DataFrame) -> DataFrame:
    """Two-part paths tag a table, three-part paths a column; others are dropped."""
    size = F.size(_parts())
    return resource_tags.filter(size.isin(2, 3)).select(
        "scope",
        F.when(size == 2, F.lit(TABLES)).otherwise(F.lit(COLUMNS)).alias("section"),
        F.substring_index("path", ".", 2).alias("table_key"),
        F.when(size == 3, F.get(_parts(), F.lit(2))).otherwise(F.lit("")).alias("column"),
        "path_pos", "tag_pos", "tag",
    )


def path_findings(resource_tags: DataFrame) -> DataFrame:
    """Paths that tag neither a table nor a column, and wildcard columns."""
    size = F.size(_parts())
    message = F.when(~size.isin(2, 3), F.lit("Resource tag path needs two or three parts")).when(
        (size == 3) & (F.get(_parts(), F.lit(2)) == "*"), F.lit("Resource tag on every column of a table")
    )
    return resource_tags.select("scope", "path", message.alias("message")).filter("message IS NOT NULL").distinct()


def tag_pairs(tagged: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pair_key, pair_value, seen): each tag as ``tag = true`` and then its
    attributes, in lower case; the first use of a key wins."""
    own = tagged.select(
        *keys, "path_pos", "tag_pos", F.lit(-1).alias("attr_pos"),
        F.lower("tag").alias("pair_key"), F.lit("true").alias("pair_value"),
    )
    described = tagged.join(attributes, ["scope", "tag"]).select(
        *keys, "path_pos", "tag_pos", F.col("attr_pos").cast("int"),
        F.lower("attr_key").alias("pair_key"), F.col("attr_value").alias("pair_value"),
    )
    place = F.struct("path_pos", "tag_pos", "attr_pos")
    return own.unionByName(described).groupBy(*keys, "pair_key").agg(
        F.min_by("pair_value", place).alias("pair_value"), F.min(place).alias("seen")
    )


def tag_catalog(resource_tags: DataFrame, attributes: DataFrame) -> DataFrame:
    """SET TAGS as a table: (scope, section, table_key, column, pair_key, pair_value, seen)."""
    return tag_pairs(split_tag_levels(resource_tags), attributes, ["scope", "section", "table_key", "column"])


def merge_tag_pairs(tagged: DataFrame, attributes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pairs): the text inside ``SET TAGS ( )``."""
    rows = tag_pairs(tagged, attributes, keys).select(
        *keys, "seen", F.concat(F.lit("'"), "pair_key", F.lit("' = '"), "pair_value", F.lit("'")).alias("pair")
    )
    return ordered_text_of_any(rows, keys, ["seen"], "pair", ", ", "pairs")


def orphan_tags(definitions: DataFrame, resource_tags: DataFrame) -> DataFrame:
    """Defined tags that no resource carries."""
    return definitions.join(resource_tags, ["scope", "tag"], "left_anti").select("scope", "tag").distinct()


def tag_statements(
    definitions: DataFrame, attributes: DataFrame, resource_tags: DataFrame, config: Config
) -> DataFrame:
    """SET TAGS for tables, then columns, then a TODO per orphan tag.

    ``policy_key`` of the result is the scope.
    """
    levels = ["scope", "section", "table_key", "column"]
    set_tags = merge_tag_pairs(split_tag_levels(resource_tags), attributes, levels)
    table = _table_name(F.col("table_key"), config)
    column = F.when(F.col("section") == COLUMNS, F.concat(F.lit(" ALTER COLUMN "), "column")).otherwise(F.lit(""))
    tagged = raw_rows(
        set_tags.withColumn("policy_key", F.col("scope")),
        "TAG",
        F.concat(F.lit("ALTER TABLE "), table, column, F.lit(" SET TAGS ("), "pairs", F.lit(")")),
        obj_key=F.col("table_key"), obj_sub=F.col("column"),
    )
    lost = orphan_tags(definitions, resource_tags).withColumns({"path_pos": F.lit(0), "tag_pos": F.lit(0)})
    todo = merge_tag_pairs(lost, attributes, ["scope", "tag"])
    orphans = raw_rows(
        todo.withColumn("policy_key", F.col("scope")),
        "TAG",
        F.concat(
            F.lit("-- TODO: No resourceTags found for tag '"), "tag",
            F.lit(
                "'.\n-- Apply this tag to the relevant table(s)/column(s):\n"
                f"ALTER TABLE {config.catalog}.{config.schema}.<table_name> SET TAGS ("
            ),
            "pairs", F.lit(")"),
        ),
        section=ORPHANS, obj_key=F.col("tag"),
    )
    rows = tagged.unionByName(orphans)
    heads = rows.select("policy_key").distinct().select(
        "policy_key", F.lit("").alias("policy_id"), F.lit(C.TAG_HEADER_NAME).alias("name"),
        F.lit(C.TAG_HEADER_DESCRIPTION).alias("description"),
    )
    return finish(rows, heads)


# --- which tables and columns a policy's tags reach --------------------------------


def policy_tags(policies: DataFrame) -> DataFrame:
    """(policy_key, scope, tag), distinct per policy; arrays are in the row, so no shuffle."""
    return policies.select("policy_key", "scope", F.explode(F.array_distinct(resource_values("tag"))).alias("tag"))


def tags_to_tables(policies: DataFrame, resource_tags: DataFrame) -> DataFrame:
    """(policy_key, table_key, tags): tables with at least one of the policy's tags."""
    on_table = (
        resource_tags.filter(F.size(_parts()) >= 2)
        .select("scope", "tag", F.substring_index("path", ".", 2).alias("table_key"))
        .distinct()
    )
    return (
        policy_tags(policies)
        .join(on_table, ["scope", "tag"])
        .groupBy("policy_key", "table_key")
        .agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    )


def reached_tables(policies: DataFrame, resource_tags: DataFrame) -> DataFrame:
    """(policy_key, table_key, first_table): ``first_table`` marks each policy's first in name order."""
    tables = tags_to_tables(policies, resource_tags).select("policy_key", "table_key")
    first = tables.groupBy("policy_key").agg(F.min("table_key").alias("first"))
    return tables.join(first, "policy_key").select(
        "policy_key", "table_key", (F.col("table_key") == F.col("first")).alias("first_table")
    )


def tag_to_columns(resource_tags: DataFrame, config: Config) -> DataFrame:
    """(scope, tag, db, tbl, column, path_pos); here two parts mean table.column."""
    parts, size = _parts(), F.size(_parts())
    rows = resource_tags.filter(size.isin(2, 3)).select(
        "scope", "tag", "path_pos",
        F.when(size == 3, F.get(parts, F.lit(0))).otherwise(F.lit(config.schema)).alias("db"),
        F.get(parts, size - 2).alias("tbl"),
        F.get(parts, size - 1).alias("column"),
    )
    # A tag listed twice on a path still names its column once.
    return rows.filter("column <> '*'").distinct()


def tagged_columns_of_table(policies: DataFrame, resource_tags: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """(policy_key, table_key, column, path_pos) for every table the policy reaches;
    ``<column>`` where only the table itself is tagged. ``tables`` are these tables where they are known."""
    columns = (
        policy_tags(policies)
        .join(resource_tags.filter(F.size(_parts()) == 3), ["scope", "tag"])
        .groupBy("policy_key", F.substring_index("path", ".", 2).alias("table_key"), F.get(_parts(), F.lit(2)).alias("column"))
        .agg(F.min("path_pos").alias("path_pos"))
    )
    tables = reached_tables(policies, resource_tags) if tables is None else tables
    return tables.join(columns, ["policy_key", "table_key"], "left").select(
        *tables.columns,
        F.coalesce("column", F.lit("<column>")).alias("column"),
        F.coalesce("path_pos", F.lit(0)).alias("path_pos"),
    )


# --- tag access policies ---------------------------------------------------------------


def _of_route(policies: DataFrame, route: str) -> DataFrame:
    return with_route(policies).filter(F.col("route") == route)


def _item_lead() -> Column:
    """Place of an item's first allowed access, NULL for an item that grants nothing."""
    allowed = lambda a: F.coalesce(a["is_allowed"], F.lit(True)) & a["type"].isNotNull()
    numbered = F.transform("accesses", lambda a, i: F.struct(i.alias("acc_pos"), allowed(a).alias("ok")))
    first = F.get(F.filter(numbered, lambda a: a["ok"]), F.lit(0))["acc_pos"]
    return F.when(F.size(F.concat("users", "groups", "roles")) > 0, first)


def _leads(
    mine: DataFrame, tables: DataFrame, access: DataFrame, filters: DataFrame, masks: DataFrame, resource_tags: DataFrame
) -> DataFrame:
    """(policy_key, lead): section, item and access of the first statement of each tag access policy.

    It is always about the first table and the first principal, so it follows from the items before they meet tables.
    """

    def at(section: int, item_pos: Column, acc_pos: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), item_pos.cast("bigint").alias("item_pos"), acc_pos.cast("int").alias("acc_pos")
        ).alias("lead")

    keys, zero = mine.select("policy_key"), F.lit(0)
    reached = tables.filter("first_table").select("policy_key", "table_key")
    grants = access.filter("kind = 'allow'").withColumn("acc_pos", _item_lead()).filter("acc_pos IS NOT NULL")
    early = (
        grants.select("policy_key", at(GRANTS, F.col("item_pos"), F.col("acc_pos"))).join(keys, "policy_key", "left_semi")
        .unionByName(access.filter("kind = 'deny'").select("policy_key", at(DENIES, zero, zero)).join(keys, "policy_key", "left_semi"))
        .unionByName(
            filters.filter("filter_expr <> ''").select("policy_key", at(FILTERS, F.col("item_pos"), zero)).join(reached, "policy_key", "left_semi")
        )
        .groupBy("policy_key").agg(F.min("lead").alias("lead"))
    )
    rest = reached.join(masks.select("policy_key").distinct(), "policy_key", "left_semi").join(early, "policy_key", "left_anti")
    places = tagged_columns_of_table(mine.join(rest, "policy_key", "left_semi"), resource_tags, rest)
    late = places.groupBy("policy_key").agg(F.min(at(MASKS, F.col("path_pos"), zero)).alias("lead"))
    return early.unionByName(late)


def _with_leads(mine: DataFrame, tables: DataFrame, leads: DataFrame) -> DataFrame:
    """(policy_key, tags, table_key, first_table, lead): one row per table, one without a table for policies that reach none.

    ``lead`` is set on the first row of a policy and holds what its header says as well.
    """
    headed = F.struct("lead.*", head_of().alias("head"))
    known = mine.join(leads, "policy_key", "left").select(
        "policy_key", F.array_sort(F.array_distinct(resource_values("tag"))).alias("tags"),
        F.when(F.col("lead").isNotNull(), headed).alias("lead"),
    )
    rows = _in_groups(known.join(tables, "policy_key", "left"))
    return rows.withColumn("lead", F.when(F.coalesce("first_table", F.lit(True)), F.col("lead")))


#: Tables that a row meets in one task, about.
TABLES_PER_GROUP = 4


def _in_groups(reached: DataFrame) -> DataFrame:
    """Adds ``table_groups``, how many groups the tables of a policy are dealt out to, and ``table_group``."""
    counts = reached.groupBy("policy_key").agg(F.ceil(F.count("table_key") / TABLES_PER_GROUP).cast("int").alias("table_groups"))
    groups = F.greatest("table_groups", F.lit(1))
    dealt = F.coalesce(F.pmod(F.hash("table_key"), groups), F.lit(0))
    dealt = F.when(F.col("table_key").isNull(), F.lit(0)).otherwise(dealt)
    return reached.join(counts, "policy_key").withColumns({"table_groups": groups, "table_group": dealt})


def _groups_of(reached: DataFrame) -> DataFrame:
    """(policy_key, table_groups), one row per policy."""
    return reached.filter("coalesce(first_table, true)").groupBy("policy_key").agg(F.max("table_groups").alias("table_groups"))


def _per_group(rows: DataFrame) -> DataFrame:
    """Rows once per group of tables, so that what they become is made in as many tasks as its size needs."""
    return rows.withColumn("table_group", F.explode(F.sequence(F.lit(0), F.col("table_groups") - 1))).drop("table_groups")


def _headed(section: int, item_pos: Column, *others: Column) -> Column:
    """The header of the row a lead is about."""
    found = (F.col("lead.section") == section) & F.col("lead.item_pos").eqNullSafe(item_pos)
    for other in others:
        found = found & other
    return F.when(F.coalesce(found, F.lit(False)), F.col("lead.head"))


def _unled(policies: DataFrame, resource_tags: DataFrame) -> DataFrame:
    """Tag access policies and the tables they reach, without leads."""
    mine = _of_route(policies, "tag_access").select("policy_key", "scope", "resources")
    known = mine.select("policy_key", F.array_sort(F.array_distinct(resource_values("tag"))).alias("tags"))
    lead = F.lit(None).cast(f"struct<section: int, item_pos: bigint, acc_pos: int, head: {HEAD_TYPE}>")
    return _in_groups(known.join(reached_tables(mine, resource_tags), "policy_key", "left")).withColumn("lead", lead)


def _tag_grant_rows(items: DataFrame, reached: DataFrame, config: Config) -> DataFrame:
    """Raw grants of tag access policies in one pass: per tagged table, else a placeholder.

    Items of other policies are left out before anything is exploded.
    """
    allow = items.filter("kind = 'allow'").join(_groups_of(reached), "policy_key")
    rows = _per_group(expand_grants(allow, config)).join(reached.drop("table_groups"), ["policy_key", "table_group"])
    matched = F.col("table_key").isNotNull()
    default = F.lit(f"{config.catalog}.{config.schema}")
    placeholder = F.concat(default, F.lit(".<table_with_"), F.array_join("tags", "_"), F.lit(">"))
    note = F.concat(
        F.lit("-- NOTE: No resourceTags metadata found for tag(s): "), F.array_join("tags", ", "),
        F.lit(".\n-- Replace the placeholder with the actual table(s) that carry these tags.\n"),
    )
    schema = F.concat(F.lit(config.catalog + "."), F.substring_index("table_key", ".", 1))
    who = F.concat(F.lit(" TO `"), "principal", F.lit("`"))
    grant = F.concat(
        F.when(matched, F.lit("")).otherwise(note), F.lit("GRANT "), "privilege", F.lit(" ON TABLE "),
        F.when(matched, _table_name(F.col("table_key"), config)).otherwise(placeholder), who,
    )
    create = F.concat(
        F.lit(C.TAG_CREATE_NOTE + "GRANT CREATE TABLE ON SCHEMA "), F.when(matched, schema).otherwise(default), who
    )
    body = F.when(F.col("privilege") == "CREATE", create).otherwise(grant)
    return raw_rows(
        rows, "ACCESS_TAG", body, section=GRANTS, obj_key=F.coalesce(F.col("table_key"), F.lit("")),
        head=_headed(GRANTS, F.col("item_pos"), F.col("prin_pos") == 0, F.col("lead.acc_pos") == F.col("acc_pos")),
    )


def tag_grants(policies: DataFrame, items: DataFrame, resource_tags: DataFrame, config: Config) -> DataFrame:
    """Grants on every table that carries one of the policy's tags."""
    return _tag_grant_rows(items, _unled(policies, resource_tags).filter("table_key IS NOT NULL"), config)


def tag_grants_fallback(
    policies: DataFrame, items: DataFrame, resource_tags: DataFrame, config: Config
) -> DataFrame:
    """Placeholder grants of policies whose tags are on no table."""
    return _tag_grant_rows(items, _unled(policies, resource_tags).filter("table_key IS NULL"), config)


def deny_digest(policies: DataFrame, items: DataFrame) -> DataFrame:
    """(policy_key, digest): one comment per tag policy with the denied users and groups."""
    deny = items.filter("kind = 'deny'").join(
        _of_route(policies, "tag_access").select("policy_key"), "policy_key", "left_semi"
    )
    lines = explode_principals(deny, roles=False).withColumn(
        "line", F.concat(F.lit("--   DENY "), "ptype", F.lit(": "), "pname")
    )
    listed = principals_joined(lines, deny.drop("roles"), ["item_pos", "prin_pos"], "line", "\n", "lines")
    return (
        deny.select("policy_key").distinct().join(listed, "policy_key", "left")
        .select("policy_key", F.concat_ws("\n", F.lit(C.DENY_NOTE), "lines").alias("digest"))
    )


def tag_filter_rows(
    policies: DataFrame, items: DataFrame, resource_tags: DataFrame, config: Config, reached: DataFrame | None = None
) -> DataFrame:
    """Row filters of tag policies: one function per table and item."""
    mine = _of_route(policies, "tag_access")
    reached = _unled(policies, resource_tags) if reached is None else reached
    reached = reached.filter("table_key IS NOT NULL")
    used = items.filter("filter_expr <> ''").join(mine.select("policy_key", "policy_id"), "policy_key").join(_groups_of(reached), "policy_key")
    clauses = map_principal(explode_principals(used, roles=False), config).withColumn(
        "clause",
        F.concat(
            F.when(F.col("ptype") == "user", user_test(F.col("principal"))).otherwise(group_test(F.col("principal"))),
            "filter_expr",
        ),
    )
    whens = ordered_text(clauses, ["policy_key", "item_pos"], ["prin_pos"], "clause", "\n", "whens", principal_chunk())
    tables = reached.select("policy_key", "table_group", "table_key", "lead")
    parts = F.split("table_key", r"\.")
    rows = (
        used.select("policy_key", "policy_id", "item_pos", "filter_expr", "table_groups")
        .join(whens, ["policy_key", "item_pos"], "left")
        .withColumn("columns", F.array_join(filter_columns(F.col("filter_expr"), session_words=False), ", "))
        .withColumn(
            "filter_body",
            F.when(F.col("whens").isNotNull(), case_body(F.col("whens"), F.lit("TRUE"))).otherwise(F.col("filter_expr")),
        )
        .transform(_per_group)
        .join(tables, ["policy_key", "table_group"])
        .withColumn(
            "function",
            F.concat_ws(
                ".", F.lit(config.catalog), F.get(parts, F.lit(0)),
                filter_function_name(F.get(parts, F.lit(1)), F.col("policy_id"), F.col("item_pos")),
            ),
        )
    )
    table = _table_name(F.col("table_key"), config)
    return filter_statement_pair(
        rows, "ACCESS_TAG", table, section=FILTERS, obj_key=F.col("table_key"),
        head=_headed(FILTERS, F.col("item_pos"), F.col("part") == 0),
    )


def tag_mask_supplements(
    policies: DataFrame, items: DataFrame, resource_tags: DataFrame, config: Config, reached: DataFrame | None = None
) -> DataFrame:
    """Column masks that a tag access policy carries along."""
    mine = _of_route(policies, "tag_access")
    reached = _unled(policies, resource_tags) if reached is None else reached
    tables = reached.filter("table_key IS NOT NULL").select("policy_key", "table_key", "lead")
    masks = items.join(mine.select("policy_key"), "policy_key", "left_semi")
    real = F.when(F.col("mask_type") != "MASK_NONE", F.col("item_pos"))
    kinds = masks.groupBy("policy_key").agg(
        F.coalesce(
            F.min_by(F.when(real.isNotNull(), F.col("mask_type")), real), F.lit(RESOURCE_FALLBACK)
        ).alias("mask_kind")
    )
    per_policy = kinds.join(pass_through(masks, config), "policy_key", "left")
    parts = F.split("table_key", r"\.")
    rows = tagged_columns_of_table(mine, resource_tags, tables).join(per_policy, "policy_key")
    return mask_statement_pair(
        rows, "ACCESS_TAG", RESOURCE_FALLBACK, F.concat(F.lit(config.catalog + "."), F.get(parts, F.lit(0))), F.get(parts, F.lit(1)),
        _table_name(F.col("table_key"), config), config,
        section=MASKS, obj_key=F.col("table_key"), item_pos=F.col("path_pos"), obj_sub=F.lit(""),
        head=_headed(MASKS, F.col("path_pos"), F.col("part") == 0),
    )


def tag_access_rows(
    policies: DataFrame, access: DataFrame, filters: DataFrame, masks: DataFrame,
    resource_tags: DataFrame, config: Config, write: bool = True,
) -> DataFrame:
    """Grants, deny digest, then the row filters and masks of tag access policies.

    Rows carry their header. The tables that policies reach are written once, or all is one lazy plan (``write=False``).
    """
    mine = _of_route(policies, "tag_access").select("policy_key", "scope", "resources", "policy_id", "name", "description")
    tables = reached_tables(mine, resource_tags)
    if write:
        tables = write_through(tables, "tables")
    leads = _leads(mine, tables, access, filters, masks, resource_tags)
    reached = _with_leads(mine, tables, leads)
    if write:
        reached = write_through(reached, "reached")
    lead = reached.filter("coalesce(first_table, true)").select("policy_key", "lead")
    digest = deny_digest(policies, access).join(lead, "policy_key")
    denies = raw_rows(digest, "ACCESS_TAG", F.col("digest"), section=DENIES, head=_headed(DENIES, F.lit(0)))
    return (
        _tag_grant_rows(access, reached, config)
        .unionByName(denies)
        .unionByName(tag_filter_rows(policies, filters, resource_tags, config, reached))
        .unionByName(tag_mask_supplements(policies, masks, resource_tags, config, reached))
    )


# --- tag mask policies -------------------------------------------------------------------


def _tag_mask_targets(policies: DataFrame, masks: DataFrame) -> DataFrame:
    """Tag mask policies with their first tag and the first mask type that really masks."""
    mine = _of_route(policies, "tag_mask").select(
        "policy_key", "scope", head_of().alias("head"), F.get(resource_values("tag"), F.lit(0)).alias("tag")
    )
    real = F.when((F.col("mask_type") != "MASK_NONE") & (F.col("mask_type") != ""), F.col("item_pos"))
    kinds = masks.groupBy("policy_key").agg(
        F.min_by(F.when(real.isNotNull(), F.col("mask_type")), real).alias("mask_kind")
    )
    return mine.join(kinds, "policy_key")


def tag_mask_rows(policies: DataFrame, masks: DataFrame, resource_tags: DataFrame, config: Config) -> DataFrame:
    """Mask functions for every column that carries the policy's first tag."""
    targets = _tag_mask_targets(policies, masks).filter("mask_kind IS NOT NULL")
    open_to = pass_through(
        masks.join(targets.select("policy_key"), "policy_key", "left_semi"), config, map_users=False
    )
    columns = tag_to_columns(resource_tags, config)
    # Columns of a tag are dealt out to groups, as tables are.
    sizes = columns.groupBy("scope", "tag").agg(
        F.min(F.struct("path_pos")).alias("first"), F.ceil(F.count(F.lit(1)) / TABLES_PER_GROUP).cast("int").alias("table_groups")
    )
    columns = columns.join(sizes, ["scope", "tag"]).withColumns({
        "is_first": F.struct("path_pos") == F.col("first"),
        "table_group": F.pmod(F.hash("db", "tbl", "column", "path_pos"), F.col("table_groups")),
    }).drop("first", "table_groups")
    led = targets.join(open_to, "policy_key", "left").join(sizes.drop("first"), ["scope", "tag"])
    rows = _per_group(led).join(columns, ["scope", "tag", "table_group"])
    prefix = F.concat_ws(".", F.lit(config.catalog), F.col("db"))
    return mask_statement_pair(
        rows, "COLUMN_MASK_TAG", TAG_FALLBACK, prefix, F.col("tbl"), F.concat_ws(".", prefix, F.col("tbl")), config,
        item_pos=F.col("path_pos"), head=F.when(F.col("is_first") & (F.col("part") == 0), F.col("head")),
    )


def tag_mask_errors(policies: DataFrame, masks: DataFrame, resource_tags: DataFrame, config: Config) -> DataFrame:
    """Tag mask policies without a tagged column, or without a type that masks."""
    targets = _tag_mask_targets(policies, masks)
    columns = tag_to_columns(resource_tags, config).select("scope", "tag").distinct().withColumn("tagged", F.lit(True))
    message = F.when(
        F.col("tagged").isNull(),
        F.concat(
            F.lit("Tag-based policy for tag '"), "tag",
            F.lit(
                "'. No tagged resources found in metadata. "
                "Query your data catalog to find tables/columns with this tag."
            ),
        ),
    ).when(F.col("mask_kind").isNull(), F.concat(F.lit("No masking type for tag '"), "tag", F.lit("'")))
    return (
        targets.join(columns, ["scope", "tag"], "left")
        .select("policy_key", message.alias("message"))
        .filter("message IS NOT NULL")
    )
