"""Queries for privileges, resources, joins, statements and tags."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade import constants as C
from palisade.functions import identifiers as ids
from palisade.operators import column_masks, filters, grants, resources, statements, tags, translate
from palisade.operators.config import Config
from palisade.operators.privileges import (
    explode_accesses, explode_principals, location_privilege, map_principal, map_privilege,
)
from palisade.plans import fixtures as fx
from palisade.plans import oracle as o
from palisade.plans.registry import query
from palisade.sources.mappings import with_override

POL = "policy_key, policy_type"


def config(spark: SparkSession, sf_dir: str) -> Config:
    return Config(mapping=fx.mapping(spark, sf_dir))


# --- policies and resources --------------------------------------------------------------


@query("infer_policy_type", f"SELECT {POL} FROM pol")
def infer_policy_type(spark, sf_dir):
    return fx.policies_frame(spark, sf_dir).select("policy_key", "policy_type")


@query("policies_by_type", "SELECT policy_key, name FROM pol WHERE policy_type = 'ROW_FILTER'")
def policies_by_type(spark, sf_dir):
    return fx.policies_frame(spark, sf_dir).filter("policy_type = 'ROW_FILTER'").select("policy_key", "name")


@query("is_path_policy", "SELECT policy_key, (path1 IS NOT NULL OR coalesce(other_resource = 'url', false)) AND tbl IS NULL AS is_path FROM base")
def is_path_policy(spark, sf_dir):
    policies = fx.with_resources(fx.fx_policies(spark, sf_dir))
    return policies.select("policy_key", resources.is_path_policy().alias("is_path"))


@query("route_policy", "SELECT policy_key, route FROM pol")
def route_policy(spark, sf_dir):
    return fx.policies_frame(spark, sf_dir).select("policy_key", resources.policy_route().alias("route"))


_TAGGED = "CASE WHEN tag1 IS NULL THEN res ELSE 'main.ranger_migration.<table_with_' || tag1 || coalesce('_' || tag2, '') || '>' END"


@query("resolve_resource", f"SELECT policy_key, {_TAGGED} AS resource_path FROM (SELECT *, {o.RES} AS res FROM base) t")
def resolve_resource(spark, sf_dir):
    policies = fx.with_resources(fx.fx_policies(spark, sf_dir))
    return policies.select("policy_key", resources.resolve_resource(Config()).alias("resource_path"))


@query(
    "object_keyword",
    f"""SELECT policy_key, CASE WHEN split_part(res, ' ', 1) IN ('CATALOG', 'SCHEMA', 'FUNCTION') THEN res ELSE 'TABLE ' || res END AS grant_on
    FROM (SELECT policy_key, {o.RES} AS res FROM base) t WHERE res IS NOT NULL""",
)
def object_keyword(spark, sf_dir):
    policies = fx.with_resources(fx.fx_policies(spark, sf_dir))
    path = resources.resolve_resource(Config(), tag_rule=False)
    return policies.select("policy_key", path.alias("p")).filter("p IS NOT NULL").select(
        "policy_key", resources.object_keyword(F.col("p")).alias("grant_on")
    )


@query("not_translatable", o.finish("r_nt"))
def not_translatable(spark, sf_dir):
    run = fx.inputs(spark, sf_dir)
    return statements.finish_known(translate.untranslatable_rows(run, Config()))


@query("path_slug", f"SELECT policy_key, path, {o.LOCATION} AS location FROM (SELECT policy_key, unnest([path1, path2]) AS path FROM base) t WHERE path IS NOT NULL")
def path_slug(spark, sf_dir):
    paths = fx.fx_policies(spark, sf_dir).select("policy_key", F.explode(F.array("path1", "path2")).alias("path"))
    return paths.filter("path IS NOT NULL").select("policy_key", "path", ids.path_slug(F.col("path")).alias("location"))


# --- privileges and principals ----------------------------------------------------------------


@query("allowed_accesses", "SELECT policy_key, kind, item_pos, acc_pos, access_type FROM acc")
def allowed_accesses(spark, sf_dir):
    items = fx.access_items(fx.fx_items(spark, sf_dir))
    return explode_accesses(items).select("policy_key", "kind", "item_pos", "acc_pos", "access_type")


@query("explode_principals", "SELECT policy_key, item_pos, prin_pos, ptype, pname FROM who")
def explode_principals_query(spark, sf_dir):
    items = fx.access_items(fx.fx_items(spark, sf_dir))
    return explode_principals(items).select("policy_key", "item_pos", "prin_pos", "ptype", "pname")


@query("extract_principals", "SELECT policy_key, item_pos, prin_pos, ptype, pname FROM who WHERE ptype <> 'role'")
def extract_principals(spark, sf_dir):
    items = fx.access_items(fx.fx_items(spark, sf_dir))
    return explode_principals(items, roles=False).select("policy_key", "item_pos", "prin_pos", "ptype", "pname")


@query("map_privilege", "SELECT policy_key, item_pos, acc_pos, access_type, privilege FROM acc")
def map_privilege_query(spark, sf_dir):
    rows = explode_accesses(fx.access_items(fx.fx_items(spark, sf_dir)))
    return map_privilege(rows, config(spark, sf_dir)).select(
        "policy_key", "item_pos", "acc_pos", "access_type", "privilege"
    )


@query(
    "map_external_privilege",
    f"SELECT policy_key, item_pos, acc_pos, {o.case_map('lower(access_type)', o.C.LOCATION_PRIVILEGES, 'upper(access_type)')} AS privilege FROM acc",
)
def map_external_privilege(spark, sf_dir):
    rows = explode_accesses(fx.access_items(fx.fx_items(spark, sf_dir)))
    return rows.select("policy_key", "item_pos", "acc_pos", location_privilege(F.col("access_type")).alias("privilege"))


@query("remap_create", "SELECT policy_key, item_pos, acc_pos, privilege, on_schema FROM agrants")
def remap_create(spark, sf_dir):
    rows = grants.access_privileges(
        fx.policies_frame(spark, sf_dir), fx.access_items(fx.fx_items(spark, sf_dir)), config(spark, sf_dir)
    )
    return rows.select("policy_key", "item_pos", "acc_pos", "privilege", "on_schema")


@query("map_principal", "SELECT policy_key, item_pos, prin_pos, principal FROM who")
def map_principal_query(spark, sf_dir):
    rows = explode_principals(fx.access_items(fx.fx_items(spark, sf_dir)))
    return map_principal(rows, config(spark, sf_dir)).select("policy_key", "item_pos", "prin_pos", "principal")


_SLASHED = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_partkey % 5 WHEN 0 THEN '/sales/orders' WHEN 1 THEN 'sales'
  WHEN 2 THEN '/hr/people/salary/' WHEN 3 THEN '/a/b/c/d' ELSE '/s' || CAST(l_suppkey AS STRING) || '/t' END AS path"""


@query(
    "map_resource_path",
    f"""SELECT path, count(*) AS n, any_value(coalesce(m.target_value, CASE len(p) WHEN 1 THEN 'main.' || p[1] WHEN 2 THEN 'main.' || p[1] || '.' || p[2]
      ELSE p[1] || '.' || p[2] || '.' || p[3] END)) AS target
    FROM (SELECT path, string_split(trim(path, '/'), '/') AS p FROM ({_SLASHED} FROM lineitem) a) t
    LEFT JOIN map_ m ON m.mapping_type = 'resource' AND m.source_value = path GROUP BY path""",
)
def map_resource_path(spark, sf_dir):
    rows = spark.sql(_SLASHED + " FROM {lineitem}", lineitem=fx.table(spark, sf_dir, "lineitem"))
    # The lookup depends on the path alone, so the lines are counted per path first.
    paths = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    mapped = with_override(paths, fx.mapping(spark, sf_dir), "resource", "path", "o", F.lit(None).cast("string"))
    return mapped.select("path", "n", ids.map_resource_path(F.col("path"), F.col("o")).alias("target"))


@query(
    "override_lookup",
    """SELECT mapping_type, count(*) AS n, count(target_value) AS overridden FROM (
      SELECT 'principal' AS mapping_type, m.target_value FROM who0 LEFT JOIN map_ m ON m.mapping_type = 'principal' AND m.source_value = w.n
      UNION ALL SELECT 'privilege', m.target_value FROM (SELECT a1 AS t FROM items WHERE coalesce(ok1, true)
        UNION ALL SELECT a2 FROM items WHERE a2 IS NOT NULL) a LEFT JOIN map_ m ON m.mapping_type = 'privilege' AND m.source_value = t) x GROUP BY mapping_type""",
)
def override_lookup(spark, sf_dir):
    items, m = fx.access_items(fx.fx_items(spark, sf_dir)), fx.mapping(spark, sf_dir)
    none = F.lit(None).cast("string")
    people = with_override(explode_principals(items), m, "principal", "pname", "t", none)
    rights = with_override(explode_accesses(items), m, "privilege", "access_type", "t", none)
    both = people.select(F.lit("principal").alias("mapping_type"), "t").unionByName(
        rights.select(F.lit("privilege").alias("mapping_type"), "t")
    )
    return both.groupBy("mapping_type").agg(F.count(F.lit(1)).alias("n"), F.count("t").alias("overridden"))


@query(
    "load_mapping_config",
    """SELECT mapping_type, source_value, target_value FROM map_""",
)
def load_mapping_config(spark, sf_dir):
    from palisade.plans.audit_queries import audit_schema
    from palisade.sources import sinks
    from palisade.sources.mappings import load_mapping_config as load

    schema = audit_schema(spark)
    rows = fx.mapping(spark, sf_dir)
    day = F.lit("2024-01-01").cast("timestamp")
    # Two generations of every entry: the newer one has to win.
    old = rows.select("mapping_type", "source_value", F.lit("outdated").alias("target_value"), day.alias("created_at"))
    new = rows.select("*", (day + F.expr("INTERVAL 1 DAY")).alias("created_at"))
    both = old.unionByName(new).withColumnsRenamed({"source_value": "ranger_value", "target_value": "uc_value"})
    sinks._append(both, schema, "mapping_config")
    return load(spark, f"{schema}.mapping_config")


# --- plain statements ------------------------------------------------------------------------------


@query("expand_grants", "SELECT policy_key, item_pos, prin_pos, acc_pos, principal, privilege FROM acc JOIN who USING (policy_key, item_pos)")
def expand_grants(spark, sf_dir):
    rows = grants.expand_grants(fx.access_items(fx.fx_items(spark, sf_dir)), config(spark, sf_dir))
    return rows.select("policy_key", "item_pos", "prin_pos", "acc_pos", "principal", "privilege")


@query("access_grants", o.finish("r_access"))
def access_grants(spark, sf_dir):
    items = fx.access_items(fx.fx_items(spark, sf_dir))
    rows = grants.access_grants(fx.policies_frame(spark, sf_dir), items, config(spark, sf_dir))
    return statements.finish_known(rows)


@query(
    "header_on_first",
    f"""SELECT policy_key, item_pos, prin_pos, acc_pos FROM (SELECT policy_key, item_pos, prin_pos, acc_pos,
      row_number() OVER (PARTITION BY policy_key ORDER BY {o.ORDER}) AS rn FROM r_access WHERE may_head) t WHERE rn = 1""",
)
def header_on_first(spark, sf_dir):
    items = fx.access_items(fx.fx_items(spark, sf_dir))
    rows = grants.access_grants(fx.policies_frame(spark, sf_dir), items, config(spark, sf_dir))
    return statements.header_positions(rows).select("policy_key", "first.item_pos", "first.prin_pos", "first.acc_pos")


@query("external_location_grants", o.finish("r_path"))
def external_location_grants(spark, sf_dir):
    items = fx.access_items(fx.fx_items(spark, sf_dir))
    rows = grants.external_location_grants(fx.policies_frame(spark, sf_dir), items, config(spark, sf_dir))
    return statements.finish_known(rows)


@query("merge_row_filters", "SELECT policy_key, filter_body FROM fbody")
def merge_row_filters(spark, sf_dir):
    return filters.merge_row_filters(fx.filter_items(fx.fx_items(spark, sf_dir)), config(spark, sf_dir))


_FILTER_ERRORS = """SELECT policy_key, 'Invalid table path for row filter: ' || res AS message FROM ftargets
  WHERE len(parts) <> 3 AND policy_key IN (SELECT policy_key FROM items WHERE filter_expr IS NOT NULL)"""


@query(
    "row_filter_statements",
    f"SELECT policy_key, part, sql, NULL AS error FROM ({o.finish('r_filter')}) f UNION ALL SELECT policy_key, 0, NULL, message FROM ({_FILTER_ERRORS}) e",
)
def row_filter_statements(spark, sf_dir):
    policies, c = fx.policies_frame(spark, sf_dir), config(spark, sf_dir)
    items = fx.filter_items(fx.fx_items(spark, sf_dir))
    rows = statements.finish_known(filters.row_filter_statements(policies, items, c))
    bad = filters.filter_errors(policies, items, c)
    return rows.select("policy_key", "part", "sql", F.lit(None).cast("string").alias("error")).unionByName(
        bad.select("policy_key", F.lit(0).alias("part"), F.lit(None).cast("string").alias("sql"), F.col("message").alias("error"))
    )


@query("default_mask_choice", "SELECT policy_key, coalesce(mask_kind, 'MASK_REDACT') AS mask_kind FROM mkind")
def default_mask_choice(spark, sf_dir):
    return column_masks.default_mask(fx.mask_items(fx.fx_items(spark, sf_dir)))


_MASK_ERRORS = """SELECT policy_key, CASE WHEN len(parts) <> 3 THEN 'Invalid table path for column masking: ' || res
    ELSE 'No columns specified for masking in policy ' || policy_id END AS message FROM mtargets
  WHERE (len(parts) <> 3 OR len(columns) = 0) AND policy_key IN (SELECT policy_key FROM items WHERE mask_type IS NOT NULL)"""


@query(
    "column_mask_statements",
    f"SELECT policy_key, obj_pos, part, sql, NULL AS error FROM ({o.finish('r_mask')}) f UNION ALL SELECT policy_key, 0, 0, NULL, message FROM ({_MASK_ERRORS}) e",
)
def column_mask_statements(spark, sf_dir):
    policies, c = fx.policies_frame(spark, sf_dir), config(spark, sf_dir)
    items = fx.mask_items(fx.fx_items(spark, sf_dir))
    rows = statements.finish_known(column_masks.column_mask_statements(policies, items, c))
    none = F.lit(None).cast("string")
    return rows.select("policy_key", "obj_pos", "part", "sql", none.alias("error")).unionByName(
        column_masks.mask_errors(policies, items, c).select(
            "policy_key", F.lit(0).alias("obj_pos"), F.lit(0).alias("part"), none.alias("sql"), F.col("message").alias("error")
        )
    )


_CUSTOM = {"CUSTOM": "CONCAT(LEFT({column}, 1), '***')", "MASK": "'hidden'"}
_ARMS = " ".join(f"WHEN {o.lit(k)} THEN {o.lit(v)}" for k, v in C.MASKS.items())
o.CTES["r_mask_own"] = o.CTES["r_mask"].replace(_ARMS, " ".join(f"WHEN {o.lit(k)} THEN {o.lit(v)}" for k, v in {**C.MASKS, **_CUSTOM}.items()))


@query("custom_mask_statements", f"SELECT policy_key, obj_pos, part, sql FROM ({o.finish('r_mask_own')}) f")
def custom_mask_statements(spark, sf_dir):
    """Column mask statements where the run brings mask types of its own."""
    policies, c = fx.policies_frame(spark, sf_dir), replace(config(spark, sf_dir), masks=_CUSTOM)
    rows = column_masks.column_mask_statements(policies, fx.mask_items(fx.fx_items(spark, sf_dir)), c)
    return statements.finish_known(rows).select("policy_key", "obj_pos", "part", "sql")


# --- tags -----------------------------------------------------------------------------------------------


@query(
    "split_tag_levels",
    """SELECT section, table_key, col AS column_name, string_agg(tag, ',' ORDER BY tag_pos) AS tags FROM levels GROUP BY ALL""",
)
def split_tag_levels(spark, sf_dir):
    from palisade.functions.ordering import ordered_text_of_any

    levels = tags.split_tag_levels(fx.resource_tags(spark, sf_dir))
    keys = ["section", "table_key", "column"]
    return ordered_text_of_any(levels, keys, ["tag_pos"], "tag", ",", "tags").withColumnRenamed("column", "column_name")


@query("merge_tag_pairs", "SELECT section, table_key, col AS column_name, pairs FROM pairtext WHERE section < 2")
def merge_tag_pairs(spark, sf_dir):
    levels = tags.split_tag_levels(fx.resource_tags(spark, sf_dir))
    rows = tags.merge_tag_pairs(levels, fx.attributes(spark, sf_dir), ["scope", "section", "table_key", "column"])
    return rows.drop("scope").withColumnRenamed("column", "column_name")


@query(
    "tag_path_findings",
    """SELECT DISTINCT path, CASE WHEN len(string_split(path, '.')) NOT IN (2, 3) THEN 'Resource tag path needs two or three parts'
      ELSE 'Resource tag on every column of a table' END AS message FROM rtags
    WHERE len(string_split(path, '.')) NOT IN (2, 3) OR (len(string_split(path, '.')) = 3 AND split_part(path, '.', 3) = '*')""",
)
def tag_path_findings(spark, sf_dir):
    """Tagged paths that no statement can be made of, or that stand for every column."""
    return tags.path_findings(fx.resource_tags(spark, sf_dir)).select("path", "message")


@query("tag_catalog", "SELECT section, table_key, col AS column_name, pair_key, pair_value FROM pairs WHERE section < 2")
def tag_catalog(spark, sf_dir):
    rows = tags.tag_catalog(fx.resource_tags(spark, sf_dir), fx.attributes(spark, sf_dir))
    return rows.drop("scope", "seen").withColumnRenamed("column", "column_name")


@query("orphan_tags", "SELECT DISTINCT tag FROM defs WHERE tag NOT IN (SELECT tag FROM rtags) ORDER BY tag")
def orphan_tags(spark, sf_dir):
    return tags.orphan_tags(fx.definitions(spark, sf_dir), fx.resource_tags(spark, sf_dir)).select("tag").orderBy("tag")


@query("tag_statements", f"SELECT section, obj_key, obj_sub, sql FROM ({o.finish('r_tag', 'taghead')}) t")
def tag_statements(spark, sf_dir):
    rows = tags.tag_statements(
        fx.definitions(spark, sf_dir), fx.attributes(spark, sf_dir), fx.resource_tags(spark, sf_dir), Config()
    )
    return rows.select("section", "obj_key", "obj_sub", "sql")


@query(
    "sorted_tag_statements",
    f"""SELECT CAST(row_number() OVER (ORDER BY section, obj_key, obj_sub) AS BIGINT) AS stmt_no, sql FROM ({o.finish('r_tag', 'taghead')}) t""",
)
def sorted_tag_statements(spark, sf_dir):
    from palisade.functions.ordering import numbered_by_range

    rows = tags.tag_statements(
        fx.definitions(spark, sf_dir), fx.attributes(spark, sf_dir), fx.resource_tags(spark, sf_dir), Config()
    )
    placed = numbered_by_range(rows, ["policy_key"], ["section", "obj_key", "obj_sub"], "stmt_no")
    return placed.select(F.col("stmt_no").cast("bigint"), "sql").orderBy("stmt_no")


@query("tags_to_tables", "SELECT policy_key, table_key, tags FROM ttables")
def tags_to_tables(spark, sf_dir):
    policies = fx.policies_frame(spark, sf_dir)
    rows = tags.tags_to_tables(policies, fx.resource_tags(spark, sf_dir))
    return rows.withColumn("tags", F.array_join("tags", ","))


@query(
    "tag_intersection",
    "SELECT policy_key, string_agg(tag, ',' ORDER BY tag) AS known_tags FROM ptags WHERE tag IN (SELECT tag FROM rtags) GROUP BY policy_key",
)
def tag_intersection(spark, sf_dir):
    policies = fx.policies_frame(spark, sf_dir)
    used = tags.policy_tags(policies).join(fx.resource_tags(spark, sf_dir), ["scope", "tag"], "left_semi")
    return used.groupBy("policy_key").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("known_tags"))


@query("tag_to_columns", "SELECT tag, db, tbl, col AS column_name, path_pos FROM tcolumns")
def tag_to_columns(spark, sf_dir):
    rows = tags.tag_to_columns(fx.resource_tags(spark, sf_dir), Config())
    return rows.drop("scope").withColumnRenamed("column", "column_name")


@query("tagged_columns_of_table", "SELECT policy_key, table_key, col AS column_name, path_pos FROM tabcols")
def tagged_columns_of_table(spark, sf_dir):
    policies = fx.policies_frame(spark, sf_dir)
    rows = tags.tagged_columns_of_table(policies, fx.resource_tags(spark, sf_dir))
    return rows.drop("first_table").withColumnRenamed("column", "column_name")


@query("tag_grants", "SELECT policy_key, obj_key, item_pos, prin_pos, acc_pos, body FROM r_taggrant")
def tag_grants(spark, sf_dir):
    run = fx.inputs(spark, sf_dir)
    rows = tags.tag_grants(run.policies, run.access, run.resource_tags, config(spark, sf_dir))
    return rows.select("policy_key", "obj_key", "item_pos", "prin_pos", "acc_pos", "body")


@query("tag_grants_fallback", "SELECT policy_key, item_pos, prin_pos, acc_pos, body FROM r_tagnogrant")
def tag_grants_fallback(spark, sf_dir):
    run = fx.inputs(spark, sf_dir)
    rows = tags.tag_grants_fallback(run.policies, run.access, run.resource_tags, config(spark, sf_dir))
    return rows.select("policy_key", "item_pos", "prin_pos", "acc_pos", "body")


@query("deny_digest", "SELECT policy_key, digest FROM denies")
def deny_digest(spark, sf_dir):
    run = fx.inputs(spark, sf_dir)
    return tags.deny_digest(run.policies, run.access)


@query("tag_access_statements", o.finish("r_tagaccess"))
def tag_access_statements(spark, sf_dir):
    run = fx.inputs(spark, sf_dir)
    rows = tags.tag_access_rows(
        run.policies, run.access, run.filters, run.masks, run.resource_tags, config(spark, sf_dir)
    )
    return statements.finish_known(rows)


_TAG_MASK_ERRORS = """SELECT policy_key, CASE WHEN tag1 NOT IN (SELECT tag FROM tcolumns) THEN 'Tag-based policy for tag ''' || tag1 ||
      '''. No tagged resources found in metadata. Query your data catalog to find tables/columns with this tag.'
      ELSE 'No masking type for tag ''' || tag1 || '''' END AS message
    FROM pol JOIN mkind USING (policy_key) WHERE route = 'tag_mask' AND (tag1 NOT IN (SELECT tag FROM tcolumns) OR mask_kind IS NULL)"""


@query(
    "tag_mask_statements",
    f"SELECT policy_key, item_pos, part, sql, NULL AS error FROM ({o.finish('r_tagmask')}) f UNION ALL SELECT policy_key, 0, 0, NULL, message FROM ({_TAG_MASK_ERRORS}) e",
)
def tag_mask_statements(spark, sf_dir):
    run, c = fx.inputs(spark, sf_dir), config(spark, sf_dir)
    rows = statements.finish_known(tags.tag_mask_rows(run.policies, run.masks, run.resource_tags, c))
    none = F.lit(None).cast("string")
    return rows.select("policy_key", "item_pos", "part", "sql", none.alias("error")).unionByName(
        tags.tag_mask_errors(run.policies, run.masks, run.resource_tags, c).select(
            "policy_key", F.lit(0).cast("bigint").alias("item_pos"), F.lit(0).alias("part"), none.alias("sql"),
            F.col("message").alias("error"),
        )
    )


@query("translate_all", "SELECT * FROM all_sql")
def translate_all(spark, sf_dir):
    return translate.translate_all(fx.inputs(spark, sf_dir), config(spark, sf_dir))


@query(
    "union_statements",
    f"""SELECT 0 AS phase, CAST(NULL AS BIGINT) AS policy_key, {o.ORDER}, sql FROM ({o.finish('r_tag', 'taghead')}) t
    UNION ALL SELECT 1, policy_key, {o.ORDER}, sql FROM all_sql""",
)
def union_statements(spark, sf_dir):
    rows = translate.translate_with_tags(fx.inputs(spark, sf_dir), config(spark, sf_dir))
    return rows.select("phase", "policy_key", *statements.ORDER, "sql")


_ATTRIBUTION = """
  SELECT policy_key, 0 AS section, 0 AS obj_pos, item_pos, prin_pos, ptype || ':' || principal AS label
    FROM (SELECT DISTINCT policy_key, item_pos FROM agrants) a JOIN who USING (policy_key, item_pos)
  UNION ALL SELECT DISTINCT policy_key, 0, obj_pos, item_pos, prin_pos, principal FROM locs
  UNION ALL SELECT policy_key, 0, 0, item_pos, prin_pos, ptype || ':' || principal FROM ftargets JOIN who USING (policy_key)
    WHERE len(parts) = 3 AND filter_expr <> '' AND ptype <> 'role'
  UNION ALL SELECT policy_key, 0, unnest(range(len(columns))), item_pos, prin_pos, ptype || ':' || principal FROM mtargets JOIN who USING (policy_key)
    WHERE len(parts) = 3 AND mask_type <> 'MASK_NONE' AND ptype <> 'role'
  UNION ALL SELECT policy_key, 0, 0, item_pos, prin_pos, ptype || ':' || principal FROM pol JOIN who USING (policy_key)
    WHERE route = 'tag_mask' AND mask_type <> 'MASK_NONE' AND ptype <> 'role'"""

_DISTINCT = """SELECT policy_key, label, min((section, item_pos, prin_pos)) AS place FROM (
    SELECT p.policy_key, 0 AS section, item_pos, prin_pos, ptype || ':' || principal AS label FROM pol p JOIN who w USING (policy_key)
      WHERE route = 'tag_access' AND w.kind = 'allow' AND (policy_key NOT IN (SELECT policy_key FROM ttables) OR (policy_key, item_pos) IN (SELECT (policy_key, item_pos) FROM acc))
    UNION ALL SELECT p.policy_key, 1, item_pos, prin_pos, ptype || ':' || principal FROM pol p JOIN who w USING (policy_key)
      WHERE route = 'tag_access' AND filter_expr <> '' AND ptype <> 'role' AND policy_key IN (SELECT policy_key FROM ttables)
    UNION ALL SELECT p.policy_key, 2, item_pos, prin_pos, ptype || ':' || principal FROM pol p JOIN who w USING (policy_key)
      WHERE route = 'tag_access' AND mask_type <> 'MASK_NONE' AND ptype <> 'role' AND policy_key IN (SELECT policy_key FROM ttables)) t
  GROUP BY policy_key, label"""


@query(
    "principal_attribution",
    f"""SELECT policy_key, string_agg(label, ', ' ORDER BY section, obj_pos, item_pos, prin_pos) AS principals FROM ({_ATTRIBUTION}
    UNION ALL SELECT policy_key, place[1], 0, place[2], place[3], label FROM ({_DISTINCT}) d) a GROUP BY policy_key""",
)
def principal_attribution(spark, sf_dir):
    rows = translate.principal_attribution(fx.inputs(spark, sf_dir), config(spark, sf_dir))
    return translate.principals_text(rows)


@query(
    "distinct_principals",
    f"SELECT policy_key, string_agg(label, ', ' ORDER BY place) AS principals FROM ({_DISTINCT}) d GROUP BY policy_key",
)
def distinct_principals(spark, sf_dir):
    return translate.principals_text(translate.distinct_principals(fx.inputs(spark, sf_dir), config(spark, sf_dir)))


@query(
    "number_statements",
    f"""SELECT priority AS source, policy_key, {o.ORDER}, CAST(row_number() OVER (PARTITION BY priority ORDER BY policy_key, {o.ORDER}) AS BIGINT) AS stmt_no,
      CAST(count(*) OVER (PARTITION BY priority) AS BIGINT) AS stmt_total FROM all_sql JOIN base USING (policy_key)""",
)
def number_statements(spark, sf_dir):
    rows = numbered_statements(spark, sf_dir)
    return rows.select("source", "policy_key", *statements.ORDER, "stmt_no", "stmt_total")


def numbered_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements per source in policy order."""
    run = fx.inputs(spark, sf_dir)
    sources = run.policies.select("policy_key", F.col("priority").alias("source"))
    rows = fx.staged(
        spark, sf_dir, "statements", lambda: translate.translate_all(run, config(spark, sf_dir))
    ).join(sources, "policy_key")
    return translate.number_statements(rows, ["source"], ["policy_key"])
