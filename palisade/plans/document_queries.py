"""Queries for reading, unwrapping, normalising and validating policy files."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions.text import conditions_to_sql
from palisade.operators import audit, validate
from palisade.plans import fixtures as fx
from palisade.plans import oracle as o
from palisade.plans.registry import query
from palisade.session import scratch_dir
from palisade.sources import documents as docs
from palisade.sources import export_ranges, tags

POS = "block_pos, section, pos"
POS_COLUMNS = ("block_pos", "section", "pos")


def _unwrapped(spark, sf_dir):
    return docs.unwrap_policies(fx.documents(spark, sf_dir))


def _parsed(spark, sf_dir):
    return docs.parse_policies(_unwrapped(spark, sf_dir))


@query("read_policy_documents", "SELECT policy_id, shape FROM doc")
def read_policy_documents(spark, sf_dir):
    """Write the files as lines, read them back and list what they hold."""
    path = scratch_dir(spark, "exports")
    fx.documents(spark, sf_dir).select("json").write.text(path)
    read = docs.read_policy_documents(spark, path, one_per_file=False)
    rows = docs.unwrap_policies(read)
    return rows.select(F.get_json_object("policy_json", "$.id").alias("policy_id"), "shape")


@query(
    "read_large_export",
    """SELECT CAST(export AS INTEGER) AS export, CAST(row_number() OVER (PARTITION BY export ORDER BY k, block_pos, section, pos) AS INTEGER) AS pos, policy_id
    FROM (SELECT *, CAST(policy_id AS BIGINT) AS k, CAST(policy_id AS BIGINT) // 20000 AS export FROM doc WHERE shape = 'standard') d""",
)
def read_large_export(spark, sf_dir):
    """Write policies as few large exports, each one JSON object, and read these in ranges of 1 MB."""
    rows = _unwrapped(spark, sf_dir).filter("shape = 'standard'")
    rows = rows.withColumn("k", F.get_json_object("policy_json", "$.id").cast("bigint")).withColumn("export", F.expr("k div 20000"))
    ends = F.array(F.struct(F.lit(-1).alias("ord"), F.lit('{"serviceName": "svc", "policies": [null').alias("line")), F.struct(F.lit(1).alias("ord"), F.lit("]}").alias("line")))
    lines = rows.select("export").distinct().select("export", F.inline(ends)).withColumn("k", F.lit(0).cast("bigint"))
    place = F.struct(*POS_COLUMNS)
    lines = lines.select("export", "ord", "k", F.lit(None).cast("struct<block_pos: int, section: int, pos: int>").alias("place"), "line").unionByName(
        rows.select("export", F.lit(0).alias("ord"), "k", place.alias("place"), F.concat(F.lit(","), "policy_json").alias("line"))
    )
    path = scratch_dir(spark, "large_exports")
    lines.repartition("export").sortWithinPartitions("export", "ord", "k", "place").select("export", "line").write.partitionBy("export").text(path)
    found, _ = export_ranges.read_large_exports(spark, path, range_bytes=1 << 20)
    policies = docs.unwrap_large_exports(found).filter("policy_json IS NOT NULL")
    export = F.regexp_extract("source", "export=([0-9]+)", 1).cast("int").alias("export")
    return policies.select(export, "pos", F.get_json_object("policy_json", "$.id").alias("policy_id"))


def _unwrap_query(name: str, shape: str):
    @query(name, f"SELECT source, {POS}, policy_id, service_name FROM doc WHERE shape = '{shape}'")
    def run(spark, sf_dir):
        rows = _unwrapped(spark, sf_dir).filter(F.col("shape") == shape)
        return rows.select(
            "source", *POS_COLUMNS, F.get_json_object("policy_json", "$.id").alias("policy_id"), "service_name"
        )

    return run


_unwrap_query("unwrap_standard_export", "standard")
_unwrap_query("unwrap_single_policy", "single")
_unwrap_query("unwrap_test_cases", "testCases")
_unwrap_query("unwrap_policy_deltas", "policyDeltas")
_unwrap_query("unwrap_tag_policy_info", "tagPolicyInfo")
_unwrap_query("unwrap_tag_policies_block", "tagPolicies")

_DEFINED = "SELECT 't' || CAST(s_suppkey // 20 AS VARCHAR) AS source, 'D' || CAST(s_suppkey AS VARCHAR) AS tag, {k} AS attr_key, {v} AS attr_value FROM supplier"


@query(
    "read_tag_definitions",
    _DEFINED.format(k="'Level'", v="s_name") + " UNION ALL " + _DEFINED.format(k="'nation'", v="CAST(s_nationkey AS VARCHAR)"),
)
def read_tag_definitions(spark, sf_dir):
    rows = tags.read_tag_attributes(fx.tag_documents(spark, sf_dir))
    return rows.select("source", "tag", "attr_key", "attr_value")


@query(
    "read_resource_tags",
    """SELECT source, path, unnest([0, 1])::INTEGER AS tag_pos, unnest(arg_max(t, k)) AS tag FROM (
      SELECT 'r' || CAST(p_partkey // 16 AS VARCHAR) AS source, p_partkey AS k, [p_type, 'S' || CAST(p_size AS VARCHAR)] AS t,
        unnest(CASE WHEN (p_partkey // 16) % 2 = 0 THEN ['db.t.c' || CAST(p_partkey AS VARCHAR)] ELSE CASE p_size % 5 WHEN 0 THEN [] WHEN 1 THEN ['t.*']
          WHEN 2 THEN ['db.t.a', 'db.t.b' || CAST(p_partkey % 3 AS VARCHAR)] WHEN 3 THEN ['u.a'] ELSE ['db.t.*'] END END) AS path FROM part) x
    GROUP BY source, path""",
)
def read_resource_tags(spark, sf_dir):
    return tags.read_resource_tags(fx.tag_documents(spark, sf_dir)).select("source", "path", "tag_pos", "tag")


# --- the validation files ---------------------------------------------------------------

o.CTES.update({
    "vp": """SELECT *, 'v' || CAST(n AS VARCHAR) AS source, CAST(r AS INTEGER) AS idx, e IN (0, 2, 4, 5) AS inherits,
  CASE k % 19 WHEN 0 THEN 'Policy_' || CAST(r AS VARCHAR) WHEN 1 THEN '' WHEN 2 THEN '5' WHEN 3 THEN 'None' ELSE 'policy_' || CAST(k AS VARCHAR) END AS policy_name
  FROM (SELECT policy_key AS k, policy_key // 4 AS n, policy_key % 4 AS r, (policy_key // 4) % 8 AS e FROM base) t WHERE e <= 5""",
    "vi": "SELECT policy_key AS k, CAST(row_number() OVER (PARTITION BY policy_key ORDER BY item_pos) - 1 AS INTEGER) AS item_pos, s1, p1 FROM items",
    "v_required": """SELECT source, idx, policy_name, 'E' AS severity, 'Missing required field: ' || unnest(list_filter([CASE WHEN k % 20 = 0 THEN 'id' END,
    CASE WHEN k % 19 = 0 THEN 'name' END, CASE WHEN k % 3 = 0 AND NOT inherits THEN 'service' END, CASE WHEN k % 17 = 0 THEN 'resources' END],
    lambda x: x IS NOT NULL)) AS message FROM vp""",
    "v_id": """SELECT source, idx, policy_name, 'E' AS severity, 'Policy ID must be integer, got <class ''' ||
    CASE k % 20 WHEN 1 THEN 'str' WHEN 2 THEN 'float' ELSE 'NoneType' END || '''>' AS message FROM vp WHERE k % 20 IN (1, 2, 3)""",
    "v_name": "SELECT source, idx, policy_name, 'E' AS severity, 'Policy name must be non-empty string' AS message FROM vp WHERE k % 19 IN (1, 2, 3)",
    "v_resources": """SELECT source, idx, policy_name, CASE k % 17 WHEN 5 THEN 'W' ELSE 'E' END AS severity, CASE k % 17 WHEN 1 THEN 'Resources section is empty'
    WHEN 2 THEN 'Resource ''database'' must be a dictionary' WHEN 3 THEN 'Resource ''database'' missing ''values'' field'
    WHEN 4 THEN 'Resource ''database'' values must be a list' ELSE 'Resource ''database'' has empty values list' END AS message FROM vp WHERE k % 17 BETWEEN 1 AND 5""",
    "vlists": """SELECT *, 'policyItems' AS list FROM vp WHERE k % 13 > 1 UNION ALL SELECT *, 'denyPolicyItems' FROM vp WHERE k % 6 = 0""",
    "v_access": """SELECT source, idx, policy_name, list, -1 AS item_pos, 'E' AS severity, 'policyItems must be a list' AS message FROM (SELECT *, 'policyItems' AS list FROM vp WHERE k % 13 = 1) a
  UNION ALL SELECT source, idx, policy_name, list, item_pos, 'W', 'Policy item ' || item_pos || ' has no users, groups, or roles' FROM vlists JOIN vi USING (k) WHERE s1 % 10 IN (5, 6)
  UNION ALL SELECT source, idx, policy_name, list, item_pos, CASE p1 % 7 WHEN 1 THEN 'E' WHEN 3 THEN 'E' ELSE 'W' END, 'Policy item ' || item_pos || CASE p1 % 7
    WHEN 0 THEN ' has no ''accesses'' field (audit-only policy item)' WHEN 1 THEN ' accesses must be a list' WHEN 2 THEN ' has empty accesses list (audit-only policy item)'
    ELSE ' access missing ''type''' END FROM vlists JOIN vi USING (k) WHERE p1 % 7 <= 3""",
    "v_filter": """SELECT source, idx, policy_name, -1 AS item_pos, 'E' AS severity, 'rowFilterPolicyItems must be a list' AS message FROM vp WHERE k % 11 = 0
  UNION ALL SELECT source, idx, policy_name, item_pos, 'W', 'Row filter item ' || item_pos || ' has no users, groups, or roles' FROM vp JOIN vi USING (k) WHERE k % 11 IN (1, 2) AND s1 % 10 IN (5, 6)
  UNION ALL SELECT source, idx, policy_name, item_pos, 'E', 'Row filter item ' || item_pos || CASE p1 % 6 WHEN 0 THEN ' missing ''rowFilterInfo''' WHEN 1 THEN ' missing filter expression'
    ELSE ' has empty filter expression' END FROM vp JOIN vi USING (k) WHERE k % 11 IN (1, 2) AND p1 % 6 <= 2""",
    "v_mask": """SELECT source, idx, policy_name, -1 AS item_pos, 'E' AS severity, 'dataMaskPolicyItems must be a list' AS message FROM vp WHERE k % 7 = 0
  UNION ALL SELECT source, idx, policy_name, item_pos, 'W', 'Masking item ' || item_pos || ' has no users, groups, or roles' FROM vp JOIN vi USING (k) WHERE k % 7 IN (1, 2) AND s1 % 10 IN (5, 6)
  UNION ALL SELECT source, idx, policy_name, item_pos, CASE p1 % 6 WHEN 2 THEN 'W' ELSE 'E' END, 'Masking item ' || item_pos || CASE p1 % 6 WHEN 0 THEN ' missing ''dataMaskInfo'''
    WHEN 1 THEN ' missing mask type' ELSE ' has unknown mask type: MASK_REDACT' END FROM vp JOIN vi USING (k) WHERE k % 7 IN (1, 2) AND p1 % 6 <= 2""",
    "v_none": """SELECT source, idx, policy_name, 'W' AS severity, 'Policy has no policy items (no permissions defined)' AS message FROM vp
  WHERE k % 13 = 0 AND k % 6 <> 0 AND k % 11 > 2 AND k % 7 > 2""",
    "v_all": "SELECT source, idx, policy_name, severity, message FROM v_required UNION ALL SELECT source, idx, policy_name, severity, message FROM v_id"
             " UNION ALL SELECT source, idx, policy_name, severity, message FROM v_name UNION ALL SELECT source, idx, policy_name, severity, message FROM v_resources"
             " UNION ALL SELECT source, idx, policy_name, severity, message FROM v_access UNION ALL SELECT source, idx, policy_name, severity, message FROM v_filter"
             " UNION ALL SELECT source, idx, policy_name, severity, message FROM v_mask UNION ALL SELECT source, idx, policy_name, severity, message FROM v_none",
    "vfiles": "SELECT DISTINCT 'v' || CAST(policy_key // 4 AS VARCHAR) AS source, (policy_key // 4) % 8 AS e FROM base",
    "v_envelope": f"""SELECT source, unnest(CASE e WHEN 0 THEN ['side_keys'] WHEN 2 THEN ['deltas'] WHEN 3 THEN ['zones'] WHEN 4 THEN ['test_cases'] WHEN 5 THEN ['side_keys', 'tag_info']
    WHEN 6 THEN ['no_policies'] WHEN 7 THEN ['side_keys', 'policies_type'] ELSE [] END) AS rule, e FROM vfiles""",
})
_FINDING = "source, idx, policy_name, severity, message"


def _policies(spark, sf_dir):
    """The validation files' policies as a written table: each rule group reads it once."""
    files = fx.validation_documents(spark, sf_dir)
    return fx.staged(spark, sf_dir, "exported", lambda: validate.with_variant(validate.exported_policies(files)))


def _finding_query(name: str, check, cte: str, extra: tuple[str, ...] = ()):
    columns = ", ".join([*extra, _FINDING])

    @query(name, f"SELECT {columns} FROM {cte}")
    def run(spark, sf_dir):
        return validate.check_findings(_policies(spark, sf_dir), check()).select(*extra, "source", "idx", "policy_name", "severity", "message")

    return run


_finding_query("validate_required_fields", validate.required_fields, "v_required")
_finding_query("validate_id_type", validate.id_type, "v_id")
_finding_query("validate_name", validate.name_text, "v_name")
_finding_query("validate_resources", validate.resources, "v_resources")
_finding_query("validate_access_items", validate.access_items, "v_access", ("list", "item_pos"))
_finding_query("validate_filter_items", validate.filter_items, "v_filter", ("item_pos",))
_finding_query("validate_mask_items", validate.mask_items, "v_mask", ("item_pos",))
_finding_query("validate_has_items", validate.no_items, "v_none")


@query("validate_envelope", "SELECT source, rule, CASE WHEN rule IN ('no_policies', 'policies_type') THEN 'E' ELSE 'W' END AS severity FROM v_envelope")
def validate_envelope(spark, sf_dir):
    return validate.envelope_findings(fx.validation_documents(spark, sf_dir)).select("source", "rule", "severity")


@query(
    "validation_verdict",
    """SELECT source, coalesce(errors, 0) = 0 AS is_valid, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings FROM vfiles LEFT JOIN (
      SELECT source, count(*) FILTER (severity = 'E') AS errors, count(*) FILTER (severity = 'W') AS warnings FROM (SELECT source, severity FROM v_all
        UNION ALL SELECT source, CASE WHEN rule IN ('no_policies', 'policies_type') THEN 'E' ELSE 'W' END FROM v_envelope) t GROUP BY source) c USING (source)""",
)
def validation_verdict(spark, sf_dir):
    return validate.validation_verdict(fx.validation_documents(spark, sf_dir), _policies(spark, sf_dir))


@query(
    "export_findings",
    """SELECT source, severity, '[' || policy_name || '] ' || message AS message FROM v_all UNION ALL
    SELECT source, CASE WHEN rule IN ('no_policies', 'policies_type') THEN 'E' ELSE 'W' END, CASE rule
      WHEN 'deltas' THEN 'Detected incremental update format (''policyDeltas''). Policies will be extracted from each delta''s ''policy'' field.'
      WHEN 'zones' THEN 'Detected ''securityZones'' in this file. Security zone boundaries have no direct Unity Catalog equivalent — policies will be translated ignoring zone scope.'
      WHEN 'test_cases' THEN 'Detected ACL provider test format (''testCases'' key). Policies will be extracted from each testCase''s servicePolicies block.'
      WHEN 'side_keys' THEN 'Detected Ranger test file format (keys: ' || CASE e WHEN 0 THEN 'serviceName, tests' WHEN 5 THEN 'serviceName' ELSE 'serviceDef' END
        || '). serviceDef and tests sections will be ignored — only ''policies'' will be translated.'
      WHEN 'tag_info' THEN 'Detected ''tagPolicyInfo'' section. Tag-based policies will be extracted and translated.'
      WHEN 'no_policies' THEN 'Export JSON missing ''policies'' field. Expected format: {"policies": [...]}'
      ELSE '''policies'' field must be a list' END FROM v_envelope
    UNION ALL SELECT source, 'W', 'Export contains no policies' FROM vfiles WHERE source NOT IN (SELECT source FROM vp) AND source NOT IN
      (SELECT source FROM v_envelope WHERE rule IN ('no_policies', 'policies_type'))""",
)
def export_findings(spark, sf_dir):
    """Every message an export gets, policy findings under the policy's name."""
    return validate.export_findings(fx.validation_documents(spark, sf_dir), _policies(spark, sf_dir))


def _verdicts(spark, sf_dir):
    return validate.policy_verdicts(_policies(spark, sf_dir))


@query(
    "validation_totals",
    """SELECT count(*) AS total, count(*) FILTER (errors = 0) AS valid, count(*) FILTER (errors > 0) AS invalid,
      printf('%.1f%%', round(count(*) FILTER (errors = 0) * 1000.0 / count(*)) / 10) AS valid_share,
      printf('%.1f%%', 100 - round(count(*) FILTER (errors = 0) * 1000.0 / count(*)) / 10) AS invalid_share,
      CAST(sum(errors) AS BIGINT) AS total_errors, CAST(sum(warnings) AS BIGINT) AS total_warnings
    FROM (SELECT source, idx, count(severity) FILTER (severity = 'E') AS errors, count(severity) FILTER (severity = 'W') AS warnings
      FROM vp LEFT JOIN v_all USING (source, idx) GROUP BY source, idx) t""",
)
def validation_totals(spark, sf_dir):
    return validate.validation_totals(_verdicts(spark, sf_dir))


@query(
    "validation_details",
    f"SELECT {_FINDING} FROM (SELECT *, bool_or(severity = 'E') OVER (PARTITION BY source, idx) AS bad FROM v_all) v WHERE bad",
)
def validation_details(spark, sf_dir):
    return validate.validation_details(_policies(spark, sf_dir)).select("source", "idx", "policy_name", "severity", "message")


@query(
    "top3_errors_per_file",
    """SELECT source, idx, message, CAST(rank AS INTEGER) AS rank FROM (SELECT source, idx, message,
      row_number() OVER (PARTITION BY source ORDER BY idx, c, i, message) AS rank FROM (
        SELECT source, idx, 0 AS c, strpos('id name service resources', split_part(message, ': ', 2)) AS i, message, severity FROM v_required
        UNION ALL SELECT source, idx, 1, 0, message, severity FROM v_id UNION ALL SELECT source, idx, 2, 0, message, severity FROM v_name
        UNION ALL SELECT source, idx, 3, 0, message, severity FROM v_resources
        UNION ALL SELECT source, idx, CASE list WHEN 'policyItems' THEN 4 ELSE 7 END, item_pos, message, severity FROM v_access
        UNION ALL SELECT source, idx, 5, item_pos, message, severity FROM v_filter
        UNION ALL SELECT source, idx, 6, item_pos, message, severity FROM v_mask) e WHERE severity = 'E') t WHERE rank <= 3""",
)
def top3_errors_per_file(spark, sf_dir):
    findings = validate.policy_findings(_policies(spark, sf_dir))
    return audit.top_errors_per_file(findings, 3).select("source", "idx", "message", "rank")


@query("union_policy_sources", "SELECT source, idx, CASE WHEN inherits THEN 'root' END AS root_service FROM vp")
def union_policy_sources(spark, sf_dir):
    return validate.exported_policies(fx.validation_documents(spark, sf_dir)).select("source", "idx", "root_service")


@query(
    "detected_keys",
    "SELECT source, CASE e WHEN 0 THEN 'serviceName,tests' WHEN 2 THEN 'serviceName' WHEN 5 THEN 'serviceName' WHEN 7 THEN 'serviceDef' ELSE '' END AS keys FROM vfiles",
)
def detected_keys(spark, sf_dir):
    rows = docs.with_root_keys(fx.validation_documents(spark, sf_dir))
    return rows.select("source", F.array_join(validate.detected_keys(F.col("keys")), ",").alias("keys"))


@query(
    "propagate_service",
    """SELECT source, CAST(CASE WHEN e = 5 AND r = 3 THEN 1 ELSE 0 END AS INTEGER) AS section, CAST(CASE WHEN e = 5 AND r = 3 THEN 0 ELSE r END AS INTEGER) AS pos,
      CASE WHEN k % 3 > 0 THEN 'svc' WHEN inherits THEN 'root' END AS service FROM vp WHERE NOT (e = 4 AND r = 3)""",
)
def propagate_service(spark, sf_dir):
    rows = docs.propagate_service(docs.unwrap_policies(fx.validation_documents(spark, sf_dir)))
    return rows.select("source", "section", "pos", "service")


@query(
    "capture_parse_errors",
    """SELECT DISTINCT source, 'Error reading file' AS stage, CAST(NULL AS INTEGER) AS pos FROM docall WHERE blk % 97 = 0
    UNION ALL SELECT source, 'Error parsing policy', NULL FROM vfiles WHERE e = 7
    UNION ALL SELECT source, 'Error parsing policy', CAST(CASE WHEN e = 5 AND r = 3 THEN 0 ELSE r END AS INTEGER) FROM vp
      WHERE NOT (e = 4 AND r = 3) AND (k % 17 = 2 OR k % 11 = 0 OR k % 7 = 0)""",
)
def capture_parse_errors(spark, sf_dir):
    files = fx.documents(spark, sf_dir).unionByName(fx.validation_documents(spark, sf_dir))
    whole = docs.document_errors(files).withColumn("pos", F.lit(None).cast("int"))
    single = docs.policy_errors(docs.parse_policies(docs.unwrap_policies(files)))
    return whole.unionByName(single.select("source", "stage", "pos"))


# --- normalised relations ---------------------------------------------------------------------


@query(
    "normalise_policy",
    f"""SELECT source, {POS}, policy_id, name, '' AS service, description, policy_key % 12 <> 1 AS is_enabled, true AS is_audit_enabled, policy_type FROM doc""",
)
def normalise_policy(spark, sf_dir):
    rows = docs.normalise_policies(_parsed(spark, sf_dir))
    return rows.select(
        "source", *POS_COLUMNS, "policy_id", "name", "service", "description", "is_enabled", "is_audit_enabled", "policy_type"
    )


@query(
    "normalise_resources",
    """SELECT d.policy_key, CAST(n - 1 AS INTEGER) AS res_pos, kind AS resource_type, CASE kind WHEN 'database' THEN db WHEN 'table' THEN tbl
      WHEN 'column' THEN col1 || coalesce(',' || col2, '') WHEN 'path' THEN path1 || coalesce(',' || path2, '') WHEN 'udf' THEN udf
      WHEN 'tag' THEN tag1 || coalesce(',' || tag2, '') ELSE 's3://bucket/' || status END AS value_list, false AS is_excludes, false AS is_recursive
    FROM (SELECT *, unnest(kinds) AS kind, generate_subscripts(kinds, 1) AS n FROM pol) p JOIN dockey d ON d.k = p.policy_key""",
)
def normalise_resources(spark, sf_dir):
    rows = docs.normalise_resources(_parsed(spark, sf_dir))
    return rows.withColumn("value_list", F.array_join("values", ",")).drop("values")


_LISTS = """array_to_string(list_filter([u1, u2], lambda x: x IS NOT NULL), ',') AS users,
  array_to_string(list_filter([g1, g2, g3], lambda x: x IS NOT NULL), ',') AS groups"""


def _joined_lists(df, *names):
    return df.withColumns({n: F.array_join(n, ",") for n in names})


@query(
    "normalise_access_items",
    f"""SELECT policy_key, kind, item_pos, {_LISTS}, array_to_string(list_filter([r1, r2], lambda x: x IS NOT NULL), ',') AS roles,
      a1 || '=' || coalesce(CAST(ok1 AS VARCHAR), '') || coalesce(',' || a2 || '=', '') AS accesses, false AS delegate_admin FROM docitems""",
)
def normalise_access_items(spark, sf_dir):
    rows = _joined_lists(docs.normalise_access_items(_parsed(spark, sf_dir)), "users", "groups", "roles")
    text = F.transform(
        "accesses", lambda a: F.concat(a["type"], F.lit("="), F.coalesce(a["is_allowed"].cast("string"), F.lit("")))
    )
    return rows.withColumn("accesses", F.array_join(text, ",")).drop("conditions")


@query(
    "item_conditions",
    """SELECT policy_key, kind, item_pos, CASE WHEN kind = 'deny' THEN coalesce(a, 'TRUE') ELSE coalesce(nullif(array_to_string(list_filter([
      CASE WHEN g1 IS NOT NULL THEN 'teams = ''' || g1 || '''' END,
      CASE WHEN b IS NOT NULL THEN 'users IN (''' || a || ''', ''' || b || ''')' WHEN a IS NOT NULL THEN 'users = ''' || a || '''' END
      ], lambda x: x IS NOT NULL), ' AND '), ''), 'TRUE') END AS predicate
    FROM (SELECT *, coalesce(u1, u2) AS a, CASE WHEN u1 IS NOT NULL THEN u2 END AS b FROM docitems) d""",
)
def item_conditions(spark, sf_dir):
    """Conditions of access items, from the documents, as predicates."""
    rows = docs.normalise_access_items(_parsed(spark, sf_dir))
    return rows.select("policy_key", "kind", "item_pos", F.array_join(conditions_to_sql(F.col("conditions")), " AND ").alias("predicate"))


@query(
    "normalise_filter_items",
    f"""SELECT d.policy_key, CAST(row_number() OVER (PARTITION BY d.policy_key ORDER BY i.item_pos) - 1 AS BIGINT) AS item_pos, {_LISTS}, filter_expr
    FROM dockey d JOIN items i ON i.policy_key = d.k WHERE filter_expr IS NOT NULL""",
)
def normalise_filter_items(spark, sf_dir):
    return _joined_lists(docs.normalise_filter_items(_parsed(spark, sf_dir)), "users", "groups").drop("conditions")


@query(
    "normalise_mask_items",
    f"""SELECT d.policy_key, CAST(row_number() OVER (PARTITION BY d.policy_key ORDER BY i.item_pos) - 1 AS BIGINT) AS item_pos, {_LISTS}, mask_type
    FROM dockey d JOIN items i ON i.policy_key = d.k WHERE mask_type IS NOT NULL""",
)
def normalise_mask_items(spark, sf_dir):
    return _joined_lists(docs.normalise_mask_items(_parsed(spark, sf_dir)), "users", "groups").drop("mask_condition", "conditions")


# --- lint ---------------------------------------------------------------------------------------------

# Statements as users write them, from line items: every form and every fault.
_STATEMENTS = """SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, CASE l_partkey % 14
  WHEN 0 THEN 'GRANT SELECT ON TABLE t TO `u' || CAST(l_suppkey AS STRING) || '`;' WHEN 1 THEN 'grant manage on schema s to x'
  WHEN 2 THEN 'GRANT SELECT TABLE t TO y' WHEN 3 THEN 'GRANT ALL PRIVILEGES ON TABLE t'
  WHEN 4 THEN 'CREATE OR REPLACE FUNCTION f(x STRING)' WHEN 5 THEN 'CREATE OR REPLACE FUNCTION a.f(x STRING) RETURNS STRING RETURN x'
  WHEN 6 THEN 'ALTER TABLE t SET MASK m' WHEN 7 THEN 'ALTER TABLE t DROP COLUMN c' WHEN 8 THEN 'CREATE TAG x'
  WHEN 9 THEN 'create tag if not exists x' WHEN 10 THEN '   ' WHEN 11 THEN '-- a comment that is longer than thirty letters'
  WHEN 12 THEN '' ELSE ' ALTER TABLE t SET ROW FILTER f ON (a)' END AS sql FROM {lineitem}"""
o.CTES["stm"] = (
    "SELECT *, upper(trim(sql)) AS t, CASE WHEN trim(sql) = '' THEN 'empty' WHEN starts_with(upper(trim(sql)), 'GRANT') THEN 'grant' "
    "WHEN starts_with(upper(trim(sql)), 'CREATE OR REPLACE FUNCTION') THEN 'function' WHEN starts_with(upper(trim(sql)), 'ALTER TABLE') THEN 'alter' "
    "WHEN starts_with(upper(trim(sql)), 'CREATE TAG') THEN 'tag' ELSE 'unknown' END AS kind FROM ("
    + _STATEMENTS.replace("{lineitem}", "lineitem") + ") s"
)


def _lint_query(name: str, group: str, sql: str):
    @query(name, sql)
    def run(spark, sf_dir):
        rows = spark.sql(_STATEMENTS, lineitem=fx.table(spark, sf_dir, "lineitem"))
        return validate.lint_statements(rows, ["k", "n", "p", "s"], rules=(group,))

    return run


_K = "k, n, p, s"
_lint_query(
    "lint_statement_kind", "kind",
    f"""SELECT {_K}, kind AS rule, CASE kind WHEN 'empty' THEN 'E' ELSE 'W' END AS severity, CASE kind WHEN 'empty' THEN 'SQL statement is empty'
      ELSE 'Unknown SQL statement type: ' || left(sql, 30) || '...' END AS message FROM stm WHERE kind IN ('empty', 'unknown')""",
)
_lint_query(
    "lint_grant", "grant",
    f"""SELECT {_K}, 'grant_to' AS rule, 'E' AS severity, 'GRANT statement missing TO clause' AS message FROM stm WHERE kind = 'grant' AND NOT contains(t, ' TO ')
    UNION ALL SELECT {_K}, 'grant_on', 'E', 'GRANT statement missing ON clause' FROM stm WHERE kind = 'grant' AND NOT contains(t, ' ON ')
    UNION ALL SELECT {_K}, 'grant_privilege', 'W', 'Potentially invalid privilege: ' || pr FROM (SELECT *, trim(split_part(split_part(t, 'GRANT', 2), 'ON', 1)) AS pr
      FROM stm WHERE kind = 'grant') g WHERE pr NOT IN {o.words(C.KNOWN_PRIVILEGES)}""",
)
_lint_query(
    "lint_function", "function",
    f"""SELECT {_K}, 'function_return' AS rule, 'E' AS severity, 'Function missing RETURN clause' AS message FROM stm WHERE kind = 'function' AND NOT contains(t, 'RETURN')
    UNION ALL SELECT {_K}, 'function_name', 'W', 'Function should use fully qualified name (catalog.schema.function)' FROM stm WHERE kind = 'function' AND NOT contains(sql, '.')""",
)
_lint_query(
    "lint_alter", "alter",
    f"""SELECT {_K}, 'alter_operation' AS rule, 'W' AS severity, 'ALTER statement has unknown operation type' AS message FROM stm
    WHERE kind = 'alter' AND NOT regexp_matches(t, 'SET ROW FILTER|ALTER COLUMN|SET MASK|SET TAGS')""",
)
_lint_query(
    "lint_tag", "tag",
    f"""SELECT {_K}, 'tag_exists' AS rule, 'W' AS severity, 'CREATE TAG should use IF NOT EXISTS for idempotency' AS message FROM stm
    WHERE kind = 'tag' AND NOT contains(t, 'IF NOT EXISTS')""",
)
