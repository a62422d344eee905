"""Queries for sinks, apply outcomes, summaries and the audit views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palisade import constants as C
from palisade.operators import audit, translate, validate
from palisade.operators.config import Config
from palisade.plans import fixtures as fx
from palisade.plans import oracle as o
from palisade.plans.registry import query
from palisade.plans.translation_queries import (
    _ATTRIBUTION, _DISTINCT, _FILTER_ERRORS, _MASK_ERRORS, _TAG_MASK_ERRORS, config, numbered_statements,
)
from palisade.session import scratch_dir
from palisade.sources import documents as docs
from palisade.sources import sinks

RUN_AT = "2024-06-01 12:00:00"


def audit_schema(spark) -> str:
    """A schema of its own with empty audit tables, in the shared scratch folder."""
    name = f"audit_{uuid.uuid4().hex}"
    sinks.create_audit_tables(spark, name, scratch_dir(spark, name))
    return name


def run_time():
    return F.lit(RUN_AT).cast("timestamp")


def _translation_log(spark, sf_dir):
    return fx.relation(spark, sf_dir, fx.translation_log_sql, "events")


def _apply_log(spark, sf_dir):
    return fx.relation(spark, sf_dir, fx.apply_log_sql, "events")


def _outcomes(spark, sf_dir):
    return fx.relation(spark, sf_dir, fx.outcomes_sql, "lineitem")


def _outputs(spark, sf_dir):
    """Every policy is applied, also those without a line."""
    return fx.inputs(spark, sf_dir).policies.select("policy_key")


def _statements(spark, sf_dir):
    run, c = fx.inputs(spark, sf_dir), config(spark, sf_dir)
    return fx.staged(spark, sf_dir, "statements", lambda: translate.translate_all(run, c))


# --- sinks -----------------------------------------------------------------------------------

_NUMBERED = f"""SELECT priority AS source, policy_key, CAST(row_number() OVER (PARTITION BY priority ORDER BY policy_key, {o.ORDER}) AS BIGINT) AS stmt_no,
  CAST(count(*) OVER (PARTITION BY priority) AS BIGINT) AS stmt_total, sql FROM all_sql JOIN base USING (policy_key)"""


_RULE = o.lit(C.SCRIPT_RULE)


@query(
    "write_sql_script",
    f"""SELECT source, stmt_no, {_RULE} || chr(10) || '-- Statement ' || stmt_no || ' of ' || stmt_total || chr(10) || {_RULE} || chr(10) || {o.strip('sql')} AS block
    FROM ({_NUMBERED}) t""",
)
def write_sql_script(spark, sf_dir):
    """Write one script per source, read the scripts back and take them apart at the banners."""
    path = scratch_dir(spark, "scripts")
    sinks.write_sql_script(numbered_statements(spark, sf_dir), path)
    files = spark.read.schema("value string, source string").text(path, wholetext=True)
    blocks = F.split("value", f"(?m)(?=^{C.SCRIPT_RULE}\n-- Statement [0-9]+ of [0-9]+\n)")
    rows = files.select("source", F.explode(blocks).alias("block")).filter("block <> ''")
    number = F.regexp_extract("block", "-- Statement ([0-9]+) of", 1).cast("bigint")
    return rows.select("source", number.alias("stmt_no"), F.regexp_replace("block", "\n+\\z", "").alias("block"))


@query("append_history", "SELECT event_id, CAST(event_id % 7 AS INTEGER) AS policies FROM events ORDER BY ts DESC, event_id LIMIT 200")
def append_history(spark, sf_dir):
    path = scratch_dir(spark, "history")
    runs = _runs(spark, sf_dir)
    for kind in ("error", "other"):
        is_error = F.col("event_type") == "error"
        sinks.append_history(runs.filter(is_error if kind == "error" else ~is_error), path)
    return audit.history_top(spark.read.parquet(path), 200, "event_id").select("event_id", "policies")


@query(
    "append_raw_policies",
    "SELECT DISTINCT source AS file_name, 'ui' AS upload_source, env IN (2) AS has_test_cases FROM docall WHERE blk % 97 <> 0 "
    "UNION ALL SELECT DISTINCT source, 'ui', NULL FROM docall WHERE blk % 97 = 0",
)
def append_raw_policies(spark, sf_dir):
    schema = audit_schema(spark)
    sinks.append_raw_policies(fx.documents(spark, sf_dir), schema, run_time())
    rows = spark.table(f"{schema}.ranger_policies_raw")
    keys = F.expr("json_object_keys(policies_json)")
    return rows.select("file_name", "upload_source", F.array_contains(keys, "testCases").alias("has_test_cases"))


_LOST = """SELECT policy_key, 'Not translatable — ''' || name || ''' (id=' || policy_id || '): ' || CASE route WHEN 'access' THEN array_to_string(reasons, '; ')
  ELSE 'resource types ' || types || ' have no UC equivalent.' END AS message FROM nt"""
o.CTES["terrors"] = f"{_LOST} UNION ALL {_FILTER_ERRORS} UNION ALL {_MASK_ERRORS} UNION ALL {_TAG_MASK_ERRORS}"
o.CTES["touts"] = (
    "SELECT DISTINCT policy_key, policy_type FROM all_sql UNION SELECT policy_key, 'COLUMN_MASK_TAG' FROM pol JOIN mkind USING (policy_key) WHERE route = 'tag_mask'"
)


_WHO = f"""SELECT policy_key, string_agg(label, ', ' ORDER BY section, obj_pos, item_pos, prin_pos) AS principals FROM ({_ATTRIBUTION}
    UNION ALL SELECT policy_key, place[1], 0, place[2], place[3], label FROM ({_DISTINCT}) d) a GROUP BY policy_key"""
_PATH_LIST = """SELECT policy_key, '[''' || string_agg(path, ''', ''' ORDER BY obj_pos) || ''']' AS pathlist FROM paths GROUP BY policy_key"""


@query(
    "output_policies",
    f"""SELECT policy_key, policy_id, t.policy_type,
      CASE t.policy_type WHEN 'EXTERNAL_LOCATION' THEN 'External Location grant for path(s): ' || pathlist
        WHEN 'NOT_TRANSLATABLE' THEN 'Cannot translate ' || CASE route WHEN 'row_filter' THEN 'row filter policy' WHEN 'column_mask' THEN 'column mask policy'
          ELSE 'policy' END || ' ''' || name || ''' to Unity Catalog'
        ELSE coalesce(nullif(description, ''), CASE t.policy_type WHEN 'ACCESS' THEN 'Access policy for ' || res WHEN 'ROW_FILTER' THEN 'Row filter for ' || res
          WHEN 'COLUMN_MASK' THEN 'Column masking for ' || res WHEN 'ACCESS_TAG' THEN 'Tag-based access for: ' || taglist
          ELSE 'Tag-based column masking for ' || tag1 END) END AS description,
      CASE t.policy_type WHEN 'EXTERNAL_LOCATION' THEN 'EXTERNAL LOCATION ' || pathlist
        WHEN 'NOT_TRANSLATABLE' THEN CASE WHEN len(kinds) = 0 THEN '[]' ELSE '[''' || array_to_string(kinds, ''', ''') || ''']' END
        WHEN 'ACCESS_TAG' THEN 'TAG ' || taglist WHEN 'COLUMN_MASK_TAG' THEN 'main.ranger_migration.<table_with_' || tag1 || '>' ELSE res END AS resource,
      CASE t.policy_type WHEN 'NOT_TRANSLATABLE' THEN '' ELSE coalesce(principals, '') END AS principals
    FROM touts t JOIN (SELECT * EXCLUDE (policy_type), array_to_string(list_sort(list_distinct(list_filter([tag1, tag2], lambda x: x IS NOT NULL))), ', ') AS taglist
      FROM pol) p USING (policy_key) LEFT JOIN ({_PATH_LIST}) l USING (policy_key) LEFT JOIN ({_WHO}) w USING (policy_key)""",
)
def output_policies(spark, sf_dir):
    """What a run makes of each policy: its kind, description, object and principals."""
    run = fx.inputs(spark, sf_dir)
    return translate.output_policy_table(run, _statements(spark, sf_dir), config(spark, sf_dir))


@query(
    "append_translation_log",
    """SELECT source AS metadata, CAST(n AS INTEGER) AS ranger_policy_count, CAST(coalesce(u, 0) AS INTEGER) AS uc_policy_count,
      CAST(coalesce(e, 0) AS INTEGER) AS error_count, errors FROM (SELECT policy_key // 64 AS b, '{''source'': ''b' || b || '''}' AS source, count(*) AS n FROM base GROUP BY b) p
    LEFT JOIN (SELECT policy_key // 64 AS b, count(*) AS u FROM touts GROUP BY b) x USING (b)
    LEFT JOIN (SELECT policy_key // 64 AS b, count(*) AS e, string_agg(message, '; ' ORDER BY policy_key, message) AS errors FROM terrors GROUP BY b) y USING (b)""",
)
def append_translation_log(spark, sf_dir):
    """One log row per run of 64 policies."""
    run, c = fx.inputs(spark, sf_dir), config(spark, sf_dir)
    source = F.concat(F.lit("b"), F.expr("policy_key div 64").cast("string")).alias("source")
    statements = _statements(spark, sf_dir)
    outputs = translate.output_policies(run, statements).select(source)
    errors = translate.translation_errors(run, c).select(source, F.col("policy_key").alias("pos"), "message")
    schema = audit_schema(spark)
    sinks.append_translation_log(
        sinks.translation_log_rows(run.policies.select(source), outputs, errors, run_time()), schema
    )
    return spark.table(f"{schema}.translation_log").select(
        "metadata", "ranger_policy_count", "uc_policy_count", "error_count", "errors"
    )


_SKIP = """SELECT policy_key, CAST(count(*) FILTER (ok) AS INTEGER) AS executed_count, CAST(count(*) AS INTEGER) AS total_statements,
  string_agg(error, '; ' ORDER BY statement_idx) AS error_details FROM outcomes GROUP BY policy_key
  UNION ALL SELECT policy_key, 0, 0, NULL FROM base WHERE policy_key NOT IN (SELECT policy_key FROM outcomes)"""
_SKIP = f"""SELECT policy_key, CASE WHEN executed_count = total_statements THEN 'success' ELSE 'partial' END AS status,
  CASE WHEN executed_count = total_statements THEN 'Successfully executed ' || executed_count || ' statements'
    ELSE 'Completed with errors: ' || executed_count || '/' || total_statements || ' successful' END AS message,
  executed_count, total_statements, error_details FROM ({_SKIP}) s"""


@query(
    "append_apply_log",
    f"SELECT CAST(policy_key AS VARCHAR) AS policy_id, 'ACCESS' AS policy_type, status, message, executed_count, total_statements, error_details, CAST(NULL AS VARCHAR) AS applied_by FROM ({_SKIP}) t",
)
def append_apply_log(spark, sf_dir):
    results = audit.apply_outcomes_skip(_outputs(spark, sf_dir), _outcomes(spark, sf_dir)).withColumns(
        {"policy_id": F.col("policy_key").cast("string"), "policy_type": F.lit("ACCESS")}
    )
    schema = audit_schema(spark)
    sinks.append_apply_log(results, schema, run_time())
    return spark.table(f"{schema}.uc_policies_applied").drop("timestamp")


_DAILY = """SELECT CAST(timestamp AS DATE) AS translation_date, count(*) AS translation_count, CAST(sum(ranger_policy_count) AS BIGINT) AS total_ranger_policies,
  CAST(sum(uc_policy_count) AS BIGINT) AS total_uc_policies, CAST(sum(error_count) AS BIGINT) AS total_errors FROM tlog GROUP BY ALL"""


@query("create_audit_tables", _DAILY)
def create_audit_tables(spark, sf_dir):
    """Create tables and views (twice: the second time changes nothing), log runs, read a view."""
    schema = audit_schema(spark)
    sinks.create_audit_tables(spark, schema)
    sinks.create_audit_views(spark, schema)
    sinks.append_translation_log(_translation_log(spark, sf_dir), schema)
    return spark.table(f"{schema}.v_translation_summary")


# --- apply outcomes --------------------------------------------------------------------------------


@query(
    "dry_run_plan",
    """SELECT policy_key, policy_type, 'skipped' AS status, 'Dry run - not executed' AS message, 0 AS executed_count,
      CAST(count(sql) AS INTEGER) AS total_statements FROM touts LEFT JOIN all_sql USING (policy_key, policy_type) GROUP BY policy_key, policy_type""",
)
def dry_run_plan(spark, sf_dir):
    run, statements = fx.inputs(spark, sf_dir), _statements(spark, sf_dir)
    return audit.dry_run_plan(translate.output_policies(run, statements), statements)


@query("apply_outcomes_skip", _SKIP)
def apply_outcomes_skip(spark, sf_dir):
    return audit.apply_outcomes_skip(_outputs(spark, sf_dir), _outcomes(spark, sf_dir))


@query(
    "apply_outcomes_strict",
    """SELECT policy_key, CASE WHEN stop IS NULL THEN 'success' ELSE 'error' END AS status,
      CASE WHEN stop IS NULL THEN 'Successfully executed ' || n || ' statements' ELSE 'Failed after ' || n || ' statements' END AS message,
      CAST(n AS INTEGER) AS executed_count, CAST(total AS INTEGER) AS total_statements, error_details FROM (
      SELECT policy_key, stop, count(*) AS total, count(*) FILTER (stop IS NULL OR statement_idx < stop) AS n, max(error) FILTER (statement_idx = stop) AS error_details
      FROM (SELECT *, min(CASE WHEN NOT ok THEN statement_idx END) OVER (PARTITION BY policy_key) AS stop FROM outcomes) t GROUP BY policy_key, stop) s
      UNION ALL SELECT policy_key, 'success', 'Successfully executed 0 statements', 0, 0, NULL FROM base WHERE policy_key NOT IN (SELECT policy_key FROM outcomes)""",
)
def apply_outcomes_strict(spark, sf_dir):
    return audit.apply_outcomes_strict(_outputs(spark, sf_dir), _outcomes(spark, sf_dir))


@query(
    "apply_report",
    """SELECT policy_id AS "Policy ID", policy_type AS "Type", status AS "Status", message AS "Message", executed_count AS "Executed",
      total_statements AS "Total SQL", coalesce(error_details, '-') AS "Errors" FROM alog""",
)
def apply_report(spark, sf_dir):
    return audit.apply_report(_apply_log(spark, sf_dir))


@query(
    "audit_record",
    """SELECT CAST(policy_key AS VARCHAR) AS policy_id, item_pos, array_to_string(list_filter([a1, a2], lambda x: x IS NOT NULL), ';') AS statements,
      CASE WHEN kind = 'deny' THEN 0 ELSE len(list_filter([a1, a2], lambda x: x IS NOT NULL))::INTEGER END AS statement_count FROM items WHERE kind <> 'deny'
    UNION ALL SELECT CAST(policy_key AS VARCHAR), item_pos, '', 0 FROM items WHERE kind = 'deny'""",
)
def audit_record(spark, sf_dir):
    listed = F.when(F.col("kind") != "deny", F.array_compact(F.array("a1", "a2")))
    results = fx.fx_items(spark, sf_dir).select(
        "policy_key", F.col("item_pos").cast("string").alias("message"), listed.alias("statements"),
        F.lit("ACCESS").alias("policy_type"), F.lit("success").alias("status"),
    )
    rows = audit.audit_record(results, run_time())
    return rows.select(
        "policy_id", F.col("message").cast("bigint").alias("item_pos"),
        F.array_join("sql_statements", ";").alias("statements"), "statement_count",
    )


# --- summaries ----------------------------------------------------------------------------------------


@query(
    "policy_summary",
    """SELECT count(*) AS total, count(*) FILTER (policy_type = 'ACCESS') AS access, count(*) FILTER (policy_type = 'ROW_FILTER') AS row_filter,
      count(*) FILTER (policy_type = 'COLUMN_MASK') AS column_mask, (SELECT count(DISTINCT source) FROM docall WHERE blk % 97 = 0) AS errors FROM doc""",
)
def policy_summary(spark, sf_dir):
    files = fx.documents(spark, sf_dir)
    parsed = docs.parse_policies(docs.unwrap_policies(files))
    errors = docs.document_errors(files).select("source").unionByName(docs.policy_errors(parsed).select("source"))
    return audit.policy_summary(docs.normalise_policies(parsed), errors)


@query(
    "apply_summary",
    """SELECT count(*) AS total_policies, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS errors,
      count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'skipped') AS skipped,
      printf('%.1f%%', count(*) FILTER (status = 'success') * 100.0::DOUBLE / count(*)) AS success_rate, CAST(sum(executed_count) AS BIGINT) AS total_statements_executed FROM alog""",
)
def apply_summary(spark, sf_dir):
    return audit.apply_summary(_apply_log(spark, sf_dir))


@query(
    "translation_stats",
    f"""SELECT (SELECT count(*) FROM base) AS policies, (SELECT count(*) FROM all_sql) + (SELECT count(*) FROM ({o.finish('r_tag', 'taghead')}) t) AS statements,
      (SELECT count(*) FROM touts WHERE policy_type <> 'NOT_TRANSLATABLE') AS translatable,
      (SELECT count(*) FROM touts WHERE policy_type = 'NOT_TRANSLATABLE') AS not_translatable, (SELECT count(*) FROM terrors) AS warnings""",
)
def translation_stats(spark, sf_dir):
    from palisade.operators import tags

    run, c = fx.inputs(spark, sf_dir), config(spark, sf_dir)
    statements = fx.staged(spark, sf_dir, "statements", lambda: translate.translate_all(run, c))
    first = tags.tag_statements(run.definitions, run.attributes, run.resource_tags, Config())
    return audit.translation_stats(
        run.policies, statements.select("sql").unionByName(first.select("sql")),
        translate.output_policies(run, statements), translate.translation_errors(run, c),
    )


def _runs(spark, sf_dir):
    """Run history from events: one translation run per event."""
    events = fx.table(spark, sf_dir, "events")
    return events.select(
        F.col("ts").alias("timestamp"), "event_id", "event_type", (F.col("event_id") % 7).cast("int").alias("policies"),
        F.col("user_id").cast("int").alias("sql_statements"), (F.col("event_id") % 3).cast("int").alias("not_translatable"),
    )


@query(
    "history_totals",
    "SELECT count(*) AS runs, CAST(sum(event_id % 7) AS BIGINT) AS total_policies, CAST(sum(user_id) AS BIGINT) AS total_sql_statements, CAST(sum(event_id % 3) AS BIGINT) AS total_skipped FROM events",
)
def history_totals(spark, sf_dir):
    return audit.history_totals(_runs(spark, sf_dir))


@query("history_top200", "SELECT event_id, CAST(user_id AS INTEGER) AS sql_statements FROM events ORDER BY ts DESC, event_id LIMIT 200")
def history_top200(spark, sf_dir):
    return audit.history_top(_runs(spark, sf_dir), 200, "event_id").select("event_id", "sql_statements")


@query("daily_translation_summary", _DAILY)
def daily_translation_summary(spark, sf_dir):
    return audit.daily_translation_summary(_translation_log(spark, sf_dir))


@query(
    "daily_application_summary",
    """SELECT CAST(timestamp AS DATE) AS application_date, policy_type, status, count(*) AS policy_count, CAST(sum(executed_count) AS BIGINT) AS statements_executed,
      CAST(sum(total_statements) AS BIGINT) AS total_statements FROM alog GROUP BY ALL""",
)
def daily_application_summary(spark, sf_dir):
    return audit.daily_application_summary(_apply_log(spark, sf_dir))


@query(
    "recent_errors",
    """SELECT policy_id, policy_type, status, message, error_details FROM alog WHERE status IN ('error', 'partial')
    ORDER BY timestamp DESC, policy_id, policy_type, status LIMIT 100""",
)
def recent_errors(spark, sf_dir):
    return audit.recent_errors(_apply_log(spark, sf_dir)).drop("timestamp")


@query(
    "preview_first_n",
    "SELECT policy_id, status, (SELECT count(*) FROM alog) > 50 AS truncated FROM alog ORDER BY timestamp, CAST(policy_id AS BIGINT) LIMIT 50",
)
def preview_first_n(spark, sf_dir):
    rows = _apply_log(spark, sf_dir).withColumn("number", F.col("policy_id").cast("bigint"))
    return audit.preview(rows, 50, "timestamp", "number").select("policy_id", "status", "truncated")


@query(
    "corpus_stats",
    """SELECT count(*) AS total, count(*) FILTER (v AND p) AS passed, count(*) FILTER (NOT (v AND p)) AS failed, count(*) FILTER (NOT v) AS validation_failed,
      count(*) FILTER (NOT p) AS parsing_failed, count(*) FILTER (NOT p) AS translation_failed, CAST(sum(policies) AS BIGINT) AS total_policies,
      (SELECT count(*) FROM all_sql SEMI JOIN doc USING (policy_key)) AS total_sql_statements FROM (
      SELECT source, min(blk % 97) <> 0 AS p, min(blk % 97) <> 0 AND min(env) IN (0, 2) AND bool_and(name <> '' AND len(kinds) > 0 AND policy_key NOT IN (
          SELECT policy_key FROM items WHERE filter_expr = '')) AS v,
        count(*) FILTER (policy_key IN (SELECT policy_key FROM doc)) AS policies FROM docall GROUP BY source) t""",
)
def corpus_stats(spark, sf_dir):
    """Validate, parse and translate every file; count what passed each stage."""
    files = fx.documents(spark, sf_dir)
    tables = document_tables(spark, sf_dir)
    run = translate.Inputs(
        tables.policies.withColumn("scope", F.lit("")), tables.access_items, tables.filter_items, tables.mask_items,
        fx.definitions(spark, sf_dir), fx.attributes(spark, sf_dir), fx.resource_tags(spark, sf_dir),
    )
    statements = fx.staged(
        spark, sf_dir, "file_statements", lambda: translate.translate_all(run, config(spark, sf_dir))
    )
    per_policy = statements.groupBy("policy_key").agg(F.count(F.lit(1)).alias("n"))
    per_file = tables.policies.join(per_policy, "policy_key", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("policies"), F.coalesce(F.sum("n"), F.lit(0)).alias("statements")
    )
    verdicts = validate.validation_verdict(files).select("source", "is_valid")
    broken = docs.document_errors(files).select("source", F.lit(True).alias("broken"))
    zero, no = F.lit(0).cast("bigint"), F.lit(False)
    rows = (
        files.select("source").join(verdicts, "source", "left").join(broken, "source", "left")
        .join(per_file, "source", "left")
        .select(
            "source", F.coalesce("is_valid", no).alias("validation_ok"), (~F.coalesce("broken", no)).alias("parsing_ok"),
            (~F.coalesce("broken", no)).alias("translation_ok"), F.coalesce("policies", zero).alias("policies"),
            F.coalesce("statements", zero).alias("statements"),
        )
    )
    return audit.corpus_stats(rows)


def document_tables(spark, sf_dir) -> docs.PolicyTables:
    """The relations of the policy files, from files parsed and written once.

    The parsed form is nested; each relation reads only the nested fields it needs.
    """
    files = fx.documents(spark, sf_dir)
    parsed = fx.staged(spark, sf_dir, "file_parsed", lambda: docs.parse_policies(docs.unwrap_policies(files)))
    return docs.PolicyTables(
        docs.normalise_policies(parsed), docs.normalise_access_items(parsed),
        docs.normalise_filter_items(parsed), docs.normalise_mask_items(parsed),
    )
