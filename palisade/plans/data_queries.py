"""Queries for scalar functions and for masks and filters on data."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade import constants as C
from palisade.functions import identifiers as ids
from palisade.functions import masks, text
from palisade.operators import enforce
from palisade.operators.enforce import FilterRule, MaskRule, Principal
from palisade.plans import fixtures as fx
from palisade.plans import oracle as o
from palisade.plans.registry import query

# --- masks ------------------------------------------------------------------------------

LAST4 = "repeat('X', greatest(length({c}) - 4, 0)::INT) || right({c}, 4)"
FIRST4 = "left({c}, 4) || repeat('X', greatest(length({c}) - 4, 0)::INT)"


def _mask_query(name: str, table: str, key: str, column: str, fn, sql: str, cast: str | None = None):
    @query(name, f"SELECT {key}, {sql.replace('{c}', column)} AS masked FROM {table}")
    def run(spark, sf_dir):
        masked = fn(column)
        return fx.table(spark, sf_dir, table).select(key, (masked.cast(cast) if cast else masked).alias("masked"))

    return run


_mask_query("mask_none", "customer", "c_custkey", "c_name", masks.mask_none, "{c}")
_mask_query("mask_full", "customer", "c_custkey", "c_name", masks.mask_full, "'XXXXX'")
_mask_query("mask_show_last_4", "nation", "n_nationkey", "n_name", masks.mask_show_last_4, LAST4)
_mask_query("mask_show_first_4", "customer", "c_custkey", "c_mktsegment", masks.mask_show_first_4, FIRST4)
_mask_query("mask_hash", "documents", "doc_id", "text", masks.mask_hash, "sha256({c})")
_mask_query("mask_null", "conversations", "conv_id", "text", masks.mask_null, "CAST(NULL AS VARCHAR)")
_mask_query("mask_date_show_year", "orders", "o_orderkey", "o_orderdate", masks.mask_date_show_year, "make_date(year({c}), 1, 1)")
_mask_query(
    "mask_timestamp_show_date", "events", "event_id", "ts", masks.mask_timestamp_show_date,
    "strftime(date_trunc('day', {c}), '%Y-%m-%d %H:%M:%S')", "string",
)
_mask_query("mask_redact", "customer", "c_custkey", "c_mktsegment", masks.mask_redact, "'[REDACTED]'")

_KINDS = "SELECT policy_key, item_pos, mask_type FROM items WHERE mask_type IS NOT NULL"
_KNOWN = "(" + ", ".join(o.lit(k) for k in C.MASKS) + ")"


@query(
    "mask_fallback",
    f"""SELECT policy_key, item_pos, CASE WHEN mask_type IN {_KNOWN} THEN mask_type ELSE 'MASK_REDACT' END AS for_resource,
      CASE WHEN mask_type IN {_KNOWN} THEN mask_type ELSE 'MASK_HASH' END AS for_tag,
      {o.mask_template('mask_type', "'c'", 'MASK_REDACT')} AS sql_text FROM ({_KINDS}) t""",
)
def mask_fallback(spark, sf_dir):
    rows = fx.mask_items(fx.fx_items(spark, sf_dir))
    kind = F.col("mask_type")
    return rows.select(
        "policy_key", "item_pos",
        masks.effective_mask(kind, masks.RESOURCE_FALLBACK).alias("for_resource"),
        masks.effective_mask(kind, masks.TAG_FALLBACK).alias("for_tag"),
        masks.mask_text(kind, F.lit("c"), masks.RESOURCE_FALLBACK).alias("sql_text"),
    )


@query("mask_signature", f"SELECT policy_key, item_pos, {o.mask_type('mask_type')} AS sql_type FROM ({_KINDS}) t")
def mask_signature(spark, sf_dir):
    rows = fx.mask_items(fx.fx_items(spark, sf_dir))
    return rows.select("policy_key", "item_pos", masks.mask_sql_type(F.col("mask_type")).alias("sql_type"))


# --- names and paths ------------------------------------------------------------------------

_NAMES = """SELECT DISTINCT name FROM (SELECT p_brand AS name FROM {part} UNION ALL SELECT p_name FROM {part}
  UNION ALL SELECT CAST(p_size AS STRING) || 'x' FROM {part} UNION ALL SELECT n_name FROM {nation}
  UNION ALL SELECT c_mktsegment FROM {customer}) AS n"""


def _duck(template: str) -> str:
    return template.replace("{", "").replace("}", "")


def _names(spark, sf_dir):
    frames = {t: fx.table(spark, sf_dir, t) for t in ("part", "nation", "customer")}
    return spark.sql(_NAMES, **frames)


@query("quote_identifier", f"SELECT name, {o.quote('name')} AS quoted FROM ({_duck(_NAMES)}) t")
def quote_identifier(spark, sf_dir):
    return _names(spark, sf_dir).select("name", ids.quote_identifier(F.col("name")).alias("quoted"))


@query(
    "sanitize_identifier",
    f"SELECT name, CASE WHEN substr(name, 1, 1) BETWEEN '0' AND '9' THEN '`' || name || '`' ELSE {o.quote('name')} END AS quoted FROM ({_duck(_NAMES)}) t",
)
def sanitize_identifier(spark, sf_dir):
    return _names(spark, sf_dir).select("name", ids.sanitize_identifier(F.col("name")).alias("quoted"))


_PATHS = """SELECT l_orderkey AS k, l_linenumber AS n, CASE l_partkey % 5 WHEN 0 THEN '/c' WHEN 1 THEN '/c/s' || CAST(l_suppkey AS STRING)
    WHEN 2 THEN 'c/s/t-' || CAST(l_partkey AS STRING) || '/' WHEN 3 THEN '/c/s/9t/col' || CAST(l_linenumber AS STRING) ELSE '//c//t/x/y/z' END AS path
  FROM {lineitem}"""


def _paths(spark, sf_dir):
    return spark.sql(_PATHS, lineitem=fx.table(spark, sf_dir, "lineitem"))


_PARTS = f"SELECT k, n, path, string_split(trim(path, '/'), '/') AS p FROM ({_duck(_PATHS)}) t"


@query("parse_resource_path", f"SELECT k, n, p[1] AS catalog, p[2] AS schema_name, p[3] AS table_name, p[4] AS column_name FROM ({_PARTS}) q")
def parse_resource_path(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("k", "n", ids.parse_resource_path(F.col("path")).alias("r"))
    return rows.select(
        "k", "n", F.col("r.catalog").alias("catalog"), F.col("r.schema").alias("schema_name"),
        F.col("r.table").alias("table_name"), F.col("r.column").alias("column_name"),
    )


def _clean(x: str) -> str:
    return f"(CASE WHEN {x} <> '' THEN CASE WHEN substr({x}, 1, 1) BETWEEN '0' AND '9' THEN '`' || {x} || '`' ELSE {o.quote(x)} END END)"


@query(
    "build_resource_path",
    f"""SELECT k, n, array_to_string(list_filter([{_clean('p[1]')}, {_clean('p[2]')}, {_clean('p[3]')}], lambda x: x IS NOT NULL), '.')
      || coalesce('(' || {_clean('p[4]')} || ')', '') AS built FROM ({_PARTS}) q""",
)
def build_resource_path(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("k", "n", ids.parse_resource_path(F.col("path")).alias("r"))
    parts = [F.col(f"r.{c}") for c in ("catalog", "schema", "table", "column")]
    return rows.select("k", "n", ids.build_resource_path(*parts).alias("built"))


_DOTTED = """SELECT p_partkey AS k, CASE p_partkey % 9 WHEN 0 THEN 'main.' || p_type WHEN 1 THEN 'main.' || p_brand WHEN 2 THEN 'main.`' || p_brand || '`.t'
    WHEN 3 THEN 'a.b.c.d' WHEN 4 THEN p_type WHEN 5 THEN 'main.1x' WHEN 6 THEN 'main..t' WHEN 7 THEN 'c.s.t_' || CAST(p_size AS STRING)
    ELSE '`a`.`b c`' END AS name FROM {part}"""


@query(
    "validate_identifier",
    f"""SELECT k, name, len(p) BETWEEN 2 AND 3 AND len(list_filter(p, lambda x: NOT (regexp_matches(trim(x, '`'), '^[a-zA-Z][a-zA-Z0-9_]*$')
      OR (starts_with(x, '`') AND ends_with(x, '`'))))) = 0 AS valid FROM (SELECT k, name, string_split(name, '.') AS p FROM ({_duck(_DOTTED)}) t) q""",
)
def validate_identifier(spark, sf_dir):
    rows = spark.sql(_DOTTED, part=fx.table(spark, sf_dir, "part"))
    return rows.select("k", "name", ids.validate_identifier(F.col("name")).alias("valid"))


@query(
    "mask_function_name",
    f"SELECT policy_key, item_pos, 'mask_t_' || {o.plain('rf')} || '_' || {o.plain('coalesce(a2, a1)')} || '_' || {o.plain('lower(mask_type)')} AS fn FROM items WHERE mask_type IS NOT NULL",
)
def mask_function_name(spark, sf_dir):
    rows = fx.fx_items(spark, sf_dir).filter("mask_type IS NOT NULL")
    table = F.concat(F.lit("t-"), F.col("rf"))
    return rows.select(
        "policy_key", "item_pos",
        ids.mask_function_name(table, F.coalesce("a2", "a1"), F.col("mask_type")).alias("fn"),
    )


@query("filter_function_name", f"SELECT policy_key, item_pos, 'rf_' || {o.plain('coalesce(a2, a1)')} || '_' || policy_key || '_' || item_pos AS fn FROM items")
def filter_function_name(spark, sf_dir):
    rows = fx.fx_items(spark, sf_dir)
    return rows.select(
        "policy_key", "item_pos",
        ids.filter_function_name(F.coalesce("a2", "a1"), F.col("policy_key"), F.col("item_pos")).alias("fn"),
    )


# --- text ---------------------------------------------------------------------------------------


@query(
    "format_statement",
    f"""SELECT doc_id, md5({o.header('source', 'CAST(doc_id AS VARCHAR)', 'lang || text')} || {o.fmt_body('text')}) AS digest,
      CAST(length({o.fmt_body('text')}) AS INTEGER) AS body_length FROM documents""",
)
def format_statement(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    full = text.format_statement(
        F.col("text"), F.col("source"), F.col("doc_id").cast("string"), F.concat("lang", "text")
    )
    return docs.select("doc_id", F.md5(full).alias("digest"), F.length(text.format_body(F.col("text"))).alias("body_length"))


@query(
    "condition_to_sql",
    """SELECT policy_key, item_pos, CASE WHEN kind = 'deny' THEN coalesce(u1, 'TRUE') ELSE coalesce(nullif(array_to_string(list_filter([
      CASE WHEN u1 IS NOT NULL THEN 'users' || CASE WHEN u2 IS NOT NULL THEN ' IN (''' || u1 || ''', ''' || u2 || ''')' ELSE ' = ''' || u1 || '''' END END,
      CASE WHEN g1 IS NOT NULL THEN 'teams = ''' || g1 || '''' END], lambda x: x IS NOT NULL), ' AND '), ''), 'TRUE') END AS predicate
    FROM (SELECT policy_key, item_pos, kind, coalesce(u1, u2) AS u1, CASE WHEN u1 IS NOT NULL THEN u2 END AS u2, g1 FROM items) t""",
)
def condition_to_sql(spark, sf_dir):
    rows = fx.fx_items(spark, sf_dir)
    users = F.array_compact(F.array("u1", "u2"))
    entries = F.create_map(F.lit("users"), users, F.lit("teams"), F.array_compact(F.array("g1")))
    kind = F.when(F.col("kind") == "deny", F.lit("expression"))
    return rows.select("policy_key", "item_pos", text.condition_to_sql(kind, users, entries).alias("predicate"))


@query(
    "extract_table_placeholder",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '{table}' WHEN 1 THEN '{Table}' WHEN 2 THEN '{TABLE}' END AS placeholder FROM documents""",
)
def extract_table_placeholder(spark, sf_dir):
    mark = F.element_at(F.array(*map(F.lit, ("{table}", "{Table} {table}", "{TABLE}", "{tab}"))), (F.col("doc_id") % 4 + 1).cast("int"))
    docs = fx.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.extract_table_placeholder(F.concat("text", mark)).alias("placeholder"))


_FILTERS = "SELECT policy_key, item_pos, filter_expr FROM items WHERE filter_expr IS NOT NULL"


@query(
    "filter_columns",
    f"""SELECT policy_key, item_pos, array_to_string({o.first_seen(o.filter_words('filter_expr'))}, ',') AS plain_columns,
      array_to_string({o.first_seen(o.filter_words('filter_expr', session=False))}, ',') AS tag_columns FROM ({_FILTERS}) t""",
)
def filter_columns(spark, sf_dir):
    rows = fx.filter_items(fx.fx_items(spark, sf_dir))
    expression = F.col("filter_expr")
    return rows.select(
        "policy_key", "item_pos", F.array_join(text.filter_columns(expression), ",").alias("plain_columns"),
        F.array_join(text.filter_columns(expression, session_words=False), ",").alias("tag_columns"),
    )


@query("ordered_distinct", "SELECT policy_key, array_to_string(cols, ', ') AS columns FROM fcols WHERE len(cols) > 0")
def ordered_distinct(spark, sf_dir):
    from palisade.operators.filters import ordered_filter_columns

    return ordered_filter_columns(fx.filter_items(fx.fx_items(spark, sf_dir)))


# --- enforcement on the driver tables -----------------------------------------------------------------

CUSTOMER_FILTERS = [
    FilterRule("group", "BUILDING", "c_acctbal > 0"), FilterRule("user", "user_1", "c_nationkey = 3"),
]
ORDER_FILTERS = [
    FilterRule("user", "user_7", "o_orderstatus = 'F'"),
    FilterRule("group", "MACHINERY", "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
]


@query(
    "apply_column_mask",
    f"""SELECT c_custkey, {LAST4.replace('{c}', 'c_name')} AS c_name, c_nationkey, '[REDACTED]' AS c_mktsegment,
      sha256(CAST(c_nationkey AS VARCHAR)) AS hashed FROM customer""",
)
def apply_column_mask(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "customer").withColumn("hashed", F.col("c_nationkey"))
    rows = enforce.apply_column_mask(rows, "c_name", "MASK_SHOW_LAST_4")
    rows = enforce.apply_column_mask(rows, "c_mktsegment", "SHUFFLE")
    return enforce.apply_column_mask(rows, "hashed", "MASK_HASH").drop("c_acctbal")


@query(
    "apply_mask_for_principal",
    f"""SELECT o_orderkey, o_orderpriority AS for_clerk, {FIRST4.replace('{c}', 'o_orderpriority')} AS for_guest,
      CAST(o_orderdate AS DATE) AS day_clerk, make_date(year(o_orderdate), 1, 1) AS day_guest FROM orders""",
)
def apply_mask_for_principal(spark, sf_dir):
    rules = [
        MaskRule("o_orderpriority", "MASK_SHOW_FIRST_4", ("user_7",), ("MACHINERY",)),
        MaskRule("o_orderdate", "MASK_DATE_SHOW_YEAR", (), ("MACHINERY",)),
    ]
    rows = fx.table(spark, sf_dir, "orders")
    clerk, guest = Principal("user_9", ("MACHINERY",)), Principal("user_8", ("BUILDING",))
    return rows.select(
        "o_orderkey",
        enforce.masked_for(clerk, rules[0]).alias("for_clerk"), enforce.masked_for(guest, rules[0]).alias("for_guest"),
        enforce.masked_for(clerk, rules[1]).alias("day_clerk"), enforce.masked_for(guest, rules[1]).alias("day_guest"),
    )


@query(
    "apply_row_filter",
    "SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 0",
)
def apply_row_filter(spark, sf_dir):
    # user_1 is also in BUILDING: the first rule decides, the second is not applied.
    mine = Principal("user_1", ("BUILDING",))
    rows = enforce.apply_row_filter(fx.table(spark, sf_dir, "customer"), mine, CUSTOMER_FILTERS)
    return rows.select("c_custkey", "c_name")


# Three tables of data under names that tags know: the first and the last tagged one, and one without a tag.
_TAGGED_TABLES = ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey")
_READER = Principal("p_9", ("grp_R", "uc_4"))


def _table_names(resource_tags, parts: int) -> list[str]:
    key = F.substring_index("path", ".", 2)
    named = resource_tags.filter((F.size(F.split("path", r"\.")) >= parts) & ~F.endswith("path", F.lit("*")))
    row = named.agg(F.min(key).alias("first"), F.max(key).alias("last")).first()
    return [row["first"], row["last"], "db.untagged"]


_TABLES_SQL = """SELECT unnest(['customer', 'supplier', 'nation']) AS which, unnest([min(k), max(k), 'db.untagged']) AS k
  FROM (SELECT parts[1] || '.' || parts[2] AS k FROM tparts WHERE len(parts) >= {parts} AND parts[len(parts)] <> '*') x"""
_IDS_SQL = "SELECT 'customer' AS which, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'nation', n_nationkey FROM nation"
_MASKED_COLUMNS = [f"col{i}" for i in range(7)]


def _tag_mask_sql() -> str:
    def shown(i: int) -> str:
        v, kind = f"strftime(DATE '1992-01-01' + CAST((id + {i}) % 2000 AS INTEGER), '%Y-%m-%d')", f"kind{i}"
        masked = f"""CASE {kind} WHEN 'MASK' THEN 'XXXXX' WHEN 'MASK_SHOW_LAST_4' THEN repeat('X', 6) || right({v}, 4)
          WHEN 'MASK_SHOW_FIRST_4' THEN left({v}, 4) || repeat('X', 6) WHEN 'MASK_NULL' THEN NULL
          WHEN 'MASK_DATE_SHOW_YEAR' THEN left({v}, 4) || '-01-01' WHEN 'MASK_TIMESTAMP_SHOW_DATE' THEN {v} || ' 00:00:00'
          WHEN 'MASK_REDACT' THEN '[REDACTED]' ELSE sha256({v}) END"""
        plain = f"CASE WHEN {kind} = 'MASK_TIMESTAMP_SHOW_DATE' THEN {v} || ' 00:00:00' ELSE {v} END"
        return f"CASE WHEN {kind} IS NULL OR sees{i} THEN {plain} ELSE {masked} END AS col{i}"

    rules = ", ".join(
        f"max(CASE WHEN col = 'col{i}' THEN mask_kind END) AS kind{i}, coalesce(bool_or(col = 'col{i}' AND sees), false) AS sees{i}" for i in range(7)
    )
    return f"""SELECT which, id, {", ".join(map(shown, range(7)))} FROM ({_IDS_SQL}) d JOIN ({_TABLES_SQL.format(parts=3)}) t USING (which)
      LEFT JOIN (SELECT k, {rules} FROM (
        SELECT k, col, mask_kind, EXISTS (SELECT 1 FROM who w WHERE w.policy_key = r.p AND w.mask_type = 'MASK_NONE'
          AND (w.ptype = 'user' AND w.pname = 'p_9' OR w.ptype = 'group' AND w.principal IN ('grp_R', 'uc_4'))) AS sees
        FROM (SELECT c.db || '.' || c.tbl AS k, c.col, max(pol.policy_key) AS p FROM tcolumns c JOIN pol ON pol.tag1 = c.tag JOIN mkind USING (policy_key)
          WHERE route = 'tag_mask' AND mask_kind IS NOT NULL GROUP BY ALL) r JOIN mkind m ON m.policy_key = r.p) x GROUP BY k) y USING (k)"""


@query("apply_tag_mask", _tag_mask_sql())
def apply_tag_mask(spark, sf_dir):
    """Columns masked for one reader as the tags and the tag mask policies say."""
    policies, masks = fx.policies_frame(spark, sf_dir), fx.mask_items(fx.fx_items(spark, sf_dir))
    tags, out = fx.resource_tags(spark, sf_dir), None
    for (name, key), table in zip(_TAGGED_TABLES, _table_names(tags, 3)):
        day = lambda i: F.date_add(F.lit("1992-01-01").cast("date"), ((F.col(key) + i) % 2000).cast("int")).cast("string")
        data = fx.table(spark, sf_dir, name).select(
            F.lit(name).alias("which"), F.col(key).cast("bigint").alias("id"), *[day(i).alias(c) for i, c in enumerate(_MASKED_COLUMNS)]
        )
        shown = enforce.apply_tag_mask(data, tags, policies, masks, table, _READER, fx.mapping(spark, sf_dir))
        shown = shown.withColumns({c: F.col(c).cast("string") for c in _MASKED_COLUMNS})
        out = shown if out is None else out.unionByName(shown)
    return out


_PEOPLE_SQL = """SELECT which, id, CASE id % 4 WHEN 0 THEN 'WEST' WHEN 1 THEN 'CENTRAL' ELSE 'EAST' END AS region,
  CASE id % 3 WHEN 0 THEN '2023-06-01' ELSE '2024-02-01' END AS order_date, CASE id % 5 WHEN 0 THEN 'hr' ELSE 'it' END AS dept,
  CASE id % 2 WHEN 0 THEN 'Ann' ELSE 'Bob' END AS name, CASE id % 7 WHEN 0 THEN NULL ELSE 'open' END AS status,
  CASE id % 6 WHEN 0 THEN DATE '9999-01-01' ELSE DATE '2020-01-01' END AS day FROM {ids}"""
# What the expressions of the filter items mean for these rows.
_VISIBLE_SQL = """CASE filter_expr WHEN 'region = ''WEST''' THEN region = 'WEST'
  WHEN 'region IN (''WEST'', ''CENTRAL'')  AND order_date >= ''2024-01-01''' THEN region IN ('WEST', 'CENTRAL') AND order_date >= '2024-01-01'
  WHEN 'dept!=''hr'' OR name LIKE ''A%''' THEN dept <> 'hr' OR name LIKE 'A%'
  WHEN 'status IS NOT NULL AND CURRENT_DATE > day' THEN status IS NOT NULL AND day < DATE '9999-01-01' ELSE true END"""


@query(
    "apply_tag_row_filter",
    f"""SELECT which, id, region, dept, status FROM ({_PEOPLE_SQL.format(ids="(" + _IDS_SQL + ") ids")}) d JOIN ({_TABLES_SQL.format(parts=2)}) t USING (which)
    LEFT JOIN (SELECT table_key AS k, arg_max((i.policy_key, i.item_pos, i.filter_expr), (i.policy_key, i.item_pos)) AS last
      FROM ttables JOIN items i USING (policy_key) WHERE route = 'tag_access' AND i.filter_expr <> '' GROUP BY table_key) r USING (k)
    LEFT JOIN (SELECT policy_key, item_pos, bool_or(ptype = 'user' AND principal = 'p_9' OR ptype = 'group' AND principal IN ('grp_R', 'uc_4')) AS mine
      FROM who WHERE ptype <> 'role' GROUP BY ALL) w ON w.policy_key = last[1] AND w.item_pos = last[2]
    WHERE last IS NULL OR mine = false OR {_VISIBLE_SQL.replace('filter_expr', 'last[3]')}""",
)
def apply_tag_row_filter(spark, sf_dir):
    """Rows that one reader sees of each table, by its tags and the row filters of tag policies."""
    policies, filters = fx.policies_frame(spark, sf_dir), fx.filter_items(fx.fx_items(spark, sf_dir))
    tags, out = fx.resource_tags(spark, sf_dir), None
    for (name, key), table in zip(_TAGGED_TABLES, _table_names(tags, 2)):
        ids = fx.table(spark, sf_dir, name).select(F.lit(name).alias("which"), F.col(key).cast("bigint").alias("id"))
        data = spark.sql(_PEOPLE_SQL, ids=ids)
        seen = enforce.apply_tag_row_filter(data, tags, policies, filters, table, _READER, fx.mapping(spark, sf_dir))
        out = seen if out is None else out.unionByName(seen)
    return out.select("which", "id", "region", "dept", "status")


@query(
    "secured_view",
    f"""SELECT o_orderkey, {LAST4.replace('{c}', 'c_name')} AS c_name, '[REDACTED]' AS c_mktsegment, o_orderstatus,
      make_date(year(o_orderdate), 1, 1) AS o_orderdate, {FIRST4.replace('{c}', 'o_orderpriority')} AS o_orderpriority
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
)
def secured_view(spark, sf_dir):
    """What user_7 sees of orders with their customers."""
    user = Principal("user_7", ("HOUSEHOLD",))
    orders = enforce.secured_view(
        fx.table(spark, sf_dir, "orders"), "secured_orders", user, ORDER_FILTERS,
        [MaskRule("o_orderdate", "MASK_DATE_SHOW_YEAR"), MaskRule("o_orderpriority", "MASK_SHOW_FIRST_4")],
    )
    customer = enforce.secured_view(
        fx.table(spark, sf_dir, "customer"), "secured_customer", user, CUSTOMER_FILTERS,
        [MaskRule("c_name", "MASK_SHOW_LAST_4"), MaskRule("c_mktsegment", "MASK_REDACT")],
    )
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "o_orderkey", "c_name", "c_mktsegment", "o_orderstatus", "o_orderdate", "o_orderpriority"
    )


@query(
    "rows_visible_per_principal",
    """SELECT user_name, CASE WHEN user_name = 'user_7' THEN (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')
      WHEN segment_group = 'MACHINERY' THEN (SELECT count(*) FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
      WHEN n_nationkey % 3 < 2 THEN (SELECT count(*) FROM orders WHERE o_totalprice > 1000 * (n_nationkey % 10) AND o_custkey % 2 = n_nationkey % 3)
      ELSE (SELECT count(*) FROM orders) END AS visible FROM fxprin JOIN nation ON n_name = nation_group""",
)
def rows_visible_per_principal(spark, sf_dir):
    people = fx.relation(spark, sf_dir, fx.principals_sql, "customer", "nation", "region").select(
        "user_name", F.array("segment_group", "nation_group").alias("groups")
    )
    fixed = spark.createDataFrame([(i, r.kind, r.name, r.predicate) for i, r in enumerate(ORDER_FILTERS)], "rule_pos int, kind string, name string, predicate string")
    # Two of three nations have a rule of their own, in a table.
    n = F.col("n_nationkey")
    nations = fx.table(spark, sf_dir, "nation").filter(n % 3 < 2).select(
        (n + 10).cast("int").alias("rule_pos"), F.lit("group").alias("kind"), F.col("n_name").alias("name"),
        F.format_string("o_totalprice > %d AND o_custkey %% 2 = %d", (n % 10 * 1000).cast("int"), (n % 3).cast("int")).alias("predicate"),
    )
    rules = fixed.unionByName(nations)
    return enforce.rows_visible_per_principal(people, rules, fx.table(spark, sf_dir, "orders"))


# --- SQL functions -------------------------------------------------------------------------------------------


@query(
    "register_mask_functions",
    f"""SELECT o_orderkey, {FIRST4.replace('{c}', 'o_orderpriority')} AS priority, make_date(year(o_orderdate), 1, 1) AS day,
      '[REDACTED]' AS status FROM orders WHERE o_orderstatus = 'F'""",
)
def register_mask_functions(spark, sf_dir):
    fns = enforce.register_mask_functions(spark, ["MASK_SHOW_FIRST_4", "MASK_DATE_SHOW_YEAR", "MASK_REDACT"])
    enforce.register_filter_function(
        spark, "fn_orders_visible", ["o_orderstatus", "o_orderpriority"], Principal("user_7"), ORDER_FILTERS
    )
    return spark.sql(
        f"SELECT o_orderkey, {fns['MASK_SHOW_FIRST_4']}(o_orderpriority) AS priority, "
        f"{fns['MASK_DATE_SHOW_YEAR']}(CAST(o_orderdate AS DATE)) AS day, {fns['MASK_REDACT']}(o_orderstatus) AS status "
        "FROM {orders} WHERE fn_orders_visible(o_orderstatus, o_orderpriority)",
        orders=fx.table(spark, sf_dir, "orders"),
    )


@query(
    "register_custom_mask",
    "SELECT c_custkey, left(c_name, 1) || '***' AS initial, lower(left(c_mktsegment, 2)) AS code FROM customer",
)
def register_custom_mask(spark, sf_dir):
    custom = {"INITIAL": "CONCAT(LEFT({column}, 1), '***')", "CODE": "LOWER(LEFT({column}, 2))"}
    rows = fx.table(spark, sf_dir, "customer").withColumnsRenamed({"c_name": "initial", "c_mktsegment": "code"})
    rows = enforce.apply_mask_for_principal(rows, Principal("user_1"), [MaskRule("initial", "INITIAL")], custom)
    return enforce.apply_column_mask(rows, "code", "CODE", custom).select("c_custkey", "initial", "code")
