"""Policy relations derived from the driver tables.

Each relation is one SELECT. Spark and the SQL oracle read the same text, with three
dialect differences filled in. Every grouping here has groups of bounded size: items are
keyed by (order, line number) and keep minima and maxima only, so an order that holds a
third of all lines is combined before the shuffle like any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.operators.translate import Inputs
from palisade.session import scratch_dir


@dataclass(frozen=True)
class Dialect:
    name: str

    def div(self, a: str, b: int) -> str:
        return f"({a} div {b})" if self.name == "spark" else f"({a} // {b})"

    def first_part(self, path: str) -> str:
        return f"split({path}, '[.]')[0]" if self.name == "spark" else f"string_split({path}, '.')[1]"


SPARK, DUCK = Dialect("spark"), Dialect("duck")


def policies_sql(d: Dialect, orders: str = "orders") -> str:
    return f"""
SELECT k AS policy_key, CAST(k AS STRING) AS policy_id,
  CASE k % 50 WHEN 7 THEN '' ELSE 'policy_' || CAST(k AS STRING) END AS name,
  CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 END AS declared_type,
  CASE k % 7 WHEN 0 THEN '*' WHEN 1 THEN 'sales' WHEN 2 THEN 'hr-prod' WHEN 3 THEN 'finance'
             WHEN 4 THEN 'a.b' WHEN 5 THEN 'crm' END AS db,
  CASE c % 6 WHEN 0 THEN '*' WHEN 1 THEN 'orders' WHEN 2 THEN 'cust-omer' WHEN 3 THEN 'ns:tab'
             WHEN 4 THEN 'line*' END AS tbl,
  CASE c % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'ssn-no' WHEN 2 THEN 'birth_date' END AS col1,
  CASE c % 8 WHEN 1 THEN 'phone' END AS col2,
  CASE c % 11 WHEN 0 THEN '/data/' || st || '/*' WHEN 5 THEN '/' WHEN 1 THEN '/user/' || chr(123) || 'USER' || chr(125) || '/' || st END AS path1,
  CASE c % 22 WHEN 11 THEN '/tmp/a b' WHEN 5 THEN '/x.y' END AS path2,
  CASE c % 13 WHEN 5 THEN 'udf-' || st END AS udf,
  CASE c % 17 WHEN 0 THEN 'topic' WHEN 1 THEN 'entity' WHEN 2 THEN 'queue' WHEN 3 THEN 'url' END AS other_resource,
  CASE c % 14 WHEN 3 THEN 'S' || CAST(c % 60 + 1 AS STRING) END AS tag1,
  CASE c % 28 WHEN 3 THEN 'S' || CAST(k % 50 + 1 AS STRING) END AS tag2,
  CASE k % 9 WHEN 0 THEN '' WHEN 1 THEN 'Policy  for ' || pr || ' orders in status ' || st ||
       ' whose description is long enough to be wrapped over more than one header line'
       ELSE 'desc ' || pr END AS description,
  pr AS priority, st AS status
FROM (SELECT o_orderkey AS k, min(o_custkey) AS c, min(o_orderstatus) AS st, min(o_orderpriority) AS pr
      FROM {orders} GROUP BY o_orderkey) AS o"""


def items_sql(d: Dialect, lineitem: str = "lineitem", kept: str = "", within: str = "l_orderkey") -> str:
    """One item per line; line numbers repeat, so the place follows from all columns.

    ``kept`` names columns that are passed on; ``within`` is what places are counted in.
    """
    return f"""
SELECT {kept}policy_key, item_pos, CASE WHEN item_pos = 7 THEN 'deny' ELSE 'allow' END AS kind, s1, s2, p1, p2,
  CASE WHEN s1 % 3 = 0 THEN 'p_' || CAST(s1 AS STRING) END AS u1,
  CASE WHEN s2 <> s1 AND s2 % 3 = 0 THEN 'p_' || CAST(s2 AS STRING) END AS u2,
  CASE WHEN s1 % 3 = 1 THEN 'p_' || CAST(s1 AS STRING) END AS g1,
  CASE WHEN s2 <> s1 AND s2 % 3 = 1 THEN 'p_' || CAST(s2 AS STRING) END AS g2,
  CASE WHEN qmax > 25 THEN 'grp_' || rf END AS g3,
  CASE WHEN s1 % 3 = 2 THEN 'p_' || CAST(s1 AS STRING) END AS r1,
  CASE WHEN s2 <> s1 AND s2 % 3 = 2 THEN 'p_' || CAST(s2 AS STRING) END AS r2,
  CASE p1 % 9 WHEN 0 THEN 'hive:select' WHEN 1 THEN 'select' WHEN 2 THEN 'update' WHEN 3 THEN 'create'
       WHEN 4 THEN 'drop' WHEN 5 THEN 'ALL' WHEN 6 THEN 'read' WHEN 7 THEN 'execute' WHEN 8 THEN 'entity-read' END AS a1,
  CASE WHEN ls = 'F' AND qmin < 10 THEN false WHEN qmax > 40 THEN NULL ELSE true END AS ok1,
  CASE WHEN p2 <> p1 THEN CASE p2 % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'select' WHEN 2 THEN 'hive:Update' ELSE 'admin' END END AS a2,
  CASE WHEN qmax > 20 THEN CASE p1 % 12 WHEN 0 THEN 'MASK_NONE' WHEN 1 THEN 'MASK' WHEN 2 THEN 'MASK_SHOW_LAST_4'
       WHEN 3 THEN 'MASK_SHOW_FIRST_4' WHEN 4 THEN 'MASK_HASH' WHEN 5 THEN 'MASK_NULL' WHEN 6 THEN 'MASK_DATE_SHOW_YEAR'
       WHEN 7 THEN 'MASK_TIMESTAMP_SHOW_DATE' WHEN 8 THEN 'MASK_REDACT' WHEN 9 THEN 'SHUFFLE' WHEN 10 THEN 'CUSTOM'
       ELSE 'MASK_NONE' END END AS mask_type,
  CASE WHEN qmin <= 30 THEN CASE p2 % 6 WHEN 0 THEN 'region = ''WEST'''
       WHEN 1 THEN 'region IN (''WEST'', ''CENTRAL'')  AND order_date >= ''2024-01-01''' WHEN 2 THEN 'TRUE' WHEN 3 THEN ''
       WHEN 4 THEN 'dept!=''hr'' OR name LIKE ''A%''' ELSE 'status IS NOT NULL AND CURRENT_DATE > day' END END AS filter_expr,
  rf, ls, qmin, qmax
FROM (SELECT {kept}l_orderkey AS policy_key, l_suppkey AS s1, l_partkey AS p1, l_quantity AS qmin, l_quantity AS qmax,
        l_suppkey + CASE WHEN l_partkey % 3 = 0 THEN l_linenumber ELSE 0 END AS s2,
        l_partkey + CASE WHEN l_suppkey % 4 = 0 THEN l_linenumber ELSE 0 END AS p2,
        l_returnflag AS rf, l_linestatus AS ls,
        CAST(row_number() OVER (PARTITION BY {within} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
          l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS item_pos
      FROM {lineitem}) AS l"""


def resource_tags_sql(d: Dialect, part: str = "part") -> str:
    """Paths tag tables, all columns, single columns, or (one part) nothing usable."""
    return f"""
SELECT '' AS scope, path, CAST(min(min_pos) OVER (PARTITION BY path) AS BIGINT) AS path_pos, min_pos AS tag_pos, tag
FROM (SELECT path, tag, min(pos) AS min_pos FROM (
  SELECT CASE WHEN p_size = 50 THEN 't_' || p_brand ELSE
      'db' || CAST(p_size % 10 AS STRING) || '.t_' || replace(p_brand, '#', CASE WHEN p_size % 3 = 0 THEN '-' ELSE '_' END) ||
      CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 8 = 1 THEN '.*'
           ELSE '.col' || CAST(p_partkey % 7 AS STRING) END END AS path,
    'S' || CAST(p_size AS STRING) AS tag, p_partkey AS pos FROM {part}) AS a GROUP BY path, tag) AS b"""


def attributes_sql(d: Dialect, supplier: str = "supplier") -> str:
    """At most three attributes per tag; tags above S50 are on no resource."""
    return f"""
SELECT '' AS scope, tag, attr_pos,
  CASE attr_pos WHEN 0 THEN 'Level' WHEN 1 THEN 'level' ELSE 'Retention' END AS attr_key, attr_value
FROM (SELECT 'S' || CAST(s_suppkey % 60 + 1 AS STRING) AS tag, s_nationkey % 3 AS attr_pos, min(s_name) AS attr_value
      FROM {supplier} GROUP BY s_suppkey % 60, s_nationkey % 3) AS s"""


def definitions_sql(d: Dialect, supplier: str = "supplier") -> str:
    return f"SELECT DISTINCT '' AS scope, 'S' || CAST(s_suppkey % 60 + 1 AS STRING) AS tag FROM {supplier}"


def mapping_sql(d: Dialect, supplier: str = "supplier") -> str:
    return f"""
SELECT 'principal' AS mapping_type, 'p_' || CAST(s_suppkey AS STRING) AS source_value, 'uc_' || CAST(s_suppkey AS STRING) AS target_value
FROM {supplier} WHERE s_acctbal > 4000 GROUP BY s_suppkey
UNION ALL SELECT 'privilege', 'drop', 'APPLY TAG'
UNION ALL SELECT 'privilege', 'hive:select', 'BROWSE'
UNION ALL SELECT 'resource', '/sales/orders', 'main.production_schema'"""


def principals_sql(d: Dialect, customer: str = "customer", nation: str = "nation", region: str = "region") -> str:
    return f"""
SELECT 'user_' || CAST(c_custkey AS STRING) AS user_name, c_mktsegment AS segment_group, n_name AS nation_group, r_name AS role
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey"""


def translation_log_sql(d: Dialect, events: str = "events") -> str:
    return f"""
SELECT ts AS timestamp, 'translation' AS activity, CAST(user_id AS INT) AS ranger_policy_count,
  CAST(event_id % 50 AS INT) AS uc_policy_count, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count
FROM {events}"""


def apply_log_sql(d: Dialect, events: str = "events") -> str:
    return f"""
SELECT ts AS timestamp, CAST(event_id AS STRING) AS policy_id,
  CASE event_id % 4 WHEN 0 THEN 'ACCESS' WHEN 1 THEN 'ROW_FILTER' WHEN 2 THEN 'COLUMN_MASK' ELSE 'ACCESS_TAG' END AS policy_type,
  CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'success' WHEN 'error' THEN 'error'
                  WHEN 'click' THEN 'partial' ELSE 'skipped' END AS status,
  'run by user ' || CAST(user_id AS STRING) AS message,
  CAST(event_id % 7 AS INT) AS executed_count, CAST(event_id % 7 + event_id % 3 AS INT) AS total_statements,
  CASE WHEN event_type = 'error' THEN 'Error executing SQL: ' || props END AS error_details
FROM {events}"""


def outcomes_sql(d: Dialect, lineitem: str = "lineitem") -> str:
    return f"""
SELECT policy_key, item_pos AS statement_idx, r1 IS NULL AS ok,
  CASE WHEN r1 IS NOT NULL THEN 'Error executing SQL: ' || r1 END AS error
FROM ({items_sql(d, lineitem)}) AS i"""


# --- Spark side ------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, make, **options: str) -> DataFrame:
    """A derived relation as a written table, the way an ingest job leaves it.

    Written once per application below the shared checkpoint folder. Later plans start
    from a scan with known size instead of repeating the derivation in every branch.
    ``options`` are those of the writer.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STAGED:
        path = scratch_dir(spark, name)
        make().write.options(**options).parquet(path)
        _STAGED[key] = path
    return spark.read.parquet(_STAGED[key])


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    """``spark.sql`` over frames for texts that hold braces of their own."""
    for name in frames:
        text = text.replace("{" + name + "}", f"\0{name}\1")
    text = text.replace("{", "{{").replace("}", "}}").replace("\0", "{").replace("\1", "}")
    return spark.sql(text, **frames)


def relation(spark: SparkSession, sf_dir: str, make, *names: str) -> DataFrame:
    """Run one of the SELECTs above over Parquet tables."""
    frames = {n: table(spark, sf_dir, n) for n in names}
    text = make(SPARK, *["{" + n + "}" for n in names])
    return spark.sql(text, **frames)


def _present(*names: str):
    return F.array_compact(F.array(*names))


def fx_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, policies_sql, "orders")


def fx_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "items", lambda: relation(spark, sf_dir, items_sql, "lineitem"))


def resource_entries():
    """Array of (type, values), in the order the keys have in a file."""
    one = lambda kind, *cols: F.when(
        F.col(cols[0]).isNotNull(), F.struct(F.lit(kind).alias("key"), _present(*cols).alias("value"))
    )
    other = F.when(
        F.col("other_resource").isNotNull(),
        F.struct(
            F.col("other_resource").alias("key"),
            F.array(F.concat(F.lit("s3://bucket/"), F.col("status"))).alias("value"),
        ),
    )
    return F.array_compact(
        F.array(
            one("database", "db"), one("table", "tbl"), one("column", "col1", "col2"), one("path", "path1", "path2"),
            one("udf", "udf"), other, one("tag", "tag1", "tag2"),
        )
    )


def with_resources(policies: DataFrame) -> DataFrame:
    return policies.withColumn("resources", F.map_from_entries(resource_entries()))


def policies_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies with their inferred type, resources map and scope."""
    return staged(spark, sf_dir, "policies", lambda: typed_policies(spark, sf_dir))


def typed_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from palisade.sources.documents import infer_policy_type

    items = fx_items(spark, sf_dir)
    lists = items.groupBy("policy_key").agg(
        F.bool_or(F.col("mask_type").isNotNull()).alias("has_masks"),
        F.bool_or(F.col("filter_expr").isNotNull()).alias("has_filters"),
    )
    declared = F.col("declared_type")
    return (
        with_resources(fx_policies(spark, sf_dir))
        .join(lists, "policy_key", "left")
        .withColumn(
            "policy_type",
            infer_policy_type(
                declared, declared.isNotNull(),
                F.coalesce("has_masks", F.lit(False)), F.coalesce("has_filters", F.lit(False)),
            ),
        )
        .withColumn("scope", F.lit(""))
    )


def access_items(items: DataFrame) -> DataFrame:
    accesses = F.filter(
        F.array(
            F.struct(F.col("a1").alias("type"), F.col("ok1").alias("is_allowed")),
            F.struct(F.col("a2").alias("type"), F.lit(None).cast("boolean").alias("is_allowed")),
        ),
        lambda a: a["type"].isNotNull(),
    )
    return items.select(
        "policy_key", "kind", "item_pos", _present("u1", "u2").alias("users"),
        _present("g1", "g2", "g3").alias("groups"), _present("r1", "r2").alias("roles"), accesses.alias("accesses"),
    )


def filter_items(items: DataFrame) -> DataFrame:
    return items.filter("filter_expr IS NOT NULL").select(
        "policy_key", "item_pos", _present("u1", "u2").alias("users"), _present("g1", "g2", "g3").alias("groups"),
        "filter_expr",
    )


def mask_items(items: DataFrame) -> DataFrame:
    return items.filter("mask_type IS NOT NULL").select(
        "policy_key", "item_pos", _present("u1", "u2").alias("users"), _present("g1", "g2", "g3").alias("groups"),
        "mask_type",
    )


def resource_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "resource_tags", lambda: _resource_tags(spark, sf_dir))


def _resource_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same rows as the SELECT, with the first position per path from a join instead of
    a window, so a path that holds many tags is not sorted in one task."""
    text = resource_tags_sql(SPARK, "{part}")
    inner = text[text.index("FROM (") + len("FROM ("):text.rindex(") AS b")]
    rows = spark.sql(inner, part=table(spark, sf_dir, "part"))
    first = rows.groupBy("path").agg(F.min("min_pos").alias("path_pos"))
    return rows.join(first, "path").select(
        F.lit("").alias("scope"), "path", "path_pos", F.col("min_pos").alias("tag_pos"), "tag"
    )


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, attributes_sql, "supplier")


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, definitions_sql, "supplier")


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "mapping", lambda: relation(spark, sf_dir, mapping_sql, "supplier"))


def inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    items = fx_items(spark, sf_dir)
    return Inputs(
        policies_frame(spark, sf_dir), access_items(items), filter_items(items), mask_items(items),
        definitions(spark, sf_dir), attributes(spark, sf_dir), resource_tags(spark, sf_dir),
    )


# --- JSON documents (Spark side only) ---------------------------------------------------


def _document_lists() -> list[Column]:
    """Item lists of a policy: at most seven items, one per line number. Rows without a ``kind`` are no items."""
    filled = lambda *cols: F.nullif(_present(*cols), F.array().cast("array<string>"))
    accesses = F.filter(
        F.array(
            F.struct(F.col("a1").alias("type"), F.col("ok1").alias("isAllowed")),
            F.struct(F.col("a2").alias("type"), F.lit(None).cast("boolean").alias("isAllowed")),
        ),
        lambda a: a["type"].isNotNull(),
    )
    who = [filled("u1", "u2").alias("users"), filled("g1", "g2", "g3").alias("groups")]
    expression = F.to_json(F.struct(F.lit("expression").alias("type"), filled("u1", "u2").alias("values")))
    named = F.to_json(F.struct(filled("g1").alias("teams"), F.lit("x").alias("note"), filled("u1", "u2").alias("users")))
    conditions = F.when(F.col("kind") == "deny", F.concat(F.lit("["), expression, F.lit("]"))).otherwise(named).alias("conditions")
    access = F.struct(*who, filled("r1", "r2").alias("roles"), accesses.alias("accesses"), conditions)
    row_filter = F.struct(*who, F.struct(F.col("filter_expr").alias("filterExpr")).alias("rowFilterInfo"))
    mask = F.struct(*who, F.struct(F.col("mask_type").alias("dataMaskType")).alias("dataMaskInfo"))

    # A VARIANT has no order, so the text becomes one after the sort.
    as_json = lambda i: i.withField("conditions", F.parse_json(i["conditions"]))

    def listed(condition, item, name, shown=lambda i: i):
        rows = F.array_sort(F.collect_list(F.when(condition, F.struct("item_pos", item.alias("i")))))
        return F.when(F.size(rows) > 0, F.transform(rows, lambda r: shown(r["i"]))).alias(name)

    return [
        listed(F.col("kind") == "allow", access, "policyItems", as_json),
        listed(F.col("kind") == "deny", access, "denyPolicyItems", as_json),
        listed(F.col("filter_expr").isNotNull(), row_filter, "rowFilterPolicyItems"),
        listed(F.col("mask_type").isNotNull(), mask, "dataMaskPolicyItems"),
    ]


def _lines_by_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policies (``policy`` is set) and lines as rows of one table, dealt out by block of four policies.

    That is the only time that lines are shuffled: places, lists, policies and files are made where a block lies.
    """
    policies, lines = fx_policies(spark, sf_dir), table(spark, sf_dir, "lineitem").filter("l_orderkey IS NOT NULL")
    used = set(re.findall(r"\bl_\w+", items_sql(SPARK, "lines")))
    made = policies.select(F.col("policy_key").alias("l_orderkey"), F.struct(*[c for c in policies.columns if c not in ("policy_key", "policy_id", "priority")]).alias("policy"))
    rows = lines.select(*[c for c in lines.columns if c in used]).unionByName(made, allowMissingColumns=True)
    return rows.withColumn("block", F.expr("l_orderkey div 4")).repartition("block")


def policy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(block, policy_key, policy_json), with a block's policies in one partition; NULL fields are left out of the text."""
    text = items_sql(SPARK, "{lines}", "block, policy, ", "block, l_orderkey, policy IS NULL")
    items = spark.sql(text, lines=_lines_by_block(spark, sf_dir))
    item = F.col("policy").isNull()
    items = items.withColumns({c: F.when(item, F.col(c)) for c in ("kind", "filter_expr", "mask_type")})
    lists = items.groupBy("block", "policy_key").agg(F.first("policy", ignorenulls=True).alias("policy"), *_document_lists())
    lists = lists.filter("policy IS NOT NULL").select("block", "policy_key", "policy.*", *[c for c in lists.columns if c.endswith("Items")])
    resources = F.map_from_entries(
        F.transform(resource_entries(), lambda e: F.struct(e["key"], F.struct(e["value"].alias("values"))))
    )
    body = F.struct(
        F.col("policy_key").alias("id"), F.when(F.col("name") != "", F.col("name")).alias("name"),
        F.col("declared_type").alias("policyType"),
        F.when(F.col("description") != "", F.col("description")).alias("description"),
        F.when(F.col("policy_key") % 12 == 1, F.lit(False)).alias("isEnabled"),
        resources.alias("resources"),
        "policyItems", "denyPolicyItems", "rowFilterPolicyItems", "dataMaskPolicyItems",
    )
    return lists.select("block", "policy_key", F.to_json(body).alias("policy_json"))


#: For long texts that are read a few times.
PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "documents", lambda: build_documents(spark, sf_dir), **PACKED)


def build_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, json): four policies per file in one of six envelope shapes; every 97th
    block of files is cut short so that it does not parse."""
    rows = policy_json(spark, sf_dir).withColumn("shape", F.expr("block % 6"))
    rows = rows.withColumn(
        "source",
        F.when(F.col("shape") == 1, F.concat(F.lit("p"), F.col("policy_key").cast("string"))).otherwise(
            F.concat(F.lit("d"), F.col("block").cast("string"))
        ),
    )

    def texts(condition):
        pairs = F.array_sort(F.collect_list(F.when(condition, F.struct("policy_key", "policy_json"))))
        return F.array_join(F.transform(pairs, lambda p: p["policy_json"]), ",")

    place = F.col("policy_key") % 4
    grouped = rows.groupBy("source", "block", "shape").agg(
        texts(F.lit(True)).alias("all"), texts(place == 0).alias("p0"), texts(place == 1).alias("p1"),
        texts(place == 2).alias("p2"), texts(place == 3).alias("p3"), texts(place >= 1).alias("rest"),
        texts(place <= 1).alias("head"), texts(place >= 2).alias("tail"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("policy_key", "policy_json"))),
                lambda p: F.concat(F.lit('{"changeType":1,"policy":'), p["policy_json"], F.lit("}")),
            ),
            ",",
        ).alias("deltas"),
    )
    text = (
        F.when(F.col("shape") == 0, F.concat(F.lit('{"serviceName":"svc","serviceDef":{},"policies":['), "all", F.lit("]}")))
        .when(F.col("shape") == 1, F.col("all"))
        .when(
            F.col("shape") == 2,
            F.concat(
                F.lit('{"testCases":[{"servicePolicies":{"serviceName":"svc","policies":['), "head",
                F.lit(']}},{"servicePolicies":{"policies":['), "p2", F.lit('],"tagPolicies":{"policies":['), "p3",
                F.lit("]}}}]}"),
            ),
        )
        .when(F.col("shape") == 3, F.concat(F.lit('{"policyDeltas":['), "deltas", F.lit(',{"changeType":2}]}')))
        .when(
            F.col("shape") == 4,
            F.concat(F.lit('{"policies":['), "head", F.lit('],"tagPolicyInfo":{"tagPolicies":['), "tail", F.lit("]}}")),
        )
        .otherwise(
            F.concat(F.lit('{"policies":['), "p0", F.lit('],"tagPolicies":{"policies":['), "rest", F.lit("]}}"))
        )
    )
    cut = F.when(F.col("block") % 97 == 0, F.substring(text, F.lit(1), F.length(text) - 3)).otherwise(text)
    return grouped.select("source", cut.alias("json"))


def tag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of tag definitions (20 suppliers each) and of resource tags (16 parts each),
    in object form for even file numbers and in list form for odd ones."""
    return run_sql(
        spark,
        """
SELECT 't' || CAST(n AS STRING) AS source, CASE WHEN n % 2 = 0
    THEN '{"tagDefinitions":{' || array_join(transform(r, x -> '"D' || x.k || '":{"attributeDefs":' || x.a || '}'), ',') || '}}'
    ELSE '{"tagDefinitions":[' || array_join(transform(r, x -> '{"name":"D' || x.k || '","attributeDefs":' || x.a || '}'), ',') || ']}' END AS json
FROM (SELECT n, array_sort(collect_list(struct(k, a))) AS r
      FROM (SELECT s_suppkey AS k, s_suppkey div 20 AS n,
                   '{"Level":"' || min(s_name) || '","nation":"' || CAST(min(s_nationkey) AS STRING) || '"}' AS a
            FROM {supplier} GROUP BY s_suppkey) GROUP BY n)
UNION ALL
SELECT 'r' || CAST(n AS STRING) AS source, CASE WHEN n % 2 = 0
    THEN '{"resourceTags":{' || array_join(transform(r, x -> '"db.t.c' || x.k || '":["' || x.t || '","' || x.z || '"]'), ',') || '}}'
    ELSE '{"resourceTags":[' || array_join(transform(r, x -> '{"resource":{' || x.res || '},"tags":["' || x.t || '","' || x.z || '"]}'), ',') || ']}' END AS json
FROM (SELECT n, array_sort(collect_list(struct(k, t, z, res))) AS r
      FROM (SELECT p_partkey AS k, p_partkey div 16 AS n, min(p_type) AS t, 'S' || CAST(min(p_size) AS STRING) AS z,
              CASE min(p_size) % 5 WHEN 0 THEN '"database":"db"' WHEN 1 THEN '"table":"t"'
                WHEN 2 THEN '"database":"db","table":"t","column":["a","b' || CAST(p_partkey % 3 AS STRING) || '"]'
                WHEN 3 THEN '"table":"u","column":["a"]' ELSE '"database":"db","table":"t"' END AS res
            FROM {part} GROUP BY p_partkey) GROUP BY n)
""",
        supplier=table(spark, sf_dir, "supplier"), part=table(spark, sf_dir, "part"),
    )


VALIDATION_ITEMS = """
SELECT policy_key, item_pos, s1, p1,
  concat_ws(',', CASE s1 % 5 WHEN 0 THEN NULL WHEN 1 THEN '"users":[]' ELSE '"users":["p"]' END,
    CASE s1 % 10 WHEN 0 THEN '"groups":["g"]' WHEN 1 THEN '"roles":["r"]' END) AS who,
  CASE p1 % 7 WHEN 0 THEN NULL WHEN 1 THEN '"accesses":"x"' WHEN 2 THEN '"accesses":[]'
    WHEN 3 THEN '"accesses":[{"isAllowed":true},{"type":"read"}]' ELSE '"accesses":[{"type":"select"}]' END AS acc,
  CASE p1 % 6 WHEN 0 THEN NULL WHEN 1 THEN '"rowFilterInfo":{}' WHEN 2 THEN '"rowFilterInfo":{"filterExpr":""}'
    ELSE '"rowFilterInfo":{"filterExpr":"a = 1"}' END AS rf,
  CASE p1 % 6 WHEN 0 THEN NULL WHEN 1 THEN '"dataMaskInfo":{}' WHEN 2 THEN '"dataMaskInfo":{"dataMaskType":"MASK_REDACT"}'
    WHEN 3 THEN '"dataMaskInfo":{"dataMaskType":"SHUFFLE"}' ELSE '"dataMaskInfo":{"dataMaskType":"MASK"}' END AS dm
FROM {items}"""

VALIDATION_POLICIES = """
SELECT k, '{' || concat_ws(',',
  CASE k % 20 WHEN 0 THEN NULL WHEN 1 THEN '"id":"x"' WHEN 2 THEN '"id":1.5' WHEN 3 THEN '"id":null' WHEN 4 THEN '"id":true'
    ELSE '"id":' || CAST(k AS STRING) END,
  CASE k % 19 WHEN 0 THEN NULL WHEN 1 THEN '"name":""' WHEN 2 THEN '"name":5' WHEN 3 THEN '"name":null'
    ELSE '"name":"policy_' || CAST(k AS STRING) || '"' END,
  CASE k % 3 WHEN 0 THEN NULL ELSE '"service":"svc"' END,
  CASE k % 17 WHEN 0 THEN NULL WHEN 1 THEN '"resources":{}' WHEN 2 THEN '"resources":{"database":"x"}'
    WHEN 3 THEN '"resources":{"database":{"isExcludes":false}}' WHEN 4 THEN '"resources":{"database":{"values":"x"}}'
    WHEN 5 THEN '"resources":{"database":{"values":[]},"table":{"values":["t"]}}'
    ELSE '"resources":{"database":{"values":["db"]}}' END,
  CASE k % 13 WHEN 0 THEN NULL WHEN 1 THEN '"policyItems":{}' ELSE '"policyItems":[' || acc || ']' END,
  CASE k % 6 WHEN 0 THEN '"denyPolicyItems":[' || acc || ']' END,
  CASE k % 11 WHEN 0 THEN '"rowFilterPolicyItems":"x"' WHEN 1 THEN '"rowFilterPolicyItems":[' || rf || ']'
    WHEN 2 THEN '"rowFilterPolicyItems":[' || rf || ']' END,
  CASE k % 7 WHEN 0 THEN '"dataMaskPolicyItems":"x"' WHEN 1 THEN '"dataMaskPolicyItems":[' || dm || ']'
    WHEN 2 THEN '"dataMaskPolicyItems":[' || dm || ']' END) || '}' AS policy_json
FROM {lists}"""


def validation_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, policy_json): policies with one field in twenty missing or of another type."""
    items = run_sql(spark, VALIDATION_ITEMS, items=fx_items(spark, sf_dir))

    def texts(part: str):
        rows = F.array_sort(F.collect_list(F.struct("item_pos", "who", part)))
        body = lambda r: F.concat(
            F.lit("{"), F.array_join(F.filter(F.array(r["who"], r[part]), lambda t: t != ""), ","), F.lit("}")
        )
        return F.array_join(F.transform(rows, body), ",").alias(part)

    per_policy = items.groupBy("policy_key").agg(texts("acc"), texts("rf"), texts("dm"))
    keys = fx_policies(spark, sf_dir).select(F.col("policy_key"))
    empty = F.lit("")
    lists = keys.join(per_policy, "policy_key", "left").select(
        F.col("policy_key").alias("k"), *[F.coalesce(c, empty).alias(c) for c in ("acc", "rf", "dm")]
    )
    return run_sql(spark, VALIDATION_POLICIES, lists=lists)


def validation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "validation", lambda: _validation_documents(spark, sf_dir))


def _validation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, json): four policies per file, eight kinds of envelope."""
    rows = validation_policies(spark, sf_dir).withColumn("n", F.expr("k div 4"))

    def joined(condition, wrap=None):
        pairs = F.array_sort(F.collect_list(F.when(condition, F.struct("k", "policy_json"))))
        return F.array_join(F.transform(pairs, lambda p: wrap(p["policy_json"]) if wrap else p["policy_json"]), ",")

    place = F.col("k") % 4
    grouped = rows.groupBy("n").agg(
        joined(F.lit(True)).alias("every"), joined(place <= 2).alias("head"), joined(place == 3).alias("last"),
        joined(F.lit(True), lambda t: F.concat(F.lit('{"policy":'), t, F.lit("}"))).alias("deltas"),
    )
    n = F.col("n") % 8
    c = F.concat
    text = (
        F.when(n == 0, c(F.lit('{"serviceName":"root","tests":[],"policies":['), "every", F.lit("]}")))
        .when(n == 1, c(F.lit('{"policies":['), "every", F.lit("]}")))
        .when(n == 2, c(F.lit('{"serviceName":"root","policyDeltas":['), "deltas", F.lit("]}")))
        .when(n == 3, c(F.lit('{"securityZones":{},"policies":['), "every", F.lit("]}")))
        .when(
            n == 4,
            c(F.lit('{"testCases":[{"servicePolicies":{"serviceName":"root","policies":['), "head",
              F.lit('],"tagPolicies":['), "last", F.lit("]}}]}")),
        )
        .when(
            n == 5,
            c(F.lit('{"serviceName":"root","policies":['), "head", F.lit('],"tagPolicyInfo":{"tagPolicies":['), "last", F.lit("]}}")),
        )
        .when(n == 6, c(F.lit('{"rules":['), "every", F.lit("]}")))
        .otherwise(F.lit('{"serviceDef":{},"policies":{"a":1}}'))
    )
    return grouped.select(c(F.lit("v"), F.col("n").cast("string")).alias("source"), text.alias("json"))
