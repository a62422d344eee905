"""Policy exports: read, unwrap every envelope shape, normalise to relations.

All steps are narrow: one pass over the documents, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade.constants import ITEM_LISTS
from palisade.functions.once import computed_once

# The conditions of an item are a list of objects or one object of lists. Their text is kept as it is: the order of keys
# is that of the predicates, and a VARIANT would sort them.
_ACCESS_ITEMS = (
    "ARRAY<STRUCT<users: ARRAY<STRING>, groups: ARRAY<STRING>, roles: ARRAY<STRING>,"
    " accesses: ARRAY<STRUCT<type: STRING, isAllowed: BOOLEAN>>, delegateAdmin: BOOLEAN, conditions: STRING>>"
)
_FILTER_ITEMS = (
    "ARRAY<STRUCT<users: ARRAY<STRING>, groups: ARRAY<STRING>, rowFilterInfo: STRUCT<filterExpr: STRING>, conditions: STRING>>"
)
_MASK_ITEMS = (
    "ARRAY<STRUCT<users: ARRAY<STRING>, groups: ARRAY<STRING>,"
    " dataMaskInfo: STRUCT<dataMaskType: STRING, conditionExpr: STRING>, conditions: STRING>>"
)
_RESOURCES = "MAP<STRING, STRUCT<values: ARRAY<STRING>, isExcludes: BOOLEAN, isRecursive: BOOLEAN>>"
POLICY_SCHEMA = (
    "id STRING, name STRING, service STRING, description STRING, policyType DOUBLE,"
    f" isEnabled BOOLEAN, isAuditEnabled BOOLEAN, resources {_RESOURCES},"
    + ",".join(f" {name} {_ACCESS_ITEMS}" for name in ITEM_LISTS)
    + f", rowFilterPolicyItems {_FILTER_ITEMS}, dataMaskPolicyItems {_MASK_ITEMS}"
)
_BLOCK_SCHEMA = (
    "serviceName STRING, policies ARRAY<STRING>,"
    " tagPolicyInfo STRUCT<tagPolicies: ARRAY<STRING>>, tagPolicies STRUCT<policies: ARRAY<STRING>>"
)
_ROOT_SCHEMA = "testCases ARRAY<STRUCT<servicePolicies: STRING>>, policyDeltas ARRAY<STRUCT<policy: STRING>>"
ORDER = ("block_pos", "section", "pos")


@dataclass
class PolicyTables:
    """Normalised relations; ``policy_key`` joins them, positions carry list order, ``conditions`` is JSON text."""

    policies: DataFrame
    access_items: DataFrame
    filter_items: DataFrame
    mask_items: DataFrame


def read_policy_documents(spark: SparkSession, paths: str | list[str], one_per_file: bool = True) -> DataFrame:
    """(source, json). ``one_per_file=False`` reads one document per line, which splits."""
    text = spark.read.text(paths, wholetext=one_per_file)
    return text.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("json"))


def _has(keys: str, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def with_root_keys(docs: DataFrame) -> DataFrame:
    """Adds ``keys`` (NULL unless the text is a whole JSON object)."""
    return computed_once(docs, keys=F.expr("json_object_keys(json)"))


def document_errors(docs: DataFrame) -> DataFrame:
    """Documents that are not readable JSON, and whole-document parse failures."""
    rooted = with_root_keys(docs)
    unreadable = F.col("keys").isNull() & F.expr("try_parse_json(json) IS NULL")
    root = F.from_json("json", "policies STRING, testCases STRING, policyDeltas STRING")
    listed = (
        F.when(_has("keys", "testCases"), root["testCases"])
        .when(_has("keys", "policies"), root["policies"])
        .when(_has("keys", "policyDeltas"), root["policyDeltas"])
        .otherwise(F.lit("[]"))
    )
    # The keys of an object stand where policies should; an empty one has none.
    stage = (
        F.when(unreadable, F.lit("Error reading file"))
        .when(F.regexp_replace(listed, r"\s", "") == "{}", F.lit(None).cast("string"))
        .when(F.startswith(listed, F.lit("{")), F.lit("Error parsing policy"))
        .when(~_is_list(listed), F.lit("Error parsing JSON"))
    )
    return rooted.withColumn("stage", stage).filter("stage IS NOT NULL").select("source", "stage")


def _is_list(text: Column) -> Column:
    return F.coalesce(F.startswith(text, F.lit("[")), F.lit(False))


def _policies(values: Column, shape: str, section: int) -> Column:
    """Struct for one list of policies inside a block."""
    return F.struct(
        F.lit(shape).alias("shape"),
        F.lit(section).alias("section"),
        F.coalesce(values, F.array().cast("array<string>")).alias("values"),
    )


def unwrap_policies(docs: DataFrame) -> DataFrame:
    """One row per policy of every envelope shape.

    Result: source, shape, service_name, block_pos, section, pos, policy_json.
    A test-case file is a list of blocks, every other file is one block.
    """
    cases = _has("keys", "testCases")
    roots = computed_once(
        with_root_keys(docs),
        root=F.from_json("json", _ROOT_SCHEMA),
        cases=cases,
        deltas=~cases & _has("keys", "policyDeltas") & ~_has("keys", "policies"),
    )
    blocks = computed_once(
        roots.select(
            "source", "cases", "deltas", "root",
            F.posexplode(
                F.when(F.col("cases"), F.col("root.testCases.servicePolicies")).otherwise(F.array("json"))
            ).alias("block_pos", "block_json"),
        ),
        block_keys=F.expr("json_object_keys(block_json)"),
        block=F.from_json("block_json", _BLOCK_SCHEMA),
    )
    listed = _has("block_keys", "policies")
    single = (
        _has("block_keys", "policyItems")
        | _has("block_keys", "dataMaskPolicyItems")
        | _has("block_keys", "rowFilterPolicyItems")
    )
    deltas = F.filter(
        F.col("root.policyDeltas.policy"),
        lambda p: p.isNotNull() & (F.regexp_replace(p, r"\s", "") != "{}"),
    )
    usual = F.array(
        F.when(listed, _policies(F.col("block.policies"), "standard", 0))
        .when(single, _policies(F.array("block_json"), "single", 0))
        .otherwise(_policies(F.lit(None).cast("array<string>"), "none", 0)),
        _policies(F.col("block.tagPolicyInfo.tagPolicies"), "tagPolicyInfo", 1),
        _policies(F.col("block.tagPolicies.policies"), "tagPolicies", 2),
    )
    parts = F.when(F.col("deltas"), F.array(_policies(deltas, "policyDeltas", 0))).otherwise(usual)
    exploded = blocks.select(
        "source", "cases", "block_pos",
        F.col("block.serviceName").alias("service_name"),
        F.explode(parts).alias("part"),
    )
    return exploded.select(
        "source",
        F.when(F.col("cases"), F.lit("testCases")).otherwise(F.col("part.shape")).alias("shape"),
        "service_name", "block_pos", "part.section",
        F.posexplode("part.values").alias("pos", "policy_json"),
    )


def unwrap_large_exports(rows: DataFrame) -> DataFrame:
    """``unwrap_policies`` for exports that came in elements and shells (``export_ranges.read_large_exports``).

    Positions count the elements of a list, so those of deltas without a policy leave gaps.
    """
    shells = rows.filter("key IS NULL").select("source", F.col("text").alias("json"))
    heads = computed_once(with_root_keys(shells), block=F.from_json("json", "serviceName STRING"))
    cases, listed = _has("keys", "testCases"), _has("keys", "policies")
    heads = heads.select("source", F.col("block.serviceName").alias("service_name"), cases.alias("cases"), listed.alias("listed"))
    # One row per file, and the driver holds the list of files.
    parts = rows.filter("key IS NOT NULL").join(F.broadcast(heads), "source")
    value = F.when(F.col("text") != "null", F.col("text"))
    delta = F.from_json("text", "policy STRING")["policy"]
    chosen = F.when(F.col("key") == "policies", value).otherwise(delta)
    flat = parts.filter(~F.col("cases") & ((F.col("key") == "policies") | ((F.col("key") == "policyDeltas") & ~F.col("listed"))))
    flat = flat.select(
        "source", F.when(F.col("key") == "policies", "standard").otherwise("policyDeltas").alias("shape"), "service_name",
        F.lit(0).alias("block_pos"), F.lit(0).alias("section"), F.col("pos").cast("int").alias("pos"), chosen.alias("policy_json"),
    ).filter((F.col("shape") == "standard") | (F.regexp_replace("policy_json", r"\s", "") != "{}"))
    one = F.concat(F.lit('{"testCases":['), "text", F.lit("]}"))
    # The place of the case rides along in the name of its source.
    blocks = unwrap_policies(
        parts.filter(F.col("key") == "testCases").select(F.concat("pos", F.lit(" "), "source").alias("source"), one.alias("json"))
    )
    name = F.col("source")
    blocks = blocks.withColumns({
        "block_pos": F.substring_index(name, " ", 1).cast("int"), "source": F.substr(name, F.instr(name, " ") + 1),
    })
    return unwrap_policies(shells).unionByName(flat).unionByName(blocks)


def parse_policies(unwrapped: DataFrame) -> DataFrame:
    """Adds the parsed policy ``p``, its key list, its key and ``broken``.

    A present key whose value does not fit its type makes the policy unparseable;
    an absent key only takes the default.
    """
    lists = [*ITEM_LISTS, "rowFilterPolicyItems", "dataMaskPolicyItems"]
    parsed = computed_once(
        unwrapped,
        p=F.from_json("policy_json", POLICY_SCHEMA),
        policy_keys=F.expr("json_object_keys(policy_json)"),
        policy_key=F.concat_ws("#", "source", *ORDER),
    )
    resources = F.col("p.resources")
    broken = F.col("policy_keys").isNull() | (
        _has("policy_keys", "resources")
        & (resources.isNull() | F.exists(F.map_values(resources), lambda r: r.isNull()))
    )
    for name in lists:
        value = F.col(f"p.{name}")
        # An empty object or text in place of a list simply has no items.
        empty = F.coalesce(F.get_json_object("policy_json", f"$.{name}").isin("{}", ""), F.lit(False))
        wrong = F.when(value.isNull(), ~empty).otherwise(F.exists(value, lambda i: i.isNull()))
        broken = broken | (_has("policy_keys", name) & wrong)
    return parsed.withColumn("broken", F.coalesce(broken, F.lit(True)))


def policy_errors(parsed: DataFrame) -> DataFrame:
    return parsed.filter("broken").select(
        "source", F.lit("Error parsing policy").alias("stage"), *ORDER
    )


def infer_policy_type(declared: Column, present: Column, has_masks: Column, has_filters: Column) -> Column:
    """A declared type wins (1 mask, 2 filter, anything else access); else by item lists."""
    return (
        F.when(present & (declared == 1), F.lit("COLUMN_MASK"))
        .when(present & (declared == 2), F.lit("ROW_FILTER"))
        .when(present, F.lit("ACCESS"))
        .when(has_masks, F.lit("COLUMN_MASK"))
        .when(has_filters, F.lit("ROW_FILTER"))
        .otherwise(F.lit("ACCESS"))
    )


def normalise_policies(parsed: DataFrame) -> DataFrame:
    """Policies with defaults; ``resources`` keeps only the value lists, in file order."""
    # Only a JSON number fills the typed field; text counts as some other type, JSON null as absent.
    numeric = F.col("p.policyType")
    present = numeric.isNotNull() | (
        _has("policy_keys", "policyType") & F.get_json_object("policy_json", "$.policyType").isNotNull()
    )
    return parsed.filter("NOT broken").select(
        "policy_key", "source", "shape", "service_name", *ORDER,
        F.coalesce("p.id", F.lit("0")).alias("policy_id"),
        F.coalesce("p.name", F.lit("")).alias("name"),
        F.coalesce("p.service", F.lit("")).alias("service"),
        F.coalesce("p.description", F.lit("")).alias("description"),
        F.coalesce("p.isEnabled", F.lit(True)).alias("is_enabled"),
        F.coalesce("p.isAuditEnabled", F.lit(True)).alias("is_audit_enabled"),
        infer_policy_type(
            numeric, present, _has("policy_keys", "dataMaskPolicyItems"), _has("policy_keys", "rowFilterPolicyItems")
        ).alias("policy_type"),
        F.transform_values(
            F.coalesce("p.resources", F.expr(f"CAST(map() AS {_RESOURCES})")),
            lambda _k, v: F.coalesce(v["values"], F.array().cast("array<string>")),
        ).alias("resources"),
    )


def normalise_resources(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter("NOT broken").select(
        "policy_key", F.posexplode("p.resources").alias("res_pos", "resource_type", "r")
    )
    return rows.select(
        "policy_key", "res_pos", "resource_type",
        F.coalesce("r.values", F.array().cast("array<string>")).alias("values"),
        F.coalesce("r.isExcludes", F.lit(False)).alias("is_excludes"),
        F.coalesce("r.isRecursive", F.lit(False)).alias("is_recursive"),
    )


def _list(name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast("array<string>"))


def normalise_access_items(parsed: DataFrame) -> DataFrame:
    """All four access lists in one pass; ``kind`` tells them apart."""
    lists = F.array(
        *[
            F.struct(F.lit(kind).alias("kind"), F.col(f"p.{name}").alias("items"))
            for name, kind in ITEM_LISTS.items()
        ]
    )
    rows = (
        parsed.filter("NOT broken")
        .select("policy_key", F.explode(lists).alias("l"))
        .select("policy_key", "l.kind", F.posexplode("l.items").alias("item_pos", "i"))
    )
    return rows.select(
        "policy_key", "kind", F.col("item_pos").cast("bigint").alias("item_pos"),
        _list("i.users").alias("users"), _list("i.groups").alias("groups"), _list("i.roles").alias("roles"),
        F.transform(
            F.coalesce("i.accesses", F.expr("CAST(array() AS ARRAY<STRUCT<type: STRING, isAllowed: BOOLEAN>>)")),
            lambda a: F.struct(a["type"].alias("type"), a["isAllowed"].alias("is_allowed")),
        ).alias("accesses"),
        F.coalesce("i.delegateAdmin", F.lit(False)).alias("delegate_admin"), "i.conditions",
    )


def normalise_filter_items(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter("NOT broken").select(
        "policy_key", F.posexplode("p.rowFilterPolicyItems").alias("item_pos", "i")
    )
    return rows.select(
        "policy_key", F.col("item_pos").cast("bigint").alias("item_pos"),
        _list("i.users").alias("users"), _list("i.groups").alias("groups"),
        F.coalesce("i.rowFilterInfo.filterExpr", F.lit("")).alias("filter_expr"), "i.conditions",
    )


def normalise_mask_items(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter("NOT broken").select(
        "policy_key", F.posexplode("p.dataMaskPolicyItems").alias("item_pos", "i")
    )
    return rows.select(
        "policy_key", F.col("item_pos").cast("bigint").alias("item_pos"),
        _list("i.users").alias("users"), _list("i.groups").alias("groups"),
        F.coalesce("i.dataMaskInfo.dataMaskType", F.lit("MASK")).alias("mask_type"),
        F.col("i.dataMaskInfo.conditionExpr").alias("mask_condition"), "i.conditions",
    )


def policy_tables(docs: DataFrame) -> PolicyTables:
    parsed = parse_policies(unwrap_policies(docs))
    return PolicyTables(
        normalise_policies(parsed),
        normalise_access_items(parsed),
        normalise_filter_items(parsed),
        normalise_mask_items(parsed),
    )


def propagate_service(unwrapped: DataFrame) -> DataFrame:
    """The root's service name fills in for policies that name none."""
    own = F.from_json("policy_json", "service STRING")["service"]
    absent = ~F.coalesce(F.array_contains(F.expr("json_object_keys(policy_json)"), "service"), F.lit(False))
    return unwrapped.withColumn(
        "service", F.when(absent & (F.length("service_name") > 0), F.col("service_name")).otherwise(own)
    )
