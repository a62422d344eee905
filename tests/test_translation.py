"""Small files with hand-worked results: statement text and known oddities."""

import json

import pytest
from pyspark.sql import functions as F

from palisade.operators.config import Config
from palisade.operators.tags import tag_statements
from palisade.operators.translate import Inputs, translate_all, translation_errors
from palisade.sources import documents, tags

RULE = "-- " + "=" * 78


def run(spark, *files):
    docs = spark.createDataFrame([(f"f{i}", json.dumps(f)) for i, f in enumerate(files)], "source string, json string")
    t = documents.policy_tables(docs)
    scope = lambda df: df.withColumnRenamed("source", "scope")
    return Inputs(
        t.policies.withColumn("scope", F.col("source")), t.access_items, t.filter_items, t.mask_items,
        scope(tags.read_tag_definitions(docs)), scope(tags.read_tag_attributes(docs)), scope(tags.read_resource_tags(docs)),
    )


FILES: dict[str, dict] = {}


class Result:
    """All test files translated in one run; statements and errors by file."""

    def __init__(self, spark):
        names = list(FILES)
        inputs = run(spark, *FILES.values())
        self.sql = {n: [] for n in names}
        self.errors = {n: [] for n in names}
        name_of = lambda key: names[int(key.split("#")[0][1:])]
        for row in sorted(translate_all(inputs, Config()).collect(), key=lambda r: tuple(r[:-1])):
            self.sql[name_of(row["policy_key"])].append(row["sql"])
        for row in translation_errors(inputs, Config()).collect():
            self.errors[name_of(row["policy_key"])].append(row["message"])


@pytest.fixture(scope="module")
def result(spark):
    return Result(spark)


def policy(**fields):
    return {"policies": [{"id": 7, "name": "p", "resources": {"database": {"values": ["db"]}, "table": {"values": ["t", "u"]}}, **fields}]}


FILES["grants"] = policy(
    description="d" * 71,
    policyItems=[
        {"users": ["ann"], "groups": ["g"], "roles": ["r"],
         "accesses": [{"type": "hive:select"}, {"type": "drop", "isAllowed": False}]}
    ],
)


def test_only_the_first_table_gets_grants_and_the_header_is_on_the_first(result):
    assert result.sql["grants"] == [
        f"{RULE}\n-- Ranger Policy: p\n-- Policy ID: 7\n-- Description: {'d' * 70}\n--              d\n{RULE}\n"
        "GRANT SELECT ON TABLE main.db.t TO `ann`;",
        "GRANT SELECT ON TABLE main.db.t TO `g`;",
        "GRANT SELECT ON TABLE main.db.t TO `r`;",
    ]


FILES["create"] = policy(policyItems=[{"users": ["ann"], "accesses": [{"type": "create"}, {"type": "create"}]}])


def test_create_on_a_table_moves_to_the_schema_once_and_without_header(result):
    assert result.sql["create"] == [
        "-- NOTE: Ranger 'create' on a table maps to UC schema-level privilege.\n"
        "-- Granting CREATE TABLE on the parent schema instead.\n"
        "GRANT CREATE TABLE ON SCHEMA main.db TO `ann`;"
    ]


FILES["wildcard"] = policy(
    resources={"table": {"values": ["*"]}}, policyItems=[{"users": ["ann"], "accesses": [{"type": "create"}]}]
)


def test_wildcard_table_without_database(result):
    assert result.sql["wildcard"][0].endswith("GRANT CREATE TABLE ON SCHEMA main.ranger_migration TO `ann`;")


FILES["filter"] = policy(
    rowFilterPolicyItems=[
        {"users": ["ann"], "groups": ["g"], "rowFilterInfo": {"filterExpr": "region = 'W'"}},
        {"groups": ["h"], "rowFilterInfo": {"filterExpr": ""}},
        {"users": ["bob"], "rowFilterInfo": {"filterExpr": "x NOT IN (1) AND region > 2"}},
    ]
)


def test_row_filter_is_one_case_and_else_true(result):
    create, attach = result.sql["filter"]
    assert create.split(RULE + "\n")[-1] == (
        "CREATE OR REPLACE FUNCTION main.db.rf_t_7_0(region STRING)\nRETURNS BOOLEAN\nRETURN\n CASE\n"
        " WHEN current_user() = 'ann'\n THEN region = 'W'\n"
        " WHEN is_account_group_member('g')\n THEN region = 'W'\n"
        " WHEN current_user() = 'bob'\n THEN x NOT IN (1) AND region > 2\n ELSE TRUE\n END;"
    )
    assert attach == "ALTER TABLE main.db.t\nSET ROW FILTER main.db.rf_t_7_0\nON (region);"


FILES["mask"] = policy(
    resources={"database": {"values": ["db"]}, "table": {"values": ["t"]}, "column": {"values": ["c", "e"]}},
    dataMaskPolicyItems=[
        {"users": ["ann"], "dataMaskInfo": {"dataMaskType": "MASK_NONE"}},
        {"groups": ["g"], "dataMaskInfo": {"dataMaskType": "SHUFFLE"}},
        {"groups": ["h"], "dataMaskInfo": {"dataMaskType": "MASK_HASH"}},
    ],
)


def test_column_mask_uses_the_first_real_type_for_every_column(result):
    got = result.sql["mask"]
    assert len(got) == 4
    assert got[2] == (
        "CREATE OR REPLACE FUNCTION main.db.mask_t_e_shuffle(e STRING)\nRETURNS STRING\nRETURN\n CASE\n"
        " WHEN current_user() = 'ann'\n THEN e\n ELSE '[REDACTED]'\n END;"
    )
    assert got[3] == "ALTER TABLE main.db.t\nALTER COLUMN e\nSET MASK main.db.mask_t_e_shuffle;"


FILES["lost"] = policy(
    resources={"topic": {"values": ["x"]}, "queue": {"values": ["y"]}}, policyItems=[{"users": ["ann"]}]
)


def test_untranslatable_resource_lists_reasons_in_file_order(result):
    (got,) = result.sql["lost"]
    assert got.endswith(
        "-- NOT TRANSLATABLE: Policy 'p' (id=7)\n-- Kafka topics are managed by Kafka ACLs, not Unity Catalog.\n"
        "-- 'queue' has no Unity Catalog equivalent.;"
    )
    (message,) = result.errors["lost"]
    assert message.startswith("Not translatable — 'p' (id=7): Kafka topics")


FILES["schema_filter"] = policy(
    resources={"database": {"values": ["db"]}},
    rowFilterPolicyItems=[{"users": ["a"], "rowFilterInfo": {"filterExpr": "x = 1"}}],
)


def test_a_schema_level_row_filter_is_an_error(result):
    assert result.sql["schema_filter"] == []
    assert result.errors["schema_filter"] == ["Invalid table path for row filter: SCHEMA main.db"]


FILES["path"] = policy(
    resources={"path": {"values": ["/a/*", "/"]}},
    policyItems=[{"users": ["ann"], "accesses": [{"type": "execute"}, {"type": "zip"}]}],
)


def test_storage_path(result):
    got = result.sql["path"]
    assert got[0].endswith("GRANT READ FILES ON EXTERNAL LOCATION `ext_loc_a_all` TO `ann`;")
    assert "-- Description: -- NOTE: Replace 'ext_loc_a_all' with the actual UC External Location name\n" in got[0].replace("\n--              ", "")
    assert got[1:] == [
        "GRANT ZIP ON EXTERNAL LOCATION `ext_loc_a_all` TO `ann`;",
        "GRANT READ FILES ON EXTERNAL LOCATION `ext_loc_root` TO `ann`;",
        "GRANT ZIP ON EXTERNAL LOCATION `ext_loc_root` TO `ann`;",
    ]


TAG_FILE = {
    "tagDefinitions": {"PII": {"attributeDefs": {"Level": "high", "pii": "x"}}, "LOST": {}},
    "resourceTags": {"db.t": ["PII"], "db.t.c": ["PII", "OTHER"], "x.y.z": ["OTHER"], "one": ["PII2"]},
}


FILES["tagged"] = {
    **TAG_FILE,
    "policies": [
        {
            "id": 9, "name": "tagged", "policyType": 0, "resources": {"tag": {"values": ["PII"]}},
            "policyItems": [{"groups": ["g"], "accesses": [{"type": "select"}]}],
            "denyPolicyItems": [{"users": ["eve"], "roles": ["r"]}],
            "rowFilterPolicyItems": [
                {"groups": ["g"], "rowFilterInfo": {"filterExpr": ""}},
                {"groups": ["g"], "rowFilterInfo": {"filterExpr": "a = CURRENT_DATE"}},
            ],
            "dataMaskPolicyItems": [{"users": ["u"], "dataMaskInfo": {"dataMaskType": "MASK"}}],
        }
    ],
}


def test_tag_access_policy(result):
    got = result.sql["tagged"]
    assert got[0].endswith("GRANT SELECT ON TABLE main.db.t TO `g`;") and got[0].startswith(RULE)
    assert got[1].endswith("explicit permission exclusion.\n-- DENY user: eve;")
    assert got[2].startswith("CREATE OR REPLACE FUNCTION main.db.rf_t_9_1(a STRING)")
    assert got[4].startswith("CREATE OR REPLACE FUNCTION main.db.mask_t_c_mask(c STRING)") and "'XXXXX'" in got[4]
    assert len(got) == 6


def test_tag_statements(spark):
    inputs = run(spark, {**TAG_FILE, "policies": []})
    rows = tag_statements(inputs.definitions, inputs.attributes, inputs.resource_tags, Config()).collect()
    rows.sort(key=lambda r: (r["section"], r["obj_key"], r["obj_sub"]))
    got = [r["sql"].split(RULE + "\n")[-1] for r in rows]
    assert got == [
        "ALTER TABLE main.db.t SET TAGS ('pii' = 'true', 'level' = 'high');",
        "ALTER TABLE main.db.t ALTER COLUMN c SET TAGS ('pii' = 'true', 'level' = 'high', 'other' = 'true');",
        "ALTER TABLE main.x.y ALTER COLUMN z SET TAGS ('other' = 'true');",
        "-- TODO: No resourceTags found for tag 'LOST'.\n-- Apply this tag to the relevant table(s)/column(s):\n"
        "ALTER TABLE main.ranger_migration.<table_name> SET TAGS ('lost' = 'true');",
    ]


def tag_mask(tag, kind):
    return {
        **TAG_FILE,
        "policies": [
            {"id": 1, "name": "m", "policyType": 1, "resources": {"tag": {"values": [tag, "OTHER"]}},
             "dataMaskPolicyItems": [{"users": ["u"], "dataMaskInfo": {"dataMaskType": kind}}]}
        ],
    }


FILES["tag_mask"] = tag_mask("PII", "SHUFFLE")
FILES["tag_mask_nowhere"] = tag_mask("NONE", "MASK")
FILES["tag_mask_open"] = tag_mask("PII", "MASK_NONE")


def test_tag_mask_without_columns_or_without_type(result):
    assert len(result.sql["tag_mask"]) == 4  # db.t reads as table db, column t
    assert result.errors["tag_mask_open"] == ["No masking type for tag 'PII'"]
    assert result.errors["tag_mask_nowhere"][0].startswith("Tag-based policy for tag 'NONE'")
    assert result.sql["tag_mask_open"] == result.sql["tag_mask_nowhere"] == []


def test_policy_type(spark):
    cases = [
        (1, {}, "COLUMN_MASK"), (2, {}, "ROW_FILTER"), (3, {"dataMaskPolicyItems": []}, "ACCESS"),
        (None, {"dataMaskPolicyItems": []}, "COLUMN_MASK"), ("1", {}, "ACCESS"), (None, {}, "ACCESS"),
        (None, {"rowFilterPolicyItems": []}, "ROW_FILTER"),
    ]
    files = [policy(**lists, **({} if d is None else {"policyType": d})) for d, lists, _ in cases]
    rows = run(spark, *files).policies.select("scope", "policy_type").collect()
    assert {r["scope"]: r["policy_type"] for r in rows} == {f"f{i}": c[2] for i, c in enumerate(cases)}


def test_conditions_of_items(spark):
    from palisade.functions.text import conditions_to_sql

    cases = {
        '[{"type": "expression", "values": ["a > 1", "b"]}]': ["a > 1"], '[{"type":"expression"}]': ["TRUE"],
        '[{"type":"ip","values":["1","2"]},{"z":["q"],"a":["r"]}]': ["values IN ('1', '2')", "z = 'q' AND a = 'r'"],
        '{"users":["u","v"],"note":"x","teams":[],"n":3}': ["users IN ('u', 'v')"], "{}": ["TRUE"], "[]": [], None: [], "nonsense": [],
    }
    rows = spark.createDataFrame([(k,) for k in cases], "c string").select("c", conditions_to_sql(F.col("c")).alias("p")).collect()
    assert {r.c: r.p for r in rows} == cases
    item = {"users": ["u"], "accesses": [{"type": "read"}], "conditions": [{"z": [1, 2], "a": ["x"]}]}
    docs = spark.createDataFrame([("f", json.dumps(policy(policyItems=[item])))], "source string, json string")
    (row,) = documents.policy_tables(docs).access_items.select(conditions_to_sql(F.col("conditions")).alias("p")).collect()
    assert row.p == ["z IN ('1', '2') AND a = 'x'"]
