"""What large tables need: few shuffles, bounded files, one pass over statements."""

import json
import re

from pyspark.sql import functions as F

from palisade.operators.config import Config
from palisade.plans import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_lines_of_documents_are_shuffled_once(spark):
    """Orders by key, then policies and lines by block: lists and files are made where a block lies."""
    plan = fx.build_documents(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2
    assert plan.count("Exchange hashpartitioning(block") == 1


def test_documents_of_odd_keys(spark, tmp_path):
    """Lines without an order, orders without a line, repeated and null keys."""
    orders = [(1, 3, "O", "1-URGENT"), (1, 2, "F", "5-LOW"), (5, 4, "P", "3-MEDIUM"), (None, 1, "O", "1-URGENT")]
    line = (3, 4, 1, 21.0, 5.5, 0.1, 0.0, "R", "F", None)
    lines = [(1, *line), (1, *line), (9, *line), (None, *line), (1, 7, 9, 1, 3.0, 5.5, 0.1, 0.0, None, "O", None)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(
        lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double,"
        " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["policy_key"]: json.loads(r["policy_json"]) for r in fx.policy_json(spark, str(tmp_path)).collect()}
    assert set(found) == {1, 5, None}
    assert len(found[1]["policyItems"]) == 3 and "policyItems" not in found[5] and "policyItems" not in found[None]


def test_script_files_are_bounded(spark, tmp_path, monkeypatch):
    """Files hold so many statements, and their names still give the order."""
    from palisade.sources import sinks

    monkeypatch.setattr(sinks, "STATEMENTS_PER_FILE", 5, raising=False)
    rows = spark.range(1, 43).selectExpr("'s' AS source", "id AS stmt_no", "42L AS stmt_total", "'GRANT x' || id AS sql")
    sinks.write_sql_script(rows.repartition(3), f"{tmp_path}/scripts")
    texts = [p.read_text() for p in sorted((tmp_path / "scripts/source=s").glob("part-*"))]
    assert max(t.count("-- Statement ") for t in texts) <= 5
    assert [int(w) for w in re.findall("-- Statement ([0-9]+) of", "".join(texts))] == list(range(1, 43))


def test_tag_statements_are_made_in_one_pass(spark):
    """Headers of tag policies need no second look at their statements."""
    from palisade.operators import statements, tags

    run = fx.inputs(spark, SF)
    rows = tags.tag_access_rows(run.policies, run.access, run.filters, run.masks, run.resource_tags, Config())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(statements.finish_known(rows)).count("parquet") == plan(rows).count("parquet")
    made = statements.finish_known(rows)
    first = statements.finish(rows.withColumn("may_head", F.lit(True)), run.policies)  # the smallest place of all
    assert {(r.policy_key, r.sql) for r in made.collect()} == {(r.policy_key, r.sql) for r in first.collect()}


def test_leads_of_policies_without_grants(spark):
    """The header goes to the digest, the first filter, the first mask, or the placeholder, whichever comes first."""
    from palisade.operators import statements, tags

    types = "policy_key long, policy_id string, name string, description string, scope string, policy_type string, resources map<string, array<string>>"
    policies = spark.createDataFrame([(k, str(k), f"p{k}", "d", "", "ACCESS", {"tag": ["A"] if k < 5 else ["B"]}) for k in range(1, 6)], types)
    one = [{"type": "select", "is_allowed": True}]
    access = spark.createDataFrame(
        [(1, "allow", 1, ["u"], [], [], [{"type": "select", "is_allowed": False}]), (1, "allow", 2, ["u", "v"], [], [], one),
         (2, "deny", 1, ["u"], [], [], one), (5, "allow", 1, [], [], [], one), (5, "allow", 3, ["u"], [], [], one)],
        "policy_key long, kind string, item_pos long, users array<string>, groups array<string>, roles array<string>, accesses array<struct<type: string, is_allowed: boolean>>",
    )
    filters = spark.createDataFrame(
        [(k, i, ["u"], [], "a = 1" if i > 1 else "") for k in (1, 2, 3) for i in (1, 2, 3)],
        "policy_key long, item_pos long, users array<string>, groups array<string>, filter_expr string",
    )
    masks = spark.createDataFrame(
        [(k, 1, ["u"], [], "MASK") for k in (1, 2, 3, 4)],
        "policy_key long, item_pos long, users array<string>, groups array<string>, mask_type string",
    )
    found = [("", p, i, i, "A") for i, p in enumerate(["d.t2", "d.t1.c", "d.t1.b", *[f"d.t{n}" for n in range(3, 14)]])]
    tagged = spark.createDataFrame(found, "scope string, path string, path_pos long, tag_pos long, tag string")
    rows = tags.tag_access_rows(policies, access, filters, masks, tagged, Config())
    headed = [r for r in statements.finish_known(rows).collect() if r.sql.startswith("-- ===") or f"p{r.policy_key}" in r.sql]
    places = {r.policy_key: (r.section, r.obj_key, r.item_pos, r.prin_pos, r.part) for r in headed}
    assert len(headed) == 5 and places == {
        1: (0, "d.t1", 2, 0, 0), 2: (1, "", 0, 0, 0), 3: (2, "d.t1", 2, 0, 0), 4: (3, "d.t1", 1, 0, 0), 5: (0, "", 3, 0, 0),
    }
