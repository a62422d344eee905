"""Skew, ordering and plan shape."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from palisade.functions.ordering import numbered, ordered_text
from palisade.operators import enforce, translate
from palisade.operators.config import Config
from palisade.operators.enforce import FilterRule, MaskRule, Principal
from palisade.operators.translate import Inputs
from palisade.plans import fixtures as fx
from palisade.sources import documents, sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed():
    rng = random.Random(3)
    rows = [("hot", i, rng.randrange(50)) for i in range(3000)]
    rows += [(f"k{i % 40}", i, rng.randrange(50)) for i in range(3000, 6000)]
    rng.shuffle(rows)
    return rows


def test_numbering_of_a_hot_key_matches_brute_force(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, pos long, x int").repartition(7)
    df = df.withColumns({"tier": F.floor(F.col("pos") / 1000), "fine": F.floor(F.col("pos") / 100)})
    got = numbered(df, ["k"], [F.col("pos")], ["tier", "fine"], "n", "total").collect()
    by_key = {}
    for k, pos, _ in sorted(skewed, key=lambda r: r[1]):
        by_key.setdefault(k, []).append(pos)
    want = {(k, p): (i, len(ps)) for k, ps in by_key.items() for i, p in enumerate(ps, 1)}
    assert {(r["k"], r["pos"]): (r["n"], r["total"]) for r in got} == want


def test_chunked_text_matches_brute_force(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, pos long, x int").withColumn("t", F.col("x").cast("string"))
    got = ordered_text(df.repartition(5), ["k"], ["pos"], "t", "|", "text", F.floor(F.col("pos") / 64)).collect()
    want = {}
    for k, _, x in sorted(skewed, key=lambda r: r[1]):
        want.setdefault(k, []).append(str(x))
    assert {r["k"]: r["text"] for r in got} == {k: "|".join(v) for k, v in want.items()}


def test_script_of_a_hot_source_is_several_ordered_files(spark, tmp_path):
    rows = [("a", i, 900, f"GRANT {i}") for i in range(1, 901)] + [("b", 1, 1, "GRANT b")]
    df = spark.createDataFrame(rows, "source string, stmt_no long, stmt_total long, sql string").repartition(8)
    sinks.write_sql_script(df, str(tmp_path / "out"))
    files = sorted((tmp_path / "out" / "source=a").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert [line for line in text.splitlines() if line.startswith("GRANT")] == [r[3] for r in rows[:900]]


def test_a_file_of_many_policies_keeps_its_order(spark):
    policy = lambda i: {
        "id": 100 - i, "name": f"p{i}", "policyType": 0, "resources": {"database": {"values": ["d"]}, "table": {"values": [f"t{i}"]}},
        "policyItems": [{"users": [f"u{k}" for k in range(3)], "accesses": [{"type": "select"}, {"type": "update"}]}],
    }
    docs = spark.createDataFrame([("f", json.dumps({"policies": [policy(i) for i in range(25)]}))], "source string, json string")
    t = documents.policy_tables(docs)
    empty = lambda kinds: spark.createDataFrame([], kinds)
    run = Inputs(
        t.policies.withColumn("scope", F.lit("")), t.access_items, t.filter_items, t.mask_items, empty("scope string, tag string"),
        empty("scope string, tag string, attr_pos int, attr_key string, attr_value string"),
        empty("scope string, path string, path_pos bigint, tag_pos bigint, tag string"),
    )
    rows = translate.file_statements(translate.translate_all(run, Config()), t.policies).orderBy("stmt_no").collect()
    grants = [re.search(r"GRANT (\w+) ON TABLE \S+\.(t\d+) TO `(u\d)`", r.sql).groups() for r in rows]
    assert [g[1:] for g in grants[::2]] == [(f"t{i}", f"u{k}") for i in range(25) for k in range(3)]
    assert [r.stmt_no for r in rows] == list(range(1, 151)) and {r.stmt_total for r in rows} == {150}


def test_numbering_splits_a_hot_item_and_a_hot_policy(spark):
    rows = [(1, 0, "", 0, p, a) for p in range(1500) for a in range(2)] + [(1, 0, "", i, 0, 0) for i in range(1, 700)] + [(2, 0, "o", 0, 0, 0)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k long, section int, obj_key string, item_pos long, prin_pos int, acc_pos int").withColumns(
        {"source": F.lit("s"), "obj_pos": F.lit(0), "obj_sub": F.lit(""), "part": F.lit(0)}
    )
    got = translate.number_statements(df, ["source"], ["k"]).orderBy("stmt_no").collect()
    assert [(r.k, r.section, r.obj_key, r.item_pos, r.prin_pos, r.acc_pos) for r in got] == sorted(rows, key=lambda r: r[:2] + r[3:])
    assert [r.stmt_no for r in got] == list(range(1, len(rows) + 1))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_filter_reaches_the_scan_and_masked_columns_are_pruned(spark):
    rules = [FilterRule("user", "u", "o_orderstatus = 'F'"), FilterRule("group", "g", "o_custkey = 1")]
    df = enforce.secured_view(
        fx.table(spark, SF, "orders"), "v", Principal("u", ("g",)), rules, [MaskRule("o_orderpriority", "MASK_HASH")]
    )
    plan = _plan(spark.table("v").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,F)" in plan and "o_custkey" not in plan and "o_orderpriority" not in plan
    assert df.count() > 0


def test_a_row_filter_never_adds_rows_and_unlisted_principals_see_all(spark):
    orders = fx.table(spark, SF, "orders")
    rules = [FilterRule("user", "u", "o_orderstatus = 'F'")]
    total = orders.count()
    assert enforce.apply_row_filter(orders, Principal("u"), rules).count() < total
    assert enforce.apply_row_filter(orders, Principal("x"), rules).count() == total


def test_visible_rows_needs_no_cross_join_of_principals_and_data(spark):
    people = spark.createDataFrame([("u", ["g"]), ("x", [])], "user_name string, groups array<string>")
    rules = spark.createDataFrame([(0, "group", "g", "o_orderstatus = 'F'"), (1, "user", "u", "true")], "rule_pos int, kind string, name string, predicate string")
    df = enforce.rows_visible_per_principal(people, rules, fx.table(spark, SF, "orders"))
    assert "Cartesian" not in _plan(df)
    assert dict(map(tuple, df.collect()))["x"] == fx.table(spark, SF, "orders").count()


def test_ingest_has_no_shuffle(spark):
    docs = spark.createDataFrame([("s", '{"policies":[{"id":1,"resources":{}}]}')], "source string, json string")
    assert "Exchange" not in _plan(documents.policy_tables(docs).access_items)


def test_whole_files_and_broken_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "policies": [\n  {"id": 1, "name": "x", "resources": {}}, 5, {"resources": []}\n ]\n}')
    (tmp_path / "b.json").write_text('{"policies": [')
    (tmp_path / "c.json").write_text('{"policies": 5}')
    docs = documents.read_policy_documents(spark, str(tmp_path))
    parsed = documents.parse_policies(documents.unwrap_policies(docs))
    assert [r["policy_id"] for r in documents.normalise_policies(parsed).collect()] == ["1"]
    assert documents.policy_errors(parsed).count() == 2
    stages = {r["source"][-6:]: r["stage"] for r in documents.document_errors(docs).collect()}
    assert stages == {"b.json": "Error reading file", "c.json": "Error parsing JSON"}


def test_mask_lengths(spark):
    from palisade.functions import masks

    df = spark.createDataFrame([("abcdef",), ("abc",), (None,)], "c string")
    got = [tuple(r) for r in df.select(masks.mask_show_last_4("c"), masks.mask_show_first_4("c"), masks.mask_full("c")).collect()]
    assert got == [("XXcdef", "abcdXX", "XXXXX"), ("abc", "abc", "XXXXX"), (None, None, "XXXXX")]


# --- hot items, columns and sections ----------------------------------------------------------------------------


def test_an_item_of_100_000_users_is_joined_in_chunks(spark):
    from palisade.operators import column_masks, filters

    users = [f"u{i}" for i in range(100_000)]
    rows = [("p", 0, ["a"], ["g"], "x = 1"), ("p", 1, users, [], "y = 2"), ("p", 2, ["b"], [], "z = 3"), ("q", 0, ["c"], [], "w")]
    items = spark.createDataFrame(rows, "policy_key string, item_pos bigint, users array<string>, groups array<string>, filter_expr string")
    whens = filters.filter_clauses(items, Config())
    joined = filters.principals_joined(whens.select("policy_key", "item_pos", "prin_pos", F.col("pname").alias("t")), items, ["item_pos", "prin_pos"], "t", ",", "text")
    assert {r.policy_key: r.text for r in joined.collect()} == {"p": ",".join(["a", "g", *users, "b"]), "q": "c"}
    # The largest group that is sorted holds one chunk.
    run, fine = filters.item_chunk(), F.struct("item_pos", filters.principal_chunk())
    assert whens.groupBy("policy_key", run, fine).count().agg(F.max("count")).first()[0] <= filters.ITEMS_PER_CHUNK
    body = {r.policy_key: r.filter_body for r in filters.merge_row_filters(items, Config()).collect()}
    assert body["p"].count("WHEN") == 100_003 and body["p"].index("= 'u99999'") < body["p"].index("= 'b'")
    masks = items.select("policy_key", "item_pos", "users", "groups", F.lit("MASK_NONE").alias("mask_type"))
    by_rank = {r.policy_key: r.whens for r in column_masks.pass_through(masks, Config(), map_users=False).collect()}
    assert by_rank["p"].index("= 'b'") < by_rank["p"].index("member('g')") and by_rank["p"].count("WHEN") == 100_003


def test_text_of_a_hot_key_is_cut_by_counting(spark, skewed):
    from palisade.functions.ordering import ordered_text_of_any

    df = spark.createDataFrame(skewed, "k string, pos long, x int").select("k", (F.col("pos") * F.col("pos")).alias("pos"), F.col("x").cast("string").alias("t"))
    want = {}
    for k, _, x in sorted(skewed, key=lambda r: r[1]):
        want.setdefault(k, []).append(str(x))
    for chunk in (10, 100, 10_000):
        got = ordered_text_of_any(df.repartition(5), ["k"], ["pos"], "t", "|", "text", chunk).collect()
        assert {r["k"]: r["text"] for r in got} == {k: "|".join(v) for k, v in want.items()}


def test_tags_of_a_hot_column(spark):
    from palisade.operators import tags

    tagged = [("", 1, "db.t", "c", 1, i * 7919 % 10_007, f"T{i}") for i in range(3000)] + [("", 1, "db.t", "d", 2, 5, "X")]
    rows = spark.createDataFrame(tagged, "scope string, section int, table_key string, column string, path_pos bigint, tag_pos bigint, tag string")
    attributes = spark.createDataFrame([("", "X", 0, "K", "v")], "scope string, tag string, attr_pos bigint, attr_key string, attr_value string")
    got = {r["column"]: r.pairs for r in tags.merge_tag_pairs(rows, attributes, ["scope", "section", "table_key", "column"]).collect()}
    ordered = sorted(tagged[:-1], key=lambda r: r[5])
    assert got == {"c": ", ".join(f"'{r[6].lower()}' = 'true'" for r in ordered), "d": "'x' = 'true', 'k' = 'v'"}


@pytest.mark.parametrize("ranges", [None, 1, 9])
def test_numbering_by_ranges(spark, skewed, ranges):
    from palisade.functions.ordering import numbered_by_range

    rows = skewed + [(None, 1, 2), (None, None, 3), ("hot", 5, 60), ("hot", 5, 60)]
    df = spark.createDataFrame(rows, "k string, pos long, x int").repartition(6)
    numbered_rows = numbered_by_range(df, ["k"], ["pos", "x"], "n", ranges)
    by_key = {}
    for r in numbered_rows.collect():
        by_key.setdefault(r.k, []).append((r.n, r.pos, r.x))
    order = lambda p: tuple((v is not None, v or 0) for v in p)
    for k, found in by_key.items():
        want = sorted(((p, x) for kk, p, x in rows if kk == k), key=order)
        assert [(p, x) for _, p, x in sorted(found)] == want and [n for n, _, _ in sorted(found)] == list(range(1, len(want) + 1))
    plan = numbered_rows._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan  # no window over the rows of a key, only over its ranges


def test_grants_with_many_overrides_are_the_same(spark, monkeypatch):
    from dataclasses import replace

    from palisade.operators import grants, statements
    from palisade.sources import mappings

    policies, items = fx.policies_frame(spark, SF), fx.access_items(fx.fx_items(spark, SF))
    c = replace(Config(), mapping=fx.mapping(spark, SF))

    def rows():
        return sorted(map(tuple, statements.finish_known(grants.access_grants(policies, items, c)).drop("policy_type").collect()))

    few = rows()
    monkeypatch.setattr(mappings, "FEW", 0)
    assert mappings.few_overrides(c.mapping, "privilege") is None
    assert rows() == few and len(few) > 1000


def test_headers_need_no_second_read(spark):
    from palisade.operators import grants, statements

    policies, items = fx.policies_frame(spark, SF), fx.access_items(fx.fx_items(spark, SF))
    rows = grants.access_grants(policies, items, Config())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # Formatting adds no scan; grants read the items twice, once narrowly for the first statements.
    assert plan(statements.finish_known(rows)).count("parquet") == plan(rows).count("parquet") <= 4
