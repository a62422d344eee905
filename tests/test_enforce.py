"""Indexed predicates and rules compiled from relations."""

import random

from pyspark.sql import functions as F

from palisade.operators import enforce
from palisade.operators.enforce import Principal

KINDS = "s string, t string, i int, b bigint, d double, day date"


def data(spark, n=400):
    rng = random.Random(1)
    rows = [
        (rng.choice(["F", "O", "", None, "x AND y", "it's"]), rng.choice(["a", "b"]), rng.choice([None, *range(-3, 8)]), rng.randint(0, 2**40),
         rng.choice([None, float("nan"), -1.5, 0.0, 2.0, 7.25]), None)
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, KINDS)


PREDICATES = [
    "s = 'F'", "s='F'", "S = 'F' and T = 'a'", "t = 'a' AND s = 'F'", "s = ''", "s IN ('F', 'O', 'F')", "s IN ('F','O') AND i > 2", "i = 3", "i = 03",
    "i IN (1, 2, -3)", "i % 3 = 1 AND d >= 0", "i %3=1 AND d < 2", "d > 0", "d >= 0", "d <= 2", "d < -1", "b > 500000000000", "b % 2 = 0", "i = 1 AND i = 2",
    "s = 'x AND y'", "s = 'it''s'", "s = 'F' OR t = 'a'", "NOT (s = 'F')", "i BETWEEN 1 AND 3", "i > 1 AND i < 5", "i = '3'", "s > 'F'", "d = 2",
    "i IN (1,2) AND t IN ('a', 'b')", "s LIKE 'F%'", "i IS NOT NULL", "day IS NULL", "TRUE", "i <> 1", "i > 2.5", "d > 2",
]


def test_counts_of_every_form(spark):
    rows = data(spark)
    users = spark.createDataFrame([(f"u{k}", []) for k in range(len(PREDICATES) + 1)], "user_name string, groups array<string>")
    rules = spark.createDataFrame([(k, "user", f"u{k}", p) for k, p in enumerate(PREDICATES)], "rule_pos int, kind string, name string, predicate string")
    got = {r.user_name: r.visible for r in enforce.rows_visible_per_principal(users, rules, rows).collect()}
    counts = rows.agg(*[F.count_if(F.expr(p)).alias(f"c{k}") for k, p in enumerate(PREDICATES)]).first()
    want = {f"u{k}": counts[k] for k in range(len(PREDICATES))} | {f"u{len(PREDICATES)}": rows.count()}
    assert got == want


def test_what_is_indexed(spark):
    frame = spark.createDataFrame([(p,) for p in [*PREDICATES, "s IN ('F', 3)"]], "predicate string")
    found = {r.predicate: r for r in enforce.predicate_index(frame).collect()}
    indexed = {p for p, r in found.items() if r["shape"] is not None}
    assert {"s = 'F'", "t = 'a' AND s = 'F'", "s IN ('F','O') AND i > 2", "i %3=1 AND d < 2", "b > 500000000000"} <= indexed
    assert not indexed & {"s = 'F' OR t = 'a'", "NOT (s = 'F')", "i = 1 AND i = 2", "s = 'it''s'", "i > 1 AND i < 5", "s IN ('F', 3)", "i > 2.5"}


def test_a_thousand_predicates_are_one_scan(spark, tmp_path):
    data(spark, 2000).write.parquet(str(tmp_path / "data"))
    rows = spark.read.parquet(str(tmp_path / "data"))
    texts = [f"s = 'F' AND b > {k * 10**9}" for k in range(900)] + [f"i = {k}" for k in range(100)]
    users = spark.createDataFrame([(f"u{k}", []) for k in range(1000)], "user_name string, groups array<string>")
    rules = spark.createDataFrame([(k, "user", f"u{k}", p) for k, p in enumerate(texts)], "rule_pos int, kind string, name string, predicate string")
    seen = enforce.rows_visible_per_principal(users, rules, rows)
    plan = seen._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    got = {r.user_name: r.visible for r in seen.collect()}
    kept = rows.select("s", "b", "i").collect()
    assert got == {
        f"u{k}": sum(r.s == "F" and r.b > k * 10**9 for r in kept) if k < 900 else sum(r.i == k - 900 for r in kept) for k in range(1000)
    }


def test_index_without_rules_or_rows(spark):
    users = spark.createDataFrame([("u", ["g"]), ("v", None)], "user_name string, groups array<string>")
    none = spark.createDataFrame([], "rule_pos int, kind string, name string, predicate string")
    assert {tuple(r) for r in enforce.rows_visible_per_principal(users, none, data(spark, 5)).collect()} == {("u", 5), ("v", 5)}
    rules = spark.createDataFrame([(1, "group", "g", "i = 1")], none.schema)
    empty = spark.createDataFrame([], KINDS)
    assert {tuple(r) for r in enforce.rows_visible_per_principal(users, rules, empty).collect()} == {("u", 0), ("v", 0)}


# --- tags ---------------------------------------------------------------------------------------------------


def relations(spark):
    tags = spark.createDataFrame(
        [("", "db.t", 1, 1, "pii"), ("", "db.t.name", 2, 2, "pii"), ("", "db.t.day", 3, 3, "time"), ("", "db.u.name", 4, 4, "other")],
        "scope string, path string, path_pos bigint, tag_pos bigint, tag string",
    )
    policies = spark.createDataFrame(
        [(1, "", {"tag": ["pii"]}, "ACCESS"), (2, "", {"tag": ["pii"]}, "COLUMN_MASK"), (3, "", {"tag": ["pii", "time"]}, "COLUMN_MASK"),
         (4, "", {"tag": ["time"]}, "COLUMN_MASK"), (5, "", {"table": ["t"]}, "ACCESS")],
        "policy_key bigint, scope string, resources map<string, array<string>>, policy_type string",
    )
    who = "policy_key bigint, item_pos bigint, users array<string>, groups array<string>"
    filters = spark.createDataFrame(
        [(1, 1, ["a"], [], "id > 5"), (1, 2, ["a"], ["g"], "id > 7"), (1, 3, ["b"], [], ""), (5, 1, ["a"], [], "false")], who + ", filter_expr string"
    )
    masks = spark.createDataFrame(
        [(2, 1, [], [], "MASK_HASH"), (3, 1, ["a"], ["g"], "MASK_NONE"), (3, 2, [], [], "MASK_SHOW_FIRST_4"), (4, 1, ["b"], [], "MASK_NONE")], who + ", mask_type string"
    )
    mapping = spark.createDataFrame([("principal", "g", "mapped"), ("principal", "a", "alias")], "mapping_type string, source_value string, target_value string")
    return tags, policies, filters, masks, mapping


def test_tags_decide_rows_and_columns(spark):
    tags, policies, filters, masks, mapping = relations(spark)
    rows = spark.range(10).select("id", F.lit("secret").alias("name"), F.lit("2024-02-03").alias("day"))
    seen = lambda who, table="db.t": enforce.apply_tag_row_filter(rows, tags, policies, filters, table, who, mapping).count()
    assert seen(Principal("alias")) == 2 and seen(Principal("x", ("mapped",))) == 2  # the last item with an expression, mapped names
    assert seen(Principal("a")) == seen(Principal("b")) == 10 and seen(Principal("alias"), "db.u") == 10
    shown = lambda who, table="db.t": enforce.apply_tag_mask(rows, tags, policies, masks, table, who, mapping).first()
    assert tuple(shown(Principal("x")))[1:] == ("secrXX", "2024-02-03")  # the last policy; one without a masking type masks nothing
    assert shown(Principal("a")).name == shown(Principal("x", ("mapped",))).name == "secret"  # users of tag masks keep their names
    assert shown(Principal("alias")).name == "secrXX" and shown(Principal("x"), "db.u").name == "secret"
    assert enforce.apply_tag_mask(rows, tags, policies, masks, "db.u", Principal("x")).columns == rows.columns


def test_a_closed_view_hides_rows_from_expressions_of_users(spark, tmp_path):
    data(spark).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    rules = [enforce.FilterRule("user", "u", "s = 'F'")]
    masks = [enforce.MaskRule("t", "MASK_REDACT")]
    view = enforce.secured_view(rows, "closed_rows", Principal("u"), rules, masks, closed=True)
    curious = view.filter(F.expr("IF(s <> 'F' OR s IS NULL, raise_error('seen ' || s), i > 0) AND t = '[REDACTED]'"))
    want = rows.filter("s = 'F' AND i > 0").count()
    assert curious.count() == want > 0
    plan = curious._jdf.queryExecution().toString()
    optimized = curious._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(k for k, line in enumerate(optimized) if "Generate" in line)
    assert any("raise_error" in line for line in optimized[:at]) and not any("raise_error" in line for line in optimized[at:])
    assert any("s#" in line and "= F" in line for line in optimized[at:]) and "EqualTo(s,F)" in plan
    assert view.columns == rows.columns and view.schema["t"].dataType.simpleString() == "string"
