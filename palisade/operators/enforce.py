"""Masks and row filters applied to data, for one principal or for many.

Principal tests are literals, so Catalyst folds them: only the branch that applies
is left in the plan and its filter still reaches the Parquet scan. A view is a barrier
for what users say of its rows only where it is made ``closed``; direct table access has to be closed in any case.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palisade.constants import MASK_SQL_TYPE_DEFAULT, MASK_SQL_TYPES
from palisade.functions.masks import RESOURCE_FALLBACK, TAG_FALLBACK, mask_expr, mask_sql, mask_type
from palisade.functions.once import computed_once
from palisade.operators.resources import resource_values, with_route
from palisade.operators.tags import tags_to_tables


@dataclass(frozen=True)
class Principal:
    user: str
    groups: tuple[str, ...] = ()


@dataclass(frozen=True)
class FilterRule:
    """``kind`` is 'user' or 'group'; ``predicate`` is SQL text over the data's columns."""

    kind: str
    name: str
    predicate: str


@dataclass(frozen=True)
class MaskRule:
    column: str
    kind: str
    pass_users: tuple[str, ...] = ()
    pass_groups: tuple[str, ...] = ()


def is_named(principal: Principal, kind: str, name: str) -> Column:
    if kind == "user":
        return F.lit(principal.user) == F.lit(name)
    return F.array_contains(F.array(*map(F.lit, principal.groups)).cast("array<string>"), name)


def apply_column_mask(
    df: DataFrame,
    column: str,
    kind: str,
    custom: Mapping[str, str] | None = None,
    fallback: str = RESOURCE_FALLBACK,
) -> DataFrame:
    """The result has the mask's SQL type, so a masked number turns into text."""
    return df.withColumn(column, mask_expr(column, kind, custom, fallback))


def masked_for(principal: Principal, rule: MaskRule, custom: Mapping[str, str] | None = None,
               fallback: str = RESOURCE_FALLBACK) -> Column:
    """Listed principals see the value, everybody else (listed or not) the mask."""
    sql_type = MASK_SQL_TYPES.get(mask_type(rule.kind, custom, fallback), MASK_SQL_TYPE_DEFAULT)
    tests = [is_named(principal, "user", u) for u in rule.pass_users]
    tests += [is_named(principal, "group", g) for g in rule.pass_groups]
    masked = mask_expr(rule.column, rule.kind, custom, fallback).cast(sql_type)
    for test in reversed(tests):
        masked = F.when(test, F.col(rule.column).cast(sql_type)).otherwise(masked)
    return masked


def apply_mask_for_principal(
    df: DataFrame, principal: Principal, rules: Sequence[MaskRule], custom: Mapping[str, str] | None = None
) -> DataFrame:
    return df.withColumns({r.column: masked_for(principal, r, custom) for r in rules})


def filter_condition(principal: Principal, rules: Sequence[FilterRule]) -> Column:
    """First matching rule decides; a principal without a rule sees every row."""
    decision = F.lit(True)
    for rule in reversed(rules):
        decision = F.when(is_named(principal, rule.kind, rule.name), F.expr(rule.predicate)).otherwise(decision)
    return decision


def apply_row_filter(df: DataFrame, principal: Principal, rules: Sequence[FilterRule]) -> DataFrame:
    return df.filter(filter_condition(principal, rules))


# --- tags decide: rules of one table, compiled from relations ----------------------------------


def _named() -> Column:
    """Array of (kind, name) in list order: users before groups."""
    one = lambda kind: F.transform(F.coalesce(kind + "s", F.array().cast("array<string>")), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    return F.concat(one("user"), one("group"))


def _mapped(names: Sequence, mapping: DataFrame | None) -> Callable[[str], str]:
    """Names as the catalog knows them; only the names in use are looked up."""
    if mapping is None or not names:
        return lambda name: name
    rows = mapping.filter((F.col("mapping_type") == "principal") & F.col("source_value").isin(sorted(names)))
    known = {r["source_value"]: r["target_value"] for r in rows.collect()}
    return lambda name: known.get(name, name)


def active_tag_filter(
    resource_tags: DataFrame, policies: DataFrame, filter_items: DataFrame, table: str
) -> DataFrame:
    """The one filter item of all tag policies that stays active on ``table``; no row where no tag of it is meant.

    Every item with an expression is attached in turn, policy by policy and item by item, and each replaces the one
    before it. Policies come in the order of their keys, items in list order.
    """
    meant = tags_to_tables(with_route(policies).filter("route = 'tag_access'"), resource_tags).filter(F.col("table_key") == table)
    used = filter_items.filter("filter_expr <> ''").join(meant.select("policy_key"), "policy_key")
    last = F.max_by(F.struct("policy_key", "item_pos", "users", "groups", "filter_expr"), F.struct("policy_key", "item_pos"))
    return used.agg(last.alias("item")).filter("item IS NOT NULL").select("item.*")


def compile_tag_filter(
    resource_tags: DataFrame, policies: DataFrame, filter_items: DataFrame, table: str, principal: Principal,
    mapping: DataFrame | None = None,
) -> Column | None:
    """The condition of ``table`` for one principal, or None where no tag policy reaches it."""
    item = active_tag_filter(resource_tags, policies, filter_items, table).first()
    if item is None:
        return None
    named = [("user", n) for n in item["users"] or []] + [("group", n) for n in item["groups"] or []]
    mapped = _mapped({n for _, n in named}, mapping)
    rules = [FilterRule(kind, mapped(n), item["filter_expr"]) for kind, n in named]
    return filter_condition(principal, rules) if rules else F.expr(item["filter_expr"])


def apply_tag_row_filter(
    df: DataFrame, resource_tags: DataFrame, policies: DataFrame, filter_items: DataFrame, table: str, principal: Principal,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Filter ``df``, the rows of ``table``, where the table or one of its columns carries a tag of a policy with row filters."""
    condition = compile_tag_filter(resource_tags, policies, filter_items, table, principal, mapping)
    return df if condition is None else df.filter(condition)


def active_tag_masks(
    resource_tags: DataFrame, policies: DataFrame, mask_items: DataFrame, table: str, columns: Sequence[str]
) -> DataFrame:
    """(column, mask_type, users, groups) of the last tag mask policy on each tagged column of ``table``.

    A policy masks by its first type that masks; ``users`` and ``groups`` are those it lets see the value. Policies
    without such a type mask nothing.
    """
    meant = with_route(policies).filter("route = 'tag_mask'").select("policy_key", "scope", F.get(resource_values("tag"), F.lit(0)).alias("tag"))
    paths = resource_tags.filter(F.col("path").isin([f"{table}.{c}" for c in columns]))
    reached = paths.select("scope", "tag", F.substring_index("path", ".", -1).alias("column")).distinct().join(meant, ["scope", "tag"])
    real = F.when((F.col("mask_type") != "MASK_NONE") & (F.col("mask_type") != ""), F.col("item_pos"))
    kinds = mask_items.join(reached.select("policy_key").distinct(), "policy_key", "left_semi").groupBy("policy_key").agg(
        F.min_by(F.when(real.isNotNull(), F.col("mask_type")), real).alias("mask_type")
    )
    last = reached.join(kinds.filter("mask_type IS NOT NULL"), "policy_key").groupBy("column").agg(
        F.max_by(F.struct("policy_key", "mask_type"), "policy_key").alias("p")
    )
    last = last.select("column", "p.policy_key", "p.mask_type")
    open_to = mask_items.filter("mask_type = 'MASK_NONE'").select("policy_key", F.explode(_named()).alias("who"))
    open_to = open_to.join(last.select("policy_key"), "policy_key", "left_semi").groupBy("policy_key").agg(F.collect_set("who").alias("who"))
    return last.join(open_to, "policy_key", "left").select("column", "mask_type", F.coalesce("who", F.array().cast("array<struct<kind: string, name: string>>")).alias("who"))


def compile_tag_masks(
    resource_tags: DataFrame, policies: DataFrame, mask_items: DataFrame, table: str, columns: Sequence[str],
    mapping: DataFrame | None = None,
) -> list[MaskRule]:
    """At most one rule per column of ``table``. Users of tag masks keep their own names, groups are mapped."""
    rows = active_tag_masks(resource_tags, policies, mask_items, table, columns).collect()
    mapped = _mapped({w["name"] for r in rows for w in r["who"] if w["kind"] == "group"}, mapping)
    of = lambda r, kind, name: tuple(sorted(name(w["name"]) for w in r["who"] if w["kind"] == kind))
    return [MaskRule(r["column"], r["mask_type"], of(r, "user", str), of(r, "group", mapped)) for r in rows]


def apply_tag_mask(
    df: DataFrame, resource_tags: DataFrame, policies: DataFrame, mask_items: DataFrame, table: str, principal: Principal,
    mapping: DataFrame | None = None,
) -> DataFrame:
    """Mask every column of ``table`` that carries the tag of a tag mask policy, in one projection."""
    rules = compile_tag_masks(resource_tags, policies, mask_items, table, df.columns, mapping)
    masked = {r.column: masked_for(principal, r, fallback=TAG_FALLBACK) for r in rules}
    return df.select(*[masked[c].alias(c) if c in masked else F.col(c) for c in df.columns])


def barrier(df: DataFrame) -> DataFrame:
    """The same rows, with nothing that is said of them later moving below this point.

    Columns leave through a one-row generate, and a filter on generated columns stays above it. What is below, such
    as a policy's own filter, still reaches the scan.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def secured_view(
    df: DataFrame, name: str, principal: Principal, filters: Sequence[FilterRule], masks: Sequence[MaskRule], closed: bool = False
) -> DataFrame:
    """Filter on real values, then mask, as a temporary view.

    ``closed`` puts a barrier around it: expressions of users never see a hidden row, for the price that their own filters
    do not reach the scan.
    """
    secured = apply_mask_for_principal(apply_row_filter(df, principal, filters), principal, masks)
    secured = barrier(secured) if closed else secured
    secured.createOrReplaceTempView(name)
    return secured


# --- many principals -----------------------------------------------------------------------

#: Predicates of no indexed form that are counted in one pass over the data.
PREDICATES_PER_PASS = 200
#: Rows of the index up to which it is sent to every task; beyond, data and index meet in a shuffle.
BROADCAST_KEYS = 100_000
_WHOLE = "*"
_CONJUNCT = r"(?i)^\s*([a-z_][a-z0-9_]*(?:\s*%\s*[1-9][0-9]{0,8})?)\s*(=|>=|<=|>|<|IN\b)\s*(-?[0-9]{1,15}|'[^']*'|\(.*\))\s*$"
_LISTED = r"(?i)^\(\s*(?:'[^']*'(?:\s*,\s*'[^']*')*|-?[0-9]{1,15}(?:\s*,\s*-?[0-9]{1,15})*)\s*\)$"


def predicate_index(predicates: DataFrame) -> DataFrame:
    """(predicate, shape, key, bound) of SQL predicates that compare columns with values; NULL shape for all others.

    A predicate of equalities and IN (one list at most) and at most one comparison, joined by AND, is indexed. Its ``shape`` is
    a struct (terms, kinds, ranged, op): the terms compared for equality in name order, whether their values are texts,
    and the term and operator of the comparison. ``key`` holds the values, a row for each value of a list; ``bound`` is the
    number compared with. A term is a column or a column modulo a number.
    """
    pieces = F.split("predicate", r"(?i)\s+AND\s+")
    part = lambda c, i: F.regexp_extract(c, _CONJUNCT, i)

    def parsed(c: Column) -> Column:
        raw = part(c, 3)
        items = F.when(F.startswith(raw, F.lit("(")), F.regexp_extract_all(raw, F.lit("('[^']*'|-?[0-9]+)"), F.lit(1))).otherwise(F.array(raw))
        kinds = F.startswith(F.get(items, F.lit(0)), F.lit("'"))
        clean = F.transform(items, lambda v: F.when(kinds, F.substring_index(F.substr(v, F.lit(2)), "'", 1)).otherwise(v.cast("bigint").cast("string")))
        op = F.upper(part(c, 2))
        term = F.lower(F.regexp_replace(part(c, 1), r"\s", ""))
        return F.struct(term.alias("term"), F.when(op == "IN", "=").otherwise(op).alias("op"), kinds.alias("text"), F.array_distinct(clean).alias("items"))

    fits = F.forall(pieces, lambda c: F.rlike(c, F.lit(_CONJUNCT)) & ((~F.startswith(part(c, 3), F.lit("("))) | (F.rlike(part(c, 3), F.lit(_LISTED)) & (F.upper(part(c, 2)) == "IN"))))
    fits = fits & F.forall(pieces, lambda c: (F.upper(part(c, 2)) != "IN") | F.startswith(part(c, 3), F.lit("(")))
    rows = computed_once(predicates.select("predicate").distinct(), parts=F.when(fits, F.array_sort(F.transform(pieces, parsed))))
    same = F.filter("parts", lambda p: p["op"] == "=")
    ranged = F.filter("parts", lambda p: p["op"] != "=")
    usable = (
        (F.size(ranged) <= 1) & (F.size(F.array_distinct(F.transform(same, lambda p: p["term"]))) == F.size(same))
        & (F.size(F.filter(same, lambda p: F.size(p["items"]) > 1)) <= 1) & ~F.exists(ranged, lambda p: p["text"])
    )
    shape = F.struct(
        F.transform(same, lambda p: p["term"]).alias("terms"), F.transform(same, lambda p: p["text"]).alias("kinds"),
        F.get(ranged, F.lit(0))["term"].alias("ranged"), F.get(ranged, F.lit(0))["op"].alias("op"),
    )
    lists = F.filter(same, lambda p: F.size(p["items"]) > 1)
    choices = F.coalesce(F.get(lists, F.lit(0))["items"], F.array(F.lit("")))
    keys = F.transform(choices, lambda v: F.transform(same, lambda p: F.when(F.size(p["items"]) > 1, v).otherwise(F.get(p["items"], F.lit(0)))))
    rows = computed_once(rows, shape=F.when(F.coalesce(usable, F.lit(False)), shape), keys=keys)
    return rows.select(
        "predicate", "shape", F.explode_outer(F.when(F.col("shape").isNotNull(), F.col("keys"))).alias("key"),
        F.get(F.get(ranged, F.lit(0))["items"], F.lit(0)).try_cast("double").alias("bound"),
    )


def _readable(data: DataFrame, shape) -> Column | None:
    """(key, x) of a data row for a shape, or None where the columns or their types are not those of the values."""
    whole, numbers = {"tinyint", "smallint", "int", "bigint"}, {"float", "double"}
    known = {f.name.lower(): f.dataType.simpleString() for f in data.schema}

    def kind(term: str) -> str:
        name, _, by = term.partition("%")
        return "" if by and known.get(name) not in whole else known.get(name, "")

    fits = all(kind(t) == "string" if text else kind(t) in whole for t, text in zip(shape["terms"], shape["kinds"]))
    if not fits or (shape["ranged"] and kind(shape["ranged"]) not in whole | numbers):
        return None
    key = F.array(*[F.expr(t).cast("string") for t in shape["terms"]]).cast("array<string>")
    x = F.expr(shape["ranged"]).cast("double") if shape["ranged"] else F.lit(None).cast("double")
    kept = ~F.exists(key, lambda v: v.isNull())
    if shape["ranged"]:
        # NaN is above every number.
        kept = kept & x.isNotNull() & (F.lit(not shape["op"].startswith("<")) | ~F.isnan(x))
    return F.when(kept, F.struct(key.alias("key"), (-x if (shape["op"] or "").startswith("<") else x).alias("x")))


def _index_counts(data: DataFrame, index: DataFrame, shapes: list) -> DataFrame:
    """(predicate, visible) of indexed predicates from one scan of ``data``; the NULL predicate counts all rows.

    Bounds of one key are an ascending list, so a row counts once for its key, at the last bound it passes; a
    running sum over the bounds gives the rest.
    """
    texts = [r["name"] for r in shapes]
    found = [_readable(data, r["shape"]) for r in shapes]
    place = F.struct(F.lit(_WHOLE).alias("shape"), F.array().cast("array<string>").alias("key"), F.lit(None).cast("double").alias("x"))
    places = [F.when(f.isNotNull(), F.struct(F.lit(t).alias("shape"), f["key"].alias("key"), f["x"].alias("x"))) for t, f in zip(texts, found)]
    rows = data.select(F.inline(F.array_compact(F.array(place, *places))))
    lower = F.col("shape.op").startswith("<")
    bound = F.when(F.coalesce(lower, F.lit(False)), -F.col("bound")).otherwise(F.col("bound"))
    keyed = index.select(
        F.to_json("shape").alias("shape"), "key", F.coalesce(F.endswith("shape.op", F.lit("=")), F.lit(False)).alias("touching"),
        F.struct(bound.alias("bound"), "predicate").alias("p"),
    )
    every = data.sparkSession.range(1).select(
        F.lit(_WHOLE).alias("shape"), F.array().cast("array<string>").alias("key"), F.lit(False).alias("touching"),
        F.struct(F.lit(None).cast("double").alias("bound"), F.lit(None).cast("string").alias("predicate")).alias("p"),
    )
    keyed = keyed.unionByName(every).groupBy("shape", "key", "touching").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    keyed = keyed.withColumn("bounds", F.col("ps.bound"))
    known = F.broadcast(keyed) if sum(r["keys"] for r in shapes) <= BROADCAST_KEYS else keyed
    x = F.col("x")
    passed = F.when(x.isNull(), F.size("bounds")).otherwise(
        F.size(F.filter("bounds", lambda b: F.when(F.col("touching"), b <= x).otherwise(b < x)))
    )
    met = rows.join(known.select("shape", "key", "touching", "bounds"), ["shape", "key"])
    met = met.groupBy("shape", "key", "touching", passed.alias("pos")).agg(F.count(F.lit(1)).alias("n"))
    listed = keyed.select("shape", "key", "touching", F.posexplode("ps").alias("pos", "p"))
    listed = listed.select("shape", "key", "touching", F.col("pos") + 1, F.lit(0).cast("bigint"), F.lit(True), "p.predicate").toDF(
        "shape", "key", "touching", "pos", "n", "listed", "predicate"
    )
    both = listed.unionByName(met.withColumns({"listed": F.lit(False), "predicate": F.lit(None).cast("string")}))
    # One key's bounds and the counts between them.
    later = Window.partitionBy("shape", "key", "touching").orderBy(F.desc("pos")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("n", F.sum("n").over(later)).filter("listed").groupBy("predicate").agg(F.sum("n").cast("bigint").alias("visible"))


def rows_visible_per_principal(principals: DataFrame, rules: DataFrame, data: DataFrame) -> DataFrame:
    """(user_name, visible) without joining principals to data.

    ``principals`` is (user_name, groups), ``rules`` a table of (rule_pos, kind, name, predicate): principals
    are joined to the rules that name them, and the first one decides; without a rule every row is visible.
    Predicates of the indexed forms are counted in one scan of the data, however many they are. What the driver learns of
    them is their shapes, which follow from the data's columns. Texts of other forms become part of the plan.
    """
    mine = F.array(F.struct(F.lit("user").alias("kind"), F.col("user_name").alias("name")))
    groups = F.transform("groups", lambda g: F.struct(F.lit("group").alias("kind"), g.alias("name")))
    named = principals.select("user_name", F.explode(F.concat(mine, F.coalesce(groups, mine))).alias("p"))
    hit = named.select("user_name", "p.kind", "p.name").distinct().join(rules, ["kind", "name"])
    first = hit.groupBy("user_name").agg(F.min(F.struct("rule_pos", "predicate")).alias("rule"))
    decided = principals.join(first, "user_name", "left").select("user_name", F.col("rule.predicate").alias("predicate"))
    index = predicate_index(rules)
    shaped = index.groupBy(F.to_json("shape").alias("name"), "shape").agg(F.count(F.lit(1)).alias("keys")).collect()
    shapes = [r for r in shaped if r["shape"] is not None and _readable(data, r["shape"]) is not None]
    in_index = F.to_json("shape").isin([r["name"] for r in shapes]) if shapes else F.lit(False)
    counts = _index_counts(data, index.filter(in_index), shapes)
    if len(shapes) < len(shaped):
        texts = sorted(r["predicate"] for r in index.filter(~F.coalesce(in_index, F.lit(False))).select("predicate").distinct().collect())
        for at in range(0, len(texts), PREDICATES_PER_PASS):
            part = texts[at : at + PREDICATES_PER_PASS]
            row = data.agg(*[F.count_if(F.expr(text)).alias(f"b{i}") for i, text in enumerate(part)])
            pairs = F.array(*[F.struct(F.lit(text).alias("predicate"), F.col(f"b{i}").alias("visible")) for i, text in enumerate(part)])
            counts = counts.unionByName(row.select(F.inline(pairs)))
    found = decided["predicate"].eqNullSafe(counts["predicate"])
    return decided.join(counts, found).select("user_name", "visible")


# --- SQL functions ----------------------------------------------------------------------


def register_mask_functions(
    spark: SparkSession, kinds: Sequence[str], custom: Mapping[str, str] | None = None, prefix: str = "fn_"
) -> dict[str, str]:
    """One temporary SQL function per mask type; Spark inlines them into the plan."""
    names = {}
    for kind in kinds:
        sql_type = MASK_SQL_TYPES.get(mask_type(kind, custom), MASK_SQL_TYPE_DEFAULT)
        names[kind] = prefix + kind.lower()
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {names[kind]}(x {sql_type}) "
            f"RETURNS {sql_type} RETURN {mask_sql(kind, 'x', custom)}"
        )
    return names


def register_filter_function(
    spark: SparkSession, name: str, columns: Sequence[str], principal: Principal, rules: Sequence[FilterRule]
) -> None:
    """A row filter as a temporary SQL function for one principal; parameters are text."""
    decision = "TRUE"
    for rule in rules:
        mine = rule.name == principal.user if rule.kind == "user" else rule.name in principal.groups
        if mine:
            decision = rule.predicate
            break
    parameters = ", ".join(f"{c} STRING" for c in columns)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS BOOLEAN RETURN {decision}")
