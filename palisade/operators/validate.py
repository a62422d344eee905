"""Structural findings on exports and policies, and lint of statement text.

A finding is a row; verdicts and totals are aggregates over findings. JSON types
come from VARIANT, where a missing key is SQL NULL and a JSON null is not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from palisade import constants as C
from palisade.functions.once import computed_once
from palisade.functions.text import strip
from palisade.sources.documents import with_root_keys

FINDINGS = (
    "array<struct<check: int, list: string, item_pos: int, step: int, rule: string, severity: string, message: string>>"
)


def _finding(rule: str, severity: str, message: Column | str, when: Column) -> Column:
    text = F.lit(message) if isinstance(message, str) else message
    row = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), text.alias("message"))
    return F.when(F.coalesce(when, F.lit(False)), row)


def _has(keys: str, name: str) -> Column:
    return F.coalesce(F.array_contains(keys, name), F.lit(False))


def _get(value: Column | str, path: str, as_type: str = "variant") -> Column:
    return F.try_variant_get(value, path, as_type)


def _kind(value: Column | str, path: str) -> Column:
    return F.schema_of_variant(_get(value, path))


def _is_array(value: Column | str, path: str) -> Column:
    return _kind(value, path).startswith("ARRAY")


def _is_object(value: Column | str, path: str) -> Column:
    return _kind(value, path).startswith("OBJECT")


def _filled(value: Column | str, path: str) -> Column:
    """Truthy in the sense of a script: present, not null, not empty, not false or 0."""
    kind = _kind(value, path)
    listed = F.size(_get(value, path, "array<variant>"))
    return (
        F.when(kind.startswith("ARRAY"), listed > 0)
        .when(kind.startswith("OBJECT"), F.size(_get(value, path, "map<string,variant>")) > 0)
        .when(kind == "VOID", F.lit(False))
        .otherwise(F.coalesce(~_get(value, path, "string").isin("", "0", "false"), F.lit(False)))
    )


# --- envelope ------------------------------------------------------------------------


def _with_envelope(docs: DataFrame) -> DataFrame:
    """(source, envelope): the findings about the shape of each export as an array."""
    rooted = computed_once(
        with_root_keys(docs).filter("keys IS NOT NULL"),
        policies_text=F.from_json("json", "policies STRING")["policies"],
    )
    deltas = _has("keys", "policyDeltas") & ~_has("keys", "policies")
    cases = ~deltas & _has("keys", "testCases")
    usual = ~deltas & ~_has("keys", "testCases")
    side = detected_keys(F.col("keys"))
    nothing = ~_has("keys", "policies") & ~_has("keys", "tagPolicyInfo")
    findings = F.array(
        _finding("deltas", "W", "Detected incremental update format ('policyDeltas'). "
                 "Policies will be extracted from each delta's 'policy' field.", deltas),
        _finding("zones", "W", "Detected 'securityZones' in this file. Security zone boundaries have no "
                 "direct Unity Catalog equivalent — policies will be translated ignoring zone scope.",
                 ~deltas & _has("keys", "securityZones")),
        _finding("test_cases", "W", "Detected ACL provider test format ('testCases' key). "
                 "Policies will be extracted from each testCase's servicePolicies block.", cases),
        _finding("side_keys", "W", F.concat(
            F.lit("Detected Ranger test file format (keys: "), F.array_join(side, ", "),
            F.lit("). serviceDef and tests sections will be ignored — only 'policies' will be translated.")),
            usual & (F.size(side) > 0)),
        _finding("tag_info", "W", "Detected 'tagPolicyInfo' section. Tag-based policies will be extracted "
                 "and translated.", usual & _has("keys", "tagPolicyInfo")),
        _finding("no_policies", "E", "Export JSON missing 'policies' field. Expected format: "
                 "{\"policies\": [...]}", usual & nothing),
        _finding("policies_type", "E", "'policies' field must be a list",
                 usual & _has("keys", "policies") & ~F.coalesce(F.col("policies_text").startswith("["), F.lit(False))),
    )
    return rooted.select("source", F.array_compact(findings).alias("envelope"))


def envelope_findings(docs: DataFrame) -> DataFrame:
    """(source, rule, severity, message) about the shape of each export."""
    return _with_envelope(docs).select("source", F.inline("envelope"))


def detected_keys(keys: Column) -> Column:
    """Known side keys that are present, in name order."""
    return F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, C.SIDE_KEYS))))


def exported_policies(docs: DataFrame) -> DataFrame:
    """(source, idx, policy_json, root_service): the list the validator walks.

    It differs from the parser's: a root that is itself a policy is not read, and in
    test cases a list under ``tagPolicies`` is.
    """
    text = "ARRAY<STRING>"
    root = F.from_json("json", "serviceName STRING, policies ARRAY<STRING>, "
                       "tagPolicyInfo STRUCT<tagPolicies: ARRAY<STRING>>, "
                       "policyDeltas ARRAY<STRUCT<policy: STRING>>, "
                       "testCases ARRAY<STRUCT<servicePolicies: STRUCT<serviceName: STRING, "
                       "policies: ARRAY<STRING>, tagPolicies: STRING>>>")
    empty = F.array().cast(text)

    def case_policies(case: Column) -> Column:
        block = case["servicePolicies"]
        tags = block["tagPolicies"]
        nested = F.coalesce(F.from_json(tags, f"policies {text}")["policies"], F.from_json(tags, text), empty)
        return F.concat(F.coalesce(block["policies"], empty), nested)

    names = F.filter(F.transform("root.testCases", lambda c: c["servicePolicies"]["serviceName"]), lambda n: n.isNotNull())
    deltas = _has("keys", "policyDeltas") & ~_has("keys", "policies")
    cases = _has("keys", "testCases")
    listed = F.coalesce(F.from_json("json", "policies STRING")["policies"].startswith("["), F.lit(True))
    policies = (
        F.when(deltas, F.filter(F.col("root.policyDeltas.policy"), lambda p: p.isNotNull()))
        .when(cases, F.flatten(F.transform("root.testCases", case_policies)))
        .when(
            listed,
            F.concat(F.coalesce("root.policies", empty), F.coalesce("root.tagPolicyInfo.tagPolicies", empty)),
        )
        .otherwise(empty)
    )
    service = F.when(cases & ~deltas, F.try_element_at(names, F.lit(-1))).otherwise(F.col("root.serviceName"))
    roots = computed_once(with_root_keys(docs).filter("keys IS NOT NULL"), root=root)
    return roots.select("source", service.alias("root_service"), F.posexplode(policies).alias("idx", "policy_json"))


# --- policies -------------------------------------------------------------------------


def with_variant(policies: DataFrame) -> DataFrame:
    """Adds ``v`` and the name findings are listed under."""
    named = F.when(_get("v", "$.name").isNull(), F.concat(F.lit("Policy_"), F.col("idx").cast("string"))).otherwise(
        F.coalesce(_get("v", "$.name", "string"), F.lit("None"))
    )
    parsed = computed_once(policies, v=F.expr("try_parse_json(policy_json)"))
    return parsed.withColumn("policy_name", named)


KEYS = ("source", "idx", "policy_name")
#: Where the lists after policyItems and the check for no items stand in the order of checks.
_LATER, _LAST = 8, 12


def _placed(findings: list[Column], check: int, which: str | None = None, item_pos: Column | None = None, step: int | None = None) -> Column:
    """Those of ``findings`` that hold, each with its place: (check, list, item_pos, step)."""
    pos = F.lit(0) if item_pos is None else item_pos
    return F.transform(
        F.array_compact(F.array(*findings)),
        lambda f, i: F.struct(
            F.lit(check).alias("check"), F.lit(which).cast("string").alias("list"), pos.cast("int").alias("item_pos"),
            (i if step is None else F.lit(step)).cast("int").alias("step"),
            f["rule"].alias("rule"), f["severity"].alias("severity"), f["message"].alias("message"),
        ),
    )


def _together(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array().cast(FINDINGS)) for a in arrays])


def required_fields() -> Column:
    inherited = F.coalesce(F.length("root_service") > 0, F.lit(False))

    def missing(name: str) -> Column:
        gone = _get("v", f"$.{name}").isNull()
        return _finding("required", "E", f"Missing required field: {name}", gone & ~inherited if name == "service" else gone)

    return _placed([missing(n) for n in ("id", "name", "service", "resources")], 0)


def id_type() -> Column:
    kind = _kind("v", "$.id")
    name = (
        F.when(kind == "STRING", F.lit("str")).when(kind == "VOID", F.lit("NoneType"))
        .when(kind.startswith("ARRAY"), F.lit("list")).when(kind.startswith("OBJECT"), F.lit("dict"))
        .otherwise(F.lit("float"))
    )
    whole = kind.isin("BIGINT", "BOOLEAN") | kind.rlike(r"^DECIMAL\([0-9]+,0\)$")
    message = F.concat(F.lit("Policy ID must be integer, got <class '"), name, F.lit("'>"))
    return _placed([_finding("id_type", "E", message, ~whole)], 1)


def name_text() -> Column:
    bad = _get("v", "$.name").isNotNull() & ((_kind("v", "$.name") != "STRING") | (_get("v", "$.name", "string") == ""))
    return _placed([_finding("name", "E", "Policy name must be non-empty string", bad)], 2)


def resources() -> Column:
    present, filled = _get("v", "$.resources").isNotNull(), _filled("v", "$.resources")
    none = _placed([_finding("resources_empty", "E", "Resources section is empty", present & ~filled)], 3)

    def entry(e: Column) -> Column:
        r = e["value"]

        def named(text: str) -> Column:
            return F.concat(F.lit("Resource '"), e["key"], F.lit("'" + text))

        is_object, listed = _is_object(r, "$"), _is_array(r, "$.values")
        values, count = _get(r, "$.values"), F.size(_get(r, "$.values", "array<variant>"))
        return _placed(
            [
                _finding("resource_type", "E", named(" must be a dictionary"), ~is_object),
                _finding("values_missing", "E", named(" missing 'values' field"), is_object & values.isNull()),
                _finding("values_type", "E", named(" values must be a list"), is_object & values.isNotNull() & ~listed),
                _finding("values_empty", "W", named(" has empty values list"), is_object & listed & (count == 0)),
            ],
            3,
        )

    entries = F.map_entries(_get("v", "$.resources", "map<string,variant>"))
    return _together(none, F.when(present & filled, F.flatten(F.transform(entries, entry))))


def _item_list(name: str, check: int, label: str, findings: Callable[[Column, Column], list[Column]], wrong: str | None = None,
               more: Callable[[Column, Column], Column] | None = None) -> Column:
    """Findings of one item list: its type, then item by item."""
    present, listed = _get("v", f"$.{name}").isNotNull(), _is_array("v", f"$.{name}")
    bad = _placed([_finding("list_type", "E", f"{wrong or name} must be a list", present & ~listed)], check, name, F.lit(-1))

    def one(item: Column, pos: Column) -> Column:
        def text(words: str) -> Column:
            return F.concat(F.lit(label + " "), pos.cast("string"), F.lit(" " + words))

        principals = [_filled(item, f"$.{kind}") for kind in ("users", "groups", "roles")]
        nobody = ~(F.coalesce(principals[0], F.lit(False)) | F.coalesce(principals[1], F.lit(False)) | F.coalesce(principals[2], F.lit(False)))
        first = _finding("principals", "W", text("has no users, groups, or roles"), nobody)
        own = _placed([first, *findings(item, text)], check, name, pos)
        return own if more is None else _together(own, more(item, pos))

    items = F.transform(_get("v", f"$.{name}", "array<variant>"), one)
    return _together(bad, F.when(listed, F.flatten(items)))


def access_items() -> Column:
    """All four access lists."""
    label = "Policy item"

    def findings(item: Column, text) -> list[Column]:
        accesses, listed = _get(item, "$.accesses"), _is_array(item, "$.accesses")
        count = F.size(_get(item, "$.accesses", "array<variant>"))
        return [
            _finding("accesses_missing", "W", text("has no 'accesses' field (audit-only policy item)"), accesses.isNull()),
            _finding("accesses_type", "E", text("accesses must be a list"), accesses.isNotNull() & ~listed),
            _finding("accesses_empty", "W", text("has empty accesses list (audit-only policy item)"), listed & (count == 0)),
        ]

    def one_list(at: int, name: str) -> Column:
        # The lists after policyItems are looked at once filters and masks are done.
        check = _LATER + at if at else 4

        def untyped(item: Column, pos: Column) -> Column:
            message = F.concat(F.lit(label + " "), pos.cast("string"), F.lit(" access missing 'type'"))
            each = F.transform(
                _get(item, "$.accesses", "array<variant>"),
                lambda a: _placed([_finding("access_type", "E", message, _get(a, "$.type").isNull())], check, name, pos, step=2),
            )
            return F.flatten(each)

        return _item_list(name, check, label, findings, "policyItems", untyped)

    return _together(*[one_list(at, name) for at, name in enumerate(C.ITEM_LISTS)])


def filter_items() -> Column:
    def findings(item: Column, text) -> list[Column]:
        info, expression = _get(item, "$.rowFilterInfo"), _get(item, "$.rowFilterInfo.filterExpr")
        return [
            _finding("info_missing", "E", text("missing 'rowFilterInfo'"), info.isNull()),
            _finding("filter_missing", "E", text("missing filter expression"), info.isNotNull() & expression.isNull()),
            _finding("filter_empty", "E", text("has empty filter expression"),
                     expression.isNotNull() & ~_filled(item, "$.rowFilterInfo.filterExpr")),
        ]

    return _item_list("rowFilterPolicyItems", 5, "Row filter item", findings)


def mask_items() -> Column:
    def findings(item: Column, text) -> list[Column]:
        info, kind = _get(item, "$.dataMaskInfo"), _get(item, "$.dataMaskInfo.dataMaskType")
        value = F.coalesce(_get(item, "$.dataMaskInfo.dataMaskType", "string"), F.lit("None"))
        return [
            _finding("info_missing", "E", text("missing 'dataMaskInfo'"), info.isNull()),
            _finding("mask_missing", "E", text("missing mask type"), info.isNotNull() & kind.isNull()),
            _finding("mask_unknown", "W", F.concat(text("has unknown mask type: "), value),
                     kind.isNotNull() & ~value.isin(*C.KNOWN_MASK_TYPES)),
        ]

    return _item_list("dataMaskPolicyItems", 6, "Masking item", findings)


def no_items() -> Column:
    nothing = F.lit(True)
    for name in [*C.ITEM_LISTS, "rowFilterPolicyItems", "dataMaskPolicyItems"]:
        nothing = nothing & _get("v", f"$.{name}").isNull()
    return _placed([_finding("no_items", "W", "Policy has no policy items (no permissions defined)", nothing)], _LAST)


def check_findings(policies: DataFrame, check: Column) -> DataFrame:
    """Rows of one check above: KEYS, check, list, item_pos, step, rule, severity, message."""
    return policies.select(*KEYS, F.inline(check))


def with_findings(policies: DataFrame) -> DataFrame:
    """KEYS and ``findings``: all findings of a policy as one array, made in one pass over its row."""
    checks = [required_fields(), id_type(), name_text(), resources(), access_items(), filter_items(), mask_items(), no_items()]
    return computed_once(policies.select(*KEYS, "root_service", "v"), findings=_together(*checks)).select(*KEYS, "findings")


def policy_findings(policies: DataFrame) -> DataFrame:
    """Every policy-level finding; (idx, check, item_pos, step) is the order they are met in."""
    return with_findings(policies).select(*KEYS, F.inline("findings"))


def _count(array: str, severity: str) -> Column:
    return F.size(F.filter(array, lambda f: f["severity"] == severity)).cast("bigint")


def export_findings(docs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """(source, severity, message): envelope findings, empty exports, and policy findings
    under ``[name]``. ``policies`` may pass in the parsed policies of these files from a
    written table."""
    if policies is None:
        policies = with_variant(exported_policies(docs))
    inner = policy_findings(policies).select(
        "source", "severity", F.concat(F.lit("["), "policy_name", F.lit("] "), "message").alias("message")
    )
    empty = _export_counts(docs, policies).filter("empty").select(
        "source", F.lit("W").alias("severity"), F.lit("Export contains no policies").alias("message")
    )
    return inner.unionByName(envelope_findings(docs).select("source", "severity", "message")).unionByName(empty)


def _export_counts(docs: DataFrame, policies: DataFrame) -> DataFrame:
    """(source, errors, warnings, empty) per export, from counts per file and per policy in one aggregate."""
    zero = F.lit(0).cast("bigint")
    files = _with_envelope(docs).select(
        "source", _count("envelope", "E").alias("refused"), _count("envelope", "E").alias("e"), _count("envelope", "W").alias("w"),
        zero.alias("policies"), F.lit(1).cast("bigint").alias("files"),
    )
    each = with_findings(policies).select(
        "source", zero.alias("refused"), _count("findings", "E").alias("e"), _count("findings", "W").alias("w"),
        F.lit(1).cast("bigint").alias("policies"), zero.alias("files"),
    )
    sums = files.unionByName(each).groupBy("source").agg(*[F.sum(c).alias(c) for c in ("refused", "e", "w", "policies", "files")])
    empty = (F.col("policies") == 0) & (F.col("refused") == 0)
    return sums.filter("files > 0").select(
        "source", F.col("e").alias("errors"), (F.col("w") + empty.cast("bigint")).alias("warnings"), empty.alias("empty")
    )


def validation_verdict(docs: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """(source, is_valid, errors, warnings) per export."""
    if policies is None:
        policies = with_variant(exported_policies(docs))
    counts = _export_counts(docs, policies)
    return counts.select("source", (F.col("errors") == 0).alias("is_valid"), "errors", "warnings")


def policy_verdicts(policies: DataFrame) -> DataFrame:
    """(source, idx, policy_name, errors, warnings), policies without findings included."""
    return with_findings(policies).select(*KEYS, _count("findings", "E").alias("errors"), _count("findings", "W").alias("warnings"))


def validation_totals(verdicts: DataFrame) -> DataFrame:
    """One row; the shares are NULL when there is nothing to share."""
    total, valid = F.count(F.lit(1)), F.count_if(F.col("errors") == 0)
    row = verdicts.agg(
        total.alias("total"), valid.alias("valid"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("total_errors"),
        F.coalesce(F.sum("warnings"), F.lit(0)).alias("total_warnings"),
    )
    share = F.when(F.col("total") > 0, F.round(F.col("valid") * 1000 / F.col("total")) / 10)
    return row.select(
        "total", "valid", (F.col("total") - F.col("valid")).alias("invalid"),
        F.format_string("%.1f%%", share).alias("valid_share"),
        F.format_string("%.1f%%", 100 - share).alias("invalid_share"),
        "total_errors", "total_warnings",
    )


def validation_details(policies: DataFrame) -> DataFrame:
    """Findings of the policies that have at least one error."""
    invalid = with_findings(policies).filter(F.exists("findings", lambda f: f["severity"] == "E"))
    return invalid.select(*KEYS, F.inline("findings"))


# --- lint of statement text -----------------------------------------------------------------


def statement_kind(sql: Column) -> Column:
    text = F.upper(strip(sql))
    return (
        F.when(F.coalesce(text, F.lit("")) == "", F.lit("empty"))
        .when(text.startswith("GRANT"), F.lit("grant"))
        .when(text.startswith("CREATE OR REPLACE FUNCTION"), F.lit("function"))
        .when(text.startswith("ALTER TABLE"), F.lit("alter"))
        .when(text.startswith("CREATE TAG"), F.lit("tag"))
        .otherwise(F.lit("unknown"))
    )


def granted_privilege(sql: Column) -> Column:
    after = F.get(F.split(F.upper(sql), "GRANT"), F.lit(1))
    return strip(F.get(F.split(after, "ON"), F.lit(0)))


def lint_rules(sql: Column) -> dict[str, list[Column]]:
    kind, text = statement_kind(sql), F.upper(sql)
    grant, function, alter, tag = (kind == k for k in ("grant", "function", "alter", "tag"))
    return {
        "kind": [
            _finding("empty", "E", "SQL statement is empty", kind == "empty"),
            _finding("unknown", "W", F.concat(F.lit("Unknown SQL statement type: "), F.substring(sql, 1, 30), F.lit("...")),
                     kind == "unknown"),
        ],
        "grant": [
            _finding("grant_to", "E", "GRANT statement missing TO clause", grant & ~text.contains(" TO ")),
            _finding("grant_on", "E", "GRANT statement missing ON clause", grant & ~text.contains(" ON ")),
            _finding("grant_privilege", "W",
                     F.concat(F.lit("Potentially invalid privilege: "), granted_privilege(sql)),
                     grant & ~granted_privilege(sql).isin(*C.KNOWN_PRIVILEGES)),
        ],
        "function": [
            _finding("function_return", "E", "Function missing RETURN clause", function & ~text.contains("RETURN")),
            _finding("function_name", "W", "Function should use fully qualified name (catalog.schema.function)",
                     function & ~sql.contains(".")),
        ],
        "alter": [
            _finding("alter_operation", "W", "ALTER statement has unknown operation type",
                     alter & ~text.rlike("SET ROW FILTER|ALTER COLUMN|SET MASK|SET TAGS")),
        ],
        "tag": [
            _finding("tag_exists", "W", "CREATE TAG should use IF NOT EXISTS for idempotency",
                     tag & ~text.contains("IF NOT EXISTS")),
        ],
    }


def lint_statements(statements: DataFrame, keys: list[str], sql: str = "sql", rules: tuple[str, ...] = ()) -> DataFrame:
    """Findings per statement; all rule groups unless some are named."""
    groups = lint_rules(F.col(sql))
    chosen = [f for name, group in groups.items() if not rules or name in rules for f in group]
    rows = statements.select(*keys, F.explode(F.array_compact(F.array(*chosen))).alias("f"))
    return rows.select(*keys, "f.rule", "f.severity", "f.message")
