"""Statement text: headers, clean-up, conditions and filter columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palisade import constants as C


# Single characters only, which a regular expression tests by table look-up.
ASCII_CLASS = r"[ \t\n\x0b\f\r\x1c\x1d\x1e\x1f]"
UNICODE_CLASS = r"(?U)[\s\x1c\x1d\x1e\x1f]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(C.ASCII_SPACES + C.OTHER_SPACES))


def _is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def format_body(sql: Column) -> Column:
    """Collapse runs of blanks, trim line ends, drop blank lines, end with ``;``.

    No higher-order function, so rows stay in codegen; each pass runs only on text that
    can need it, and the wide white-space test only on text beyond ASCII.
    """
    packed = F.when(sql.contains("  "), F.regexp_replace(strip(sql), "  +", " ")).otherwise(strip(sql))
    lines = (
        F.when(~sql.contains("\n"), packed)
        .when(_is_ascii(sql), F.regexp_replace(packed, ASCII_CLASS + r"+\n", "\n"))
        .otherwise(F.regexp_replace(packed, UNICODE_CLASS + r"+\n", "\n"))
    )
    return F.concat(lines, F.when(lines.endswith(";"), F.lit("")).otherwise(F.lit(";")))


def header(name: Column, policy_id: Column, description: Column) -> Column:
    """Comment block above the first statement of a policy; NULL without name and id."""

    def line(label: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(label), value, F.lit("\n"))).otherwise(F.lit(""))

    wrapped = F.array_join(F.regexp_extract_all(description, F.lit("(?s)(.{1,70})"), F.lit(1)), "\n" + C.HEADER_CONTINUED)
    block = F.concat(
        F.lit(C.RULE + "\n"),
        line(C.HEADER_NAME, F.coalesce(name, F.lit(""))),
        line(C.HEADER_ID, F.coalesce(policy_id, F.lit(""))),
        line(C.HEADER_DESCRIPTION, F.coalesce(wrapped, F.lit(""))),
        F.lit(C.RULE),
    )
    return F.when((F.length(name) > 0) | (F.length(policy_id) > 0), block)


def format_statement(
    sql: Column, name: Column, policy_id: Column, description: Column, with_header: Column | None = None
) -> Column:
    head = header(name, policy_id, description)
    if with_header is not None:
        head = F.when(with_header, head)
    return F.concat_ws("\n", head, format_body(sql))


def filter_columns(expression: Column, session_words: bool = True) -> Column:
    """Column names left of a comparison, IN, LIKE or IS, in first-seen order."""
    words = C.FILTER_KEYWORDS + (C.FILTER_KEYWORDS_SESSION if session_words else [])
    found = F.regexp_extract_all(expression, F.lit("(?i)" + C.FILTER_COLUMN_PATTERN), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~F.upper(w).isin(*words)))


def extract_table_placeholder(expression: Column) -> Column:
    return F.nullif(F.regexp_extract(expression, r"(?i)\{table\}", 0), F.lit(""))


def condition_to_sql(kind: Column, values: Column, entries: Column) -> Column:
    """A policy condition as a predicate.

    ``kind``/``values`` are the ``type`` and ``values`` of an expression condition;
    ``entries`` is a MAP<STRING, ARRAY<STRING>> of every list-valued key.
    """

    def text(entry: Column) -> Column:
        quoted = F.concat(F.lit("'"), F.array_join(entry["value"], "', '"), F.lit("'"))
        return F.when(
            F.size(entry["value"]) == 1, F.concat(entry["key"], F.lit(" = "), quoted)
        ).otherwise(F.concat(entry["key"], F.lit(" IN ("), quoted, F.lit(")")))

    used = F.filter(F.map_entries(entries), lambda e: F.size(e["value"]) > 0)
    listed = F.array_join(F.transform(used, text), " AND ")
    return F.when(kind == "expression", F.coalesce(F.get(values, F.lit(0)), F.lit("TRUE"))).otherwise(
        F.when(F.length(listed) > 0, listed).otherwise(F.lit("TRUE"))
    )


def conditions_to_sql(conditions: Column) -> Column:
    """One predicate per condition of an item, in order; ``conditions`` is the JSON text of a list of objects or of one object.

    Absent or unreadable conditions give an empty array. Of an object only values that are lists count.
    """
    texts = F.when(F.startswith(F.ltrim(conditions), F.lit("[")), F.from_json(conditions, "array<string>")).otherwise(F.array(conditions))
    read = F.transform(texts, lambda text: F.from_json(text, "map<string, string>"))
    known = F.filter(F.coalesce(read, F.array().cast("array<map<string, string>>")), lambda c: c.isNotNull())

    def predicate(condition: Column) -> Column:
        listed = F.map_filter(condition, lambda _, value: F.coalesce(F.startswith(value, F.lit("[")), F.lit(False)))
        lists = F.transform_values(listed, lambda _, value: F.from_json(value, "array<string>"))
        kind = F.try_element_at(condition, F.lit("type"))
        return condition_to_sql(kind, F.try_element_at(lists, F.lit("values")), lists)

    return F.transform(known, predicate)


def user_test(name: Column) -> Column:
    return F.concat(F.lit("    WHEN current_user() = '"), name, F.lit("'\n      THEN "))


def group_test(name: Column) -> Column:
    return F.concat(F.lit("    WHEN is_account_group_member('"), name, F.lit("')\n      THEN "))


def case_body(whens: Column, otherwise: Column) -> Column:
    return F.concat(F.lit("CASE\n"), whens, F.lit("\n    ELSE "), otherwise, F.lit("\n  END"))
