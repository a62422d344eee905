"""Building blocks of the oracle SQL: named SELECTs that DuckDB runs over the driver tables."""

from __future__ import annotations

import re

from palisade import constants as C
from palisade.plans import fixtures as fx

D = fx.DUCK
ORDER = "section, obj_pos, obj_key, obj_sub, item_pos, prin_pos, acc_pos, part"
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(text: str) -> str:
    """A SQL text literal; line breaks are written as chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")" if len(parts) > 1 else parts[0]


def quote(x: str) -> str:
    return f"(CASE WHEN regexp_matches({x}, '[^a-zA-Z0-9_]') THEN '`' || {x} || '`' ELSE {x} END)"


def plain(x: str) -> str:
    return f"regexp_replace({x}, '[^a-zA-Z0-9_]', '_', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{SPACES}+', ''), '{SPACES}+$', '')"


def fmt_body(x: str) -> str:
    lines = (
        f"list_filter(list_transform(string_split({strip(x)}, chr(10)), "
        f"lambda l: regexp_replace(regexp_replace(l, '  +', ' ', 'g'), '{SPACES}+$', '')), "
        f"lambda l: regexp_replace(l, '{SPACES}', '', 'g') <> '')"
    )
    text = f"array_to_string({lines}, chr(10))"
    return f"({text} || CASE WHEN ends_with({text}, ';') THEN '' ELSE ';' END)"


def header(name: str, pid: str, desc: str) -> str:
    wrapped = f"array_to_string(regexp_extract_all({desc}, '(?s).{{1,70}}'), chr(10) || {lit(C.HEADER_CONTINUED)})"
    return (
        f"(CASE WHEN {name} <> '' OR {pid} <> '' THEN {lit(C.RULE)} || chr(10) || "
        f"CASE WHEN {name} <> '' THEN {lit(C.HEADER_NAME)} || {name} || chr(10) ELSE '' END || "
        f"CASE WHEN {pid} <> '' THEN {lit(C.HEADER_ID)} || {pid} || chr(10) ELSE '' END || "
        f"CASE WHEN {desc} <> '' THEN {lit(C.HEADER_DESCRIPTION)} || {wrapped} || chr(10) ELSE '' END || "
        f"{lit(C.RULE)} || chr(10) ELSE '' END)"
    )


def case_map(x: str, values: dict[str, str], default: str) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items())
    return f"(CASE {x} {arms} ELSE {default} END)"


def privilege(x: str) -> str:
    name = f"(CASE WHEN contains(lower({x}), ':') THEN substr(lower({x}), strpos(lower({x}), ':') + 1) ELSE lower({x}) END)"
    return case_map(name, C.PRIVILEGES, f"upper({name})")


def mask_template(kind: str, column: str, fallback: str) -> str:
    return f"replace({case_map(kind, C.MASKS, lit(C.MASKS[fallback]))}, '{{column}}', {column})"


def mask_type(kind: str) -> str:
    return case_map(kind, C.MASK_SQL_TYPES, "'STRING'")


def words(keywords: list[str]) -> str:
    return "(" + ", ".join(lit(w) for w in keywords) + ")"


def filter_words(expr: str, session: bool = True) -> str:
    """Matched names without keywords, repeats kept, in order."""
    keys = C.FILTER_KEYWORDS + (C.FILTER_KEYWORDS_SESSION if session else [])
    pattern = lit("(?i)" + C.FILTER_COLUMN_PATTERN)
    return f"list_filter(regexp_extract_all({expr}, {pattern}, 1), lambda w: upper(w) NOT IN {words(keys)})"


def first_seen(values: str) -> str:
    """Distinct list values, first use first."""
    return f"list_filter({values}, lambda w, i: list_position({values}, w) = i)"


RES = f"""CASE WHEN other_resource = 'url' AND tbl IS NULL THEN NULL
  WHEN udf IS NOT NULL AND tbl IS NULL THEN 'FUNCTION main.' || {quote("coalesce(db, 'ranger_migration')")} || '.' || {quote("udf")}
  WHEN db = '*' AND (tbl IS NULL OR tbl = '*') THEN 'CATALOG main'
  WHEN db IS NOT NULL AND (tbl IS NULL OR tbl = '*') THEN 'SCHEMA main.' || {quote("db")}
  WHEN regexp_matches(tbl, '[^a-zA-Z0-9_`-]') THEN 'SCHEMA main.' || {quote("coalesce(db, 'ranger_migration')")}
  WHEN tbl IS NOT NULL THEN 'main.' || {quote("coalesce(db, 'ranger_migration')")} || '.' || {quote("tbl")} END"""

KINDS = f"""list_filter([CASE WHEN db IS NOT NULL THEN 'database' END, CASE WHEN tbl IS NOT NULL THEN 'table' END,
  CASE WHEN col1 IS NOT NULL THEN 'column' END, CASE WHEN path1 IS NOT NULL THEN 'path' END,
  CASE WHEN udf IS NOT NULL THEN 'udf' END, other_resource, CASE WHEN tag1 IS NOT NULL THEN 'tag' END],
  lambda x: x IS NOT NULL)"""


def raw(policy_type: str, body: str, source: str, may_head: str = "true", note: str = "NULL", **order: str) -> str:
    o = {
        "section": "0", "obj_pos": "0", "obj_key": "''", "obj_sub": "''", "item_pos": "0", "prin_pos": "0",
        "acc_pos": "0", "part": "0", **order,
    }
    types = {"obj_key": "VARCHAR", "obj_sub": "VARCHAR", "item_pos": "BIGINT"}
    columns = ", ".join(f"CAST({v} AS {types.get(k, 'INTEGER')}) AS {k}" for k, v in o.items())
    return (
        f"SELECT policy_key, '{policy_type}' AS policy_type, {columns}, {may_head} AS may_head, "
        f"CAST({note} AS VARCHAR) AS note, {body} AS body FROM {source}"
    )


def finish(rows: str, heads: str = "pol") -> str:
    desc = f"(CASE WHEN note IS NULL THEN description ELSE {strip('description || chr(10) || note')} END)"
    head = f"(CASE WHEN may_head AND rn = 1 THEN {header('name', 'policy_id', desc)} ELSE '' END)"
    return (
        f"SELECT r.policy_key, r.policy_type, {ORDER}, {head} || {fmt_body('body')} AS sql FROM "
        f"(SELECT *, row_number() OVER (PARTITION BY policy_key, may_head ORDER BY {ORDER}) AS rn FROM {rows}) r "
        f"JOIN {heads} h ON h.policy_key = r.policy_key"
    )


WHEN_U, WHEN_G = "    WHEN current_user() = '", "    WHEN is_account_group_member('"


def when_clause(ptype: str, name: str, then: str) -> str:
    return (
        f"(CASE {ptype} WHEN 'user' THEN {lit(WHEN_U)} || {name} || '''' ELSE {lit(WHEN_G)} || {name} || ''')' END "
        f"|| chr(10) || '      THEN ' || {then})"
    )


def cased(whens: str, other: str) -> str:
    return f"('CASE' || chr(10) || {whens} || chr(10) || '    ELSE ' || {other} || chr(10) || '  END')"


def filter_pair(source: str, policy_type: str, table: str, **order: str) -> str:
    params = "array_to_string(list_transform(cols, lambda c: c || ' STRING'), ', ')"
    create = (
        f"'CREATE OR REPLACE FUNCTION ' || fn || '(' || {params} || ')' || chr(10) || 'RETURNS BOOLEAN' || chr(10) "
        "|| 'RETURN' || chr(10) || '  ' || filter_body"
    )
    attach = (
        f"'ALTER TABLE ' || {table} || chr(10) || 'SET ROW FILTER ' || fn || chr(10) || 'ON (' || "
        "array_to_string(cols, ', ') || ')'"
    )
    return (
        raw(policy_type, create, source, part="0", **order) + " UNION ALL " + raw(policy_type, attach, source, part="1", **order)
    )


def mask_pair(source: str, policy_type: str, fallback: str, table: str, **order: str) -> str:
    masked = mask_template("mask_kind", "col", fallback)
    body = f"(CASE WHEN whens IS NULL THEN {masked} ELSE {cased('replace(whens, chr(1), col)', masked)} END)"
    fn = f"(prefix || '.mask_' || {plain('tname')} || '_' || {plain('col')} || '_' || {plain('lower(mask_kind)')})"
    create = (
        f"'CREATE OR REPLACE FUNCTION ' || {fn} || '(' || col || ' ' || {mask_type('mask_kind')} || ')' || chr(10) || "
        f"'RETURNS ' || {mask_type('mask_kind')} || chr(10) || 'RETURN' || chr(10) || '  ' || {body}"
    )
    attach = (
        f"'ALTER TABLE ' || {table} || chr(10) || 'ALTER COLUMN ' || col || chr(10) || 'SET MASK ' || {fn}"
    )
    return (
        raw(policy_type, create, source, part="0", **order) + " UNION ALL " + raw(policy_type, attach, source, part="1", **order)
    )


PATH_SLUG = "replace(replace(replace(trim(path, '/'), '/', '_'), '*', 'all'), '{USER}', 'USER')"
_SLUG_OR_ROOT = "coalesce(nullif(" + PATH_SLUG + ", ''), 'root')"
LOCATION = f"('ext_loc_' || {plain(_SLUG_OR_ROOT)})"
TABLE3 = f"('main.' || {quote('schema_')} || '.' || {quote('table_')})"

CTES: dict[str, str] = {
    "base": fx.policies_sql(D),
    "items": fx.items_sql(D),
    "rtags": fx.resource_tags_sql(D),
    "attrs": fx.attributes_sql(D),
    "defs": fx.definitions_sql(D),
    "map_": fx.mapping_sql(D),
    "lists": "SELECT policy_key, bool_or(mask_type IS NOT NULL) AS hm, bool_or(filter_expr IS NOT NULL) AS hf, bool_or(kind = 'allow') AS ha FROM items GROUP BY policy_key",
    "pol": f"""SELECT *, CASE WHEN tag1 IS NOT NULL THEN CASE WHEN policy_type = 'COLUMN_MASK' THEN 'tag_mask' ELSE 'tag_access' END
  WHEN (path1 IS NOT NULL OR other_resource = 'url') AND tbl IS NULL THEN 'path'
  WHEN policy_type = 'COLUMN_MASK' THEN 'column_mask' WHEN policy_type = 'ROW_FILTER' THEN 'row_filter' ELSE 'access' END AS route
FROM (SELECT b.*, coalesce(ha OR hm OR hf, false) AS listed, CASE WHEN declared_type = 1 THEN 'COLUMN_MASK' WHEN declared_type = 2 THEN 'ROW_FILTER' WHEN declared_type IS NOT NULL THEN 'ACCESS'
    WHEN hm THEN 'COLUMN_MASK' WHEN hf THEN 'ROW_FILTER' ELSE 'ACCESS' END AS policy_type, {RES} AS res, {KINDS} AS kinds
  FROM base b LEFT JOIN lists USING (policy_key)) t""",
    "who0": """SELECT policy_key, item_pos, kind, filter_expr, mask_type, unnest(w) AS w, generate_subscripts(w, 1) AS n FROM (
  SELECT *, list_filter([{'t': 'user', 'n': u1}, {'t': 'user', 'n': u2}, {'t': 'group', 'n': g1}, {'t': 'group', 'n': g2},
    {'t': 'group', 'n': g3}, {'t': 'role', 'n': r1}, {'t': 'role', 'n': r2}], lambda x: x.n IS NOT NULL) AS w FROM items) i""",
    "who": """SELECT policy_key, item_pos, kind, filter_expr, mask_type, CAST(n - 1 AS INTEGER) AS prin_pos, w.t AS ptype, w.n AS pname,
  coalesce(m.target_value, w.n) AS principal FROM who0 LEFT JOIN map_ m ON m.mapping_type = 'principal' AND m.source_value = w.n""",
    "acc": f"""SELECT a.*, coalesce(m.target_value, {privilege('access_type')}) AS privilege FROM (
  SELECT policy_key, item_pos, kind, 0 AS acc_pos, a1 AS access_type FROM items WHERE coalesce(ok1, true)
  UNION ALL SELECT policy_key, item_pos, kind, 1, a2 FROM items WHERE a2 IS NOT NULL) a
  LEFT JOIN map_ m ON m.mapping_type = 'privilege' AND m.source_value = access_type""",
    "agrants": """SELECT a.policy_key, item_pos, acc_pos, CASE privilege WHEN 'CREATE' THEN 'CREATE TABLE' ELSE privilege END AS privilege,
    res, false AS on_schema FROM acc a JOIN pol p USING (policy_key)
    WHERE kind = 'allow' AND route = 'access' AND res IS NOT NULL
      AND NOT (privilege = 'CREATE' AND NOT regexp_matches(res, '^(CATALOG|SCHEMA|FUNCTION) '))
  UNION ALL SELECT DISTINCT a.policy_key, item_pos, 2147483647, 'CREATE TABLE', res, true FROM acc a JOIN pol p USING (policy_key)
    WHERE kind = 'allow' AND route = 'access' AND privilege = 'CREATE' AND NOT regexp_matches(res, '^(CATALOG|SCHEMA|FUNCTION) ')""",
    "agrants_w": "SELECT a.*, prin_pos, ptype, principal FROM agrants a JOIN who w USING (policy_key, item_pos)",
    "r_access": raw(
        "ACCESS",
        f"""CASE WHEN on_schema THEN {lit(C.CREATE_NOTE)} || 'GRANT CREATE TABLE ON SCHEMA ' || string_split(res, '.')[1] || '.' || string_split(res, '.')[2]
    ELSE 'GRANT ' || privilege || ' ON ' || CASE WHEN regexp_matches(res, '^(CATALOG|SCHEMA|FUNCTION) ') THEN res ELSE 'TABLE ' || res END END
    || ' TO `' || principal || '`'""",
        "agrants_w", may_head="NOT on_schema", item_pos="item_pos", prin_pos="prin_pos", acc_pos="acc_pos",
    ),
    "paths": """SELECT policy_key, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS obj_pos, unnest(p) AS path FROM (
  SELECT policy_key, CASE WHEN path1 IS NULL THEN ['s3://bucket/' || status] ELSE list_filter([path1, path2], lambda x: x IS NOT NULL) END AS p
  FROM pol WHERE route = 'path') t""",
    "locs": f"""SELECT policy_key, obj_pos, path, {LOCATION} AS location, item_pos, acc_pos, prin_pos, principal,
  {case_map('lower(access_type)', C.LOCATION_PRIVILEGES, 'upper(access_type)')} AS privilege
  FROM paths JOIN acc USING (policy_key) JOIN who USING (policy_key, item_pos) WHERE acc.kind = 'allow'""",
    "r_path": raw(
        "EXTERNAL_LOCATION",
        "'GRANT ' || privilege || ' ON EXTERNAL LOCATION `' || location || '` TO `' || principal || '`'", "locs",
        note="'-- NOTE: Replace ''' || location || ''' with the actual UC External Location name' || chr(10) || "
             "'-- that corresponds to the Ranger path: ' || path",
        obj_pos="obj_pos", item_pos="item_pos", prin_pos="prin_pos", acc_pos="acc_pos",
    ),
    "fbody": f"""SELECT policy_key, coalesce({cased('whens', "'TRUE'")}, CASE WHEN first_expr <> '' THEN first_expr ELSE 'TRUE' END) AS filter_body
  FROM (SELECT policy_key, arg_min(filter_expr, item_pos) AS first_expr FROM items WHERE filter_expr IS NOT NULL GROUP BY policy_key) f
  LEFT JOIN (SELECT policy_key, string_agg({when_clause('ptype', 'principal', 'filter_expr')}, chr(10) ORDER BY item_pos, prin_pos) AS whens
    FROM who WHERE filter_expr <> '' AND ptype <> 'role' GROUP BY policy_key) w USING (policy_key)""",
    "fcols": f"""SELECT policy_key, {first_seen('l')} AS cols FROM (
  SELECT policy_key, flatten(list({filter_words('filter_expr')} ORDER BY item_pos)) AS l FROM items WHERE filter_expr <> '' GROUP BY policy_key) t""",
    "ftargets": "SELECT policy_key, policy_id, res, string_split(res, '.') AS parts FROM pol WHERE route = 'row_filter' AND res IS NOT NULL",
    "frows": f"""SELECT policy_key, res, filter_body, coalesce(cols, []) AS cols,
  parts[1] || '.' || parts[2] || '.rf_' || {plain('parts[3]')} || '_' || {plain('policy_id')} || '_0' AS fn
  FROM ftargets JOIN fbody USING (policy_key) LEFT JOIN fcols USING (policy_key) WHERE len(parts) = 3""",
    "r_filter": filter_pair("frows", "ROW_FILTER", "res"),
    "mkind": """SELECT policy_key, arg_min(mask_type, item_pos) FILTER (mask_type <> 'MASK_NONE') AS mask_kind
  FROM items WHERE mask_type IS NOT NULL GROUP BY policy_key""",
    "mopen": f"""SELECT policy_key, string_agg({when_clause('ptype', 'principal', 'chr(1)')}, chr(10) ORDER BY item_pos, prin_pos) AS whens
  FROM who WHERE mask_type = 'MASK_NONE' AND ptype <> 'role' GROUP BY policy_key""",
    "mtargets": """SELECT policy_key, policy_id, res, string_split(res, '.') AS parts, list_filter([col1, col2], lambda c: c IS NOT NULL) AS columns
  FROM pol WHERE route = 'column_mask' AND res IS NOT NULL""",
    "mrows": """SELECT policy_key, res, parts[1] || '.' || parts[2] AS prefix, parts[3] AS tname, coalesce(mask_kind, 'MASK_REDACT') AS mask_kind, whens,
  unnest(columns) AS col, CAST(generate_subscripts(columns, 1) - 1 AS INTEGER) AS obj_pos
  FROM mtargets JOIN mkind USING (policy_key) LEFT JOIN mopen USING (policy_key) WHERE len(parts) = 3""",
    "r_mask": mask_pair("mrows", "COLUMN_MASK", "MASK_REDACT", "res", obj_pos="obj_pos"),
    "owners": """SELECT DISTINCT policy_key, 'access' AS route FROM items WHERE kind = 'allow' UNION ALL
  SELECT DISTINCT policy_key, 'row_filter' FROM items WHERE filter_expr IS NOT NULL UNION ALL
  SELECT DISTINCT policy_key, 'column_mask' FROM items WHERE mask_type IS NOT NULL""",
    "nt": f"""SELECT policy_key, policy_id, name, route, kinds,
    list_transform(kinds, lambda k: {case_map('k', C.REASONS, "'''' || k || ''' has no Unity Catalog equivalent.'")}) AS reasons,
    CASE WHEN len(kinds) = 0 THEN '[]' ELSE '[''' || array_to_string(kinds, ''', ''') || ''']' END AS types
  FROM pol SEMI JOIN owners USING (policy_key, route) WHERE res IS NULL AND route IN ('access', 'row_filter', 'column_mask')""",
    "r_nt": raw(
        "NOT_TRANSLATABLE",
        "'-- NOT TRANSLATABLE: Policy ''' || name || ''' (id=' || policy_id || ')' || chr(10) || CASE route WHEN 'access' "
        "THEN array_to_string(list_transform(reasons, lambda r: '-- ' || r), chr(10)) "
        "ELSE '-- Reason: resource types ' || types || ' have no Unity Catalog equivalent.' END",
        "nt",
    ),
    # tags
    "tparts": "SELECT *, string_split(path, '.') AS parts FROM rtags",
    "levels": """SELECT CASE len(parts) WHEN 2 THEN 0 ELSE 1 END AS section, parts[1] || '.' || parts[2] AS table_key,
  CASE len(parts) WHEN 3 THEN parts[3] ELSE '' END AS col, path_pos, tag_pos, tag FROM tparts WHERE len(parts) IN (2, 3)""",
    "tagged": """SELECT section, table_key, col, path_pos, tag_pos, tag FROM levels UNION ALL
  SELECT 2, tag, '', 0, 0, tag FROM defs WHERE tag NOT IN (SELECT tag FROM rtags)""",
    "pairs": """SELECT section, table_key, col, pair_key, arg_min(v, (path_pos, tag_pos, a)) AS pair_value, min((path_pos, tag_pos, a)) AS seen FROM (
  SELECT section, table_key, col, path_pos, tag_pos, -1 AS a, lower(tag) AS pair_key, 'true' AS v FROM tagged UNION ALL
  SELECT section, table_key, col, path_pos, tag_pos, attr_pos, lower(attr_key), attr_value FROM tagged JOIN attrs USING (tag)) t
  GROUP BY section, table_key, col, pair_key""",
    "pairtext": "SELECT section, table_key, col, string_agg('''' || pair_key || ''' = ''' || pair_value || '''', ', ' ORDER BY seen) AS pairs FROM pairs GROUP BY ALL",
    "r_tag": raw(
        "TAG",
        f"""CASE section WHEN 2 THEN '-- TODO: No resourceTags found for tag ''' || table_key || '''.' || chr(10) ||
    '-- Apply this tag to the relevant table(s)/column(s):' || chr(10) || 'ALTER TABLE main.ranger_migration.<table_name>'
    ELSE 'ALTER TABLE main.' || {quote("string_split(table_key, '.')[1]")} || '.' || {quote("string_split(table_key, '.')[2]")} ||
    CASE section WHEN 1 THEN ' ALTER COLUMN ' || col ELSE '' END END || ' SET TAGS (' || pairs || ')'""",
        "(SELECT '' AS policy_key, * FROM pairtext)", section="section", obj_key="table_key", obj_sub="col",
    ),
    "taghead": f"SELECT '' AS policy_key, '' AS policy_id, {lit(C.TAG_HEADER_NAME)} AS name, {lit(C.TAG_HEADER_DESCRIPTION)} AS description",
    "ptags": """SELECT policy_key, route, tag1 AS tag FROM pol WHERE tag1 IS NOT NULL
  UNION SELECT policy_key, route, tag2 FROM pol WHERE tag2 IS NOT NULL""",
    "ttables": """SELECT policy_key, route, table_key, array_to_string(list_sort(list(DISTINCT tag)), ',') AS tags FROM ptags JOIN (
  SELECT DISTINCT parts[1] || '.' || parts[2] AS table_key, tag FROM tparts WHERE len(parts) >= 2) USING (tag) GROUP BY policy_key, route, table_key""",
    "tcolumns": """SELECT DISTINCT tag, CASE len(parts) WHEN 3 THEN parts[1] ELSE 'ranger_migration' END AS db, parts[len(parts) - 1] AS tbl,
  parts[len(parts)] AS col, path_pos FROM tparts WHERE len(parts) IN (2, 3) AND parts[len(parts)] <> '*'""",
    "tabcols": """SELECT t.policy_key, t.route, t.table_key, coalesce(c.col, '<column>') AS col, coalesce(c.path_pos, 0) AS path_pos FROM ttables t LEFT JOIN (
  SELECT policy_key, parts[1] || '.' || parts[2] AS table_key, parts[3] AS col, min(path_pos) AS path_pos FROM ptags JOIN tparts USING (tag)
  WHERE len(parts) = 3 GROUP BY ALL) c ON c.policy_key = t.policy_key AND c.table_key = t.table_key""",
    "tgrants": """SELECT policy_key, table_key, string_split(table_key, '.')[1] AS schema_, string_split(table_key, '.')[2] AS table_, item_pos, acc_pos, prin_pos,
  privilege, principal FROM ttables JOIN acc USING (policy_key) JOIN who USING (policy_key, item_pos) WHERE route = 'tag_access' AND acc.kind = 'allow'""",
    "r_taggrant": raw(
        "ACCESS_TAG",
        f"""CASE privilege WHEN 'CREATE' THEN {lit(C.TAG_CREATE_NOTE)} || 'GRANT CREATE TABLE ON SCHEMA main.' || schema_
    ELSE 'GRANT ' || privilege || ' ON TABLE ' || {TABLE3} END || ' TO `' || principal || '`'""",
        "tgrants", obj_key="table_key", item_pos="item_pos", prin_pos="prin_pos", acc_pos="acc_pos",
    ),
    "nogrants": """SELECT policy_key, item_pos, acc_pos, prin_pos, privilege, principal, array_to_string(l, '_') AS t1, array_to_string(l, ', ') AS t2 FROM (
  SELECT policy_key, list_sort(list(DISTINCT tag)) AS l FROM ptags WHERE route = 'tag_access' AND policy_key NOT IN (SELECT policy_key FROM ttables) GROUP BY policy_key) x
  JOIN acc USING (policy_key) JOIN who USING (policy_key, item_pos) WHERE acc.kind = 'allow'""",
    "r_tagnogrant": raw(
        "ACCESS_TAG",
        f"""CASE privilege WHEN 'CREATE' THEN {lit(C.TAG_CREATE_NOTE)} || 'GRANT CREATE TABLE ON SCHEMA main.ranger_migration'
    ELSE '-- NOTE: No resourceTags metadata found for tag(s): ' || t2 || '.' || chr(10) ||
    '-- Replace the placeholder with the actual table(s) that carry these tags.' || chr(10) ||
    'GRANT ' || privilege || ' ON TABLE main.ranger_migration.<table_with_' || t1 || '>' END || ' TO `' || principal || '`'""",
        "nogrants", item_pos="item_pos", prin_pos="prin_pos", acc_pos="acc_pos",
    ),
    "denies": f"""SELECT policy_key, {lit(C.DENY_NOTE)} || coalesce(chr(10) || lines, '') AS digest FROM (
  SELECT policy_key, string_agg('--   DENY ' || ptype || ': ' || pname, chr(10) ORDER BY item_pos, prin_pos) FILTER (ptype <> 'role') AS lines
  FROM (SELECT policy_key, item_pos FROM items JOIN pol USING (policy_key) WHERE items.kind = 'deny' AND route = 'tag_access') d
  LEFT JOIN who USING (policy_key, item_pos) GROUP BY policy_key) t""",
    "r_tagdeny": raw("ACCESS_TAG", "digest", "denies", section="1"),
    "tfilters": f"""SELECT t.policy_key, table_key, string_split(table_key, '.')[1] AS schema_, string_split(table_key, '.')[2] AS table_, i.item_pos,
  {first_seen(filter_words('filter_expr', session=False))} AS cols,
  coalesce({cased('whens', "'TRUE'")}, filter_expr) AS filter_body,
  'main.' || string_split(table_key, '.')[1] || '.rf_' || {plain("string_split(table_key, '.')[2]")} || '_' || CAST(t.policy_key AS VARCHAR) || '_' || CAST(i.item_pos AS VARCHAR) AS fn
  FROM ttables t JOIN items i USING (policy_key) LEFT JOIN (
    SELECT policy_key, item_pos, string_agg({when_clause('ptype', 'principal', 'filter_expr')}, chr(10) ORDER BY prin_pos) AS whens
    FROM who WHERE filter_expr <> '' AND ptype <> 'role' GROUP BY policy_key, item_pos) w USING (policy_key, item_pos)
  WHERE route = 'tag_access' AND filter_expr <> ''""",
    "r_tagfilter": filter_pair("tfilters", "ACCESS_TAG", TABLE3, section="2", obj_key="table_key", item_pos="item_pos"),
    "tmasks": """SELECT policy_key, table_key, col, path_pos, string_split(table_key, '.')[1] AS schema_, string_split(table_key, '.')[2] AS table_,
  'main.' || string_split(table_key, '.')[1] AS prefix, string_split(table_key, '.')[2] AS tname, coalesce(mask_kind, 'MASK_REDACT') AS mask_kind, whens
  FROM tabcols JOIN mkind USING (policy_key) LEFT JOIN mopen USING (policy_key) WHERE route = 'tag_access'""",
    "r_tagsupp": mask_pair("tmasks", "ACCESS_TAG", "MASK_REDACT", TABLE3, section="3", obj_key="table_key", item_pos="path_pos"),
    "tmopen": f"""SELECT policy_key, string_agg({when_clause('ptype', "CASE ptype WHEN 'user' THEN pname ELSE principal END", 'chr(1)')}, chr(10)
    ORDER BY CASE ptype WHEN 'user' THEN 0 ELSE 1 END, item_pos, prin_pos) AS whens
  FROM who WHERE mask_type = 'MASK_NONE' AND ptype <> 'role' GROUP BY policy_key""",
    "tagmask": """SELECT policy_key, 'main.' || c.db AS prefix, c.tbl AS tname, col, path_pos, mask_kind, whens FROM pol JOIN mkind USING (policy_key)
  JOIN tcolumns c ON c.tag = tag1 LEFT JOIN tmopen USING (policy_key) WHERE route = 'tag_mask' AND mask_kind IS NOT NULL""",
    "r_tagmask": mask_pair("tagmask", "COLUMN_MASK_TAG", "MASK_HASH", "prefix || '.' || tname", item_pos="path_pos"),
    "r_tagaccess": """SELECT * FROM r_taggrant UNION ALL SELECT * FROM r_tagnogrant UNION ALL SELECT * FROM r_tagdeny
  UNION ALL SELECT * FROM r_tagfilter UNION ALL SELECT * FROM r_tagsupp""",
    "r_all": """SELECT * FROM r_access UNION ALL SELECT * FROM r_path UNION ALL SELECT * FROM r_filter UNION ALL SELECT * FROM r_mask
  UNION ALL SELECT * FROM r_nt UNION ALL SELECT * FROM r_tagaccess UNION ALL SELECT * FROM r_tagmask""",
    "all_sql": finish("r_all"),
    # audit
    "tlog": fx.translation_log_sql(D),
    "alog": fx.apply_log_sql(D),
    "outcomes": fx.outcomes_sql(D),
    "fxprin": fx.principals_sql(D),
}

# JSON documents: where each policy sits in its file
CTES.update({
    "docbase": """SELECT *, policy_key // 4 AS blk, (policy_key // 4) % 6 AS env, policy_key % 4 AS r FROM pol""",
    "docall": """SELECT *, CASE env WHEN 1 THEN 'p' || CAST(policy_key AS VARCHAR) ELSE 'd' || CAST(blk AS VARCHAR) END AS source,
  CAST(CASE WHEN env = 2 AND r >= 2 THEN 1 ELSE 0 END AS INTEGER) AS block_pos,
  CAST(CASE WHEN env = 2 AND r = 3 THEN 2 WHEN env = 4 AND r >= 2 THEN 1 WHEN env = 5 AND r >= 1 THEN 2 ELSE 0 END AS INTEGER) AS section,
  CASE env WHEN 1 THEN 'single' WHEN 2 THEN 'testCases' WHEN 3 THEN 'policyDeltas' WHEN 4 THEN CASE WHEN r >= 2 THEN 'tagPolicyInfo' ELSE 'standard' END
    WHEN 5 THEN CASE WHEN r >= 1 THEN 'tagPolicies' ELSE 'standard' END ELSE 'standard' END AS shape,
  CASE WHEN env = 0 OR (env = 2 AND r <= 1) THEN 'svc' END AS service_name FROM docbase""",
    "doc": """SELECT *, CAST(row_number() OVER (PARTITION BY source, block_pos, section ORDER BY policy_key) - 1 AS INTEGER) AS pos
  FROM docall WHERE blk % 97 <> 0 AND (env <> 1 OR listed)""",
    "dockey": "SELECT policy_key AS k, source || '#' || block_pos || '#' || section || '#' || pos AS policy_key FROM doc",
    "docitems": """SELECT d.policy_key, i.kind, CAST(row_number() OVER (PARTITION BY d.policy_key, i.kind ORDER BY i.item_pos) - 1 AS BIGINT) AS item_pos,
    i.* EXCLUDE (policy_key, kind, item_pos) FROM dockey d JOIN items i ON i.policy_key = d.k""",
})


def with_ctes(select: str) -> str:
    """``select`` with exactly the named SELECTs it needs in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text) and _used(name, text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(select)
    if not needed:
        return select
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + select


def _used(name: str, text: str) -> bool:
    return re.search(rf"(?:FROM|JOIN|from|join)\s+\(*{name}\b", text) is not None
