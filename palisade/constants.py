"""Fixed values.

Everything here must equal what existing policy exports, generated scripts and
audit tables already contain, so it is stated as plain text.
"""

# --- fixed values: defaults -------------------------------------------------
DEFAULT_CATALOG = "main"
DEFAULT_SCHEMA = "ranger_migration"

# --- fixed values: access type -> privilege ----------------------------------
PRIVILEGES = {
    "select": "SELECT",
    "read": "SELECT",
    "update": "MODIFY",
    "write": "MODIFY",
    "create": "CREATE",
    "drop": "MANAGE",
    "alter": "ALTER",
    "all": "ALL PRIVILEGES",
    "admin": "ALL PRIVILEGES",
}
LOCATION_PRIVILEGES = {
    "read": "READ FILES",
    "write": "WRITE FILES",
    "execute": "READ FILES",
    "all": "ALL PRIVILEGES",
}

# --- fixed values: mask expressions and their SQL types -----------------------
MASKS = {
    "MASK_NONE": "{column}",
    "MASK": "'XXXXX'",
    "MASK_SHOW_LAST_4": "CONCAT(REPEAT('X', LENGTH({column})-4), RIGHT({column}, 4))",
    "MASK_SHOW_FIRST_4": "CONCAT(LEFT({column}, 4), REPEAT('X', LENGTH({column})-4))",
    "MASK_HASH": "SHA2(CAST({column} AS STRING), 256)",
    "MASK_NULL": "NULL",
    "MASK_DATE_SHOW_YEAR": "MAKE_DATE(YEAR({column}), 1, 1)",
    "MASK_TIMESTAMP_SHOW_DATE": "DATE_TRUNC('DAY', {column})",
    "MASK_REDACT": "'[REDACTED]'",
}
MASK_SQL_TYPES = {"MASK_DATE_SHOW_YEAR": "DATE", "MASK_TIMESTAMP_SHOW_DATE": "TIMESTAMP"}
MASK_SQL_TYPE_DEFAULT = "STRING"

# --- fixed values: why a resource type has no counterpart ---------------------
REASONS = {
    "topic": "Kafka topics are managed by Kafka ACLs, not Unity Catalog.",
    "cluster": "Kafka cluster admin is managed by Kafka ACLs, not Unity Catalog.",
    "consumergroup": "Kafka consumer groups are managed by Kafka ACLs, not Unity Catalog.",
    "delegationtoken": "Kafka delegation tokens are not a Unity Catalog concept.",
    "entity": "Apache Atlas entity governance does not map to Unity Catalog SQL.",
    "entity-type": "Apache Atlas entity types do not map to Unity Catalog SQL.",
    "entity-classification": "Atlas classifications differ from UC tags — manual mapping required.",
    "hiveservice": "Hive service-level admin has no direct Unity Catalog equivalent.",
}

# --- fixed values: words that are never filter columns ------------------------
FILTER_KEYWORDS = [
    "AND", "OR", "NOT", "NULL", "TRUE", "FALSE", "IS", "IN", "LIKE", "BETWEEN",
    "EXISTS", "CASE", "WHEN", "THEN", "ELSE", "END",
]
FILTER_KEYWORDS_SESSION = ["CURRENT_DATE", "CURRENT_TIMESTAMP", "CURRENT_USER"]
FILTER_COLUMN_PATTERN = (
    r"\b([a-zA-Z_][a-zA-Z0-9_]*)\s*(?:=|!=|<>|<=|>=|<|>|(?:\s+(?:IN|LIKE|IS)\s))"
)

# --- fixed values: validation -------------------------------------------------
KNOWN_MASK_TYPES = [
    "MASK", "MASK_SHOW_LAST_4", "MASK_SHOW_FIRST_4", "MASK_HASH", "MASK_NULL",
    "MASK_NONE", "MASK_DATE_SHOW_YEAR", "SHUFFLE", "NULL", "CUSTOM",
]
KNOWN_PRIVILEGES = [
    "SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP", "USAGE",
    "EXECUTE", "MODIFY", "ALL PRIVILEGES",
]
SIDE_KEYS = ["original-serviceDef", "serviceDef", "serviceName", "tests"]
ITEM_LISTS = {
    "policyItems": "allow",
    "denyPolicyItems": "deny",
    "allowExceptions": "allow_exception",
    "denyExceptions": "deny_exception",
}

# --- fixed values: wording of generated scripts -------------------------------
RULE = "-- " + "=" * 78
HEADER_NAME = "-- Ranger Policy: "
HEADER_ID = "-- Policy ID: "
HEADER_DESCRIPTION = "-- Description: "
HEADER_CONTINUED = "--              "
CREATE_NOTE = (
    "-- NOTE: Ranger 'create' on a table maps to UC schema-level privilege.\n"
    "-- Granting CREATE TABLE on the parent schema instead.\n"
)
TAG_CREATE_NOTE = "-- NOTE: Ranger 'create' maps to schema-level privilege.\n"
DENY_NOTE = (
    "-- DENY POLICY (not directly expressible in Databricks UC SQL):\n"
    "-- The following principals were DENIED access in Ranger.\n"
    "-- Implement via UC row/column filters or explicit permission exclusion."
)
TAG_HEADER_NAME = "Tag Propagation"
TAG_HEADER_DESCRIPTION = (
    "Apply Unity Catalog tags to tables/columns based on "
    "Ranger resourceTags metadata. Run this before access grants."
)
SCRIPT_RULE = "-- " + "=" * 60

# --- fixed values: audit tables -----------------------------------------------
AUDIT_TABLES = {
    "ranger_policies_raw": "timestamp TIMESTAMP, policies_json STRING, upload_source STRING, file_name STRING",
    "translation_log": (
        "timestamp TIMESTAMP, activity STRING, ranger_policy_count INT, uc_policy_count INT, "
        "error_count INT, errors STRING, metadata STRING"
    ),
    "uc_policies_applied": (
        "timestamp TIMESTAMP, policy_id STRING, policy_type STRING, status STRING, message STRING, "
        "executed_count INT, total_statements INT, error_details STRING, applied_by STRING"
    ),
    "mapping_config": (
        "mapping_type STRING, ranger_value STRING, uc_value STRING, created_at TIMESTAMP, created_by STRING"
    ),
}

# --- fixed values: characters that count as white space -------------------------
ASCII_SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"
OTHER_SPACES = (
    "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
