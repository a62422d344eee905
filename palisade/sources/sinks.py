"""Scripts, run history and audit tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palisade import constants as C
from palisade.functions.text import strip


def script_blocks(numbered: DataFrame) -> DataFrame:
    """Adds ``block``: a statement under its ``Statement i of N`` banner."""
    return numbered.withColumn(
        "block",
        F.concat(
            F.lit(C.SCRIPT_RULE + "\n-- Statement "), F.col("stmt_no").cast("string"), F.lit(" of "),
            F.col("stmt_total").cast("string"), F.lit("\n" + C.SCRIPT_RULE + "\n"), strip(F.col("sql")),
        ),
    )


#: Statements in one file of a script, so that a file can be read as a whole.
STATEMENTS_PER_FILE = 10_000


def write_sql_script(numbered: DataFrame, path: str) -> None:
    """One folder of ordered part files per source.

    Rows are range-partitioned by (source, number), so a source with most of the
    statements becomes several files whose names keep the order. A file ends after STATEMENTS_PER_FILE statements.
    """
    blocks = script_blocks(numbered).select(
        "source", "stmt_no", F.concat(F.col("block"), F.lit("\n")).alias("value")
    )
    ordered = blocks.repartitionByRange("source", "stmt_no").sortWithinPartitions("source", "stmt_no")
    writer = ordered.select("source", "value").write.option("maxRecordsPerFile", STATEMENTS_PER_FILE)
    writer.partitionBy("source").mode("overwrite").text(path)


def create_audit_tables(spark: SparkSession, schema: str, location: str | None = None, by_run: bool = False) -> None:
    """The audit tables; ``by_run`` adds a last column ``run_id`` that they are partitioned by, so that a run can be repeated."""
    where = f" LOCATION '{location}'" if location else ""
    run, parts = (", run_id STRING", " PARTITIONED BY (run_id)") if by_run else ("", "")
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{where}")
    for name, columns in C.AUDIT_TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{name} ({columns}{run}) USING parquet{parts}")


def create_audit_views(spark: SparkSession, schema: str) -> None:
    """The three summary views over the audit tables."""
    spark.sql(
        f"CREATE OR REPLACE VIEW {schema}.v_translation_summary AS "
        "SELECT date(timestamp) AS translation_date, count(*) AS translation_count, "
        "sum(ranger_policy_count) AS total_ranger_policies, sum(uc_policy_count) AS total_uc_policies, "
        f"sum(error_count) AS total_errors FROM {schema}.translation_log "
        "GROUP BY date(timestamp) ORDER BY translation_date DESC"
    )
    spark.sql(
        f"CREATE OR REPLACE VIEW {schema}.v_application_summary AS "
        "SELECT date(timestamp) AS application_date, policy_type, status, count(*) AS policy_count, "
        "sum(executed_count) AS statements_executed, sum(total_statements) AS total_statements "
        f"FROM {schema}.uc_policies_applied GROUP BY date(timestamp), policy_type, status "
        "ORDER BY application_date DESC, policy_type"
    )
    spark.sql(
        f"CREATE OR REPLACE VIEW {schema}.v_recent_errors AS "
        "SELECT timestamp, policy_id, policy_type, status, message, error_details "
        f"FROM {schema}.uc_policies_applied WHERE status IN ('error', 'partial') "
        "ORDER BY timestamp DESC, policy_id LIMIT 100"
    )


_OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _append(df: DataFrame, schema: str, table: str, run_id: str | None = None) -> None:
    """Append in the table's own column order; columns the frame lacks are NULL.

    With a ``run_id`` the rows become that run's partition, in place of what an earlier attempt of it has left: repeated any
    number of times, a run is there once. The table has to be made ``by_run``.
    """
    spark = df.sparkSession
    target = spark.table(f"{schema}.{table}").schema
    if run_id is not None:
        if "run_id" not in target.names:
            raise ValueError(f"{schema}.{table} is not kept by run")
        df = df.withColumn("run_id", F.lit(run_id))
    columns = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in target
    ]
    rows = df.select(*columns)
    if run_id is None:
        rows.write.mode("append").insertInto(f"{schema}.{table}")
        return
    before = spark.conf.get(_OVERWRITE)
    spark.conf.set(_OVERWRITE, "dynamic")
    try:
        rows.write.mode("overwrite").insertInto(f"{schema}.{table}")
    finally:
        spark.conf.set(_OVERWRITE, before)


def append_raw_policies(docs: DataFrame, schema: str, when: Column, upload_source: str = "ui", run_id: str | None = None) -> None:
    rows = docs.select(
        when.alias("timestamp"), F.col("json").alias("policies_json"),
        F.lit(upload_source).alias("upload_source"), F.col("source").alias("file_name"),
    )
    _append(rows, schema, "ranger_policies_raw", run_id)


def translation_log_rows(policies: DataFrame, outputs: DataFrame, errors: DataFrame, when: Column) -> DataFrame:
    """One row per source from (source) policy rows, (source) output rows and
    (source, pos, message) errors."""
    from palisade.functions.ordering import ordered_text

    read = policies.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("ranger_policy_count"))
    made = outputs.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("uc_policy_count"))
    failed = errors.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("error_count"))
    text = ordered_text(
        errors, ["source"], ["pos", "message"], "message", "; ", "errors", F.floor(F.col("pos") / 512)
    )
    zero = F.lit(0)
    return (
        read.join(made, "source", "left").join(failed, "source", "left").join(text, "source", "left")
        .select(
            when.alias("timestamp"), F.lit("translation").alias("activity"), "ranger_policy_count",
            F.coalesce("uc_policy_count", zero).alias("uc_policy_count"),
            F.coalesce("error_count", zero).alias("error_count"), "errors",
            F.concat(F.lit("{'source': '"), "source", F.lit("'}")).alias("metadata"),
        )
    )


def append_translation_log(rows: DataFrame, schema: str, run_id: str | None = None) -> None:
    _append(rows, schema, "translation_log", run_id)


def append_apply_log(results: DataFrame, schema: str, when: Column, run_id: str | None = None) -> None:
    _append(results.withColumn("timestamp", when), schema, "uc_policies_applied", run_id)


def append_history(runs: DataFrame, path: str, run_id: str | None = None) -> None:
    """Run entries are only ever added; readers take the newest 200. A ``run_id`` makes a repeated write leave one set of entries."""
    if run_id is None:
        runs.write.mode("append").parquet(path)
    else:
        rows = runs.withColumn("run_id", F.lit(run_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
