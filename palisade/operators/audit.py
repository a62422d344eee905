"""Apply outcomes, summaries and the audit views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palisade.functions.ordering import ordered_text

OUTCOMES_PER_CHUNK = 512


def _share(part: Column, total: Column) -> Column:
    """``x.x%``, or ``0%`` of nothing."""
    return F.when(total > 0, F.format_string("%.1f%%", part * 100 / total)).otherwise(F.lit("0%"))


def policy_summary(policies: DataFrame, errors: DataFrame) -> DataFrame:
    counts = policies.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("policy_type") == kind).alias(name)
            for kind, name in (("ACCESS", "access"), ("ROW_FILTER", "row_filter"), ("COLUMN_MASK", "column_mask"))
        ],
    )
    return counts.crossJoin(errors.agg(F.count(F.lit(1)).alias("errors")))  # one row by one row


def dry_run_plan(outputs: DataFrame, statements: DataFrame) -> DataFrame:
    """Every output policy is skipped, those without a statement as well; nothing is executed."""
    keys = ["policy_key", "policy_type"]
    counts = statements.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return outputs.select(*keys).join(counts, keys, "left").select(
        "policy_key", "policy_type", F.lit("skipped").alias("status"),
        F.lit("Dry run - not executed").alias("message"), F.lit(0).alias("executed_count"),
        F.coalesce("n", F.lit(0)).alias("total_statements"),
    )


def _errors_text(outcomes: DataFrame) -> DataFrame:
    chunk = F.floor(F.col("statement_idx") / OUTCOMES_PER_CHUNK)
    return ordered_text(
        outcomes.filter("NOT ok"), ["policy_key"], ["statement_idx"], "error", "; ", "error_details", chunk
    )


def _per_policy(outputs: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts for every output policy; one without a statement has executed all of its 0 statements."""
    zero = F.lit(0)
    joined = outputs.select("policy_key").distinct().join(counts, "policy_key", "left")
    return joined.withColumns({c: F.coalesce(c, zero) for c in ("executed_count", "total_statements")})


def apply_outcomes_skip(outputs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Errors are skipped over: any error makes the policy partial. One row per policy of ``outputs``."""
    counts = outcomes.groupBy("policy_key").agg(
        F.count_if("ok").cast("int").alias("executed_count"), F.count(F.lit(1)).cast("int").alias("total_statements")
    )
    done = F.col("executed_count") == F.col("total_statements")
    executed = F.col("executed_count").cast("string")
    return _per_policy(outputs, counts).join(_errors_text(outcomes), "policy_key", "left").select(
        "policy_key",
        F.when(done, F.lit("success")).otherwise(F.lit("partial")).alias("status"),
        F.when(done, F.concat(F.lit("Successfully executed "), executed, F.lit(" statements")))
        .otherwise(
            F.concat(F.lit("Completed with errors: "), executed, F.lit("/"),
                     F.col("total_statements").cast("string"), F.lit(" successful"))
        ).alias("message"),
        "executed_count", "total_statements", "error_details",
    )


def apply_outcomes_strict(outputs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Stop at the first error; what ran before it counts. One row per policy of ``outputs``.

    Outcomes are summed up per chunk of statements first: a chunk is all done, or it has a first error
    and a number of statements before that. The chunks before the first one with an error count in full.
    """
    failed = F.when(~F.col("ok"), F.col("statement_idx"))
    chunks = outcomes.withColumn("chunk", F.floor(F.col("statement_idx") / OUTCOMES_PER_CHUNK)).groupBy("policy_key", "chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min(failed).alias("stop"), F.min_by("error", failed).alias("error"),
        F.array_sort(F.collect_list("statement_idx")).alias("places"),
    )
    before = F.size(F.filter("places", lambda i: F.col("stop").isNull() | (i < F.col("stop"))))
    per = chunks.select("policy_key", F.struct("chunk", before.alias("ran"), "stop", "error").alias("c"), "n").groupBy("policy_key").agg(
        F.sum("n").cast("int").alias("total_statements"), F.min_by("c.error", "c.stop").alias("error_details"),
        F.min("c.stop").alias("stop"), F.array_sort(F.collect_list("c")).alias("parts"),
    )
    first = F.coalesce(F.array_min(F.transform(F.filter("parts", lambda c: c["stop"].isNotNull()), lambda c: c["chunk"])), F.lit(2**62))
    ran = F.aggregate(F.filter("parts", lambda c: c["chunk"] <= first), F.lit(0), lambda a, c: a + c["ran"])
    counts = per.select("policy_key", "total_statements", "stop", "error_details", ran.alias("executed_count"))
    executed = F.col("executed_count").cast("string")
    return _per_policy(outputs, counts).select(
        "policy_key",
        F.when(F.col("stop").isNull(), F.lit("success")).otherwise(F.lit("error")).alias("status"),
        F.when(F.col("stop").isNull(), F.concat(F.lit("Successfully executed "), executed, F.lit(" statements")))
        .otherwise(F.concat(F.lit("Failed after "), executed, F.lit(" statements"))).alias("message"),
        "executed_count", "total_statements",
        F.when(F.col("stop").isNotNull(), F.col("error_details")).alias("error_details"),
    )


def apply_report(results: DataFrame) -> DataFrame:
    return results.select(
        F.col("policy_id").alias("Policy ID"), F.col("policy_type").alias("Type"), F.col("status").alias("Status"),
        F.col("message").alias("Message"), F.col("executed_count").alias("Executed"),
        F.col("total_statements").alias("Total SQL"),
        F.coalesce(F.nullif("error_details", F.lit("")), F.lit("-")).alias("Errors"),
    )


def apply_summary(results: DataFrame) -> DataFrame:
    status = {"success": "success", "errors": "error", "partial": "partial", "skipped": "skipped"}
    row = results.agg(
        F.count(F.lit(1)).alias("total_policies"),
        *[F.count_if(F.col("status") == value).alias(name) for name, value in status.items()],
        F.coalesce(F.sum("executed_count"), F.lit(0)).alias("total_statements_executed"),
    )
    return row.withColumn("success_rate", _share(F.col("success"), F.col("total_policies")))


def translation_stats(
    policies: DataFrame, statements: DataFrame, outputs: DataFrame, errors: DataFrame
) -> DataFrame:
    """Policies read, statements, output policies by outcome, and notes: one row."""
    lost = F.col("policy_type") == "NOT_TRANSLATABLE"
    read = policies.agg(F.count(F.lit(1)).alias("policies"))
    made = statements.agg(F.count(F.lit(1)).alias("statements"))
    kinds = outputs.agg(F.count_if(~lost).alias("translatable"), F.count_if(lost).alias("not_translatable"))
    notes = errors.agg(F.count(F.lit(1)).alias("warnings"))
    return read.crossJoin(made).crossJoin(kinds).crossJoin(notes)  # four one-row frames


def history_totals(runs: DataFrame) -> DataFrame:
    names = {"policies": "total_policies", "sql_statements": "total_sql_statements", "not_translatable": "total_skipped"}
    return runs.agg(
        F.count(F.lit(1)).alias("runs"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in names.items()],
    )


def daily_translation_summary(log: DataFrame) -> DataFrame:
    return (
        log.groupBy(F.to_date("timestamp").alias("translation_date"))
        .agg(
            F.count(F.lit(1)).alias("translation_count"),
            F.sum("ranger_policy_count").alias("total_ranger_policies"),
            F.sum("uc_policy_count").alias("total_uc_policies"),
            F.sum("error_count").alias("total_errors"),
        )
        .orderBy(F.desc("translation_date"))
    )


def daily_application_summary(log: DataFrame) -> DataFrame:
    return (
        log.groupBy(F.to_date("timestamp").alias("application_date"), "policy_type", "status")
        .agg(
            F.count(F.lit(1)).alias("policy_count"),
            F.sum("executed_count").alias("statements_executed"),
            F.sum("total_statements").alias("total_statements"),
        )
        .orderBy(F.desc("application_date"), "policy_type", "status")
    )


def newest(df: DataFrame, n: int, *ties: str) -> DataFrame:
    """Top n by time: a partial top-n per task, then one merge of n rows each."""
    return df.orderBy(F.desc("timestamp"), *ties).limit(n)


def recent_errors(log: DataFrame, n: int = 100) -> DataFrame:
    columns = [c for c in ("timestamp", "policy_id", "policy_type", "status", "message", "error_details") if c in log.columns]
    return newest(log.filter(F.col("status").isin("error", "partial")).select(*columns), n, "policy_id", "policy_type", "status")


def history_top(runs: DataFrame, n: int = 200, *ties: str) -> DataFrame:
    return newest(runs, n, *ties)


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows, each with a flag that the frame had more."""
    head = df.orderBy(*order).limit(n + 1)
    size = head.agg((F.count(F.lit(1)) > n).alias("truncated"))
    return head.limit(n).crossJoin(size)  # n rows by one row


def corpus_stats(files: DataFrame) -> DataFrame:
    """``files``: source, validation_ok, parsing_ok, translation_ok, policies, statements."""
    passed = F.col("validation_ok") & F.col("parsing_ok") & F.col("translation_ok")
    return files.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"),
        F.count_if(~F.col("validation_ok")).alias("validation_failed"),
        F.count_if(~F.col("parsing_ok")).alias("parsing_failed"),
        F.count_if(~F.col("translation_ok")).alias("translation_failed"),
        F.sum("policies").alias("total_policies"), F.sum("statements").alias("total_sql_statements"),
    )


def top_errors_per_file(findings: DataFrame, n: int = 3) -> DataFrame:
    """First n errors per file, in the order a reader meets them.

    Spark turns the row_number filter into a group limit below the exchange, so each
    task sends at most n rows per file.
    """
    order = Window.partitionBy("source").orderBy("idx", "check", "item_pos", "step", "message")
    ranked = findings.filter("severity = 'E'").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= n)


def audit_record(results: DataFrame, when: Column) -> DataFrame:
    """Audit rows; ``statements`` is an array that may be NULL."""
    listed = F.coalesce("statements", F.array().cast("array<string>"))
    return results.select(
        when.alias("timestamp"), F.col("policy_key").cast("string").alias("policy_id"), "policy_type", "status",
        "message", listed.alias("sql_statements"), F.size(listed).alias("statement_count"),
    )
