"""Override mappings for resources, principals and privileges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def load_mapping_config(spark: SparkSession, table: str) -> DataFrame:
    """(mapping_type, source_value, target_value): the newest entry per value wins."""
    rows = spark.table(table)
    return (
        rows.groupBy("mapping_type", F.col("ranger_value").alias("source_value"))
        .agg(F.max_by("uc_value", F.struct("created_at", "uc_value")).alias("target_value"))
    )


def with_override(
    df: DataFrame, mapping: DataFrame | None, kind: str, value: str, out: str, default: Column | None = None
) -> DataFrame:
    """``out`` = override of ``value`` if the mapping has one, else ``default``.

    The join carries no broadcast hint: AQE broadcasts a mapping that is small at run
    time and otherwise shuffles, splitting a principal or privilege that is hot.
    """
    fallback = F.col(value) if default is None else default
    if mapping is None:
        return df.withColumn(out, fallback)
    # A value that is listed twice must not double the rows it is looked up for.
    chosen = mapping.filter(F.col("mapping_type") == kind).groupBy(F.col("source_value").alias(value)).agg(
        F.max("target_value").alias("__override")
    )
    joined = df.join(chosen, value, "left")
    return joined.withColumn(out, F.coalesce("__override", fallback)).drop("__override")


#: Overrides of one kind up to which they are looked up as a literal map inside a row.
FEW = 1000


def few_overrides(mapping: DataFrame | None, kind: str) -> dict[str, str] | None:
    """Overrides of ``kind`` as a dictionary, or None where there are more than FEW of them."""
    if mapping is None:
        return {}
    rows = mapping.filter((F.col("mapping_type") == kind) & F.col("target_value").isNotNull())
    found = rows.groupBy("source_value").agg(F.max("target_value").alias("t")).limit(FEW + 1).collect()
    return None if len(found) > FEW else {r["source_value"]: r["t"] for r in found}
