"""Policy files as they arrive: the batch ingest steps, which keep no state, over a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade.sources import documents

TABLES = ("policies", "access_items", "filter_items", "mask_items", "errors")


def stream_policy_documents(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """(source, json) of new files below ``path``."""
    text = (
        spark.readStream.schema("value string").option("wholetext", "true")
        .option("maxFilesPerTrigger", files_per_batch).text(path)
    )
    return text.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("json"))


def land_batch(batch: DataFrame, batch_id: int, path: str) -> None:
    """One folder per batch and relation, overwritten when a batch is run again."""
    tables = documents.policy_tables(batch)
    parsed = documents.parse_policies(documents.unwrap_policies(batch))
    frames = {
        "policies": tables.policies, "access_items": tables.access_items, "filter_items": tables.filter_items,
        "mask_items": tables.mask_items,
        "errors": documents.document_errors(batch).unionByName(
            documents.policy_errors(parsed).select("source", "stage")
        ),
    }
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")


def start_ingest(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Normalise all files that are there, batch by batch, then stop."""
    return (
        files.writeStream.foreachBatch(lambda batch, n: land_batch(batch, n, path))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
