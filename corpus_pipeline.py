"""From raw documents to packed training sequences, stage by stage.

Each stage gets the documents that its predecessor kept, and writes what it keeps: rules reject
documents, near-duplicates go but for one of each group, secrets are masked in the text, sources are
mixed to their targets (a document taken twice is there twice), and the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palisade.llm import mixing, near_dup, packing, quality, secrets
from palisade.llm.text import free_names
from palisade.session import write_through


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the production policy."""
    (bits,) = free_names(docs, "__ledger")
    judged = quality.ledger(docs, out=bits)
    return judged.filter(quality.passes(quality.PRODUCTION, column=bits)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates at 0.8."""
    return near_dup.one_per_group(docs, threshold=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    return secrets.redact(docs, length="n_chars")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their place in a sequence."""
    return packing.pack(packing.pieces(docs)).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("mixing", mixed_sources),
    ("packing", packed_sequences),
]
#: Pivotal rounding and packing by sequence are not expressible in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``; what lies between is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_through(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
