"""Session defaults and shared scratch space."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot policy, tag or principal even when that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app: str = "palisade", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the shared checkpoint folder the session names.

    Where the session names none, a folder of the warehouse is used. With executors on other machines that has to be a
    place they share as well: a warehouse on a local disk is refused then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        remote = not spark.conf.get("spark.master", "local").startswith("local")
        if remote and (warehouse.startswith("file:") or "://" not in warehouse):
            raise ValueError("executors do not share the local warehouse folder; set spark.checkpoint.dir to a shared one")
        root = warehouse.rstrip("/") + "/.scratch"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_through(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written files.

    Cuts the lineage where a result is read more than once, and outlives lost executors.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
