"""Audit rows of a run that is repeated, and where written tables may lie."""

import pytest
from pyspark.sql import functions as F

from palisade import session
from palisade.sources import sinks


def test_a_repeated_run_leaves_one_set_of_rows(spark, tmp_path):
    when = F.lit("2024-05-06 07:08:09").cast("timestamp")
    sinks.create_audit_tables(spark, "runs_once", str(tmp_path / "audit"), by_run=True)
    docs = spark.createDataFrame([("f1", "{}"), ("f2", "[]")], "source string, json string")
    log = spark.createDataFrame([("translation", 3)], "activity string, ranger_policy_count int")
    applied = spark.createDataFrame([("7", "success"), ("8", "error")], "policy_id string, status string")
    for run in ("a", "b", "a", "a"):
        sinks.append_raw_policies(docs, "runs_once", when, run_id=run)
        sinks.append_translation_log(log, "runs_once", run_id=run)
        sinks.append_apply_log(applied.filter("policy_id = '7'") if run == "b" else applied, "runs_once", when, run_id=run)
        sinks.append_history(log, str(tmp_path / "history"), run_id=run)
    held = lambda t: {r.run_id: r["count"] for r in spark.table(f"runs_once.{t}").groupBy("run_id").count().collect()}
    assert held("ranger_policies_raw") == {"a": 2, "b": 2} and held("translation_log") == {"a": 1, "b": 1}
    assert held("uc_policies_applied") == {"a": 2, "b": 1}
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"
    sinks.create_audit_tables(spark, "runs_plain", str(tmp_path / "plain"))
    with pytest.raises(ValueError):
        sinks.append_translation_log(log, "runs_plain", run_id="a")
    for _ in range(2):
        sinks.append_translation_log(log, "runs_plain")
    assert spark.table("runs_plain.translation_log").count() == 2


class Settings:
    def __init__(self, **values):
        self.conf, self.values = self, values

    def get(self, key, default=None):
        return self.values.get(key.replace(".", "_"), default)


def test_a_local_folder_is_refused_where_executors_are_remote():
    local = {"spark_sql_warehouse_dir": "file:/tmp/warehouse"}
    assert session.scratch_dir(Settings(spark_master="local[8]", **local), "x").startswith("file:/tmp/warehouse/.scratch/x-")
    with pytest.raises(ValueError):
        session.scratch_dir(Settings(spark_master="yarn", **local), "x")
    assert session.scratch_dir(Settings(spark_master="yarn", spark_checkpoint_dir="file:/shared", **local), "x").startswith("file:/shared/x-")
    assert session.scratch_dir(Settings(spark_master="yarn", spark_sql_warehouse_dir="hdfs://n/w"), "x").startswith("hdfs://n/w/.scratch/x-")
