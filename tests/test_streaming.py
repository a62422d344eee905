from palisade.streaming import ingest


def test_files_arriving_in_two_rounds_are_each_read_once(spark, tmp_path):
    inbox, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for round_, (good, bad) in enumerate([("a", "b"), ("c", "d")]):
        (tmp_path / "in" / f"{good}.json").write_text('{"policies":[{"id":%d,"resources":{}}]}' % round_)
        (tmp_path / "in" / f"{bad}.json").write_text("{")
        files = ingest.stream_policy_documents(spark, inbox)
        assert ingest.start_ingest(files, out, state).awaitTermination(60)
    rows = spark.read.parquet(f"{out}/policies").collect()
    assert sorted((r["policy_id"], r["batch"]) for r in rows) == [("0", 0), ("1", 1)]
    assert spark.read.parquet(f"{out}/errors").count() == 2
