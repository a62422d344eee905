"""The pipeline stage by stage, and every registered query with an oracle."""

import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from palisade.llm import catalog
from tests.check import compare, duck
from tests.llm.test_row_operators import base_spans, measured

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes in and out of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    secret = 'A note about the new server that every reader should keep: password = "hunter2hunter2" and nothing else.'
    docs = docs.unionByName(spark.createDataFrame([(10**6, secret, "en", "src1", len(secret))], docs.schema))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_all_are_registered():
    queries = entry.queries()
    assert "pipeline" in queries and set(catalog.QUERIES) <= set(queries)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, name):
    assert compare(catalog.QUERIES[name](spark, SF), duck(SF), catalog.ORACLES[name]) == ""


def test_stages_keep_the_columns(stages):
    for given, made in stages[:-1]:
        assert made.columns == given.columns


def test_rules_reject_and_keep(stages, spark):
    given, made = stages[0]
    kept = {r.doc_id for r in made.collect()}
    for r in given.collect():
        n, _, _, _, repeated = measured(r.text)
        if n < 10 or 100 * repeated > 20 * n:
            assert r.doc_id not in kept
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [r.doc_id for r in labels if r.quality == 1]
    assert sum(d in kept for d in good) >= 0.9 * len(good)


def test_one_of_each_group_stays(stages):
    from palisade.llm import near_dup

    given, made = stages[1]
    found = near_dup.near_duplicates(given, threshold=80).collect()
    assert {r.doc_id for r in made.collect()} == {r.component_id for r in found} and made.count() < given.count()


def test_near_copies_at_0_8_go(spark):
    from tests.llm.test_corpus_operators import components_of, shingles

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    words = [f"w{i}" for i in range(200)]
    # One changed word in the middle of n makes (n - 9) / (n + 1) of the 5-word shingles common: 0.80, 0.82, 0.84 and below 0.8.
    made = []
    for k, n in enumerate((49, 54, 60, 46)):
        text = words[k * 30 : k * 30 + n]
        made += [(10**6 + 2 * k, " ".join(text)), (10**6 + 2 * k + 1, " ".join([*text[: n // 2], "other", *text[n // 2 + 1 :]]))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in made], docs.schema))
    rows = docs.select("doc_id", "text").collect()
    sets = [shingles(r.text) for r in rows]
    want = {}
    for root, r, s in zip(components_of(sets, 80), rows, sets):
        if s:
            want[root] = min(want.get(root, r.doc_id), r.doc_id)
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert {r.doc_id for r in got if shingles(r.text)} == set(want.values())
    assert {i for i, _ in made} - {r.doc_id for r in got} == {10**6 + 1, 10**6 + 3, 10**6 + 5}


def test_no_secret_is_left(stages):
    given, made = stages[2]
    assert any(base_spans(r.text) for r in given.collect())
    assert given.count() == made.count() and not any(base_spans(r.text) for r in made.collect())


def test_mixture_and_sequences(stages):
    given, made = stages[3]
    words = lambda df: sum(len((r.text or "").split()) for r in df.collect())
    assert words(made) == pytest.approx(1.5 * words(given), rel=0.05)
    rows = stages[4][1].collect()
    assert len({(r.doc_id) for r in rows}) == made.select("doc_id").distinct().count()
    per = {}
    for r in rows:
        per.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in per.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048


def test_run_is_the_stages_in_a_row(spark, stages):
    made = corpus_pipeline.run(spark, SF)
    assert made.columns == stages[-1][1].columns
    assert abs(made.count() - stages[-1][1].count()) <= 5  # the stages above had one document more
