"""Scores that doubles do not hold."""

import random

import pytest

from palisade.llm import topk


def by_hand(rows, k, every):
    scaled = {i: [int(64 * x // 1) for x in v] for i, v in rows}
    out = set()
    for q in scaled:
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(scaled[q], scaled[i])), i) for i in scaled if i != q)
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("shard_values", [64, 1 << 19])
def test_scores_near_four_times_ten_to_the_seventeenth(spark, monkeypatch, shard_values):
    monkeypatch.setattr(topk, "SHARD_VALUES", shard_values)
    rng = random.Random(3)
    base = [1e7, 1.0 / 64, 0.0]
    rows = [(0, base), (1, [1e7, 1.0 / 64, 0.0]), (2, [1e7, 2.0 / 64, 0.0]), (3, [1e7, 0.0, 0.0]), (4, [-1e7, 5.0, 0.0])]
    rows += [(i, [1e7, rng.randint(-9, 9) / 64, rng.randint(-9, 9) / 64]) for i in range(5, 90)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=7, every=5).collect()
    assert {tuple(r) for r in found} == by_hand(rows, 7, 5)


def test_scores_beyond_64_bits_do_not_crash(spark):
    rows = [(i, [1e17, float(i)]) for i in range(6)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), k=2, every=5).collect()
    assert len(found) == 4 and all(r.score > 9 * 10**18 for r in found)
