"""The pivot index against plain comparisons, and what it leaves unread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import pivots
from lodestone.operators import retrieval as R


def plain(x, queries, k, measure, own=False):
    s = R.MEASURES[measure](x, x)
    return {q: sorted(((-round(float(s[q, i]), 6) + 0.0, i) for i in range(len(x)) if own or i != q))[:k] for q in queries}


def found(spark, ix, frame, k, every, seen=None, own=False):
    got = R.rank(pivots.nearest(frame.where(F.col("id") % every == 0).select(F.col("id").alias("q"), "v"), ix, k, own, seen=seen), k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.q, r["rank"])):
        out.setdefault(r.q, []).append((-r.score + 0.0, r.id))
    return out


@pytest.mark.parametrize("measure", ["cosine", "profile"])
def test_clusters_are_skipped_and_nothing_is_lost(spark, monkeypatch, measure):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) if measure == "cosine" else rng.dirichlet(np.full(6, 0.2), 12)
    x = np.abs(centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 0.01) if measure == "profile" else centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6)) * 0.05
    x = x / x.sum(1, keepdims=True) if measure == "profile" else x
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>").repartition(5)
    monkeypatch.setattr(R, "QUERY_BYTES", 20000)  # several blocks
    seen = {}
    got = found(spark, pivots.index(frame, measure, 40), frame, 4, 15, seen)
    want = plain(x, range(0, 900, 15), 4, measure)
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert seen["read"] < 0.5 * seen["pairs"]


def test_isotropic_equal_and_odd_vectors(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 5)).round(1)
    x[40:90] = x[7]  # a hot group of equal vectors
    odd = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [float("nan")] * 5), (204, [float("inf")] * 5), (205, []), (300, [1.0, 2.0]), (310, [2.0, 1.0]), (320, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "id long, v array<double>").repartition(4)
    for n in (1, 9, 500):
        got = found(spark, pivots.index(frame, pivots=n), frame, 6, 10)
        assert [i for _, i in got.pop(300)] == [320, 310] and [i for _, i in got.pop(310)] == [320, 300] and len(got.pop(320)) == 2
        want = plain(x, range(0, 120, 10), 6, "cosine")
        assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}
    assert [i for _, i in found(spark, pivots.index(frame), frame, 2, 40, own=True)[40]] == [7, 40]


def test_empty_and_few(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert found(spark, pivots.index(none), none, 3, 1) == {}
    one = spark.createDataFrame([(4, [1.0, 0.0])], "id long, v array<double>")
    assert found(spark, pivots.index(one), one, 3, 1) == {} and found(spark, pivots.index(none), one, 3, 1) == {}
    two = spark.createDataFrame([(4, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, v array<double>")
    assert {q: [i for _, i in v] for q, v in found(spark, pivots.index(two), two, 3, 1).items()} == {2: [4], 4: [2]}


def test_many_equal_vectors_dont_all_leave_their_task(spark):
    frame = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(4000)], "id long, v array<double>").coalesce(1)
    q = frame.where("id in (0, 5)").select(F.col("id").alias("q"), "v")
    assert R.nearest(q, frame, 3).count() < 100
    assert sorted((r.q, r.id) for r in R.rank(R.nearest(q, frame, 3), 3).collect()) == [(0, 1), (0, 2), (0, 3), (5, 0), (5, 1), (5, 2)]
