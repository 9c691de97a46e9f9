"""Quantiles by selection and bootstrap by weights, against plain versions."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.operators import selection as S

PROBS = [0, 0.1, 1 / 3, 0.5, 0.975, 1]


@pytest.mark.parametrize("fetch,bins", [(4096, 1024), (20, 8), (5, 4)])
def test_quantiles_equal_sorted_lists(spark, fetch, bins):
    rng = random.Random(fetch)
    rows = [("even", float(i % 50)) for i in range(500)] + [("skew", rng.choice([1e300, -1e300, 1e-300, 0.0, 5.0]) * rng.random()) for _ in range(400)] + [("one", 3.5)] * 300 + [("few", x) for x in (2.0, 1.0)] + [("few", None), ("few", float("nan")), ("none", None)]
    rows += [("tight", 1.0 + k * 2.0**-52) for k in range(64)] * 3
    got = {r.g: (r.n, r.q) for r in S.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(3), ["g"], "v", PROBS, fetch, bins).collect()}
    assert set(got) == {"even", "skew", "one", "few", "tight"}
    for g, (n, q) in got.items():
        own = sorted(v for h, v in rows if h == g and v is not None and v == v)
        assert n == len(own)
        for p, x in zip(PROBS, q, strict=True):
            at = (n - 1) * p
            a, b = own[int(np.floor(at))], own[int(np.ceil(at))]
            assert x == pytest.approx(a + (b - a) * (at - np.floor(at)), rel=1e-12)


def test_bootstrap_by_weights_is_the_same_in_any_partitions(spark):
    rng = random.Random(1)
    rows = [(c, u, rng.random()) for c in "ab" for u in range(40)]
    df = spark.createDataFrame(rows, "c string, u long, s double")
    got = [sorted((r.c, r.k, round(r.m, 9)) for r in S.bootstrap_means(df.repartition(n), "c", "u", "s", 50).collect()) for n in (1, 7)]
    assert got[0] == got[1] and len(got[0]) == 100
    draw = lambda c, u, k: sum(int(hashlib.sha256(f"0/{c}/{u}/{k // 16}".encode()).hexdigest()[4 * (k % 16) : 4 * (k % 16) + 4], 16) >= x for x in S.LIMITS)
    for c, k, m in got[0][:60]:
        w = [draw(c, u, k) for d, u, _ in rows if d == c]
        assert m == pytest.approx(sum(a * s for a, (_, _, s) in zip(w, [r for r in rows if r[0] == c], strict=True)) / sum(w))
    spread = np.std([m for c, _, m in got[0] if c == "a"])
    own = np.array([s for c, _, s in rows if c == "a"])
    assert spread == pytest.approx(own.std() / np.sqrt(len(own)), rel=0.35)
