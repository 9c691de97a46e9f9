"""F1, F2 of round 4: pairs of near copies are found and multiplied where the documents lie."""

import random

import numpy as np
import pytest

from lodestone.operators import bags
from lodestone.operators import retrieval as R

from .conftest import TINY
from .test_growth import plan
from .test_round3 import against_sql


@pytest.mark.parametrize("name", ["near_dup_pairs", "pair_partners"])
def test_candidates_are_not_shuffled(spark, name):
    """No row for two documents with a rare word in common, and no vector for each pair, is joined or grouped by Spark."""
    p = plan(spark, name, TINY)
    assert "sum(both" not in p and "profile" not in p and "array<double>" not in p


@pytest.mark.parametrize("sent, meetings", [(1 << 20, 1 << 20), (3000, 50), (1, 1)])
def test_pairs_do_not_depend_on_blocks(spark, monkeypatch, sent, meetings):
    """One block of all vectors, several, and one for nearly each, with documents taken together and one by one: pairs and products are those of all pairs."""
    monkeypatch.setattr(bags, "HEAD_BYTES", sent if sent > 1 else 4000)
    monkeypatch.setattr(bags, "VECTOR_BYTES", sent if sent > 1 else 4000)
    monkeypatch.setattr(bags, "MEETINGS", meetings)
    r, docs = np.random.default_rng(8), []
    for _ in range(50):
        base = {int(x): float(r.uniform(0.2, 2)) for x in r.integers(0, 120, 25)}
        docs += [base, {t: w for t, w in base.items() if r.uniform() < 0.8} or base, {**base, int(r.integers(0, 120)): 1.0}]
    docs += [{1: 1.0}, {1: 2.0}, {2: 1.0, 3: 1.0}, {500: 1.0}, {}]
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    unit = [{t: float(w / np.sqrt(sum(v * v for v in d.values()))) for t, w in sorted(d.items())} for d in docs]
    rows = spark.createDataFrame([(-i, list(d), [df[t] for t in d], list(d.values())) for i, d in enumerate(unit)], "id long, t array<long>, df array<long>, w array<double>").repartition(3)
    for least in (0.5, 0.9):
        want = {(-j, -i): x for i, d in enumerate(unit) for j in range(i + 1, len(docs)) if round(x := sum(w * unit[j].get(t, 0) for t, w in d.items()), 6) >= least}
        got = bags.near(rows, least, R.LEVELS).collect()
        assert {(x.a, x.b): x.sim for x in got} == {k: pytest.approx(x, abs=1e-6) for k, x in want.items()} and len(got) == len(want) > 20


def test_near_copies_in_blocks_against_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bags, "HEAD_BYTES", 20_000)
    monkeypatch.setattr(bags, "VECTOR_BYTES", 20_000)
    r = random.Random(7)
    words = [f"w{k}" for k in range(80)]
    base = [[r.choice(words) for _ in range(r.randint(1, 25))] for _ in range(40)]
    texts = [" ".join(w if r.random() < 0.95 else r.choice(words) for w in b) for b in base for _ in range(6)] + ["", None, "x"]
    for name in ("near_dup_pairs", "pair_partners"):
        got, want = against_sql(spark, tmp_path, name, documents={"doc_id": list(range(len(texts))), "text": texts})
        assert got == want and len(got) > 30


def test_no_vectors(spark):
    assert bags.near(spark.createDataFrame([], "id int, t array<long>, df array<long>, w array<double>"), 0.8, R.LEVELS).collect() == []
