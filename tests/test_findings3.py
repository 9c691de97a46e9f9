"""Cases of the findings of round 3 that were left open then."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import blockmax
from lodestone.operators import retrieval as R


def test_bounds_find_the_first_of_leave_one_out(monkeypatch):
    """queries of different means are screened by one product; few scores are made one by one, and the first k are those of all scores."""
    r = np.random.default_rng(11)
    lists = [r.zipf(1.3, r.integers(0, 60)) % 400 for _ in range(700)]
    lists[50:60] = [lists[49]] * 10
    batch = pa.RecordBatch.from_arrays([pa.array(range(700)), pa.array(lists, pa.list_(pa.int64()))], ["id", "toks"])
    rows = [{"q": q, "s": 0, "k1": 1.5, "b": 0.75, "avgdl": 20.0 + q / 1e4, "terms": [{"t": int(t), "w": 0.5 + 1 / c} for t, c in zip(*np.unique(lists[q], return_counts=True), strict=True)]} for q in range(0, 700, 9)]
    sent, made = blockmax.Sent(rows), []
    assert sent.bounded and sent.kinds.shape[1] > 16
    plain = blockmax.Block.pairs
    monkeypatch.setattr(blockmax.Block, "pairs", lambda self, i, j: made.append(len(i)) or plain(self, i, j))
    monkeypatch.setattr(blockmax, "BLOCK", 256)
    best = blockmax.Best(len(rows), 10)
    blockmax.score_blocks(sent, best, batch, own=False)
    whole = [blockmax.half_up(s(np.arange(len(rows))), 6) for _, _, s, _ in blockmax.term_blocks(sent, batch, False)]
    score = np.concatenate(whole, axis=1)
    for i, x in enumerate(rows):
        score[i, x["q"]] = -np.inf
        want = np.lexsort((np.arange(700), -score[i]))[:10]
        assert best.id[i].tolist() == want.tolist() and best.score[i].tolist() == score[i][want].tolist()
    assert 0 < sum(made) < score.size / 5


@pytest.mark.parametrize("kinds", [1, 3])
def test_products_equal_sums_by_term(kinds):
    """All scores of a block, common terms multiplied as a matrix, against the formula."""
    r = np.random.default_rng(12)
    lists = [[f"t{x}" for x in r.zipf(1.3, r.integers(0, 60)) % 90] for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(lists, pa.list_(pa.string()))], ["id", "toks"])
    rows = [{"q": q, "s": q % kinds, "k1": 1.5, "b": 0.75 - 0.1 * (q % kinds), "avgdl": 20.0, "terms": [{"t": f"t{x}", "w": 1.0 - x / 40} for x in r.choice(90, 12, False)]} for q in range(40)]
    sent = blockmax.Sent(rows)
    assert sent.common()[1].shape[1] > 20
    got = np.concatenate([s(np.arange(5, 40)) for _, _, s, _ in blockmax.term_blocks(sent, batch, False)], axis=1)
    for i, x in enumerate(rows[5:]):
        for j, words in enumerate(lists):
            f = [words.count(t["t"]) for t in x["terms"]]
            assert abs(got[i, j] - sum(t["w"] * n * 2.5 / (n + 1.5 * (1 - x["b"] + x["b"] * len(words) / 20)) for t, n in zip(x["terms"], f, strict=True))) < 1e-9


def test_texts_are_split_and_queries_made_once(spark, tmp_path):
    """Passes over the documents read words that were written, not texts."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 3} x") for i in range(50)] + [(50, None)], "doc_id long, text string")
    index = R.index(docs, "doc_id", "text", packed=True)
    assert dict(index["docs"].dtypes)["toks"] == "array<bigint>" and "regexp" not in index["docs"]._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_of_lists(spark):
    """signed counts by MD5 of each word, null without words."""
    got = {r.id: r.v for r in R.encode_lists(spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, None), (4, ["zo\u00eb"])], "id long, toks array<string>")).collect()}
    assert got[2] is None and got[3] is None
    for i, words in ((1, ["a", "b", "a"]), (4, ["zo\u00eb"])):
        v = np.zeros(R.DIM)
        for w in words:
            h = hashlib.md5(w.encode()).hexdigest()
            v[int(h[:8], 16) % R.DIM] += 1 if int(h[8], 16) % 2 == 0 else -1
        assert np.allclose(got[i], v / np.sqrt((v * v).sum()), atol=1e-15)


def test_conditions_keep_no_ranking(spark, tmp_path):
    """pairs of the pool aren't sorted or joined; ties, nulls, and fewer suppliers than places, against SQL."""
    from __spark_entry__ import queries

    from .test_round3 import against_sql

    for n in (3, 450):
        r = np.random.default_rng(n)
        bal = [None if i % 41 == 5 else float(x) for i, x in enumerate(r.integers(0, 60, n) / 4)]
        got, want = against_sql(spark, tmp_path, "condition_union", supplier={"s_suppkey": list(range(n)), "s_name": ["s"] * n, "s_nationkey": [None if i % 37 == 3 else int(x) for i, x in enumerate(r.integers(0, 25, n))], "s_acctbal": bal})
        assert got == want and len(got) > 20 * ((n + 99) // 100)
    plan = queries()["condition_union"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and plan.count("Join Cross") == 1  # the two static examples


def test_edges_are_shuffled_once(spark):
    """pairs are found in windows of one exchange, without joining back; as the joins found them."""
    from pyspark.sql import functions as F

    from lodestone.operators import matching as M
    from lodestone.plans import registry

    r = np.random.default_rng(13)
    rows = spark.createDataFrame([(int(r.integers(0, 4)), None if i % 50 == 7 else int(r.integers(0, 5)), "ab"[r.integers(0, 2)], bool(r.integers(0, 2)), i) for i in range(400)], "ex int, x int, typ string, gt boolean, id int")
    passes = [["x", "typ"], ["x"]]
    want = {tuple(p) for p in M.match_passes(rows.where("gt"), rows.where("not gt"), ["ex"], passes, ["id"]).collect()}
    made = M.mates(rows, "gt", ["ex"], passes, ["id"])
    got = {tuple(p) for p in made.where("gt and mate is not null").select("ex", "id", F.col("mate.id").alias("f"), "pass").collect()}
    back = {tuple(p) for p in made.where("not gt and mate is not null").select("ex", F.col("mate.id").alias("g"), "id", "pass").collect()}
    assert got == want == back and {p[3] for p in got} == {1, 2} and made.count() == 400
    for name in ("end_multiplicity", "rel_error_class", "extra_elements"):
        plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
