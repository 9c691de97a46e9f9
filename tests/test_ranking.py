"""Rankings without whole lists: block maxima, fusion by places, re-ranking."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestone.operators import blockmax
from lodestone.operators import retrieval as R


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choices(vocab, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(0, 40)))) for i in range(n)] + [(n, None), (n + 1, ""), (n + 2, "rare1 rare2 w0"), (n + 3, "rare1")]


QUERIES = [(0, "w0 w1 w1 rare1"), (1, "nothing here"), (2, ""), (3, None), (4, "w7 w9 w9 w50"), (5, "rare2 rare1")]


def plain_scores(docs, queries):
    toks = {i: (t or "").split() for i, t in docs}
    df, n = Counter(t for x in toks.values() for t in set(x)), len(docs)
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean, avg = sum(raw.values()) / len(raw), sum(map(len, toks.values())) / n
    idf = {t: 0.25 * mean if w < 0 else w for t, w in raw.items()}
    out = {}
    for q, text in queries:
        for i, x in toks.items():
            f = Counter(x)
            out[q, i] = round(sum(c * idf[t] * f[t] * 2.5 / (f[t] + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t, c in Counter((text or "").split()).items() if f[t]), 6)
    return out


def asked(spark, docs, queries):
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(queries, "item_id long, text string")
    index = R.index(d, "doc_id", "text")
    return index["docs"], R.bm25_queries(index, R.query_terms(q, "item_id", "text"), q.select(q.item_id.alias("q")))


def order(scores, q):
    return sorted((-round(s, 5), i) for (k, i), s in scores.items() if k == q)


def test_top_k_of_all_documents(spark):
    docs = corpus()
    want = plain_scores(docs, QUERIES)
    got = blockmax.top(*asked(spark, docs, QUERIES), 7, spans=True).collect()
    for q, _ in QUERIES:
        mine = sorted((r["rank"], r.id, r.score) for r in got if r.q == q)
        assert [(-round(s, 5), i) for _, i, s in mine] == order(want, q)[:7]
        assert all(abs(r.lo - min(s for (k, _), s in want.items() if k == q)) < 2e-6 and abs(r.hi - max(s for (k, _), s in want.items() if k == q)) < 2e-6 for r in got if r.q == q)
    assert len(got) == 7 * len(QUERIES)


def test_no_row_for_each_pair_is_shuffled(spark):
    plan = blockmax.top(*asked(spark, corpus(30), QUERIES), 3)._jdf.queryExecution().executedPlan().toString()
    last = plan.split("Window", 1)[1]
    assert "Join" not in last and "MapInArrow" in last  # beyond the scoring pass only the last window's exchange


def test_blocks_are_skipped(monkeypatch):
    monkeypatch.setattr(blockmax, "BLOCK", 16)
    rng = random.Random(2)
    docs = [["good", "good", "good"] for _ in range(16)] + [rng.choices(["weak", "other", "x"], k=30) for _ in range(320)]
    sent = blockmax.Sent([{"q": 0, "s": 0, "k1": 1.5, "b": 0.75, "avgdl": 20.0, "terms": [{"t": "good", "w": 3.0}, {"t": "weak", "w": 0.5}]}])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(docs))), pa.array(docs)], ["id", "toks"])
    best, seen = blockmax.Best(1, 5), {}
    blockmax.score_blocks(sent, best, batch, seen=seen)
    whole = blockmax.Best(1, 5)
    blockmax.score_blocks(sent, whole, batch, skip=False)
    assert seen == {"read": 1, "skipped": 20}
    assert (best.id == whole.id).all() and (best.score == whole.score).all() and best.id[0].tolist() == [0, 1, 2, 3, 4]


def test_places_without_a_ranking(spark):
    docs = corpus()
    scorer, want = asked(spark, docs, QUERIES), plain_scores(docs, QUERIES)
    rng = random.Random(3)
    wanted = [(q, i) for q, _ in QUERIES for i in rng.sample(range(len(docs)), 12)]
    got = {(r.q, r.id): r["rank"] for r in blockmax.ranks(*scorer, spark.createDataFrame(wanted, "q long, id long")).collect()}
    place = {(q, i): k for q, _ in QUERIES for k, (_, i) in enumerate(order(want, q), 1)}
    assert got == {x: place[x] for x in wanted}


def test_fusion_equals_fusion_of_whole_lists(spark):
    docs = corpus()
    rng = np.random.default_rng(1)
    vectors = {i: rng.standard_normal(4) if i % 7 else None for i, _ in docs}
    meant = {q: rng.standard_normal(4) for q, _ in QUERIES}
    v = spark.createDataFrame([(i, None if x is None else x.tolist()) for i, x in vectors.items()], "id long, v array<double>")
    m = spark.createDataFrame([(q, 0, x.tolist()) for q, x in meant.items()], "q long, s int, v array<double>")
    texts, queries = asked(spark, docs, QUERIES)
    cos = {(q, i): 0.0 if vectors[i] is None else round(float(vectors[i] @ meant[q] / np.sqrt(vectors[i] @ vectors[i]) / np.sqrt(meant[q] @ meant[q])), 6) for q in meant for i in vectors}
    one, two = plain_scores(docs, QUERIES), cos
    got = R.rank(R.fused([texts, v], [queries, m], 5), 5, 8).collect()
    for q, _ in QUERIES:
        total = Counter()
        for run in (one, two):
            for k, (_, i) in enumerate(sorted((-s, i) for (p, i), s in run.items() if p == q), 1):
                total[i] += 1 / (60 + k)
        want = sorted((-round(s, 8), i) for i, s in total.items())[:5]
        assert [(-round(r.score, 8), r.id) for r in sorted(got, key=lambda r: r["rank"]) if r.q == q] == want


@pytest.mark.parametrize("seed", [1, 2])
def test_reranking_equals_the_loop(spark, seed):
    docs = [(i, t) for i, t in corpus(60, seed) if t is not None] + [(500 + i, "w0 w1 w2 rare1") for i in range(3)]
    want, toks = plain_scores(docs, QUERIES), {i: set(t.split()) for i, t in docs}
    got = {}
    for r in R.mmr_whole(*asked(spark, docs, QUERIES), 4).collect():
        got.setdefault(r.q, {})[r.pick] = r.id
    for q, _ in QUERIES:
        mine = {i: s for (k, i), s in want.items() if k == q}
        lo, hi, chosen = min(mine.values()), max(mine.values()), []
        jac = lambda a, b: len(toks[a] & toks[b]) / len(toks[a] | toks[b]) if toks[a] | toks[b] else 0.0
        for _ in range(4):
            rel = lambda i: 1.0 if hi == lo else (mine[i] - lo) / (hi - lo)
            chosen.append(min((i for i in mine if i not in chosen), key=lambda i: (-round(0.7 * rel(i) - 0.3 * max((jac(i, c) for c in chosen), default=0.0), 9), -mine[i], i)))
        assert [got[q][k] for k in (1, 2, 3, 4)] == chosen, q
