"""TF-IDF pairs of items and documents are found where the documents lie."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import bags
from lodestone.operators import retrieval as R

from .conftest import TINY
from .test_growth import plan
from .test_round3 import against_sql


def test_leakage_shuffles_no_postings(spark):
    """Neither words of all documents nor pairs of words are dealt out or joined: what is left in the last plan are the candidates."""
    p = plan(spark, "tfidf_leakage", TINY)
    assert "Window" not in p and "regexp_extract_all" not in p and p.count("Join") <= 4


def test_leakage_of_odd_tables(spark, tmp_path):
    """Ids that repeat, are null or on the other side, texts that are null, empty or without words, and copies, against SQL."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)] + ["Ünï", "a_b", "Σας", "x"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [text(r.randint(1, 30)) for _ in range(40)]
    docs = [text(r.randint(0, 60)) for _ in range(200)] + [r.choice(items) + " " + text(r.randint(0, 25)) for _ in range(200)] + [None, "", "x y", items[0], items[0].upper(), *[items[1]] * 30]
    ids = list(range(len(docs)))
    ids[10:13], ids[250:254], ids[300:303], ids[310] = [7, 7, 7], [9, 9, 11, 11], [None, None, None], -2
    got, want = against_sql(spark, tmp_path, "tfidf_leakage", documents={"doc_id": ids, "text": docs}, benchmark={"item_id": [*range(38), 5, -400], "text": [*items[:37], None, *items[38:]]})
    assert got == want and len(got) > 100


@pytest.mark.parametrize("items", [0, 3])
def test_leakage_without_items_or_documents(spark, tmp_path, items):
    docs = 0 if items else 3
    table = lambda n, name: {name: pa.array(range(n), pa.int64()), "text": pa.array(["one two three"] * n, pa.string())}
    got, want = against_sql(spark, tmp_path, "tfidf_leakage", documents=table(docs, "doc_id"), benchmark=table(items, "item_id"))
    assert got == want == []


@pytest.mark.parametrize("size, listed", [(1, 0), (64, 0), (64, 30), (1, 59), (bags.CELLS, 0), (bags.CELLS, bags.FREQUENT)])
def test_matches_do_not_depend_on_cells_or_blocks(spark, monkeypatch, size, listed):
    """One cell for all words, shared ones, and one for each; queries in several blocks, documents in slices: pairs and cosines are those of all pairs, at the very edge too."""
    monkeypatch.setattr(bags, "FREQUENT", listed)
    monkeypatch.setattr(bags.blockmax, "QUERIES", 7)
    monkeypatch.setattr(bags.blockmax, "TOKENS", 200)
    r = random.Random(4)
    words = [f"w{k}" for k in range(60)]
    texts = [[r.choice(words) for _ in range(r.randint(1, 20))] for _ in range(20)]
    texts += [r.choice(texts)[:] + [r.choice(words) for _ in range(r.randint(0, 10))] for _ in range(120)] + [[], None]
    tf = [{w: x.count(w) for w in x} for x in (x or [] for x in texts)]
    df = {w: sum(w in x for x in tf) for w in words}
    vec = [{w: (1 + math.log(f)) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, f in x.items()} for x in tf]
    norm = lambda a: np.sqrt(sum(x * x for x in a.values()))
    sims = {(i, j): sum(w * vec[j].get(t, 0) for t, w in vec[i].items()) / (norm(vec[i]) * norm(vec[j])) for i in range(20) for j in range(20, len(texts)) if vec[j]}
    edge = sorted(round(x, 6) for x in sims.values())[len(sims) * 9 // 10]
    rows = bags.bags(spark.createDataFrame(list(enumerate(texts)), "id long, toks array<string>").repartition(3))
    got = {(x.a, x.b): x.sim for x in bags.matches(rows, edge, F.col("id") < 20, size=size).collect()}
    assert got == {k: pytest.approx(x, abs=1e-6) for k, x in sims.items() if round(x, 6) >= edge} and len(got) > 200
    every = spark.createDataFrame([(i,) for i in range(20, len(texts))], "id long")
    found = {x.id: dict(zip(x.t, zip(x.df, x.w, strict=True), strict=True)) for x in bags.vectors(rows, len(texts), every, size).collect()}
    hashes = {r.w: r.t for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("t")).collect()}
    assert found == {i: {hashes[w]: (df[w], pytest.approx(x / norm(v))) for w, x in v.items()} for i, v in enumerate(vec) if i >= 20}


def test_edge_of_the_threshold(spark):
    """A cosine that only rounding lifts to the threshold is kept, as in SQL."""
    rows = bags.bags(spark.createDataFrame([(-1, ["a", "b"]), (1, ["a", "c"]), (2, ["d"])], "id long, toks array<string>"))
    idf = [math.log(4 / (1 + d)) + 1 for d in (2, 1)]
    exact = idf[0] ** 2 / (idf[0] ** 2 + idf[1] ** 2)
    up = math.floor(exact * 1e6 + 0.5) / 1e6
    near = bags.matches(rows, up, F.col("id") < 0).collect()
    assert [(x.a, x.b, x.sim) for x in near] == [(-1, 1, up)]
    assert bags.matches(rows, up + 1e-6, F.col("id") < 0).collect() == []


def test_known_frequencies_bound_those_that_are_not(spark, monkeypatch):
    """At most FREQUENT words are listed, the most frequent; a cell of several words holds the largest of their frequencies, negated."""
    monkeypatch.setattr(bags, "FREQUENT", 5)
    df = {t: 100 - t for t in range(1, 60)} | {-7: 1000, -8: 999, 1 << 40: 998}
    known = bags.known(spark.createDataFrame(list(df.items()), "t long, df long"), 16)
    assert set(known.words.tolist()) == {-7, -8, 1 << 40}
    got = known(np.array(list(df)))
    assert all(x == d if d > 900 else -x >= d for x, d in zip(got.tolist(), df.values(), strict=True))


def test_near_duplicates_move_no_postings(spark):
    """What shares the step of F15: words of documents are neither dealt out, sorted in windows nor joined with their weights; only heads are."""
    for name in ("near_dup_pairs", "pair_partners"):
        p = plan(spark, name, TINY)
        assert "Window" not in p and "regexp_extract_all" not in p


def test_near_duplicates_of_copies(spark, tmp_path):
    """Copies in any order of words, texts without words, and words that one document has, against SQL."""
    r = random.Random(6)
    words = [f"w{k}" for k in range(80)]
    base = [[r.choice(words) for _ in range(r.randint(1, 25))] for _ in range(40)]
    texts = [" ".join(r.sample(b, len(b)) if r.random() < 0.4 else [w if r.random() < 0.95 else f"only{r.random()}" for w in b]) for b in base for _ in range(6)] + ["", None, "x", "one two"]
    for name in ("near_dup_pairs", "pair_partners"):
        got, want = against_sql(spark, tmp_path, name, documents={"doc_id": list(range(len(texts))), "text": texts})
        assert got == want and len(got) > 30


def test_heads_leave_out_words_of_one_document(spark):
    """A word that no other document has makes no candidates, but counts for the length."""
    x = spark.createDataFrame([(1, [5, 6], [1, 2], [0.8, 0.6]), (2, [6], [2], [1.0]), (3, [], [], [])], "id long, t array<long>, df array<long>, w array<double>")
    got = x.mapInArrow(bags.heads(0.5, R.LEVELS), "id long, t long, w double, rest double, end double, at int, profile string").collect()
    assert sorted((h.id, h.t, round(h.rest, 9)) for h in got) == [(1, 6, 0.6), (2, 6, 1.0)] and all(len(h.profile) == R.LEVELS for h in got)
