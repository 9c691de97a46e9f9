"""Hand-computed cases of retrieval, matching and statistics."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import responses as A
from lodestone.functions import scan
from lodestone.functions import text as X
from lodestone.functions.stem import stem
from lodestone.operators import blockmax, matching as M
from lodestone.operators import retrieval as R
from lodestone.operators import stats as S


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([(4, "Größe_7 of ships; OF Ships?")], "id int, text string")
    assert df.select(R.token_array(F.col("text")).alias("t")).first().t == ["größe", "7", "of", "ships", "of", "ships"]
    assert [r.t for r in R.tokens(df, "id", "text", ["of"]).collect()] == ["größe", "7", "ships", "ships"]
    assert [stem(w) for w in ("ships", "sailing", "navigational", "steadily", "skis", "conditional", "rubbing", "dying", "news")] == ["ship", "sail", "navig", "steadili", "ski", "condit", "rub", "die", "news"]


def test_bm25_worked_by_hand(spark):
    """Two documents of four have "oak": idf ln(2.5/2.5) = 0; "elm" in one: ln(3.5/1.5).  Lengths are 2, 4, 2, 2 and 2.5 on average."""
    docs = spark.createDataFrame([(1, "oak elm"), (2, "oak ash ash yew"), (3, "fir fir"), (4, "fir yew")], "id int, text string")
    q = R.query_terms(spark.createDataFrame([(9, "Elm oak"), (8, "birch")], "q int, text string"), "q", "text")
    ix = R.index(docs, "id", "text")
    got = {r.id: r.score for r in R.bm25(ix, q).collect()}
    norm = 1.5 * (0.25 + 0.75 * 2 / 2.5)
    assert got == {1: pytest.approx(math.log(3.5 / 1.5) * 2.5 / (1 + norm)), 2: pytest.approx(0.0)}
    assert {r.q: r.self for r in R.bm25_self(ix, q).collect()} == {9: pytest.approx(got[1])}
    every = R.rank(R.with_zeros(R.bm25(ix, q), spark.createDataFrame([(9,), (8,)], "q int"), docs.select("id"), 4), 4)
    assert rows(every, "q", "rank", "id") == [(8, 1, 1), (8, 2, 2), (8, 3, 3), (8, 4, 4), (9, 1, 1), (9, 2, 2), (9, 3, 3), (9, 4, 4)]
    top = blockmax.top(ix["docs"], R.bm25_queries(ix, q, spark.createDataFrame([(9,), (8,)], "q int")), 4)
    assert rows(top, "q", "rank", "id") == rows(every, "q", "rank", "id") and {r.id: r.score for r in top.collect() if r.q == 9 and r.id == 1} == {1: pytest.approx(got[1], abs=1e-6)}


@pytest.mark.parametrize("k", [None, 3])
def test_nearest_equals_plain_cosines(spark, monkeypatch, k):
    import numpy as np

    monkeypatch.setattr(R, "QUERY_BYTES", 300)  # several blocks
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 5)).round(1)
    rows_ = [(i, v.tolist()) for i, v in enumerate(x)] + [(60, x[3].tolist()), (61, None), (62, [0.0] * 5), (63, [1.0, 2.0]), (64, [None] * 5), (65, [float("nan")] * 5)]
    v = spark.createDataFrame(rows_, "id long, v array<double>").repartition(3)
    got = R.nearest(v.where("id % 10 = 0").select(F.col("id").alias("q"), "v"), v, k)
    got = R.rank(got, k).collect()
    y = np.vstack([x, x[3]])
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    for q in range(0, 61, 10):
        want = sorted(((-round(float(y[q] @ y[i]), 6), i) for i in range(61) if i != q))[:k]
        assert [(-round(r.score, 6), r.id) for r in sorted((r for r in got if r.q == q), key=lambda r: r.rank)] == want


def test_similar_pairs_and_classes(spark):
    rng = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    base = [[rng.choice(words) for _ in range(rng.randint(1, 25))] for _ in range(12)]
    texts = [" ".join(rng.sample(b, len(b)) if rng.random() < 0.4 else [w if rng.random() < 0.95 else rng.choice(words) for w in b]) for b in base for _ in range(4)] + ["", "w1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    toks = R.tokens(docs, "id", "text")
    n, tf = len(texts), [{w: x.split().count(w) for w in x.split()} for x in texts]
    idf = {w: math.log((1 + n) / (1 + sum(w in x for x in tf))) + 1 for x in tf for w in x}
    vec = [{w: (1 + math.log(f)) * idf[w] for w, f in x.items()} for x in tf]
    cos = lambda a, b: sum(a[w] * b.get(w, 0) for w in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values())) if a and b else 0
    want = {(a, b): pytest.approx(cos(vec[a], vec[b]), abs=1e-6) for a in range(n) for b in range(a + 1, n) if round(cos(vec[a], vec[b]), 6) >= 0.6}
    assert {(r.a, r.b): r.sim for r in R.similar_pairs(R.tfidf(toks, docs), 0.6).collect()} == want
    rep = {r.id: r.rep for r in R.classes(toks).collect()}
    assert rep == {i: min(j for j in range(n) if tf[j] == tf[i]) for i in range(n) if tf[i]}
    few = {(r.a, r.b) for r in R.similar_pairs(R.tfidf(toks, docs, spark.createDataFrame([(i,) for i in set(rep.values())], "id long")), 0.6).collect()}
    assert few == {p for p in want if rep[p[0]] == p[0] and rep[p[1]] == p[1]}


def test_leave_one_out_equals_refit(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(25)]
    texts = [(k, " ".join(rng.choice(words[: rng.randint(3, 25)]) for _ in range(rng.randint(1, 30)))) for k in range(14)]
    docs = spark.createDataFrame(texts, "id int, text string")
    index = R.index(docs, "id", "text")
    loo = {(r.q, r.id): r.score for r in blockmax.scores(index["docs"], R.bm25_leave_one_out(index, docs.select(F.col("id").alias("q"))), 9).collect()}
    for q in (0, 5, 13):
        rest = docs.where(F.col("id") != q)
        refit = R.bm25(R.index(rest, "id", "text"), R.query_terms(docs.where(F.col("id") == q), "id", "text"))
        for r in refit.collect():
            assert loo.get((r.q, r.id), 0.0) == pytest.approx(r.score, abs=1e-8)


def run(spark, q, ids):
    return spark.createDataFrame([(q, i, k) for k, i in enumerate(ids, 1)], "q int, id string, rank int")


def test_fusion(spark):
    """A document that only one ranking has gets that one's share; equal sums go by the smaller id."""
    f = R.reciprocal_rank_fusion([run(spark, 5, "pqr"), run(spark, 5, "rp")])
    assert {r.id: round(r.score, 9) for r in f.collect()} == {"p": round(1 / 61 + 1 / 62, 9), "q": round(1 / 62, 9), "r": round(1 / 63 + 1 / 61, 9)}
    tie = R.rank(R.reciprocal_rank_fusion([run(spark, 5, "nm"), run(spark, 5, "mn")]), digits=9)
    assert [(r.id, r.rank) for r in tie.orderBy("rank").collect()] == [("m", 1), ("n", 2)]


def test_rank_ties(spark):
    s = spark.createDataFrame([(1, "b", 1.0), (1, "a", 1.0), (1, "c", 2.0)], "q int, id string, score double")
    assert [r.id for r in R.rank(s).orderBy("rank").collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("weight,order", [(1.0, "stu"), (0.6, "sut"), (0.0, "suv")])
def test_mmr(spark, weight, order):
    """s and t share both words, u has one of them, v none; with all weight on relevance the base order stays, with none the least alike is taken, ties in the base order."""
    c = [(1, "s", 1, 9.0, ["k", "l"]), (1, "t", 2, 8.0, ["k", "l"]), (1, "u", 3, 7.0, ["m"]), (1, "v", 4, 1.0, ["n"])]
    df = spark.createDataFrame(c, "q int, id string, rank int, score double, toks array<string>")
    got = R.mmr(R.min_max(df).select("q", "id", "rank", F.col("norm").alias("rel"), "toks"), 3, weight)
    assert "".join(r.id for r in got.orderBy("pick").collect()) == order


def test_mmr_chooses_among_the_whole_ranking(spark, tmp_path):
    from lodestone.plans import registry

    texts = ["red fox jumps over one lazy dog"] * 25 + ["red red red fox fox fox jumps jumps jumps over over over one one one kite moon"] + [f"other words {k} are here for all" for k in range(300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "red fox jumps over one lazy dog")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.pick: r.doc_id for r in registry.QUERIES["mmr_top3"](spark, str(tmp_path)).collect()}
    assert got[1] == 0 and 25 in got.values() and len(set(got.values())) == 3


def test_camel(spark):
    from lodestone.plans.retrieval_queries import camel

    df = spark.createDataFrame([("XMLNodeReader12b",), ("tax_Rate__EU",), ("",)], "s string")
    assert [r.c for r in df.select(camel(F.col("s")).alias("c")).collect()] == [["xml", "node", "reader", "12", "b"], ["tax", "rate", "eu"], []]


def test_matching_is_the_same_in_any_order(spark):
    rng = random.Random(2)
    gold = [(1, k, rng.choice("ab"), rng.choice("xyz")) for k in range(12)]
    found = [(1, k, rng.choice("ab"), rng.choice("xyz")) for k in range(10)]
    schema = "ex int, id int, pair string, typ string"
    want = None
    for _ in range(4):
        rng.shuffle(gold), rng.shuffle(found)
        g, f = spark.createDataFrame(gold, schema).repartition(3), spark.createDataFrame(found, schema).repartition(2)
        got = rows(M.match_passes(g, f, ["ex"], [["pair", "typ"], ["pair"]], ["id"]), "gid", "fid", "pass")
        want = want or got
        assert got == want
    assert len({a for a, _, _ in want}) == len(want) == len({b for _, b, _ in want})
    same = M.match_passes(g, g, ["ex"], [["pair", "typ"], ["pair"]], ["id"])
    assert rows(same, "gid", "fid") == sorted((k, k) for _, k, _, _ in gold)


def test_counts_and_undefined_ratios(spark):
    g = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "ex int, k string")
    f = spark.createDataFrame([(1, "a"), (1, "c"), (3, "d")], "ex int, k string")
    got = {r.ex: r for r in M.key_counts(g, f, ["ex"], ["k"]).select("ex", "tp", "fp", "fn", M.precision().alias("p"), M.recall().alias("r"), M.f1().alias("f")).collect()}
    assert (got[1].tp, got[1].fp, got[1].fn) == (1, 1, 2)
    assert (got[2].p, got[2].r, got[2].f) == (None, 0.0, 0.0) and (got[3].p, got[3].r, got[3].f) == (0.0, None, 0.0)


def test_assignment_is_optimal(spark):
    from itertools import permutations

    rng = random.Random(3)
    w = {(a, b): rng.random() for a in range(5) for b in range(5)}
    got = M.assign(spark.createDataFrame([(1, a, b, x) for (a, b), x in w.items()], "g int, a int, b int, w double"), "g", 0.0).collect()
    assert sum(r.w for r in got) == pytest.approx(max(sum(w[a, p[a]] for a in range(5)) for p in permutations(range(5))))


def test_assignment_by_components(spark):
    """Pairs fall into components above the threshold; the sum is that of the best assignment of the whole group."""
    from itertools import permutations

    rng = random.Random(8)
    w = {(g, a, b): rng.choice([0.2, 0.5, 0.9, rng.random()]) for g in "xy" for a in range(6) for b in range(5) if rng.random() < 0.35}
    got = M.assign(spark.createDataFrame([(*k, x) for k, x in w.items()], "g string, a int, b int, w double").repartition(3), "g", 0.4).collect()
    assert all(r.w == w[r.g, r.a, r.b] >= 0.4 for r in got) and len({(r.g, r.a) for r in got}) == len({(r.g, r.b) for r in got}) == len(got)
    for g in "xy":
        best = max(sum(x for b, a in enumerate(p) if (x := w.get((g, a, b), 0.0)) >= 0.4) for p in permutations(range(6), 5))
        assert sum(r.w for r in got if r.g == g) == pytest.approx(best)
    chain = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("z1", "z2"), ("z9", "z9")]
    label = {r.x: r.c for r in M.components(spark.createDataFrame(chain, "u string, v string")).collect()}
    assert {label[f"n{k:03d}"] for k in range(61)} == {"n000"} and label["z2"] == "z1" and label["z9"] == "z9"
    assert M.assign(spark.createDataFrame([], "g string, a int, b int, w double"), "g", 0.4).collect() == []


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 1.0), (1, 2.0, 4.0), (1, 4.0, 3.0), (2, 1.0, 1.0), (2, 1.0, 2.0)], "g int, x double, y double")
    got = {r.g: r for r in S.spearman(df, "x", "y", "g").collect()}
    # ranks 1, 2.5, 2.5, 4 and 2, 1, 4, 3: 1.5 / sqrt(4.5 * 5)
    assert got[1].rho == pytest.approx(1.5 / math.sqrt(22.5), abs=1e-9) and got[2].rho is None
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03), ("f", "d", 0.03)], "f string, k string, p double")
    assert {r.k: round(r.holm, 6) for r in S.holm(p, "p", "f", tie="k").collect()} == {"a": 0.04, "c": 0.09, "d": 0.09, "b": 0.09}
    d = spark.createDataFrame([(k, "a", "b", x) for k, x in enumerate([1.0, -2.0, 3.0, 0.0, 3.0])], "u int, a string, b string, d double")
    r = S.signed_ranks(d).first()
    assert (r.n, r.up, r.down) == (4, 8.0, 2.0)
    assert S.student_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and S.student_two_sided(0, 5) == 1


def test_paired_p_values():
    """W = 2 of four differences: 3 of 16 sign patterns have a sum of 2 or less, doubled.  The largest W possible has p 1."""
    assert S.wilcoxon_two_sided(2, 4, 0) == pytest.approx(6 / 16) and S.wilcoxon_two_sided(0, 5, 0) == pytest.approx(2 / 32) and S.wilcoxon_two_sided(5, 4, 0) == 1
    mean, spread = 60 * 61 / 4, math.sqrt(60 * 61 * 121 / 24 - (2**3 - 2) / 48)
    assert S.wilcoxon_two_sided(mean - 1.959964 * spread, 60, 6) == pytest.approx(0.05, abs=1e-6)
    exact, near = S.wilcoxon_two_sided(400, 50, 0), S.wilcoxon_two_sided(400, 51, 0)
    assert exact == pytest.approx(math.erfc(abs(400 - 637.5) / math.sqrt(50 * 51 * 101 / 24) / math.sqrt(2)), rel=0.06) and near < exact
    assert S.student_two_sided(12.706205, 1) == pytest.approx(0.05, abs=1e-6)


def test_tournament_breaks_ties_in_order(spark):
    rows_ = [(1, "a", 0.900, 3.0, 5.0), (1, "b", 0.905, 3.0, 7.0), (1, "c", 0.899, 2.0, None), (1, "d", 0.2, 0.0, 0.0), (1, "e", 0.2, 0.0, 0.0)]
    got = S.tournament(spark.createDataFrame(rows_, "g int, name string, m1 double, slow double, fine double"), "g", 0.01, (("slow", -1), ("fine", 1))).orderBy("place").collect()
    assert [(r.name, r.decided_by) for r in got] == [("c", "slow"), ("b", "fine"), ("a", "m1"), ("d", "name"), ("e", "m1")]


def test_compare_elements_equals_loops(spark):
    """Against a plain version: names in order, relations pair by pair, generalisations as a multiset."""
    rng = random.Random(12)
    token_set = lambda n: " ".join(sorted({w.rstrip("s").lower() for w in n.split("_") if w}))
    bare = lambda n: "".join(c for c in n.lower() if c.isalnum())
    name = lambda: "_".join(rng.choice(["car", "cars", "Key", "key", "lock"]) for _ in range(rng.randint(1, 2))) if rng.random() < 0.9 else "--"
    kinds = [*M.STRUCTURAL[:3], *M.GENERAL[:1]]

    def diagram():
        classes = [(1, i, name()) for i in range(rng.randint(1, 6))]
        return classes, [(1, c, c * 10 + k, name()) for _, c, _ in classes for k in range(rng.randint(0, 3))], [(1, i, rng.choice(classes)[1], rng.choice(classes)[1], rng.choice(kinds)) for i in range(rng.randint(0, 9))]

    def match(gold, found, keys):
        pairs = []
        gold, found = ([x for x in sorted(s, key=lambda x: (bare(x[1]), x[1], x[0])) if bare(x[1])] for s in (gold, found))
        for key in keys:
            for g in list(gold):
                if f := next((f for f in found if key(f[1]) == key(g[1])), None):
                    pairs.append((g[0], f[0]))
                    gold.remove(g), found.remove(f)
        return pairs

    for _ in range(3):
        (gc, ga, ge), (fc, fa, fe) = diagram(), diagram()
        want = {}
        for level, keys in (("exact", [bare]), ("relaxed", [bare, token_set])):
            pairs = match([x[1:] for x in gc], [x[1:] for x in fc], keys)
            of = {f: g for g, f in pairs}
            want[level, "classes"] = (len(pairs), len(fc), len(gc))
            tp = sum(len(match([x[2:] for x in ga if x[1] == g], [x[2:] for x in fa if x[1] == f], keys)) for g, f in pairs)
            want[level, "attributes"] = (tp, sum(bool(bare(x[3])) for x in fa), sum(bool(bare(x[3])) for x in ga))
            tp, left = 0, [(of[s], of[t], k) for _, _, s, t, k in fe if k in M.STRUCTURAL and s in of and t in of]
            gold = [(s, t, k) for _, _, s, t, k in ge if k in M.STRUCTURAL]
            for same in (True, False):
                for g in list(gold):
                    if f := next((f for f in left if {*f[:2]} == {*g[:2]} and ((f[2] == g[2]) == same)), None):
                        tp += 1
                        gold.remove(g), left.remove(f)
            want[level, "relations"] = (tp, sum(e[4] in M.STRUCTURAL for e in fe), sum(e[4] in M.STRUCTURAL for e in ge))
            gold, tp = [(s, t) for _, _, s, t, k in ge if k in M.GENERAL], 0
            for _, _, s, t, k in fe:
                if k in M.GENERAL and (of.get(s), of.get(t)) in gold:
                    gold.remove((of[s], of[t]))
                    tp += 1
            want[level, "generalizations"] = (tp, sum(e[4] in M.GENERAL for e in fe), sum(e[4] in M.GENERAL for e in ge))
        make = lambda g, f, s: (spark.createDataFrame(g, s), spark.createDataFrame(f, s))
        tokens = lambda n: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.split(F.lower(n), "_"), lambda w: w != ""), lambda w: F.regexp_replace(w, "s+$", "")))), " ")
        got = M.compare_elements(make(gc, fc, "ex int, id int, name string"), make(ga, fa, "ex int, cid int, id int, name string"), make(ge, fe, "ex int, id int, src int, tgt int, typ string"), tokens).collect()
        made = {(r.level, r.kind): (r.tp, r.tp + r.fp, r.tp + r.fn) for r in got}
        assert made == {k: v for k, v in want.items() if k in made} and all(v == (0, 0, 0) for k, v in want.items() if k not in made)


def one(spark, text, *cols):
    r = spark.createDataFrame([(text, ["Price"])], "s string, declared array<string>").select(*cols).first()
    return r[0] if len(r) == 1 else tuple(r)


def test_notations(spark):
    s, declared = F.col("s"), F.col("declared")
    assert [one(spark, x, X.norm_mult(s)) for x in (" 2 .. N ", "1..1", None, "3", "N")] == ["2..*", "1", "", "3", "*"]
    assert [one(spark, x, X.norm_mult_etl(s)) for x in ("0..*", "2....n", None, "N", "n..1")] == ["0..*", "2..*", None, "*", "n..1"]
    assert [one(spark, x, X.normalize_type(s, declared)) for x in ("Bool[]", "Phone", "Price", "Text[][]", "text", "Order")] == ["boolean[]", "string", "Price", "string[][]", "text", "Order"]
    assert one(spark, "~ {Read-Only, static} const Int  MAX = a = b", *X.parse_attribute(s)) == ("MAX", "Int", "a = b", ["read-only", "static", "const"])
    assert one(spark, "#due : Date", *X.parse_attribute(s)) == ("due", "Date", None, []) and one(spark, "", *X.parse_attribute(s)) == ("", "", None, [])
    assert [one(spark, x, X.method_signature(s, declared)) for x in ("- Bool ok(a)", "go(x, y)::Integer", "stop", "run()")] == ["+ ok(a) : boolean", "+ go(x, y) : int", "+ stop", "+ run()"]
    assert one(spark, " 1..* {unique}  big  owner", *X.mult_role(s)) == ("1..*", "big owner") and one(spark, "{xor}", *X.mult_role(s)) == ("", "")
    assert [one(spark, x, X.reading_direction(s)) for x in ("leads >", "<of", "<<x>>", "a->", ">", " plain ")] == ["leads", "of", "<<x>>", "a->", ">", "plain"]
    assert one(spark, 'X "3..n" -- "1..1" Y', X.quoted_multiplicities(s)) == 'X "3..*" -- "1" Y'


def test_scanners():
    assert scan.balanced('x {"p":"{"} y {"q":[{"r":0}]} {"s"') == ['{"p":"{"}', '{"q":[{"r":0}]}']
    assert scan.apply_script(["m", "n"], [("rename", "n", "o"), ("add", "p", ""), ("move_first", "p", ""), ("suffix", "z", "_")]) == (["p", "m", "o"], "suffix: z not found")
    schema = scan.inline({"type": "object", "required": ["k"], "properties": {"k": {"$ref": "#/$defs/n"}}, "additionalProperties": False, "$defs": {"n": {"type": "array", "items": {"type": "integer", "minimum": 2}}}})
    assert scan.schema_errors({"k": [2, 3.0]}, schema) == [] and scan.schema_errors({"k": [1, "x"], "l": 0}, schema) == ["$.k[0]: too small", "$.k[1]: not integer", "$.l: unknown"] and scan.schema_errors({}, schema) == ["$.k: missing"]
    assert scan.schema_errors(True, {"type": ["integer", "string"]}) == ["$: not integer or string"] and scan.schema_errors("ab", {"enum": ["a"], "pattern": "^b"}) == ["$: value not allowed", "$: pattern"]


def test_json_of_responses(spark):
    cases = {
        ' {"p":1}\n': ('{"p":1}', "raw", False), "": (None, "", False), "words": (None, "", True), 'say ```\nnope\n``` and ```JSON\n[2]\n``` {"longer":"object"}': ("[2]", "fence", True), "say ```\nnope\n```": ("nope", "fence", True),
        '{bad} {"ok":1} {worse here}': ('{"ok":1}', "braces", True), "{bad one}": ("{bad one}", "raw", False), '{"a":1} {"b":22}': ('{"b":22}', "braces", True), "```json\n[1] tail\n```": ("[1] tail", "fence", True), None: (None, "", False),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = {r.i: (r.x.json, r.x.method, r.x.extra) for r in df.select("i", A.json_of(F.col("t")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    values = {"1": True, "[1]": True, "[1] x": False, "1, 2": False, "": False, "1] , [2": False, '1}, {"k":2': False, '"a"': True, "nope": False, '{"a":[]}': True}
    df = spark.createDataFrame([(x,) for x in values], "x string")
    assert {r.x: r.ok for r in df.select("x", A.decodes(F.col("x")).alias("ok")).collect()} == values


def test_files(spark, tmp_path):
    from lodestone.sources import tables as T

    (tmp_path / "a.jsonl").write_text('{"x":1,"y":"p"}\n\n{"x":2}\n')
    assert rows(T.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x long, y string").na.fill(""), "x", "y") == [(1, "p"), (2, "")]
    for folder in ("m2", "m1", "_skip"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "t.txt").write_text(f"of {folder}\nend")
    assert [(r.folder, r.name, r.content) for r in T.read_folder(spark, str(tmp_path / "in" / "*" / "t.txt")).collect()] == [("m1", "t.txt", "of m1\nend"), ("m2", "t.txt", "of m2\nend")]
    T.write_csv(spark.createDataFrame([(1, 0.123456, None)], "a int, b double, c string"), str(tmp_path / "csv"))
    assert {x for p in (tmp_path / "csv").glob("*.csv") for x in p.read_text().split()} == {"a,b,c", "1,0.1235,"}
    for k in (1, 2):
        T.append_jsonl(spark.createDataFrame([(k,)], "call int"), str(tmp_path / "log"))
    done = T.read_jsonl(spark, str(tmp_path / "log"), "call int")
    assert rows(spark.range(4).select(F.col("id").cast("int").alias("call")).join(done, "call", "left_anti"), "call") == [(0,), (3,)]
    (tmp_path / "ops.yaml").write_text("# edits\n- op: rename\n  from: 'a b'\n\n- op: drop\n  why: \"x: y\"\n  note:\n")
    got = T.read_ops(spark, str(tmp_path / "ops.yaml")).orderBy("pos").collect()
    assert [(r.pos, r.op) for r in got] == [(1, {"op": "rename", "from": "a b"}), (2, {"op": "drop", "why": "x: y", "note": ""})]
    frozen = spark.createDataFrame([("q", "r", 2, [3, 4], [1.0, 0.5], [1.0, 1.0])] + [("z", "r", 1, [5], [1.0], [1.0])] * 2, "query string, retriever string, k int, ids array<int>, scores array<double>, score_norm array<double>")
    frozen = frozen.withColumn("digest", F.when(F.col("query") == "q", T.content_digest_of(F.col("ids"))).otherwise(T.content_digest_of(F.col("ids"))))
    assert sorted((r.query, r.ok) for r in T.verified(frozen).collect()) == [("q", True), ("z", False), ("z", False)]


def test_grid_without_stems_is_part_of_the_whole(spark, tmp_path):
    from lodestone.plans import registry

    from .conftest import TINY

    part = {tuple(r) for r in registry.QUERIES["bm25_grid"](spark, TINY).select("stop", "k1", "b", "at1", "at3").collect()}
    whole = registry.QUERIES["bm25_grid48"](spark, TINY).collect()
    assert len(whole) == 48 and len(part) == 24 and {(r.stop, r.k1, r.b, r.at1, r.at3) for r in whole if not r.stem} == part


def test_token_counts(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.functions.tokens import VOCABULARY, token_count

    path = str(public_tokenizers.path(VOCABULARY))
    texts = ["a plain sentence, with Größe", "", None, "x" * 5000, "\n\t  spaces"]
    plain = Tokenizer.from_file(path)
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", token_count("s").alias("n"), token_count("s", path).alias("m")).orderBy("i").collect()
    assert [r.n for r in got] == [r.m for r in got] == [len(plain.encode(x or "", add_special_tokens=False)) for x in texts]


def test_stopword_file(spark, tmp_path):
    from lodestone.plans import retrieval_queries as Q

    (tmp_path / "stop.txt").write_text("kite\n\n moon \n")
    assert Q.stopwords(spark) == Q.STOP
    spark.conf.set("spark.lodestone.stopwords", str(tmp_path / "stop.txt"))
    try:
        assert sorted(Q.stopwords(spark)) == ["kite", "moon"]
    finally:
        spark.conf.unset("spark.lodestone.stopwords")


def test_progress_stream(spark, tmp_path):
    from lodestone.streaming import resume

    (tmp_path / "in").mkdir()
    line = '{"call_id":"%s","condition":"%s","level":%d,"latency_s":%d,"timestamp":"2024-01-01T00:0%d:00Z"}'
    (tmp_path / "in" / "a.json").write_text("\n".join([line % ("1", "x", 3, 2, 1), line % ("2", "x", 1, 4, 2), line % ("1", "x", 3, 2, 1), line % ("3", "y", 4, 1, 3)]))
    q = resume.progress(resume.manifest_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    (tmp_path / "in" / "b.json").write_text('{"call_id":"9","condition":"z","level":0,"latency_s":1,"timestamp":"2024-01-02T00:00:00Z"}')
    q.processAllAvailable()
    q.stop()
    assert sorted((r.condition, r.done, r.valid, r.latency_s) for r in spark.table("progress").collect()) == [("x", 2, 1, 3.0), ("y", 1, 1, 1.0)]


def test_stream_keeps_calls_once(spark, tmp_path):
    from lodestone.streaming import resume

    (tmp_path / "in").mkdir()
    line = '{"call_id":"%s","condition":"x","level":%d,"latency_s":1.0,"timestamp":"2024-01-01T00:0%d:00Z"}'
    (tmp_path / "in" / "a.json").write_text("\n".join([line % ("1", 3, 1), line % ("2", 1, 2), line % ("1", 3, 1)]))
    q = resume.done_calls(resume.manifest_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("calls").count() == 2
