"""Learned partitions, conversation trie and vector codes against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from lodestone.llm import codes, partitions, tree
from lodestone.llm.shared import table

TINY = "/root/testdata/sf0.001"
SOME = "/root/testdata/sf0.1"

# ---------------------------------------------------------------- trie


def brute_tree(rows, block=20):
    """[(conv_id, turn, role, text)] -> {node: ...}, by paths."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((0, 0) if turn is None else (1, turn), role or "", text or ""))
    own = {c: [r[1:] for r in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - (c % block if c >= 0 else -(-c % block)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        kids = lambda p: [x for x in members if len(x) == len(p) + 1 and x[: len(p)] == p]
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        ends = ",".join(map(str, sorted(c for c in convs if len(built[c]) == len(path))))
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids(path)), sum(not kids(p) for p in under), sum((len(members[p]) - 1) * words(p) for p in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed):
    rng = random.Random(seed)
    texts = ["", "a", "b c", "a\tb\n c", "ä ö", None, "the same first turn"]
    rows = []
    for c in rng.sample(range(-45, 90), 50):
        for turn in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([turn, turn, None, 1]), rng.choice(["user", "user", None, "tool"]), rng.choice(texts)))
    rows += [(100 + k, 1, "user", "x y") for k in range(30)] + [(7, 0, "user", "a")] * 3 + [(None, 0, "user", "z")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def tree_rows(spark, rows, **how):
    return sorted(map(tuple, tree.conversation_tree(spark.createDataFrame(rows, SCHEMA), **how).collect()), key=str)


@pytest.mark.parametrize("how", [{}, {"base": 1}, {"bits": 1}, {"base": 3, "bits": 2}, {"base": 1, "bits": 1}])
def test_tree_equals_brute_force_whatever_collides(spark, how):
    rows = conversations(len(how) + 1)
    assert tree_rows(spark, rows, **how) == brute_tree(rows)


def test_tree_long_conversation_over_partitions(spark):
    rows = [(0, t, "user", f"w{t % 7} x") for t in range(300)] + [(1, t, "user", f"w{t % 7} x") for t in range(200)] + [(2, 0, "user", "w0 x")]
    got = tree_rows(spark, rows)
    assert got == brute_tree(rows)


def test_tree_odd_rows(spark):
    assert tree_rows(spark, []) == []
    assert tree_rows(spark, [(None, 1, "user", "a")]) == []
    long = "word " * 100_000
    rows = [(20, 1, None, long), (21, None, "user", None), (40, 0, "user", "")]
    assert tree_rows(spark, rows) == brute_tree(rows)
    extra = spark.createDataFrame([(5, 1, "user", "a", 3, "q", "s")], SCHEMA + ", d long, f string, x string")
    assert sorted(map(tuple, tree.conversation_tree(extra).collect()), key=str) == brute_tree([(5, 1, "user", "a")])


def test_prefix_fingerprints():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    starts = np.array([0, 1, 40, 499])
    got = tree.prefixes(t, starts, tree.BASE)
    f = 0
    for i, x in enumerate(t.tolist()):
        f = ((0 if i in starts else f) * tree.BASE + x) % (1 << 64)
        assert f == int(got[i])


# ---------------------------------------------------------------- codes


def brute_codes(rows):
    """[(vec_id, vector, label)] -> ({vec_id: (code, error, label_error)}, digest)."""
    kept = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    step = len(kept[0][1]) // 16
    part = lambda v, p: v[p * step : (p + 1) * step]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min(range(len(books[p])), key=lambda j: (dist(part(v, p), books[p][j]), j)) for p in range(16)] for _, v, _ in kept]
    for _ in range(2):
        code = assign()
        for p in range(16):
            for j in range(len(books[p])):
                own = [part(v, p) for (_, v, _), c in zip(kept, code, strict=True) if c[p] == j]
                if own:
                    books[p][j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    code = assign()
    errors = [sum(dist(part(v, p), books[p][c[p]]) for p in range(16)) for (_, v, _), c in zip(kept, code, strict=True)]
    of = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        of[lab] = of.get(lab, 0) + e
    out = sorted((i, "".join(f"{x:02x}" for x in c), e, of[lab]) for (i, _, lab), c, e in zip(kept, code, errors, strict=True))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


VECTORS = "vec_id long, embedding array<float>, label int"


def code_rows(spark, rows):
    rows, books = codes.compress(spark.createDataFrame(rows, VECTORS).repartition(3))
    each = rows.collect()
    of = {}
    for r in each:
        of[r.label] = of.get(r.label, 0) + r.error
    return sorted((r.vec_id, bytes(r.code).hex(), r.error, of[r.label]) for r in each), codes.digest(books) if books is not None else None


@pytest.mark.parametrize("seed", [1, 2])
def test_codes_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    n = 40 if seed == 1 else 200  # fewer rows than entries, and more
    rows = [(int(i), [float(x) for x in np.round(rng.standard_normal(32) * 0.05, 2)], int(rng.integers(0, 3)) if i % 5 else None) for i in rng.permutation(n)]
    rows += [(500 + k, rows[0][1], 1) for k in range(60)] + [(900, None, 1), (901, [1.0, None] * 16, 1), (902, [float("nan")] * 32, 1), (903, [float("inf")] * 32, 1), (904, [], 1), (905, [-0.0] * 32, None)]
    assert code_rows(spark, rows) == brute_codes([r for r in rows if r[1] != []])


def test_codes_odd_rows(spark):
    assert code_rows(spark, []) == ([], None)
    assert code_rows(spark, [(1, [1.0] * 15, 1)]) == ([], None)
    assert code_rows(spark, [(1, None, 1)]) == ([], None)
    got, _ = code_rows(spark, [(1, [1.0] * 16, 1), (1, [1.0] * 16, 1), (2, [3.0] * 32, 1)])
    assert [r[:3] for r in got] == [(1, "00" * 16, 0)] * 2
    unnamed = codes.compress(spark.createDataFrame([(1, [1.0] * 16, 1), (None, [2.0] * 16, None)], VECTORS))[0].collect()
    assert {(r.vec_id, bytes(r.code).hex()) for r in unnamed} == {(1, "00" * 16), (None, "01" * 16)}
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 1)], VECTORS))
    more = spark.createDataFrame([(1, [1.0] * 16, 1, "x", "y")], VECTORS + ", code string, v string")
    assert codes.compress(more)[0].count() == 1


def test_exponion_looks_at_few_entries():
    rng = np.random.default_rng(3)
    book = rng.integers(-3000, 3000, (64, 4))
    x = book[rng.integers(0, 64, 5000)] + rng.integers(-80, 80, (5000, 4))
    want = ((x[:, None, :] - book[None]) ** 2).sum(2)
    best, low, _ = codes.nearest_entries(x, np.zeros(len(x), np.int64), book)
    assert (best == want.argmin(1)).all() and (low == want.min(1)).all()
    again, _, looked = codes.nearest_entries(x, best, book)
    assert (again == best).all() and looked < 4 * len(x)
    assert (codes.nearest_entries(x, rng.integers(0, 64, len(x)), book)[0] == want.argmin(1)).all()


# ---------------------------------------------------------------- partitions


def recall(rows, ids, x, k=5):
    u = x / np.sqrt((x * x).sum(1))[:, None]
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        s[q] = -9
        top = set(ids[np.lexsort((ids, -np.round(s, 12)))[:k]].tolist())
        have = sorted(got[ids[q]], key=lambda r: r.rank)
        assert [r.rank for r in have] == list(range(1, k + 1))
        assert [(-r.score, r.vec_id) for r in have] == sorted((-r.score, r.vec_id) for r in have)
        for r in have:
            assert abs(r.score - s[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-9 and r.vec_id != r.query_id
        hit, total = hit + len(top & {r.vec_id for r in have}), total + k
    return hit / total


def test_recall_on_given_vectors(spark):
    t = pq.read_table(f"{SOME}/embeddings.parquet")
    ids, x = t.column("vec_id").to_numpy(), np.array(t.column("embedding").to_pylist(), dtype=np.float64)
    got = partitions.nearest(table(spark, SOME, "embeddings"), lambda i: i % 50 == 0, size=250).collect()
    assert recall(got, ids, x) >= 0.9


def clustered(n=4000, dim=16, centres=40, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return (c[rng.integers(0, centres, n)] + 0.2 * rng.standard_normal((n, dim))).astype(np.float32)


def test_recall_with_two_levels_and_copies(spark):
    x = clustered()
    x[1000:1400] = x[5]
    ids = np.arange(len(x)) * 2
    frame = spark.createDataFrame([(int(i), v.tolist(), 0) for i, v in zip(ids, x, strict=True)], VECTORS)
    got = partitions.nearest(frame, lambda i: i % 50 == 0, sample=1500, size=250, leaf=300).collect()
    assert recall(got, ids, x.astype(np.float64)) >= 0.9


def test_router_sends_queries_to_few_parts():
    x = clustered(3000)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    m = partitions.fit_router(u, 16)
    assert m["probes"] <= 6
    put = np.bincount(partitions.probabilities(u, m).argmax(1), minlength=16)
    assert put.max() < 4 * put.mean()


def test_partition_is_balanced_and_cuts_little():
    x = clustered(1000)
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    g = partitions._graph(u, 10)
    part = partitions.balanced_partition(g, 7)
    size = np.bincount(part, minlength=7)
    assert size.max() - size.min() <= 1
    assert (part[:, None] != part[g]).mean() < 0.3  # by chance 6 of 7


def test_partitions_odd_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.0, 2.0], 1), (3, [-1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (None, [1.0, 1.0], 1), (50, [2.0, 0.0], 1), (50, [2.0, 0.0], 1), (8, [], 1), (9, [1.0], 1), (100, [float("inf"), 0.0], 1)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'a' as c", "1 as leaf", "2 as low")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in partitions.nearest(frame, lambda i: i % 50 == 0).collect())
    want = [(0, 1, 1, 1.0), (0, 2, 50, 1.0), (0, 3, 2, 0.0), (0, 4, 3, -1.0), (50, 1, 0, 1.0), (50, 2, 1, 1.0), (50, 3, 2, 0.0), (50, 4, 3, -1.0)]
    assert got == want
    assert partitions.nearest(spark.createDataFrame([], VECTORS), lambda i: i % 50 == 0).collect() == []
