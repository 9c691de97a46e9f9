"""Row operators: language, quality, contamination, packing, archives, backoff scores, vectors, personal data."""

import binascii
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import backoff, decontaminate, embeddings, langid, packing, pii, quality, warc
from lodestone.llm.shared import connected_components, shared_path


from . import brute

SCHEMA = "doc_id long, text string, score double, Items string, lang string, source string"


def frame(spark, rows, lang="en"):
    return spark.createDataFrame([(i, t, 0.5, "x", lang, None) for i, t in rows], SCHEMA)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    want = brute.union_find({x for e in edges for x in e}, edges)
    got = {r.id: r.component_id for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), "a", "b").collect()}
    assert got == {k: v for k, v in want.items() if k in got} and all(want[k] == k for k in set(want) - set(got))
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ------------------------------------------------------------------ 1


def test_network_gradient_and_fast_layout():
    rng = np.random.default_rng(0)
    net = langid.Net(rng.normal(0, 0.3, (2, 256, 12)), rng.normal(0, 0.3, (2, 4, 12)), rng.normal(0, 0.3, (2, 4, 3)), np.zeros(3), list("abc"))
    data, labels = rng.integers(0, 256, (4, 20)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        s = net.states(data).astype(float)
        y = s[0] @ net.o[0] + s[1] @ net.o[1] + net.b
        y -= y.max(-1, keepdims=True)
        return -(y - np.log(np.exp(y).sum(-1, keepdims=True)))[:, np.arange(4), labels].mean()

    grad = langid._gradient(net, data, labels)
    for name, at in (("u", (0, 2, 3)), ("u", (1, 1, 9)), ("x", (0, int(data[0, 3]), 5)), ("o", (1, 2, 1))):
        w, e = getattr(net, name), 2e-2
        w[at] += e
        up = loss()
        w[at] -= 2 * e
        down = loss()
        w[at] += e
        assert grad[name][at] == pytest.approx((up - down) / 2 / e, rel=2e-2, abs=2e-6)
    s = net.states(data)
    y = np.exp(s[0] @ net.o[0] + s[1] @ net.o[1])
    assert np.allclose((y / y.sum(-1, keepdims=True)).transpose(0, 2, 1), net.positions(data), atol=1e-5)


def test_language_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    letters = {"aa": "abcde ", "bb": "vwxyz ", "cc": "жзийк "}
    make = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randint(30, 400)))
    rows = [(i, make(k), 0.0, "x", k, None) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, 0.0, "x", "aa", None), (1001, "", 0.0, "x", None, None), (1002, "123 !!", 0.0, "x", "bb", None), (1003, "abc " * 30000, 0.0, "x", None, None), (None, "vwx", 0.0, "x", "bb", None), (3, "abcd", 0.0, "x", "aa", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    from lodestone.llm.shared import held_out

    net = langid.fit(docs, ~held_out())
    got = langid.predict(docs, net).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and by[1003].lang_pred == "aa"
    right = [by[i].lang_pred == k for i, _, _, _, k, _ in rows[:180] if by[i].held_out and i != 3]
    assert right and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(docs.limit(0), net).collect() == []
    assert {r.lang_pred for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


# ------------------------------------------------------------------ 2


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    from lodestone.llm.shared import held_out

    model = quality.fit(docs, labels, ~held_out())
    got = quality.score(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1], got[got.quality == 0]
    assert good.predicted.mean() > 0.97 and bad.predicted.mean() < 0.2
    assert docs.schema == quality.keep_good(docs, model).schema


def test_quality_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50000), (None, "a b"), (1, None)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    for have in (labels, labels.limit(0)):
        got = quality.score(docs, quality.fit(docs, have)).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).collect() == []


# ------------------------------------------------------------------ 3


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_contamination_equals_brute_force(spark, block):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcé0") for _ in range(3)) for _ in range(40)]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(k, text(rng.randint(11, 30))) for k in range(12)] + [(50, "Abc"), (51, text(4)), (52, None), (53, ""), (54, "..."), (12, items_text := text(12)), (13, items_text.upper())]
    docs = [(k, text(60)) for k in range(30)]
    docs += [(100 + k, text(5) + " " + t + " " + text(5)) for k, (_, t) in enumerate(items) if t] + [(200, None), (201, ""), (202, "abc " * 3000), (203, items[0][1][:-1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_matches(frame(spark, docs), bench, block_bytes=block).collect()
    have = {r.doc_id: (r.n_words, sum(b - a for a, b in r.hit_spans), len(r["items"]), hashlib.sha256(",".join(sorted(map(str, r["items"]))).encode()).hexdigest(), bool(r.hit_spans)) for r in got}
    want = brute.contamination(docs, items)
    assert have == want
    whole = max((m.words for r in got if r.doc_id == 100 for m in r.matches))
    assert whole >= len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", items[0][1]))
    kept = decontaminate.find_matches(frame(spark, docs), bench, block_bytes=block, only_clean=True)
    assert kept.columns == SCHEMA_NAMES and {r.doc_id for r in kept.collect()} == {i for i, v in want.items() if not v[4]}


SCHEMA_NAMES = ["doc_id", "text", "score", "Items", "lang", "source"]


def test_long_texts_in_pieces_equal_whole_ones(monkeypatch):
    """Texts beyond two shards, cut between words: quality statistics, contamination and shingle sets."""
    import pyarrow as pa
    from lodestone.llm import jaccard

    rng = random.Random(11)
    texts = [" ".join(rng.choice(["Ab", "cd", "é", "123", "x" * 90, "line\n", "!!"]) for _ in range(rng.randint(0, 400))) for _ in range(12)] + ["y" * 900, "", "a " + "z" * 800 + " b", "w"]
    column = pa.array(texts)
    known = jaccard.Frequencies(np.zeros((jaccard.ROWS, 1 << jaccard.CELL_BITS), np.float32))
    block = decontaminate.Block(["i", "j", "k"], [" ".join(texts[0].split()[20:80]), "cd 123", texts[3]], 10)

    def every():
        sets = [t[s[i] : s[i + 1]].tolist() for _, _, s, t, _ in jaccard.sets(column, known, 3) for i in range(len(s) - 1)]
        found = [(n, s, sorted(i), sorted((m["item_id"], m["item_word"], m["doc_word"], m["words"]) for m in ms)) for n, s, i, ms in decontaminate._scan(block, column)]
        return quality.statistics(column), sets, found

    whole = every()
    for module in (jaccard, decontaminate, quality):
        monkeypatch.setattr(module, "SHARD", 150)
    parts = every()
    assert np.allclose(whole[0], parts[0]) and whole[1] == parts[1] and whole[2] == parts[2]


def test_contamination_of_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words differ in every letter and are told apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    b = a.translate(str.maketrans("ab", "ba"))
    from lodestone.llm import jaccard

    got = {r.doc_id: len(r.hit_spans) for r in decontaminate.find_matches(frame(spark, [(1, a), (2, b)]), spark.createDataFrame([(1, a)], "item_id long, text string")).collect()}
    assert got == {1: 1, 2: 0}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(frame(spark, [(1, a), (2, b)])).collect()} == {1: 1, 2: 2}


def test_contamination_empty_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.find_matches(frame(spark, [(1, "a b"), (1, "a b"), (None, None)]), bench).collect()
    assert sorted(r.n_words for r in got) == [0, 2, 2] and not any(r.hit_spans for r in got)
    assert decontaminate.find_matches(frame(spark, []), bench).collect() == []


# ------------------------------------------------------------------ 6


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(k, f"http://h{k % 4}.Example.com:80/{k}?q={k}#x", f"<p>{'é' * (k % 5)}</p>") for k in range(40)] + [(100, None, None), (101, "", ""), (102, "no url \r\n x", "a\r\n\r\nb"), (103, "https://[bad/", "z" * 100000), (7, "http://h3.Example.com:80/7?q=7#x", "<p>éé</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    root = shared_path(spark, "test-warc")
    shards = warc.write_archives(pages, root)
    got = warc.read_captures(pages, root, shards, payloads=True).collect()
    assert len(got) == len(rows)
    top = defaultdict(int)
    for i, _, h in rows:
        top[h or ""] = max(top[h or ""], i)
    html = {i: h or "" for i, _, h in rows}
    for r in got:
        h, last = html[r.page_id], top[html[r.page_id]]
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), warc.digest(h.encode()))
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == last else ("revisit", last))
        assert r.payload == (h.encode() if r.page_id == last else None)
    index = warc.Index(root, shards)
    assert list(index.find("com,example,nowhere)/", "1")) == []
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example,www)/a?b"
    assert warc.write_archives(pages.limit(0), shared_path(spark, "test-warc")) == []


def test_archive_keeps_every_row(spark, monkeypatch):
    """Repeated rows, one id and URL with several payloads, null ids, and columns that clash with the operator's own."""
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(1, "http://a.b/", "x")] * 5 + [(1, "http://a.b/", "yyy"), (1, "http://a.b/#z", "wwwwwww"), (2, "http://a.b/", "x"), (None, "http://a.b/", "x"), (None, None, None), (3, "http://c/", "")]
    pages = spark.createDataFrame([(*r, "k", 1, "s") for r in rows], "page_id long, url string, html string, key string, kind int, sha string").repartition(3)
    root = shared_path(spark, "test-warc")
    got = warc.read_captures(pages, root, warc.write_archives(pages, root)).collect()
    want = []
    for i, _, h in rows:
        h = h or ""
        top = max(j for j, _, x in rows if (x or "") == h and j is not None)
        want.append((i, len(h), warc.digest(h.encode()), *(("response", None) if i == top else ("revisit", top))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


# ------------------------------------------------------------------ 7


def test_backoff_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice("a b c d e fé g1".split()) for _ in range(rng.randint(1, 30)))) for k in range(25)] + [(90, None), (91, "!!"), (3, "a b"), (None, "A b")]
    got = sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in backoff.backoff_scores(frame(spark, rows).repartition(5), slice_grams=100).collect())
    split = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for _, t in rows]
    gram = [list(zip(["<s>", *w[:-1]], w, strict=True)) if w else [] for w in split]
    c2, cu, cw = Counter(g for x in gram for g in x), Counter(g[0] for x in gram for g in x), Counter(w for x in split for w in x)
    n, want = sum(map(len, split)), []
    for (i, _), g, w in zip(rows, gram, split, strict=True):
        o2, ou, ow, s = Counter(g), Counter(x[0] for x in g), Counter(w), 0.0
        for u, x in g:
            m = c2[u, x] - o2[u, x]
            s += math.log(m / (cu[u] - ou[u])) if m else math.log(0.4 * max(cw[x] - ow[x], 1) / max(n - len(w), 1))
        want.append((str(i), len(w), round(s, 6)))
    assert got == sorted(want)
    assert backoff.backoff_scores(frame(spark, [])).collect() == []
    alone = backoff.backoff_scores(frame(spark, [(1, "a b a")])).collect()
    assert [(r.n_words, round(r.log_score, 9)) for r in alone] == [(3, round(3 * math.log(0.4), 9))]


def test_words_and_pieces_agree_and_hashes_differ():
    from lodestone.llm import shared

    rng = random.Random(8)
    morse = [bytes(97 + bin(i).count("1") % 2 for i in range(1024)), bytes(98 - bin(i).count("1") % 2 for i in range(1024))]
    for k in range(30):
        parts = [*morse, *(bytes(rng.choice([b"a", b"B", b"\xc3\xa9", b" ", b"-", b"longer-word-of-bytes", b"y" * 70])) for _ in range(rng.randint(0, 300)))]
        rng.shuffle(parts)
        raw = b" ".join(parts) if k % 2 else b"".join(parts)
        whole = np.frombuffer(raw, np.uint8)
        h, _, s, e, other = shared.words(np.array([0, len(raw)]), whole, decontaminate.LUT, 2)
        want = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower())]
        assert list(zip(s.tolist(), e.tolist(), strict=True)) == [w[:2] for w in want]
        by = {}
        for lane in (h, other):
            by = {}
            for w, x in zip(want, lane.tolist(), strict=True):
                assert by.setdefault(w[2], x) == x
            assert len(set(by.values())) == len(by)
        for most, carry in ((17, 2), (400, 9), (5000, 0)):
            got, places = [], []
            for own, lead in shared.pieces(whole, decontaminate.LUT, most, carry):
                got += own[0][lead:].tolist()
                places += own[2][lead:].tolist()
            assert got == h.tolist() and places == s.tolist()


# ------------------------------------------------------------------ 8


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 16))
    rows, at = [], 0
    for label in (0, 1, 1 << 20):
        for b in base:
            for _ in range(4):
                rows.append((at, (b + rng.normal(size=16) * rng.choice([0.02, 0.2, 0.35])).astype(np.float32).tolist(), label))
                at += 1
    rows += [(500 + k, rows[0][1], 0) for k in range(5)] + [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] * 16, 0), (603, [1.0, None] * 8, 0), (604, rows[0][1], None), (605, [], 0), (0, rows[0][1], 0)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert len(got) == len(rows)
    good = {i: (np.array(v, float), label) for i, v, label in rows if i < 600}
    ids = sorted(good)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if good[a][1] == good[b][1] and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    comp, deg = brute.union_find([*ids, *range(600, 606)], links), Counter(x for e in links for x in e)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (deg[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id), r


def test_vector_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 64)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 32))
    x = np.concatenate([x, x[:300] + rng.normal(size=(300, 32)) * 0.15])
    got = embeddings.near_duplicates(spark.createDataFrame([(k, v.astype(np.float32).tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).toPandas()
    y = x.astype(np.float32).astype(float)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    want = (np.triu(y @ y.T, 1) >= 0.93).sum()
    assert got.n_links.sum() / 2 / want >= 0.9


def test_large_group_of_near_copies_keeps_all_links(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "GROUP", 100)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=32) + rng.normal(size=(900, 32)) * 0.2, np.repeat(rng.normal(size=(60, 1, 32)), 3, 1).reshape(180, 32) + rng.normal(size=(180, 32)) * 0.05]).astype(np.float32)
    x = np.concatenate([x, x[:40]])
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")).collect()}
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert [got[k] for k in range(len(x))] == ((y @ y.T >= 0.93).sum(1) - 1).tolist()


# ------------------------------------------------------------------ 9


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    rng = random.Random(6)
    words = ["the", "Der", "naïve", "x1", "don't", "—", "12345", "a.b", "end.", "Ωmega,", "  ", "\n", "<|endoftext|>", "🙂"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 40, 300, 2500]))) for _ in range(40)] + [None, "", "  x", "a \n b", "word " * 1023, "word " * 1022, " lead"]
    got = packing.pack(frame(spark, list(enumerate(texts))).repartition(3), open_bins=8).collect()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ids = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}
    of, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        of[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == binascii.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for k in ids:
        ps = sorted(of[k], key=lambda r: r.piece)
        assert [p.piece for p in ps] == list(range(len(ps))) and ps[0].start == 0 and sum(p.length for p in ps) == len(ids[k])
        assert all(a.start + a.length == b.start for a, b in zip(ps, ps[1:])) and all(p.length == 1024 for p in ps[1:])
    for s in seqs.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= 1024
    assert packing.pack(frame(spark, [])).collect() == []


def test_bins_best_fit_and_fullest_closes():
    b = packing.Bins(10, 2)
    assert [b.put(6), b.put(5), b.put(4), b.put(5), b.put(3), b.put(3)] == [(0, 0), (1, 0), (0, 6), (1, 5), (2, 0), (2, 3)]
    c = packing.Bins(10, 2)
    assert [c.put(7), c.put(6), c.put(9), c.put(3), c.put(4)] == [(0, 0), (1, 0), (2, 0), (1, 6), (3, 0)]


# ------------------------------------------------------------------ 10


def test_surrogates(spark):
    rows = [
        (1, "Mr. John Smith met Mrs Anna Smith and Mr Smith."), (13, "at +1 (843) 555-7672 170.106.47.218 x"), (2, "call +1 (017) 555-7713, +1 017 555 7713 or (212) 555-1234, +19745553436"), (3, "card 4785380592391141 and 4785 3805 9239 1141; ssn 123-45-6789"),
        (4, "ip 10.1.2.3, 170.106.47.218 and v1.2.3.4.5"), (5, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" api_key: AbC123xyzQQ'), (6, "Foo.Bar@Mail7.Example.com und foo.bar@mail7.example.com"), (7, "DE89 3704 0044 0532 0130 00"),
        (8, None), (9, ""), (10, "Herr Müller und Frau Müller, г-жа Анна Иванова"), (11, "x" * 200000 + "@"), (12, "plain text. Of this. 12 of 100"), (1, "Mr. John Smith met Mrs Anna Smith and Mr Smith."),
    ]
    got = pii.replace_pii(frame(spark, rows))
    assert got.columns == SCHEMA_NAMES
    out = defaultdict(list)
    for r in got.collect():
        out[r.doc_id].append(r.text)
    assert out[1][0] == out[1][1] and out[8] == [None] and out[9] == [""] and out[11][0] == rows[11][1] and out[12] == ["plain text. Of this. 12 of 100"]
    m = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs (\S+) (\S+) and Mr (\S+)\.", out[1][0])
    assert m and m[2] == m[4] == m[5] != "Smith" and m[1] != m[3] and "Smith" not in out[1][0]
    assert any(m[1].startswith(x) for x in pii.GIVEN["latin"]["m"]) and any(m[3].startswith(x) for x in pii.GIVEN["latin"]["f"])
    p = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}), \+1 (\d{3}) (\d{3}) (\d{4}) or \(\d{3}\) \d{3}-\d{4}, \+\d{11}", out[2][0])
    assert p and p.groups()[:3] == p.groups()[3:] != ("017", "555", "7713")
    c = re.fullmatch(r"card (\d{16}) and ((?:\d{4} ?){4}); ssn \d{3}-\d{2}-\d{4}", out[3][0])
    assert c and c[1] == c[2].replace(" ", "") != "4785380592391141" and c[1][0] == "4"
    luhn = lambda x: sum(int(v) if k % 2 == 0 else sum(map(int, str(2 * int(v)))) for k, v in enumerate(reversed(x))) % 10 == 0
    assert luhn(c[1]) == luhn("4785380592391141")
    ip = re.fullmatch(r"ip (\S+), (\S+) and v1\.2\.3\.4\.5", out[4][0])
    assert ip and ip[1].startswith("10.") and ip[1] != "10.1.2.3" and ip[2] != "170.106.47.218" and all(int(x) < 256 for x in ip[2].split("."))
    assert re.fullmatch(r'token = "[0-9a-f]{40}" api_key: [A-Z][a-z][A-Z]\d{3}[a-z]{3}[A-Z]{2}', out[5][0]) and "24be" not in out[5][0]
    a, b = out[6][0].split(" und ")
    assert a.lower() == b and b.endswith(".example.com") and "foo" not in b
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}@[A-Z][a-z]{3}\d\.Example\.com", a)
    assert re.fullmatch(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", out[7][0]) and "3704 0044" not in out[7][0]
    assert re.fullmatch(r"at \+1 \(\d{3}\) \d{3}-\d{4} \d{1,3}(\.\d{1,3}){3} x", out[13][0]) and "170.106" not in out[13][0]
    n = re.fullmatch(r"Herr (\S+) und Frau (\S+), г-жа ([А-я-]+) ([А-я-]+)", out[10][0])
    assert n and n[1] == n[2] != "Müller" and n[4] != "Иванова"
    other = {r.doc_id: r.text for r in pii.replace_pii(frame(spark, rows), key="another").collect()}
    assert other[3] != out[3][0]
    assert pii.replace_pii(frame(spark, [])).collect() == []


def test_surrogates_keep_coreference_gender_script_and_hide_domains(spark):
    rows = [
        (1, "Dr. Anna Smith and Mrs Anna Smith"), (2, "Prof Anna Smith"), (3, "Mr McDonald, Mrs O'Brien and Dr Anna Maria Schmidt-Weber."), (4, "Herr Karl Groß kam. Karl Groß ging; Karl Großmann blieb."),
        (5, "a@eng.smithfamily.org b@smithfamily.org c@smithfamily.co.uk"), (6, "иван.Петров@почта.рф ΑΒΓ@δοκιμή.gr"), (7, "+49 30 1234567 or fe80::1a2b:3c4d, 2001:DB8:0:0:8:800:200C:417A; std::vector 12:30:45"), (8, "Dr Kim Lee"),
    ]
    out = {r.doc_id: r.text for r in pii.replace_pii(frame(spark, rows)).collect()}
    one, two = re.fullmatch(r"Dr\. (\S+) (\S+) and Mrs (\S+) (\S+)", out[1]), re.fullmatch(r"Prof (\S+) (\S+)", out[2])
    assert one[1] == one[3] == two[1] != "Anna" and one[2] == one[4] == two[2] != "Smith"
    assert any(one[1].startswith(x) for x in pii.GIVEN["latin"]["f"])
    three = re.fullmatch(r"Mr (\S+), Mrs (\S+) and Dr (\S+) (\S+) ([^ -]+)-(\S+)\.", out[3])
    assert three and three[3] == one[1] and not re.search("Donald|Brien|Anna|Maria|Schmidt|Weber", out[3])
    four = re.fullmatch(r"Herr (\S+ \S+) kam\. (\S+ \S+) ging; Karl Großmann blieb\.", out[4])
    assert four and four[1] == four[2] != "Karl Groß"
    five = re.fullmatch(r"\w@(\w{3})\.(\w{11})\.org \w@(\w{11})\.org \w@(\w{11})\.co\.uk", out[5])
    assert five and five[2] == five[3] and "smithfamily" not in out[5] and "eng" != five[1]
    six = re.fullmatch(r"([а-я]{4})\.([А-Я][а-я]{5})@([а-я]{5})\.рф ([Α-Ω]{3})@([α-ω]{6})\.gr", out[6])
    assert six and "иван" not in out[6] and "почта" not in out[6]
    seven = re.fullmatch(r"\+49 (\d{2}) (\d{7}) or fe80::([0-9a-f]{4}:[0-9a-f]{4}), ([0-9A-F]{4}:[0-9A-F]{3}(?::[0-9A-F]+){6}); std::vector 12:30:45", out[7])
    assert seven and (seven[1], seven[2]) != ("30", "1234567") and seven[3] != "1a2b:3c4d"
    assert not re.search("Kim|Lee", out[8])
    spark.conf.set(pii.KEY_SETTING, "secret")
    try:
        assert {r.doc_id: r.text for r in pii.replace_pii(frame(spark, rows)).collect()}[1] != out[1]
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_surrogates_when_a_format_has_too_few(spark, monkeypatch):
    monkeypatch.setattr(pii, "CROWDED", 1)
    monkeypatch.setattr(pii, "FULL", 16)
    forms = [("ssn", str(k)) for k in range(1, 6)]
    got = pii.surrogates(spark.createDataFrame(forms, "kind string, form string")).collect()
    assert all(len(r.surrogate) == 1 and r.form != r.surrogate for r in got) and len({r.surrogate for r in got}) == 5
    monkeypatch.setattr(pii, "FULL", 4)
    with pytest.raises(RuntimeError):
        pii.surrogates(spark.createDataFrame([("ssn", str(k)) for k in range(10)], "kind string, form string"))


def test_surrogates_of_upper_case_secrets(spark):
    digits = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"
    rows = [
        (1, f'TOKEN = "{digits}"'), (2, f"SEE {digits}."), (3, "Password: AbC123xyzQQ"), (4, "PASSWORD=QWERTYUIOP"), (5, digits.lower()), (6, "9233a8ECf7c5b09fe5949719b6b82bc4"),
        (7, "USE GHP_ABCDEFGHIJ0123456789ABCDEFGHIJ012345 NOW"),
    ]
    out = {r.doc_id: r.text for r in pii.replace_pii(frame(spark, rows)).collect()}
    shapes = {1: r'TOKEN = "([0-9A-F]{40})"', 2: r"SEE ([0-9A-F]{40})\.", 3: r"Password: ([A-Z][a-z][A-Z]\d{3}[a-z]{3}[A-Z]{2})", 4: "PASSWORD=([A-Z]{10})", 5: "([0-9a-f]{40})", 6: r"(\d{4}[a-f]\d[A-F]{2}[a-f]\d[a-f]\d[a-f]\d\d[a-f]{2}[a-f0-9]{15})", 7: r"USE ([A-Z]{3}_[A-Z]{10}\d{10}[A-Z]{10}\d{6}) NOW"}
    found = {k: re.fullmatch(p, out[k]) for k, p in shapes.items()}
    assert all(found.values()), out
    assert found[1][1] == found[2][1] and all(found[k][1] not in t for k, t in rows)


def test_surrogates_stay_distinct(spark):
    names = [("family", f"n:{a}{b}") for a in "ABCDEFGHIJ" for b in "abcdefghijklmnopqrst"] + [("given", f"m:{a}x") for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"] + [("ssn", f"{k:09d}") for k in range(300)]
    got = pii.surrogates(spark.createDataFrame(names, "kind string, form string")).collect()
    assert len(got) == len(names) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(names)
