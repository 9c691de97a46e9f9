"""Plain versions of the language network, the quality discriminant and the archive reader, and texts that patterns and strings must bear."""

import gzip
import io
import math
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import langid, packing, pii, quality, warc
from lodestone.llm.shared import shared_path

# ---------------------------------------------------------------- language


def plain_probabilities(net, data):
    """Probabilities of each position of one window, a byte at a time."""
    hid, size = net.hidden, len(data)
    states = np.zeros((2, size, hid))
    for k, order in ((0, range(size)), (1, range(size - 1, -1, -1))):
        h = np.zeros(hid)
        for t in order:
            a, v = net.x[k][data[t]], h @ net.u[k]
            g = np.clip(0.25 * (a[: 2 * hid] + v[: 2 * hid]) + 0.5, 0, 1)
            c = np.tanh(a[2 * hid :] + g[hid:] * v[2 * hid :])
            h = g[:hid] * h + (1 - g[:hid]) * c
            states[k, t] = h
    y = states[0] @ net.o[0] + states[1] @ net.o[1] + net.b
    y = np.exp(y - y.max(1, keepdims=True))
    return y / y.sum(1, keepdims=True)


def plain_pooled(net, text):
    raw = text.encode()
    letters = [c >= 0x80 or chr(c).isalpha() for c in raw]
    if not any(letters):
        return np.zeros(len(net.langs))
    step = langid.WINDOW - 2 * langid.AROUND
    spans = [(0, len(raw), 0)] if len(raw) <= langid.WINDOW else [(a, min(a + step, len(raw)), min(max(a - langid.AROUND, 0), len(raw) - langid.WINDOW)) for a in range(0, len(raw), step)]
    rows = []
    for a, b, lo in spans:
        p = plain_probabilities(net, raw[lo : lo + langid.WINDOW])
        rows += [p[i - lo] for i in range(a, b) if letters[i]]
    return np.mean(rows, axis=0)


def test_language_probabilities_equal_a_plain_network():
    rng = np.random.default_rng(5)
    net = langid.Net(rng.normal(0, 0.3, (2, 256, 24)), rng.normal(0, 0.3, (2, 8, 24)), rng.normal(0, 0.3, (2, 8, 3)), rng.normal(0, 1, 3), list("abc"))
    texts = ["", "12 !", "a", "été " * 9, "x" * 160, "y" * 161, "Straße 7. " * 31, "abc " * 200, "q" * 128 + "1" * 200, None]
    got = langid.pooled(net, pa.array(texts, pa.string()))
    for t, p in zip(texts, got, strict=True):
        assert np.allclose(p, plain_pooled(net, t or ""), atol=2e-5), t


def test_training_windows_come_from_the_whole_text(spark):
    text = "".join(f"w{i:05d} " for i in range(5000))
    docs = spark.createDataFrame([(1, text, "aa"), (2, "z", "bb")], "doc_id long, text string, lang string")
    windows, labels, langs = langid.sample(docs)
    at = [text.index(w.decode()) for w, k in zip(windows, labels, strict=True) if langs[k] == "aa"]
    assert len(at) == langid.PLACES and max(at) > len(text) // 2 and all(len(w) in (1, langid.SNIPPET) for w in windows)


# ---------------------------------------------------------------- quality


def plain_statistics(text):
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    upper = sum(0x41 <= c <= 0x5A for c in (text or "").encode())
    letters = sum(0x61 <= c <= 0x7A or c >= 0x80 for c in raw)
    count = lambda chars: sum(chr(c) in chars for c in raw)
    words = re.findall(rb"[^\x00\x09-\x0d\x20]+", raw)
    lines = re.findall(rb"[^\x00\n]+", (text or "").encode())
    n, sizes = len(words), [len(w) for w in words]
    mean = sum(sizes) / max(n, 1)
    spread = math.sqrt(max(sum(s * s for s in sizes) / max(n, 1) - mean * mean, 0))
    pairs = list(zip(words, words[1:]))
    share = lambda x, of: math.sqrt((x + 0.5) / (of + 20))
    return [
        math.log1p(n), share(upper, letters), *(share(count(c), len(raw)) for c in ("0123456789", "#$%&*+/<=>@[\\]^_`{|}~", "!?", ".,;:")), math.log1p(min(mean, 1000)), math.log1p(min(spread, 1000)),
        math.log((len(set(words)) + 3) / (n + 3)), share(sum(a == b for a, b in pairs), n), math.log((len(set(pairs)) + 3) / (max(n - 1, 0) + 3)), math.log((len(set(lines)) + 1) / (len(lines) + 1)),
    ]


TEXTS = ["", None, "One two two, THREE! 4 #5", "a\nb\na\n\nb", "x" * 5000, "Ünï cödé — text. text. text. " * 7, "MiXed\x00byte\tAND tab", "? ! . , ;" * 30]


def test_quality_statistics_and_densities_equal_plain_ones(monkeypatch):
    got = quality.statistics(pa.array(TEXTS, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in TEXTS], atol=1e-9)
    monkeypatch.setattr(quality, "SHARD", 40)  # long texts in pieces
    assert np.allclose(quality.statistics(pa.array(TEXTS, pa.string())), [plain_statistics(t) for t in TEXTS], atol=1e-9)


def test_quality_scores_equal_plain_densities():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 12)) @ rng.normal(0, 1, (12, 12))
    y = rng.integers(0, 2, 300)
    x[y == 1] += 0.7
    n, s, p = np.bincount(y, minlength=2).astype(float), np.stack([x[y == c].sum(0) for c in (0, 1)]), np.stack([x[y == c].T @ x[y == c] for c in (0, 1)])
    model = quality.solve(n, s, p)
    cov = [np.cov(x[y == c].T, bias=True) for c in (0, 1)]
    within = sum(n[c] * cov[c] for c in (0, 1)) / n.sum()
    log = []
    for c in (0, 1):
        m = (1 - quality.POOLED) * cov[c] + quality.POOLED * within
        m = (1 - quality.IDENTITY) * m + quality.IDENTITY * (np.trace(within) / 12 + 1e-9) * np.eye(12)
        d = x - x[y == c].mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(m), d) - 0.5 * np.linalg.slogdet(m)[1])
    want = 1 / (1 + np.exp(-(quality.TEMPER * (log[1] - log[0]) + np.log((n[1] + 1) / (n[0] + 1)))))
    assert np.allclose(model.score(x), want, atol=1e-8)


# ---------------------------------------------------------------- archives


def read_standard(data):
    """Records of an archive by the standard alone: members one after the other, version line, named fields, block of Content-Length bytes, two line ends."""
    out, at = [], io.BytesIO(data)
    raw = gzip.GzipFile(fileobj=at).read()
    while raw:
        head, raw = raw.split(b"\r\n\r\n", 1)
        version, *fields = head.decode().split("\r\n")
        fields = dict(f.split(":", 1) for f in fields)
        fields = {k: v.strip() for k, v in fields.items()}
        n = int(fields["Content-Length"])
        block, end, raw = raw[:n], raw[n : n + 4], raw[n + 4 :]
        assert version == "WARC/1.1" and end == b"\r\n\r\n"
        out.append((fields, block))
    return out


def test_archives_are_valid_by_the_standard(spark):
    rows = [(k, f"http://h{k % 3}.org/{k}", f"<p>{k % 4}</p>") for k in range(20)] + [(5, "http://h2.org/5", "<p>1</p>")] * 3 + [(30, None, "new\r\nline"), (31, "u\r\nv", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    root = shared_path(spark, "test-warc")
    shards = warc.write_archives(pages, root, date="2020-01-31T12:00:00Z")
    fs, base = warc.filesystem(root)
    records = [r for *_, name in shards for r in read_standard(fs.open_input_file(f"{base}/{name}.warc.gz").read())]
    ids = [f["WARC-Record-ID"] for f, _ in records]
    assert len(records) == len(rows) == len(set(ids))
    of = {f["WARC-Record-ID"]: (f, b) for f, b in records}
    for f, b in records:
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", f["WARC-Record-ID"]) and f["WARC-Date"] == "2020-01-31T12:00:00Z" and f["WARC-Type"] in ("response", "revisit")
        if f["WARC-Type"] == "revisit":
            first, _ = of[f["WARC-Refers-To"]]
            assert first["WARC-Type"] == "response" and first["WARC-Payload-Digest"] == f["WARC-Payload-Digest"] and first["WARC-Target-URI"] == f["WARC-Refers-To-Target-URI"] and first["WARC-Date"] == f["WARC-Refers-To-Date"]
        else:
            http, _, payload = b.partition(b"\r\n\r\n")
            assert http.startswith(b"HTTP/1.1 200") and "sha1:" + warc.digest(payload) == f["WARC-Payload-Digest"]


# ---------------------------------------------------------------- packing


def test_packing_stays_tight_over_many_tasks(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(20, 900, 1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(64)
    got = packing.pack(docs).collect()
    least = sum(r.length for r in got) / packing.CAPACITY
    assert least / len({r.sequence_id for r in got}) > 0.97
    of = {}
    for r in got:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in of.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(n for _, n in s) <= packing.CAPACITY


# ---------------------------------------------------------------- personal data

LONG = 100_000
HARD = [
    "mail a@b" + ".c" * LONG + ".com", "Mr Ab" + "-Cd" * LONG, "mail " + "x." * LONG + "@b.com", "a@" + "-" * LONG, ":" * LONG, "." * LONG, "-" * LONG, "1:" * LONG, "+1 " + "(2) " * LONG, "1 2-" * LONG, "DE12 " + "AB12 " * LONG,
    "Dr " + "A'" * LONG, "@" * LONG, "token=" * LONG, "1." * LONG,
]


def test_no_text_is_too_deep_for_the_patterns(spark, tmp_path):
    """Read from a file, so that nothing is folded while planning."""
    spark.createDataFrame(list(enumerate(HARD)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "hard"))
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.read.parquet(str(tmp_path / "hard"))).collect()}
    assert len(got) == len(HARD) and got[5] == HARD[5] and got[6] == HARD[6] and "Ab-Cd" not in got[1]


@pytest.mark.parametrize("entity", ["token=" + "aB3_" * (1 << 18), "password: " + "0123456789abcdef" * (1 << 16), "mail " + "q" * (1 << 20) + "@example.com", "secret=" + "A1B2" * (1 << 18)])
def test_an_entity_of_a_megabyte(spark, tmp_path, entity):
    spark.createDataFrame([(1, entity), (2, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "one"))
    got = {r.doc_id: r.text for r in pii.replace_pii(spark.read.parquet(str(tmp_path / "one"))).collect()}
    new = got[1]
    assert len(new) == len(entity) and new != entity
    shape = lambda x: re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", x[10:-12])))
    if not re.fullmatch(r".*?[0-9a-fA-F]+", entity[10:]):
        assert shape(new) == shape(entity)
    kept = sum(a == b for a, b in zip(new, entity, strict=True))
    assert kept < len(entity) / 3


#: Entities by plain rules, for texts made so that nothing else could be one.
SCANS = {"email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}", "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", "name": r"(?:Mr|Mrs|Frau|Herr)\.? [A-Z][a-z]+(?:-[A-Z][a-z]+)?(?: [A-Z][a-z]+)?"}


def test_surrogates_equal_a_plain_scanner(spark):
    """What a plain scanner finds is replaced, one surrogate for an entity, different ones for different entities; what it doesn't find stays, byte for byte."""
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    entity = [
        lambda: f"{word()}.{word()}@{word()}.{rng.choice(['com', 'org'])}", lambda: ".".join(str(int(x)) for x in rng.integers(11, 120, 4)), lambda: f"{rng.integers(100, 700)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}",
        lambda: f"{rng.choice(['Mr', 'Mrs', 'Frau'])} {word().title()} {word().title()}",
    ]
    pool = [rng.choice(entity)() for _ in range(60)]
    texts = [" ".join(str(rng.choice(pool)) if rng.random() < 0.2 else f"{word()}," for _ in range(30)) for _ in range(80)]
    out = {r.doc_id: r.text for r in pii.replace_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    scan = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SCANS.items()))
    given = {}
    for i, t in enumerate(texts):
        want = list(scan.finditer(t))
        between = [t[a:b] for a, b in zip([0, *(m.end() for m in want)], [*(m.start() for m in want), len(t)], strict=True)]
        form = re.escape(between[0]) + "".join((r"(\S+ \S+ \S+)" if m.lastgroup == "name" else r"(\S+)") + re.escape(x) for m, x in zip(want, between[1:], strict=True))
        new = re.fullmatch(form, out[i], re.S)
        assert new, (t, out[i])
        for a, b in zip(want, new.groups(), strict=True):
            assert a[0] != b and given.setdefault((a.lastgroup, a[0]), b) == b
    for kind in ("email", "ip", "ssn"):
        made = [v for (k, _), v in given.items() if k == kind]
        assert len(made) == len(set(made))
