"""Jaccard join and repeat removal against brute force."""

import pytest

from lodestone.llm import jaccard, repeats

from . import brute

SCHEMA = "doc_id long, text string, score double, lang string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "en") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_equals_brute_force(spark, seed):
    rows = brute.noisy_corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows).repartition(3)).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_other_threshold_and_size(spark):
    rows = brute.noisy_corpus(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows), 5, 80, 100).collect()}
    assert got == brute.jaccard(rows, 5, 80, 100)


def test_jaccard_odd_rows(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (3, "A b C d"), (None, "a b c d"), (None, "z"), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(frame(spark, rows)).collect()), key=str)
    want = [(7, 2, 3), (7, 2, 3), (3, 2, 3), (None, 2, 3), (None, 1, None), (9, 0, 9), (8, 0, 8)]
    assert got == sorted(want, key=str)
    assert jaccard.jaccard_components(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = brute.noisy_corpus(seed)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in repeats.remove_repeats(frame(spark, rows).repartition(3)).collect()}
    assert got == brute.repeats(rows)


def test_repeats_small_blocks_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", 700)
    monkeypatch.setattr(repeats, "BLOCK", 900)
    rows = brute.noisy_corpus(4)
    found = {}
    import numpy as np
    import pyarrow as pa

    ids = pa.array([i for i, _ in rows], pa.int64())
    texts = pa.array([t or "" for _, t in rows], pa.string())
    batch = pa.RecordBatch.from_arrays([ids, pa.array([0] * len(rows), pa.int64()), texts], ["id", "tag", "text"])
    settled = list(repeats._settle(repeats._runs_of([batch])))
    raw = {i: (t or "").encode() for i, t in rows}
    opened = []
    for b in settled:
        for i, packed, h, is_open in zip(*(b.column(k).to_pylist() for k in ("id", "packed", "h", "open")), strict=True):
            if is_open:
                _, lo, hi, _ = repeats._unpack(np.array([packed]))
                opened.append((h, i, packed, raw[i][lo[0] : hi[0] + 100]))
            else:
                found.setdefault(i, []).append(packed)
    h, i, p, x = zip(*opened, strict=True)
    for b in repeats._sort_blocks([pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(i, pa.int64()), pa.array(p, pa.int64()), pa.array(x, pa.binary())], ["h", "id", "packed", "bytes"])]):
        for i, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found.setdefault(i, []).append(packed)
    want = brute.repeats(rows)
    for i, t in rows:
        s = repeats.spans(np.array(found.get(i, []), np.int64))
        assert (int((s[:, 1] - s[:, 0]).sum()), len(s)) == want[i][1:3], (i, t)


def test_repeats_odd_rows(spark):
    long = " ".join(str(i * i) for i in range(200))[:150]
    rows = [(5, long), (5, long), (None, long), (6, None), (7, "")]
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 150, 150), (5, 150, 150), (None, 150, 0), (6, 0, 0), (7, 0, 0)], key=str)
    assert repeats.remove_repeats(frame(spark, [])).collect() == []
