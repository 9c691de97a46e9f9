"""Stupid-backoff scores of documents, computed relationally.

The model is the corpus without the document itself (leave one out), so every score says how well other documents predict this one.  With c the counts of all
documents less the document's own, a word w after u scores c(u, w) / c(u) if c(u, w) > 0, else 0.4 * max(c(w), 1) / N; the first word of a
document follows a start mark.  A document's score is the sum of the logarithms.

Rows are packed: one row of a relation holds a sorted run of n-grams with their numbers, not one n-gram.

* Each text is tokenized once.  A group of documents (GROUP bytes of text, or one longer text) is written as a row: its words' hashes and its text as numbers of them.
* Each group's n-grams and words are counted there and dealt out by hash slice, a row for each group and slice.  A slice holds SLICE n-grams of all groups at most, on
  average; a frequent n-gram comes once for each group that has it, however often it occurs.  The number of slices grows with the corpus.
* Slices become count tables, and each group's n-grams are joined with their counts in the table of their slice.
* Each group's rows meet its counts again, and the terms are summed per document.

Words and n-grams are known by 64-bit hashes; documents by their row.  All n-grams of all documents take part.  Memory holds one group or one slice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import LUT
from .shared import cut, drop_cut, mix, shards, table, utf8, words

ALPHA = 0.4
GROUP = 8 << 20
SLICE = 1 << 21
START = np.uint64(0x8EBC6AF09C88C6E3)
GRAMS, WORDS = 0, 1


def _blob(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the narrowest type that holds them, compressed."""
    top = int(x.max()) if len(x) else 0
    kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if top < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _numbers(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[1:]), f"<u{blob[0]}")


def _sorted_blob(keys: np.ndarray) -> bytes:
    return _blob(np.diff(keys, prepend=np.uint64(0)))


def _sorted_numbers(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=np.uint64)


def _grouped(batches):
    """(doc_id, text) -> groups: (group, ids, words, vocab, tokens, sizes)."""
    part, number = TaskContext.get().partitionId(), 0
    for b in batches:
        bounds, raw = utf8(b.column(1))
        for lo, hi in shards(bounds, GROUP):
            h, doc, _, _ = words(bounds[lo : hi + 1] - bounds[lo], raw[bounds[lo] : bounds[hi]], LUT)
            vocab, at = np.unique(h, return_inverse=True)
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), b.column(0).slice(lo, hi - lo))
            cols = [pa.array([(part << 33) + number]), ids, pa.array([len(h)]), *(pa.array([x], pa.binary()) for x in (_sorted_blob(vocab), _blob(at), _blob(np.bincount(doc, minlength=hi - lo))))]
            yield pa.RecordBatch.from_arrays(cols, ["group", "ids", "words", "vocab", "tokens", "sizes"])
            number += 1


class Group:
    """The n-grams of a group: w and u number the words (u of a first word is len(vocab), the start mark), doc the documents; gram and word are sorted keys, g numbers the grams."""

    def __init__(self, vocab: bytes, tokens: bytes, sizes: bytes):
        hashes, self.sizes = np.append(_sorted_numbers(vocab), START), _numbers(sizes).astype(np.int64)
        self.w = _numbers(tokens).astype(np.int32)
        self.doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        self.u = np.append(np.int32(len(hashes) - 1), self.w[:-1])[: len(self.w)]
        self.u[np.flatnonzero(np.diff(self.doc, prepend=-1))] = len(hashes) - 1
        key = mix(hashes[self.u] * np.uint64(0x9E3779B97F4A7C15) + hashes[self.w])
        self.gram, self.g = np.unique(key, return_inverse=True)
        self.word, back = np.unique(hashes, return_inverse=True)
        self.u, self.w = back[self.u], back[self.w]

    def counts(self, kind: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Keys, and of n-grams how often they occur, of words also how often they are followed by a word (the start mark: by a first word)."""
        if kind == GRAMS:
            return self.gram, [np.bincount(self.g, minlength=len(self.gram))]
        return self.word, [np.bincount(x, minlength=len(self.word)) for x in (self.w, self.u)]


def _edges(keys: np.ndarray, slices: int) -> np.ndarray:
    """Where each slice of sorted keys begins and the last ends; slices are ranges of hashes."""
    own = (keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    return np.searchsorted(own, np.arange(slices + 1, dtype=np.uint64))


def _dealt(slices: tuple[int, int]):
    """Groups -> (kind, slice, group, keys, counts, follows), a row for each slice that has any."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                own = Group(*(b.column(k)[i].as_py() for k in (1, 2, 3)))
                rows = []
                for kind in (GRAMS, WORDS):
                    keys, counts = own.counts(kind)
                    edge = _edges(keys, slices[kind])
                    for k in np.flatnonzero(np.diff(edge)).tolist():
                        s = slice(edge[k], edge[k + 1])
                        rows.append((kind, k, b.column(0)[i].as_py(), _sorted_blob(keys[s]), _blob(counts[0][s]), _blob(counts[1][s]) if kind == WORDS else None))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), DEALT_TYPES, strict=True)], DEALT_NAMES)

    return run


DEALT_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
DEALT_NAMES = ["kind", "slice", "group", "keys", "counts", "follows"]
DEALT = "kind int, slice int, group long, keys binary, counts binary, follows binary"
TOTALS = "group long, kind int, slice int, counts binary, follows binary"


def _totals(t: pa.Table) -> pa.Table:
    """The rows of one slice -> its count table, joined back: a row for each group with the counts of all groups, in the order of its keys."""
    keys = [_sorted_numbers(x.as_py()) for x in t.column("keys")]
    edge = np.cumsum([0, *map(len, keys)])
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    out = {}
    for name in ("counts", "follows"):
        parts = [x.as_py() for x in t.column(name)]
        if parts[0] is None:
            out[name] = parts
            continue
        total = np.bincount(at, np.concatenate([_numbers(x) for x in parts])).astype(np.int64)  # sums of whole numbers below 2**53 are exact
        out[name] = [_blob(total[at[a:z]]) for a, z in zip(edge[:-1], edge[1:], strict=True)]
    return pa.table({"group": t.column("group"), "kind": t.column("kind"), "slice": t.column("slice"), **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


def _own(doc: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """How often each element's x occurs in its document."""
    _, at, n = np.unique(doc.astype(np.int64) * size + x, return_inverse=True, return_counts=True)
    return n[at]


def _scores(total: int, alpha: float, id_type: pa.DataType):
    """A group and the counts of its n-grams and words -> (doc_id, n_words, log_score)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        own = Group(row["vocab"], row["tokens"], row["sizes"])
        rows = sorted(zip(*(right.column(k).to_pylist() for k in ("kind", "slice", "counts", "follows")), strict=True), key=lambda r: r[:2])

        def joined(kind: int, k: int) -> np.ndarray:
            parts = [_numbers(r[k]) for r in rows if r[0] == kind]
            return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)

        grams, n, m = joined(GRAMS, 2), joined(WORDS, 2), joined(WORDS, 3)
        size, score = own.sizes, np.zeros(len(own.sizes))
        if len(own.w):
            rest = grams[own.g] - _own(own.doc, own.g, len(own.gram))
            seen = rest > 0
            follows = m[own.u] - _own(own.doc, own.u, len(own.word))
            alone = np.maximum(n[own.w] - _own(own.doc, own.w, len(own.word)), 1)
            others = np.maximum(total - size, 1)[own.doc]
            term = np.log(np.where(seen, rest / np.maximum(follows, 1), alpha * alone / others))
            score = np.bincount(own.doc, term, len(size))
        return pa.table({"doc_id": left.column("ids").combine_chunks().flatten().cast(id_type), "n_words": pa.array(size), "log_score": pa.array(score)})

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, slice_grams: int = SLICE) -> DataFrame:
    """(doc_id, n_words, log_score) of each row of ``docs`` (doc_id, text): words as for decontamination.

    A text without words (null and empty too) has 0 words and score 0.  Repeated rows count as documents of their own and are answered each; a null
    doc_id is a value like any other.  In a corpus of one document all counts are 0 and every word scores alpha.  A text of any length is counted whole: it
    is a group of its own, in memory of about ten times its length.  Ties don't arise.  Columns but doc_id and text play no part."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    groups = cut(docs.select(docs["doc_id"], docs["text"]).mapInArrow(_grouped, f"group long, ids array<{kind.simpleString()}>, words long, vocab binary, tokens binary, sizes binary"), "backoff-groups")
    total = groups.agg(F.sum("words")).first()[0] or 0
    slices = (max(1, -(-total // slice_grams)), max(1, -(-total // (4 * slice_grams))))
    dealt = groups.select("group", "vocab", "tokens", "sizes").mapInArrow(_dealt(slices), DEALT)
    totals = dealt.groupBy("kind", "slice").applyInArrow(_totals, TOTALS)
    id_type = pa.schema(groups.select("ids").limit(0).toArrow().schema).field("ids").type.value_type
    scored = groups.groupBy("group").cogroup(totals.groupBy("group")).applyInArrow(_scores(total, alpha, id_type), f"doc_id {kind.simpleString()}, n_words long, log_score double")
    out = cut(scored, "backoff-scores")
    drop_cut(groups)
    return out


def op7_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff log scores of all documents under all other documents."""
    out = backoff_scores(table(spark, sf_dir, "documents"))
    per_word = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(per_word, 6).alias("log_score_per_word"))
