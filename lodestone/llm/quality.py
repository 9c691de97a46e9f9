"""Quality classifier: a regularised quadratic discriminant over transformed statistics of whole texts.

Each class (label 0, label 1) has a mean and a covariance, shrunk towards the pooled covariance and towards a multiple of the identity (Friedman's
regularised discriminant analysis).  The score is the logistic function of the tempered difference of the two log densities, each a Mahalanobis
form by the cached Cholesky factor of its covariance, plus the log of the classes' shares.  Fitting needs sums only: the tasks add up
counts, statistics and products of statistics per class, so all labelled rows take part and no text is moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, drop_cut, grams, held_out, pieces, shards, table, utf8, words

SHARD = 4 << 20
THRESHOLD = 0.7
#: Shares of the pooled covariance and of the scaled identity in each class covariance, and the factor on log-density differences.
POOLED, IDENTITY, TEMPER = 0.1, 0.02, 0.5

SPACE = np.ones(256, np.uint8) * np.arange(256).astype(np.uint8)
SPACE[[0x00, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = 0
SPACE[0x41:0x5B] = np.arange(0x61, 0x7B)

LINE = np.arange(256).astype(np.uint8)
LINE[[0x00, 0x0A]] = 0

#: Classes of bytes whose counts are statistics.
UPPER, LETTER, DIGIT, SYMBOL, BANG, STOP = range(1, 7)
CLASS = np.zeros(256, np.uint8)
CLASS[0x61:0x7B] = LETTER
CLASS[0x80:] = LETTER
CLASS[0x41:0x5B] = UPPER
CLASS[0x30:0x3A] = DIGIT
CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = SYMBOL
CLASS[[ord(c) for c in "!?"]] = BANG
CLASS[[ord(c) for c in ".,;:"]] = STOP

NAMES = ["log_words", "upper", "digit", "symbol", "bang", "stop", "word_length", "word_spread", "distinct", "repeated", "pairs", "lines"]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Number of different hashes per text."""
    if not len(h):
        return np.zeros(n)
    order = np.argsort(h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), kind="stable")
    k = h[order] ^ (doc[order].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    new = np.append(True, k[1:] != k[:-1])
    return np.bincount(doc[order][new], minlength=n).astype(float)


KINDS = (UPPER, LETTER, DIGIT, SYMBOL, BANG, STOP)


def _sums(own: np.ndarray, part: np.ndarray) -> dict[str, np.ndarray]:
    """What the statistics of a shard's texts are made of; texts stand at part[own[i]:own[i+1]]."""
    n = len(own) - 1
    kind = CLASS[part]
    out = {}
    for k in KINDS:
        total = np.zeros(len(part) + 1, np.int64)
        np.cumsum(kind == k, out=total[1:])
        out[f"kind{k}"] = (total[own[1:]] - total[own[:-1]]).astype(float)
    h, doc, s, e = words(own, part, SPACE)
    size = (e - s).astype(float)
    pair, within = grams(h, 2), doc[1:] == doc[:-1]
    same = (h[1:] == h[:-1]) & within
    lh, ldoc, _, _ = words(own, part, LINE)
    out |= {"words": np.bincount(doc, minlength=n), "size": np.bincount(doc, size, n), "square": np.bincount(doc, size * size, n), "same": np.bincount(doc[1:], same, n), "lines": np.bincount(ldoc, minlength=n)}
    return out | {"distinct": _distinct(doc, h, n), "pairs": _distinct(doc[1:][within], pair[within], n), "different_lines": _distinct(ldoc, lh, n)}


def _long_sums(part: np.ndarray) -> dict[str, np.ndarray]:
    """The same of one long text, piece by piece."""
    out = {f"kind{k}": 0.0 for k in KINDS} | dict.fromkeys(("words", "size", "square", "same", "lines"), 0.0)
    for lo in range(0, len(part), SHARD):
        count = np.bincount(CLASS[part[lo : lo + SHARD]], minlength=STOP + 1)
        for k in KINDS:
            out[f"kind{k}"] += count[k]
    seen: dict[str, np.ndarray] = {"distinct": np.zeros(0, np.uint64), "pairs": np.zeros(0, np.uint64), "different_lines": np.zeros(0, np.uint64)}
    for (h, _, s, e), lead in pieces(part, SPACE, SHARD, 1):
        size = (e - s)[lead:].astype(float)
        out["words"] += len(size)
        out["size"] += size.sum()
        out["square"] += (size * size).sum()
        out["same"] += (h[1:] == h[:-1]).sum()
        seen["distinct"] = np.union1d(seen["distinct"], h)
        seen["pairs"] = np.union1d(seen["pairs"], grams(h, 2))
    for (h, *_), _ in pieces(part, LINE, SHARD, 0):
        out["lines"] += len(h)
        seen["different_lines"] = np.union1d(seen["different_lines"], h)
    return {k: np.array([float(v)]) for k, v in (out | {k: len(v) for k, v in seen.items()}).items()}


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, len(NAMES)) transformed statistics of whole texts; finite for every text, null and empty included.

    A text beyond two shards is read in pieces: memory for a piece and for 8 bytes of each different word, pair of words and line."""
    bounds, raw = utf8(column)
    out = np.zeros((len(bounds) - 1, len(NAMES)))
    for a, b in shards(bounds, SHARD):
        own, part = bounds[a : b + 1] - bounds[a], raw[bounds[a] : bounds[b]]
        x = _long_sums(part) if len(part) > 2 * SHARD else _sums(own, part)
        length, nw, letters = np.diff(own).astype(float), x["words"].astype(float), x[f"kind{UPPER}"] + x[f"kind{LETTER}"]
        mean = x["size"] / np.maximum(nw, 1)
        spread = np.sqrt(np.maximum(x["square"] / np.maximum(nw, 1) - mean**2, 0))
        share = lambda x, of: np.sqrt((x + 0.5) / (of + 20))
        out[a:b] = np.stack(
            [
                np.log1p(nw), share(x[f"kind{UPPER}"], letters), *(share(x[f"kind{k}"], length) for k in (DIGIT, SYMBOL, BANG, STOP)),
                np.log1p(np.minimum(mean, 1000)), np.log1p(np.minimum(spread, 1000)), np.log((x["distinct"] + 3) / (nw + 3)), share(x["same"], nw),
                np.log((x["pairs"] + 3) / (np.maximum(nw - 1, 0) + 3)), np.log((x["different_lines"] + 1) / (x["lines"] + 1)),
            ], 1)
    return out


@dataclass
class Model:
    """Per class: mean, Cholesky factor of the covariance, half its log determinant; log odds of the classes' shares."""

    mean: np.ndarray
    factor: np.ndarray
    half_log_det: np.ndarray
    prior: float
    temper: float = TEMPER

    def __post_init__(self):
        self.inverse = np.linalg.inv(self.factor)  # of a triangular matrix, once; batches only multiply

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        log = [-0.5 * (((x - self.mean[c]) @ self.inverse[c].T) ** 2).sum(1) - self.half_log_det[c] for c in (0, 1)]
        z = np.clip(self.temper * (log[1] - log[0]) + self.prior, -700, 700)
        return 1 / (1 + np.exp(-z))


def solve(n: np.ndarray, s: np.ndarray, p: np.ndarray, pooled: float = POOLED, identity: float = IDENTITY) -> Model:
    """The model of counts n[2], sums s[2,d] and sums of products p[2,d,d].  A class without rows takes the other's (scores are then the prior); none at all: score 1/2."""
    d = s.shape[1]
    if not n.any():
        return Model(np.zeros((2, d)), np.stack([np.eye(d)] * 2), np.zeros(2), 0.0)
    if not n.all():
        full = int(n.argmax())
        s, p = np.stack([s[full]] * 2), np.stack([p[full]] * 2)
        used = np.stack([n[full]] * 2)
    else:
        used = n
    mean = s / used[:, None]
    scatter = p - used[:, None, None] * mean[:, :, None] * mean[:, None, :]
    within = scatter.sum(0) / used.sum()
    prior = float(np.log((n[1] + 1) / (n[0] + 1)))
    factor, half = [], []
    for c in (0, 1):
        cov = (1 - pooled) * scatter[c] / used[c] + pooled * within
        cov = (1 - identity) * cov + identity * (np.trace(within) / d + 1e-9) * np.eye(d)
        low = np.linalg.cholesky(cov)
        factor.append(low)
        half.append(float(np.log(np.diag(low)).sum()))
    return Model(mean, np.stack(factor), np.array(half), prior)


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, x) of each row of ``docs`` (doc_id, text): the statistics of its whole text."""
    d = len(NAMES)

    def stats(batches):
        for b in batches:
            x = pa.FixedSizeListArray.from_arrays(pa.array(statistics(b.column(2)).ravel()), d).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), x], ["doc_id", "held_out", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select(docs["doc_id"], held_out().alias("held_out"), docs["text"]).mapInArrow(stats, f"doc_id {kind}, held_out boolean, x array<double>")


def fit_features(rows: DataFrame, labels: DataFrame) -> Model:
    """The model of all ``rows`` (doc_id, x) that have a quality label 0 or 1 in ``labels``.

    Repeated documents and labels count as often as they pair up; a null id or label pairs with nothing."""
    d = len(NAMES)
    y = labels.where("quality in (0, 1)").select(labels["doc_id"].alias("l_id"), labels["quality"].cast("int").alias("y"))

    def sums(batches):
        n, s, p = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for b in batches:
            v, c = np.array(b.column(0).flatten()).reshape(-1, d), np.array(b.column(1))
            for k in (0, 1):
                own = v[c == k]
                n[k] += len(own)
                s[k] += own.sum(0)
                p[k] += own.T @ own
        flat = np.concatenate([np.concatenate([[n[k]], s[k], p[k].ravel()]) for k in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["k", "v"])

    labelled = rows.join(y, rows["doc_id"] == F.col("l_id")).select("x", "y")
    got = labelled.mapInArrow(sums, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros(2 * (1 + d + d * d))
    flat[got["k"].to_numpy(int)] = got["v"].to_numpy()
    flat = flat.reshape(2, -1)
    return solve(flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d))


def score_features(rows: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of each of ``rows``."""

    def run(batches):
        for b in batches:
            p = model.score(np.array(b.column(2).flatten()).reshape(-1, len(NAMES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, train: F.Column | None = None) -> Model:
    """The model of all rows of ``docs`` (doc_id, text) for which ``train`` holds, by ``fit_features``."""
    rows = docs.select(docs["doc_id"], docs["text"])
    held = cut(features(rows.where(train) if train is not None else rows), "quality")
    model = fit_features(held, labels)
    drop_cut(held)
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The id and fold of each row of ``docs`` with score (0 to 1) and predicted (1 from ``threshold`` on).  Repeated rows are answered each; equal texts score alike.  Null texts are judged
    as empty ones, very long ones in pieces; columns but doc_id and text, whatever their names, play no part."""
    return score_features(features(docs), model, threshold)


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with the columns of ``docs``, whatever they are called.

    Null texts are judged as empty ones, repeated rows alike, texts beyond two shards in pieces; no rows give none."""
    k = [f.name.lower() for f in docs.schema.fields].index("text")

    def run(batches):
        for b in batches:
            mask = pa.array(model.score(statistics(b.column(k))) >= threshold)
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in b.columns], b.schema.names)

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema.fields]))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, by a model of the labelled rows outside the held-out fold.  Every text is read once."""
    rows = cut(features(table(spark, sf_dir, "documents").select("doc_id", "text")), "quality")
    return score_features(rows, fit_features(rows.where(~F.col("held_out")), table(spark, sf_dir, "labels")))
