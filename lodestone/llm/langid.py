"""Language identification: a bidirectional gated recurrent network over bytes.

The network reads windows of WINDOW bytes in both directions, labels every position with probabilities of the learned languages, and a
document's probabilities are the mean over the positions of its letters.  Windows overlap: a label is taken from a window that goes on for AROUND bytes on either side of it, as far as the text does.
It is trained here, in numpy, by backpropagation through time, on a bounded sample of labelled rows (``per_language`` different texts of each language, those of the smallest text
hashes); what is read of each sampled text are windows drawn over the whole of it, PLACES of SNIPPET characters, from which the training steps take theirs.
Prediction covers every byte of every text in fixed memory, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import held_out, table, utf8

HIDDEN = 8
WINDOW = 160
AROUND = 16
PER_LANGUAGE = 1500
PLACES = 8
SNIPPET = 120
GROUP = 2048

LETTER = np.zeros(256, bool)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B] = True
LETTER[0x80:] = True


def _gate(x: np.ndarray) -> np.ndarray:
    """The piecewise linear sigmoid."""
    return np.clip(0.25 * x + 0.5, 0, 1)


@dataclass
class Net:
    """x: (2, 256, 3H) what a byte adds to update gate, reset gate and candidate, forward and backward; u: (2, H, 3H); o: (2, H, L); b: (L,)."""

    x: np.ndarray
    u: np.ndarray
    o: np.ndarray
    b: np.ndarray
    langs: list[str]

    @property
    def hidden(self) -> int:
        return self.u.shape[1]

    def states(self, data: np.ndarray, keep: list | None = None) -> np.ndarray:
        """data: (B, T) bytes.  Returns (2, T, B, H): the forward states, and the backward ones in the order of the text."""
        n, steps = data.shape
        hid = self.hidden
        xs = [self.x[0].astype(np.float32), self.x[1].astype(np.float32)]
        u = self.u.astype(np.float32)
        h, out = np.zeros((2, n, hid), np.float32), np.empty((2, steps, n, hid), np.float32)
        cols = np.ascontiguousarray(data.T)
        for t in range(steps):
            a = np.stack([xs[0][cols[t]], xs[1][cols[steps - 1 - t]]])
            v = np.matmul(h, u)
            g = _gate(a[..., : 2 * hid] + v[..., : 2 * hid])
            z, r = g[..., :hid], g[..., hid:]
            c = np.tanh(a[..., 2 * hid :] + r * v[..., 2 * hid :])
            new = c + z * (h - c)
            if keep is not None:
                keep.append((h, g, v[..., 2 * hid :], c))
            h = new
            out[0, t], out[1, steps - 1 - t] = h[0], h[1]
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """(T, L, B) probabilities of each position's label, for data (B, T).

        The same cell as ``states``, laid out with the windows innermost and the gates' scale folded into the weights."""
        n, steps = data.shape
        hid = self.hidden
        scale, shift = np.full(3 * hid, 0.25), np.full(3 * hid, 0.5)
        scale[2 * hid :], shift[2 * hid :] = 1, 0
        x = np.ascontiguousarray((self.x * scale + shift).transpose(0, 2, 1), np.float32)
        u = np.ascontiguousarray((self.u * scale).transpose(0, 2, 1), np.float32)
        o = np.ascontiguousarray(self.o.transpose(0, 2, 1), np.float32)
        cols = np.ascontiguousarray(data.T).astype(np.intp)
        y = np.empty((steps, len(self.b), n), np.float32)
        y[...] = self.b.astype(np.float32)[None, :, None]
        for k in (0, 1):
            h, a, v = np.zeros((hid, n), np.float32), np.empty((3 * hid, n), np.float32), np.empty((3 * hid, n), np.float32)
            g, c = np.empty((2 * hid, n), np.float32), np.empty((hid, n), np.float32)
            for t in range(steps) if k == 0 else range(steps - 1, -1, -1):
                np.take(x[k], cols[t], axis=1, out=a, mode="clip")
                np.matmul(u[k], h, out=v)
                np.add(a[: 2 * hid], v[: 2 * hid], out=g)
                np.maximum(g, 0, out=g)
                np.minimum(g, 1, out=g)
                np.multiply(g[hid:], v[2 * hid :], out=c)
                c += a[2 * hid :]
                np.tanh(c, out=c)
                h -= c
                h *= g[:hid]
                h += c
                y[t] += o[k] @ h
        y -= y.max(1, keepdims=True)
        np.exp(y, out=y)
        y /= y.sum(1, keepdims=True)
        return y


def train(snippets: list[bytes], labels: np.ndarray, langs: list[str], steps: int = 220, batch: int = 192, window: int = 80, hidden: int = HIDDEN, seed: int = 7) -> Net:
    """Adam on the mean cross-entropy of all positions.  Windows are drawn from the snippets, each language alike."""
    rng = np.random.default_rng(seed)
    size = len(langs)
    net = Net(rng.normal(0, 0.3, (2, 256, 3 * hidden)), rng.normal(0, 0.35, (2, hidden, 3 * hidden)), rng.normal(0, 0.3, (2, hidden, size)), np.zeros(size), langs)
    by = [np.flatnonzero(labels == k) for k in range(size)]
    by = [x for x in by if len(x)]
    if size < 2 or not by:
        return net
    names = ("x", "u", "o", "b")
    first, second = {k: np.zeros_like(getattr(net, k)) for k in names}, {k: np.zeros_like(getattr(net, k)) for k in names}
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by[j % len(by)]) for j in range(batch)])
        data = np.full((batch, window), 32, np.uint8)
        for j, i in enumerate(pick):
            s = snippets[i]
            lo = int(rng.integers(0, max(1, len(s) - window + 1)))
            part = np.frombuffer(s[lo : lo + window], np.uint8)
            data[j, : len(part)] = part
        grad = _gradient(net, data, labels[pick])
        norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
        rate = 0.03 * min(1, 2.2 * (1 - step / (steps + 1)))
        for k in names:
            g = grad[k] * min(1.0, 1.0 / (norm + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            getattr(net, k)[...] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _gradient(net: Net, data: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    n, steps = data.shape
    hid, kept = net.hidden, []
    s = net.states(data, kept).astype(float)
    y = s[0] @ net.o[0] + s[1] @ net.o[1] + net.b
    y = np.exp(y - y.max(-1, keepdims=True))
    d = y / y.sum(-1, keepdims=True)
    d[:, np.arange(n), labels] -= 1
    d /= n * steps
    flat = d.reshape(-1, d.shape[-1])
    go = np.stack([s[k].reshape(-1, hid).T @ flat for k in (0, 1)])
    ds = np.stack([d @ net.o[0].T, d @ net.o[1].T])
    gx, gu, dh = np.zeros_like(net.x), np.zeros_like(net.u), np.zeros((2, n, hid))
    for t in range(steps - 1, -1, -1):
        dh = dh + np.stack([ds[0, t], ds[1, steps - 1 - t]])
        h, g, v, c = kept[t]
        z, r = g[..., :hid], g[..., hid:]
        dc = dh * (1 - z) * (1 - c * c)
        dz, dr = dh * (h - c), dc * v
        da = np.concatenate([dz, dr], -1) * 0.25 * ((g > 0) & (g < 1))
        dv = np.concatenate([da, dc * r], -1)
        full = np.concatenate([da, dc], -1)
        np.add.at(gx[0], data[:, t], full[0])
        np.add.at(gx[1], data[:, steps - 1 - t], full[1])
        gu += np.matmul(h.transpose(0, 2, 1).astype(float), dv)
        dh = dh * z + np.matmul(dv, net.u.transpose(0, 2, 1))
    return {"x": gx, "u": gu, "o": go, "b": flat.sum(0)}


def pooled(net: Net, column: pa.Array) -> np.ndarray:
    """(rows, L): mean of the position probabilities over the letters of each whole text; zeros for a text without letters."""
    bounds, raw = utf8(column)
    size = np.diff(bounds)
    total, weight = np.zeros((len(size), len(net.langs))), np.zeros(len(size))
    step = WINDOW - 2 * AROUND
    n = np.where(size > WINDOW, -(-size // step), 0)
    doc = np.repeat(np.arange(len(size)), n)
    own = step * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))  # each window labels the ``step`` bytes from here
    at = np.clip(own - AROUND, 0, size[doc] - WINDOW)
    groups = [(WINDOW, doc, bounds[doc] + at, own - at, np.minimum(own + step, size[doc]) - at)]
    short = np.flatnonzero((size > 0) & (size <= WINDOW))
    for w in np.unique(size[short]):
        rows = short[size[short] == w]
        groups.append((int(w), rows, bounds[rows], np.zeros(len(rows), np.int64), np.full(len(rows), w)))
    for w, doc, at, skip, stop in groups:
        for k in range(0, len(doc), GROUP):
            d, a, s, e = doc[k : k + GROUP], at[k : k + GROUP], skip[k : k + GROUP], stop[k : k + GROUP]
            data = raw[a[:, None] + np.arange(w)[None, :]]
            place = np.arange(w)[None, :]
            use = (LETTER[data] & (place >= s[:, None]) & (place < e[:, None])).astype(np.float32)
            p = (net.positions(data) * use.T[:, None, :]).sum(0).T.astype(float)
            for j in range(p.shape[1]):
                total[:, j] += np.bincount(d, p[:, j], len(size))
            weight += np.bincount(d, use.sum(1), len(size))
    return total / np.maximum(weight, 1)[:, None]


def sample(docs: DataFrame, train_on: F.Column | None = None, per_language: int = PER_LANGUAGE) -> tuple[list[bytes], np.ndarray, list[str]]:
    """Windows of at most ``per_language`` different texts of each language, those of the smallest hash of their text: PLACES windows of each, at places that a hash draws from the whole text.  Ids and sources play no part.

    Only hashes under a limit are looked at, set for each language by an estimate of its number of different texts so that about four times as many as wanted lie under it; should fewer
    than wanted do so, the limit is raised.  So copies and languages of any size meet in no one task, and the driver gets a few thousand rows of each language."""
    rows = docs.where("lang is not null and text is not null")
    rows = rows.where(train_on) if train_on is not None else rows
    key = F.xxhash64("text")
    at = lambda i: F.pmod(F.xxhash64("text", i), F.greatest(F.length("text") - SNIPPET + 1, F.lit(1))).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(1), F.lit(PLACES)), lambda i: F.substring(F.col("text"), at(i), F.lit(SNIPPET)))
    rows = rows.where(F.col("text").rlike("\\p{L}")).select("lang", key.alias("k"), "text")
    share = {r["lang"]: min(1.0, 4 * per_language / r["d"]) for r in rows.groupBy("lang").agg(F.approx_count_distinct("k").alias("d")).collect()}
    found: dict[str, list[tuple[int, str]]] = {}
    while left := {x: s for x, s in share.items() if x not in found}:
        limits = docs.sparkSession.createDataFrame([(x, int(s * (1 << 64)) - (1 << 63) - 1) for x, s in left.items()], "l string, most long")
        under = rows.join(F.broadcast(limits), F.col("lang") == F.col("l")).where(F.col("k") <= F.col("most"))  # a row for each language
        got = under.select("lang", "k", F.filter(drawn, lambda t: t.rlike("\\p{L}")).alias("t")).groupBy("lang", "k").agg(F.first("t").alias("t")).toPandas().sort_values(["lang", "k"])
        for x, s in left.items():
            own = got[got["lang"] == x]
            if len(own) >= per_language or s >= 1:
                found[x] = list(zip(own["k"], own["t"], strict=True))[:per_language]
            else:
                share[x] = min(1.0, 2 * s)
    langs = sorted(x for x, own in found.items() if own)
    windows = [(k, t.encode()) for k, x in enumerate(langs) for _, texts in found[x] for t in texts]
    return [t for _, t in windows], np.array([k for k, _ in windows], np.int64), langs


def predict(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the pooled probability of lang_pred) of each row.

    A null text and one without a letter get ``und`` and 0, and so does every row where no language was learned.  Of languages with equal probability the first by name is taken.  A very
    long text is read window by window, each with AROUND bytes on either side.  Repeated rows are answered each; other columns, whatever their names, play no part."""

    def run(batches):
        for b in batches:
            p = pooled(net, b.column(2)) if net.langs else np.zeros((b.num_rows, 1))
            best = p.argmax(1)
            seen = np.array(b.column(3).fill_null(False)) & bool(net.langs)
            lang = [net.langs[k] if s else "und" for k, s in zip(best, seen, strict=True)]
            score = np.clip(np.where(seen, p[np.arange(len(p)), best], 0.0), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(docs["doc_id"], held_out().alias("held_out"), docs["text"], docs["text"].rlike("\\p{L}").alias("letters"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def fit(docs: DataFrame, train_on: F.Column | None = None, per_language: int = PER_LANGUAGE) -> Net:
    return train(*sample(docs, train_on, per_language))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs, ~held_out()))
