"""BM25 top-k with block maxima: documents are scored where they lie, and only the best k of each task leave it.

Queries travel in blocks of bounded size.  A task takes its documents BLOCK at a time, as a small block of postings: for each term of the queries the documents that have it, with the
largest frequency and the smallest document length among them.  Both bound what the term can add to any document of the block, whatever k1, b and mean length a query has, so the
sum of these bounds bounds the block.  A query whose k-th best score so far lies above skips the block unread; for others, scores of all documents in it are added up term by term.

Nothing is shuffled but k rows for each query and task.  Documents that share no term with a query have score 0 and are ranked with the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a block at most (fewer where many queries share the memory for scores), and numbers of a block's score matrix.
BLOCK, CELLS = 4096, 4_000_000
#: Tokens of documents whose postings are made at once.
TOKENS = 1 << 19
#: A term goes into the matrix product where it is in more than SHARE of the queries, COMMON terms at most, and where (queries with it) * (documents with it) are more than PRODUCT of a block's cells.
SHARE, COMMON, PRODUCT = 0.005, 768, 0.003
#: Terms of other queries and documents that are met at once.
MEETINGS = 1 << 20
#: Bytes and number of queries that are sent at once.
QUERY_BYTES, QUERIES = 32 << 20, 16_384


class Sent:
    """A block of queries: terms (words, or their hashes), and for each term the queries that have it with their weights."""

    def __init__(self, rows):
        if isinstance(rows, pa.Table):
            q, s, k1, b, avgdl, terms, w = (rows.column(c).combine_chunks() for c in ("q", "s", "k1", "b", "avgdl", "terms", "w"))
            number = lambda x: pc.fill_null(x.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False).copy()
            self.q, self.s = q.to_numpy(zero_copy_only=False).astype(np.int64), s.to_numpy(zero_copy_only=False).astype(np.int64)
            self.k1, self.b, self.mean = number(k1), number(b), number(avgdl)
            of = np.repeat(np.arange(len(self.q), dtype=np.int32), pc.fill_null(terms.value_lengths(), 0).to_numpy(zero_copy_only=False))
            terms, w = terms.flatten().to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False).astype(float)
        else:
            self.q = np.array([r["q"] for r in rows], np.int64)
            self.s = np.array([r["s"] for r in rows], np.int64)
            self.k1, self.b, self.mean = (np.array([float(r[c] or 0) for r in rows]) for c in ("k1", "b", "avgdl"))
            pairs = [(t["t"], i, t["w"]) for i, r in enumerate(rows) for t in r["terms"] or ()]
            of, terms, w = np.array([i for _, i, _ in pairs], np.int32), np.array([t for t, _, _ in pairs]), np.array([w for _, _, w in pairs], float)
        self.mean[self.mean <= 0] = 1.0
        self.kinds, self.kind = np.unique(np.stack([self.k1, self.b, self.mean]), axis=1, return_inverse=True) if len(self.q) else (np.zeros((3, 0)), np.zeros(0, np.int64))
        self.kind = self.kind.reshape(-1)
        self.vocabulary, term = np.unique(terms, return_inverse=True)
        order = np.argsort(term, kind="stable")
        self.of, self.w, term = of[order], w[order], term[order]
        self.start = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        # with one mean for all, scores are never less where weights aren't negative, and at most by this ratio more
        self.ratio = self.mean.min() / self.mean.max() if len(self.q) else 1.0
        self.bounded = len(self.q) > 0 and len(np.unique(self.k1)) == len(np.unique(self.b)) == 1 and bool((self.w >= 0).all()) and self.k1[0] >= 0 and 0 <= self.b[0] <= 1

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """(for each term its column or -1, weights of queries by columns) of the terms that many queries have: these are multiplied as a matrix.  Made in the task, once."""
        if not hasattr(self, "_common"):
            many = np.diff(self.start)
            columns = np.argsort(-many, kind="stable")[:COMMON]
            columns = np.sort(columns[many[columns] > max(1, len(self.q) * SHARE)])
            column = np.full(len(many), -1)
            column[columns] = np.arange(len(columns))
            of = column[np.repeat(np.arange(len(many)), many)]
            weights = np.zeros((len(self.q), len(columns)))
            np.add.at(weights, (self.of[of >= 0], of[of >= 0]), self.w[of >= 0])
            self._common = column, weights, weights.astype(np.float32)
        return self._common

    def by_query(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, terms, weights) of each query's own terms."""
        if not hasattr(self, "_by_query"):
            term = np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))
            order = np.argsort(self.of, kind="stable")
            self._by_query = np.searchsorted(self.of[order], np.arange(len(self.q) + 1)), term[order], self.w[order]
        return self._by_query

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_common", "_by_query")}

    def weight(self, of: np.ndarray, w: np.ndarray, f: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term of weight w adds for queries ``of`` where it occurs f times in ``length`` words."""
        k1, b = self.k1[of], self.b[of]
        return w * f * (k1 + 1) / (f + k1 * (1 - b + b * length / self.mean[of]))

    def block(self) -> int:
        return min(BLOCK, max(256, CELLS // max(len(self.q), 1)))


def ranges(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers start[i], start[i] + 1, ..., many[i] of them for each i."""
    return np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())


class Best:
    """The k best documents of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.exact = self.score.copy()

    def merge(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds a block's scores (rows of queries by documents in the order of their ids).  Only what can be among the k first is sorted."""
        if not score.size:
            return
        low = self.score[rows, -1].copy()
        open_ = np.flatnonzero(np.isneginf(low))
        if len(open_) and score.shape[1] > self.k:
            low[open_] = np.partition(score[open_], score.shape[1] - self.k, axis=1)[:, score.shape[1] - self.k]
        able = ((score > low[:, None]) | ((score == low[:, None]) & (ids[None, :] < self.id[rows, -1][:, None]))) & (score > -np.inf)
        tied = np.flatnonzero(np.count_nonzero(able, axis=1) > 4 * self.k)  # many equal ones: the first of them by id
        if len(tied):
            top = np.argsort(-score[tied], axis=1, kind="stable")[:, : self.k]
            able[tied] = False
            able[tied[:, None], top] = score[tied[:, None], top] > -np.inf
        i, j = np.nonzero(able)
        self.add(rows[i], score[i, j], ids[j])

    def add(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Adds single scores, in any order."""
        if not len(rows):
            return
        some = np.unique(rows)
        i, j = np.nonzero(self.score[some] > -np.inf)
        q, x, name = np.concatenate([some[i], rows]), np.concatenate([self.score[some[i], j], score]), np.concatenate([self.id[some[i], j], ids])
        order = np.lexsort((name, -x, q))
        q, x, name = q[order], x[order], name[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        at = place < self.k
        self.score[q[at], place[at]], self.id[q[at], place[at]] = x[at], name[at]

    def merge_first(self, exact: np.ndarray, ids: np.ndarray, digits: int) -> None:
        """Adds scores (all queries by vectors in the order of their ids) that are ranked rounded and kept as they are; only the k first of the block are sorted."""
        k = self.k
        if exact.shape[1] > k:
            low = np.partition(exact, exact.shape[1] - k, axis=1)[:, exact.shape[1] - k]
            i, j = np.nonzero((exact >= np.maximum(low, self.exact.min(axis=1))[:, None] - 2 * 10.0**-digits) & (exact > -np.inf))
        else:
            i, j = np.nonzero(exact > -np.inf)
        have = np.nonzero(self.score > -np.inf)
        q, x, name = np.concatenate([have[0], i]), np.concatenate([self.exact[have], exact[i, j]]), np.concatenate([self.id[have], ids[j]])
        score = half_up(x, digits)
        order = np.lexsort((name, -score, q))
        q, x, name, score = q[order], x[order], name[order], score[order]
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        at = place < k
        to = (q[at], place[at])
        self.score[to], self.exact[to], self.id[to] = score[at], x[at], name[at]


def block_postings(ids: np.ndarray, lists: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order of the documents by id, their lengths in that order, keys document * vocabulary + term that occur, their frequencies)."""
    length = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(place, length)
    key, f = np.unique(row[term >= 0] * max(len(vocabulary), 1) + term[term >= 0], return_counts=True)
    return order, length[order], key, f


def term_blocks(sent: Sent, batch: pa.RecordBatch, skip: bool):
    """(ids, rows, score(active), bound) of each block of documents of a batch (id, toks): scores of the queries ``active`` with all documents in the order of their ids, and with ``skip`` a bound of each query's scores."""
    lists = batch.column(1)
    known = pa.array(sent.vocabulary, lists.type.value_type) if len(sent.vocabulary) else pa.array([], lists.type.value_type)
    tokens = np.cumsum(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:  # documents of TOKENS tokens, or one, have their postings made at once
        hi = max(lo + 1, int(np.searchsorted(tokens, (tokens[lo - 1] if lo else 0) + TOKENS, "right")))
        for ids, rows, score, bound in _term_blocks(sent, batch.column(0)[lo:hi].to_numpy(), lists[lo:hi], known, skip):
            yield ids, rows + lo, score, bound
        lo = hi


class Block:
    """Postings of some documents: doc, term and frequency in the order of terms, and the documents' lengths."""

    def __init__(self, sent: Sent, doc, term, freq, own):
        self.sent, self.own = sent, own
        self.by_doc = doc, term, freq
        by = np.argsort(term, kind="stable")
        self.doc, self.term, self.freq = doc[by], term[by], freq[by]

    def _sums(self, active, each, kind, wide: bool):
        """Scores of ``active`` queries, ``each``: what a posting adds per weight, or None where this depends on the query."""
        sent, count = self.sent, len(self.own)
        whole = len(active) == len(sent.q)
        out = np.zeros((len(active), count), np.float64 if wide else np.float32)
        rest = np.ones(len(self.term), bool)
        if each is not None and len(self.term):
            column, weights, light = sent.common()
            column = column[self.term]
            pairs = np.diff(sent.start)[self.term]
            width = weights.shape[1]
            cells = np.bincount(column[column >= 0], pairs[column >= 0], width) if width else np.zeros(0)
            used = np.flatnonzero(cells > PRODUCT * len(sent.q) * count)
            if len(used):
                place = np.full(width + 1, -1)
                place[used] = np.arange(len(used))
                at = place[column]
                rest = at < 0
                table = np.zeros((len(used), count), out.dtype)
                table[at[~rest], self.doc[~rest]] = each[~rest]
                mine = (weights if wide else light)[:, used] if whole else (weights if wide else light)[np.ix_(active, used)]
                out = mine @ table
        doc, term, freq = self.doc[rest], self.term[rest], self.freq[rest]
        value = None if each is None else each[rest]
        start, of, w = sent.start, sent.of, sent.w
        if not whole:
            to = np.full(len(sent.q), -1)
            to[active] = np.arange(len(active))
            keep = to[of] >= 0
            start, of, w = np.append(0, np.cumsum(keep))[start], of[keep], w[keep]
        many = start[term + 1] - start[term]
        have = np.flatnonzero(many)
        doc, term, freq, many = doc[have], term[have], freq[have], many[have]
        value = None if value is None else value[have]
        ends, lo, flat = np.cumsum(many), 0, out.reshape(-1)
        while lo < len(many):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEETINGS, "right")))
            n = many[lo:hi]
            at = ranges(start[term[lo:hi]], n)
            q, d = of[at], np.repeat(doc[lo:hi], n)
            if value is None:
                add = sent.weight(q, w[at], np.repeat(freq[lo:hi], n), self.own[d])
            else:
                add = w[at] * np.repeat(value[lo:hi], n)
            np.add.at(flat, (q if whole else to[q]).astype(np.int64) * count + d, add.astype(out.dtype, copy=False))
            lo = hi
        return out

    def __call__(self, active) -> np.ndarray:
        """Scores of ``active`` queries with all documents."""
        sent = self.sent
        if sent.kinds.shape[1] > 16:
            return self._sums(active, None, None, True)
        if sent.kinds.shape[1] == 1:
            return self._sums(active, self.each(*sent.kinds[:, 0]), 0, True)
        out = np.zeros((len(active), len(self.own)))
        for kind in np.unique(sent.kind[active]):
            mine = np.flatnonzero(sent.kind[active] == kind)
            out[mine] = self._sums(active[mine], self.each(*sent.kinds[:, kind]), kind, True)
        return out

    def each(self, k1, b, mean):
        return self.freq * (k1 + 1) / (self.freq + k1 * (1 - b + b * self.own[self.doc] / mean))

    def products(self, active) -> np.ndarray:
        """Sums of weights times what stands for the frequencies, as it is."""
        return self._sums(active, self.freq, 0, True)

    def above(self, active) -> np.ndarray:
        """Bounds of the scores, too high by ``Sent.ratio`` and the rounding of short floats at most."""
        sent = self.sent
        return self._sums(active, self.each(sent.k1[0], sent.b[0], sent.mean.max()), 0, False)

    def pairs(self, i, j) -> np.ndarray:
        """The scores of queries i with documents j, pair by pair, in the order of j."""
        sent = self.sent
        start, terms, weights = sent.by_query()
        doc, term, freq = self.by_doc
        edge, out, at = np.searchsorted(doc, np.arange(len(self.own) + 1)), np.zeros(len(i)), np.zeros(len(sent.vocabulary))
        bounds = np.flatnonzero(np.append(np.append(True, j[1:] != j[:-1]), True)) if len(j) else np.zeros(1, np.int64)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            d = j[lo]
            mine = term[edge[d] : edge[d + 1]]
            at[mine] = freq[edge[d] : edge[d + 1]]
            for part in range(lo, hi, 2048):
                q = i[part : min(part + 2048, hi)]
                many = start[q + 1] - start[q]
                place = ranges(start[q], many)
                f = at[terms[place]]
                hit = np.flatnonzero(f)
                row = np.repeat(np.arange(len(q)), many)[hit]
                out[part : part + len(q)] = np.bincount(row, sent.weight(q[row], weights[place[hit]], f[hit], self.own[d]), len(q))
            at[mine] = 0
        return out


def _term_blocks(sent: Sent, ids: np.ndarray, lists: pa.Array, known: pa.Array, skip: bool):
    size, n = max(len(sent.vocabulary), 1), len(sent.q)
    order, length, key, f = block_postings(ids, lists, known)
    ids, step = ids[order], sent.block()
    for lo in range(0, len(ids), step):
        hi = min(lo + step, len(ids))
        a, b = np.searchsorted(key, (lo * size, hi * size))
        block = Block(sent, key[a:b] // size - lo, key[a:b] % size, f[a:b].astype(float), length[lo:hi].astype(float))
        bound, term = np.zeros(n), block.term
        if skip and len(term):
            first = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
            t = term[first]
            most, shortest, many = np.maximum.reduceat(block.freq, first), np.minimum.reduceat(block.own[block.doc], first), sent.start[t + 1] - sent.start[t]
            at = ranges(sent.start[t], many)
            if len(at):
                bound = np.bincount(sent.of[at], sent.weight(sent.of[at], np.maximum(sent.w[at], 0), np.repeat(most, many), np.repeat(shortest, many)), n)
        yield ids[lo:hi], order[lo:hi], block, bound


class SentVectors:
    """A block of query vectors; those that are null or zero have score 0 with everything."""

    def __init__(self, rows):
        self.q, self.s = np.array([r["q"] for r in rows], np.int64), np.array([r["s"] for r in rows], np.int64)
        dim = max((len(r["v"]) for r in rows if r["v"] is not None), default=1)
        self.v = unit_rows(np.array([r["v"] if r["v"] is not None else [0.0] * dim for r in rows], float).reshape(len(rows), dim))


def half_up(x: np.ndarray, digits: int | None) -> np.ndarray:
    """Rounded as SQL rounds doubles: the binary product with the scale, its halves away from zero, and nothing below a half.  Without ``digits`` as it is."""
    if digits is None:
        return x
    scale = 10.0**digits
    y = np.abs(x) * scale
    whole = np.floor(y)
    return np.sign(x) * (whole + (y >= whole + 0.5)) / scale


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def vector_blocks(sent: SentVectors, batch: pa.RecordBatch, skip: bool):
    """As ``term_blocks``, of cosines with a batch (id, v); a null vector counts as zero."""
    ids, dim = batch.column(0).to_numpy(), sent.v.shape[1]
    x = np.zeros((len(ids), dim))
    there = np.flatnonzero(batch.column(1).is_valid().to_numpy(zero_copy_only=False))
    x[there] = batch.column(1).take(pa.array(there)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    order = np.argsort(ids, kind="stable")
    x = unit_rows(x)[order]
    step = min(BLOCK, max(256, CELLS // max(len(sent.q), 1)))
    for lo in range(0, len(ids), step):
        yield ids[order[lo : lo + step]], order[lo : lo + step], (lambda active, y=x[lo : lo + step]: sent.v[active] @ y.T), np.full(len(sent.q), np.inf)


class SentNumbers:
    """A block of query numbers."""

    def __init__(self, rows):
        self.q, self.s = np.array([r["q"] for r in rows], np.int64), np.array([r["s"] for r in rows], np.int64)
        self.x, self.null = np.array([r["x"] or 0 for r in rows], float), np.array([r["x"] is None for r in rows], bool)


#: What stands for null, the lowest score, and for NaN, the highest.
FAR = 1e308


def number_blocks(sent: SentNumbers, batch: pa.RecordBatch, skip: bool):
    """As ``term_blocks``, of distances of numbers (id, x), negated; a null on either side comes last."""
    ids, null = batch.column(0).to_numpy(), batch.column(1).is_null().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    x, null, step = pc.fill_null(batch.column(1), 0.0).to_numpy()[order], null[order], min(BLOCK, max(256, CELLS // max(len(sent.q), 1)))

    def score(active, lo):
        with np.errstate(invalid="ignore"):
            out = -np.abs(x[None, lo : lo + step] - sent.x[active, None])
        out[np.isnan(out)] = FAR
        out[np.isneginf(out)] = -FAR / 2
        out[sent.null[active]] = -FAR
        out[:, null[lo : lo + step]] = -FAR
        return out

    for lo in range(0, len(ids), step):
        yield ids[order[lo : lo + step]], order[lo : lo + step], (lambda active, lo=lo: score(active, lo)), np.full(len(sent.q), np.inf)


KINDS = {"terms": (Sent, term_blocks), "v": (SentVectors, vector_blocks), "x": (SentNumbers, number_blocks)}
CONTENT = {"terms": "toks", "v": "v", "x": "x"}


def kind_of(queries: DataFrame) -> str:
    return next(k for k in KINDS if k in queries.columns)


def contents(docs: DataFrame, kind: str) -> DataFrame:
    x = CONTENT[kind]
    return (hashed(docs) if kind == "terms" else docs).select(F.col("id").cast("long").alias("id"), F.col(x).cast("double").alias(x) if kind == "x" else F.col(x), *(c for c in docs.columns if c == "factor"))


def slack(digits: int | None) -> float:
    return 0.0 if digits is None else 2 * 10.0**-digits


def score_blocks(sent, best: Best, batch: pa.RecordBatch, blocks=term_blocks, own: bool = True, digits: int = 6, skip: bool = True, seen: dict | None = None) -> None:
    """Scores a batch of documents (id, toks or v[, factor]) into ``best``.  ``seen`` counts blocks read and skipped and keeps the least and the largest score of each query, which needs ``skip`` off."""
    n = len(sent.q)
    weight = batch.column(2).to_numpy(zero_copy_only=False) if batch.num_columns > 2 else None
    for ids, rows, score, bound in blocks(sent, batch, skip):
        factor = None if weight is None else weight[rows]
        if factor is not None:
            bound = bound * max(factor.max(), 0)
        active = np.flatnonzero(~(bound < best.score[:, -1] - slack(digits))) if skip else np.arange(n)
        if seen is not None:
            seen["read"], seen["skipped"] = seen.get("read", 0) + len(active), seen.get("skipped", 0) + n - len(active)
        if not len(active):
            continue
        if skip and factor is None and isinstance(score, Block) and sent.bounded and sent.kinds.shape[1] > 1:
            active = _screened(sent, best, score, active, ids, own, digits)
            if not len(active):
                continue
        got = half_up(score(active), digits)
        if factor is not None:
            got = half_up(got * factor[None, :], digits)
        if not own:
            got[sent.q[active][:, None] == ids[None, :]] = -np.inf
        if seen is not None and not skip:
            finite = np.where(np.isfinite(got), got, np.nan)
            seen["lo"], seen["hi"] = np.fmin(seen.get("lo", np.full(n, np.nan)), np.nanmin(finite, axis=1)), np.fmax(seen.get("hi", np.full(n, np.nan)), np.nanmax(finite, axis=1))
        best.merge(active, got, ids)


def _screened(sent: Sent, best: Best, block: Block, active: np.ndarray, ids: np.ndarray, own: bool, digits: int) -> np.ndarray:
    """Adds the documents that can be among the first k, by bounds that are one matrix product; only their scores are made.  Returns the queries for which documents of score 0 count."""
    short = 1e-4
    most, k = block.above(active), best.k
    if not own:
        most[sent.q[active][:, None] == ids[None, :]] = 0
    low = best.score[active, -1].copy()
    fresh = np.flatnonzero(np.isneginf(low))
    if len(fresh) and most.shape[1] > k:
        low[fresh] = np.partition(most[fresh], most.shape[1] - k, axis=1)[:, most.shape[1] - k] * sent.ratio * (1 - short)
    low = (low - slack(digits)) * (1 - short)
    plain = low <= 0
    j, i = np.nonzero((most >= np.where(plain, np.inf, low)[:, None]).T)
    score = half_up(block.pairs(active[i], j), digits)
    best.add(active[i], score, ids[j])
    return active[plain]


def hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with their words as 64-bit hashes."""
    return docs.withColumn("toks", F.transform("toks", lambda t: F.xxhash64(t))) if dict(docs.dtypes)["toks"] == "array<string>" else docs


def sendings(queries: DataFrame, kind: str):
    """The queries in blocks of bounded size, each collected when it is asked for; they are made once."""
    from .retrieval import written

    if kind == "terms":
        packed = "t:bigint" in dict(queries.dtypes)["terms"]
        rows = written(queries.select(F.col("q").cast("long").alias("q"), F.col("s").cast("int").alias("s"), "k1", "b", "avgdl", F.transform("terms", lambda t: t["t"] if packed else F.xxhash64(t["t"])).alias("terms"), F.transform("terms", lambda t: t["w"].cast("double")).alias("w")))
        size = F.greatest(F.size("terms"), F.lit(0)).cast("long") * 16
    else:
        rows, size = queries, F.size("v").cast("long") * 8 if kind == "v" else F.lit(0).cast("long")
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.coalesce(size, F.lit(0).cast("long")) + 200)).first()
    blocks = max(1, math.ceil((total or 0) / QUERY_BYTES), math.ceil(n / QUERIES))
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64(F.col("q").cast(dict(queries.dtypes)["q"]), F.col("s").cast(dict(queries.dtypes)["s"])), F.lit(blocks)) == k)
        yield blocks, k, KINDS[kind][0](part.toArrow() if kind == "terms" else part.collect())


def top(docs: DataFrame, queries: DataFrame, k: int, own: bool = True, digits: int | None = 6, spans: bool = False) -> DataFrame:
    """(q, s, id, score, rank[, lo, hi]): of each query the first ``k`` of all ``docs`` by (score rounded to ``digits``, descending; id, ascending), fewer only where there are fewer documents.

    ``docs``: id, toks (tokens in order, null for none), and factor if scores are to be multiplied by one.  ``queries``: q, s (a number of a setting), k1, b, avgdl and terms, an array of (t, w) with
    w the weight of a term times its occurrences.  ``own`` off leaves the document of a query's own id out.  ``spans`` adds the least and the largest score over all documents, which reads every block."""
    spark, kind = queries.sparkSession, kind_of(queries)
    rows = contents(docs, kind)
    rows = rows.withColumn("factor", F.col("factor").cast("double")) if "factor" in docs.columns else rows
    schema = "q long, s int, id long, score double" + ", lo double, hi double" * spans

    def task(sent):
        def run(batches):
            block = sent.value
            best, seen = Best(len(block.q), k), {}
            for b in batches:
                if b.num_rows and len(block.q):
                    score_blocks(block, best, b, KINDS[kind][1], own, digits, not spans, seen if spans else None)
            i, j = np.nonzero(best.score > -np.inf)
            cols = [block.q[i], block.s[i].astype(np.int32), best.id[i, j], best.score[i, j]]
            if spans:
                cols += [seen[c][i] if len(i) else np.zeros(0) for c in ("lo", "hi")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["q", "s", "id", "score"] + ["lo", "hi"] * spans)

        return run

    out = None
    for _, _, part in sendings(queries, kind):
        got = rows.mapInArrow(task(spark.sparkContext.broadcast(part)), schema)
        out = got if out is None else out.unionByName(got)
    group = Window.partitionBy("q", "s")
    if spans:
        out = out.withColumns({"lo": F.min("lo").over(group), "hi": F.max("hi").over(group)})  # k rows of a task
    out = out.withColumn("rank", F.row_number().over(group.orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)
    kinds = dict(queries.dtypes) | {"id": dict(docs.dtypes)["id"]}
    return out.withColumns({c: F.col(c).cast(kinds[c]) for c in ("q", "id")})


def next_picks(docs: DataFrame, queries: DataFrame, weight: float, digits: int = 6) -> DataFrame:
    """(q, id, words): the next pick of each query by marginal relevance, among ``docs`` (id, toks, words: sorted hashes of the different words).

    ``queries`` has besides its terms what is chosen (ids, sets) and the span lo, hi of its scores.  A document is worth weight * relevance - (1 - weight) * its largest Jaccard similarity with what is chosen; ties go
    by (score descending, id).  Queries without a document left give no row."""
    spark = queries.sparkSession
    rows = hashed(docs).select(F.col("id").cast("long").alias("id"), "toks", "words")

    def task(sent, extra):
        def run(batches):
            block, more = sent.value, extra.value
            n = len(block.q)
            best = [None] * n  # (-value, -score, id, words)
            for b in batches:
                if not b.num_rows or not n:
                    continue
                lists = b.column(2)
                size = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                flat, edge = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(size))
                for ids, places, score, _ in term_blocks(block, b.select([0, 1]), False):
                    got = half_up(score(np.arange(n)), digits)
                    for i in range(n):
                        chosen, sets, lo, hi = more[i]
                        rel = np.ones(len(ids)) if hi == lo else (got[i] - lo) / (hi - lo)
                        most = np.round(weight * rel, 9)
                        able = np.flatnonzero((most >= (-np.inf if best[i] is None else -best[i][0])) & ~np.isin(ids, chosen))
                        if not len(able):
                            continue
                        at = places[able]
                        own = size[at]
                        words = flat[np.repeat(edge[at] - np.cumsum(own) + own, own) + np.arange(own.sum())]
                        row, sim = np.repeat(np.arange(len(able)), own), np.zeros(len(able))
                        for s in sets:
                            both = np.bincount(row, s[np.minimum(np.searchsorted(s, words), len(s) - 1)] == words, len(able)) if len(s) else np.zeros(len(able))
                            union = own + len(s) - both
                            sim = np.maximum(sim, np.divide(both, union, out=np.zeros(len(able)), where=union > 0))
                        value = np.round(weight * rel[able] - (1 - weight) * sim, 9)
                        j = np.lexsort((ids[able], -got[i][able], -value))[0]
                        key = (-value[j], -got[i][able[j]], int(ids[able[j]]))
                        if best[i] is None or key < best[i][:3]:
                            best[i] = (*key, flat[edge[at[j]] : edge[at[j] + 1]].copy())
            found = [(int(block.q[i]), float(x[0]), float(x[1]), x[2], x[3]) for i, x in enumerate(best) if x is not None]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["q", "v", "s", "id", "words"])

        return run

    out = None
    for blocks, k, part in sendings(queries, "terms"):
        mine = queries.where(F.pmod(F.xxhash64("q", "s"), F.lit(blocks)) == k).select("q", "ids", "sets", "lo", "hi").collect()  # one block, some documents a query
        of = {r["q"]: (np.array(r["ids"], np.int64), [np.array(s, np.int64) for s in r["sets"]], r["lo"], r["hi"]) for r in mine}
        extra = spark.sparkContext.broadcast([of[q] for q in part.q.tolist()])
        got = rows.mapInArrow(task(spark.sparkContext.broadcast(part), extra), "q long, v double, s double, id long, words array<long>")
        out = got if out is None else out.unionByName(got)
    best = out.groupBy("q").agg(F.min(F.struct("v", "s", "id", "words")).alias("b"))
    return best.select(F.col("q").cast(dict(queries.dtypes)["q"]).alias("q"), F.col("b.id").cast(dict(docs.dtypes)["id"]).alias("id"), F.col("b.words").alias("words"))


def scores(docs: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """(q, id, score) of all pairs whose score isn't 0: for what needs whole rankings."""
    kind = kind_of(queries)
    rows = contents(docs.drop("factor"), kind)

    def task(sent):
        def run(batches):
            block = sent.value
            for b in batches:
                if b.num_rows and len(block.q):
                    for ids, _, score, _ in KINDS[kind][1](block, b, False):
                        got = half_up(score(np.arange(len(block.q))), digits)
                        i, j = np.nonzero(got)
                        yield pa.RecordBatch.from_arrays([pa.array(block.q[i]), pa.array(ids[j]), pa.array(got[i, j])], ["q", "id", "score"])

        return run

    out = None
    for _, _, part in sendings(queries, kind):
        got = rows.mapInArrow(task(queries.sparkSession.sparkContext.broadcast(part)), "q long, id long, score double")
        out = got if out is None else out.unionByName(got)
    return out


def ranks(docs: DataFrame, queries: DataFrame, candidates: DataFrame, digits: int | None = 6, own: bool = True) -> DataFrame:
    """(q, id, rank): the place of each candidate (q, id) in the ranking of all ``docs`` by ``queries``, whose settings are one; with ``own`` off, of all but that of the query's own id.

    No ranking is made: a first pass fetches the candidates' scores, a second counts in each task how many documents come before each of them.  Candidates of a block of queries are sent along,
    some for each query; counts are added up by (q, id)."""
    spark, kind = queries.sparkSession, kind_of(queries)
    rows = contents(docs.drop("factor"), kind)
    out, leave = None, own

    def task(sent, wanted, scores):
        def run(batches):
            block, ids, known = sent.value, wanted.value, scores.value if scores is not None else None
            every = np.arange(len(block.q))
            if known is None:  # only the candidates themselves are scored
                some = np.unique(np.concatenate(ids)) if ids else np.zeros(0, np.int64)
                for b in batches:
                    b = b.filter(pa.array(np.isin(b.column(0).to_numpy(), some)))
                    if not b.num_rows or not len(block.q):
                        continue
                    for have, _, score, _ in KINDS[kind][1](block, b, False):
                        got = half_up(score(every), digits)
                        for i, own in enumerate(ids):
                            at = np.flatnonzero(np.isin(have, own))
                            if len(at):
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), block.q[i])), pa.array(have[at]), pa.array(got[i, at])], ["q", "id", "x"])
                return
            # candidates in the order of the ranking: a document comes before all candidates from some place on
            orders = [np.lexsort((own, -x)) for own, x in zip(ids, known, strict=True)]
            high = [-x[o] for x, o in zip(known, orders, strict=True)]
            names = [own[o] for own, o in zip(ids, orders, strict=True)]
            low = np.array([-x[-1] if len(x) else np.inf for x in high])
            counts = [np.zeros(len(x) + 1, np.int64) for x in ids]
            for b in batches:
                if not b.num_rows or not len(block.q):
                    continue
                for have, _, score, _ in KINDS[kind][1](block, b, False):
                    got = half_up(score(every), digits)
                    if not leave:
                        got[block.q[:, None] == have[None, :]] = -np.inf
                    i, j = np.nonzero(got >= low[:, None])
                    edge = np.searchsorted(i, np.arange(len(ids) + 1))
                    for k in np.flatnonzero(np.diff(edge)):
                        d = j[edge[k] : edge[k + 1]]
                        x = -got[k, d]
                        first, last = np.searchsorted(high[k], x, "left"), np.searchsorted(high[k], x, "right")
                        for e in np.unique(first[first < last]):  # equal scores go by id, in whose order documents and candidates are
                            same = np.flatnonzero((first == e) & (last > e))
                            first[same] += np.searchsorted(names[k][e : last[same[0]]], have[d[same]], "right")
                        counts[k] += np.bincount(first, minlength=len(counts[k]))
            for k, own in enumerate(names):
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block.q[k])), pa.array(own), pa.array(np.cumsum(counts[k])[:-1].astype(float))], ["q", "id", "x"])

        return run

    for blocks, k, part in sendings(queries, kind):
        send = spark.sparkContext.broadcast(part)
        mine = candidates.where(F.pmod(F.xxhash64("q", F.lit(0)), F.lit(blocks)) == k).select("q", "id").distinct().collect()  # some for each query of the block
        of: dict[int, list[int]] = {}
        for r in mine:
            of.setdefault(r["q"], []).append(r["id"])
        ids = [np.array(sorted(of.get(q, [])), np.int64) for q in part.q.tolist()]
        wanted = spark.sparkContext.broadcast(ids)
        found = {(r["q"], r["id"]): r["x"] for r in rows.mapInArrow(task(send, wanted, None), "q long, id long, x double").collect()}
        scores = spark.sparkContext.broadcast([np.array([found[q, i] for i in own.tolist()]) for q, own in zip(part.q.tolist(), ids, strict=True)])
        got = rows.mapInArrow(task(send, wanted, scores), "q long, id long, x double").groupBy("q", "id").agg((F.sum("x") + 1).cast("int").alias("rank"))
        out = got if out is None else out.unionByName(got)
    kinds = dict(candidates.dtypes)
    return out.withColumns({c: F.col(c).cast(kinds[c]) for c in ("q", "id")})
