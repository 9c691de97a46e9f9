"""Set-similarity join of documents on word shingles, with adaptive multi-match prefixes.

* A document's tokens are ordered by frequency class, then by hash.  The classes come from a counting sketch of fixed size over all documents: any order of
  tokens is right, and a good one keeps frequent tokens out of the prefixes.
* With o the least overlap that a document of n tokens needs, two similar documents share at least l of their first n - o + l tokens (the l-prefix
  scheme of AdaptJoin: Wang, Li, Feng, SIGMOD 2012).  Each document takes the l that makes its estimated candidate cost least: the summed frequencies of
  the prefix for scanning, plus that sum over l, which bounds the documents that share l of these tokens, for verifying.  A pair takes the smaller l of the
  two and the overlap that both sizes together need, so its prefixes are shorter, and goes on only if it shares l tokens that are in both of them.
* Documents of equal sets are one class.  A first round links each member of a token's group to the group's leader of its size class.  The second takes all pairs of a
  group that the first round hasn't connected already, so that no link between different components is lost and large groups of near copies
  cost a star and not a square.
* Pairs are verified on their prefixes, then on their whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, cut, drop_cut, grams, mix, pieces, shards, table, utf8, words

SHINGLE, NUM, DEN = 3, 90, 100
SHARD = 2 << 20
CELL_BITS, ROWS, CHUNK = 21, 2, 8192
MOST_SHARED = 6
FREQ_SHIFT = np.uint64(58)

#: White space (0x20, 0x09 to 0x0D) ends words; A-Z become a-z; the byte 0 counts as a letter, as 0xFF, which UTF-8 doesn't use.
LUT = np.arange(256).astype(np.uint8)
LUT[0] = 0xFF
LUT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
LUT[0x41:0x5B] = np.arange(0x61, 0x7B)


def _runs(h: np.ndarray, doc: np.ndarray, texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each run of ``size`` words; a text of fewer words, but some, has its whole sequence as one."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, size)
    ok = doc[size - 1 :] == doc[: len(doc) - size + 1] if len(g) else np.zeros(0, bool)
    docs, keys = [doc[: len(g)][ok]], [g[ok]]
    count = np.bincount(doc, minlength=texts)
    for k in range(1, size):
        own = np.flatnonzero(count == k)
        if len(own):
            first = np.searchsorted(doc, own)
            part = h[first]
            for j in range(1, k):
                part = mix(part * np.uint64(0x9E3779B97F4A7C15) + h[first + j] + np.uint64(j))
            docs.append(own)
            keys.append(mix(part + np.uint64(0x5851F42D4C957F2D) * np.uint64(k)))
    return np.concatenate(docs), np.concatenate(keys)


def _pieces(column: pa.Array, size: int):
    """(first text, one after the last, their shingles as (text number, hash) in parts): shards of texts are one part, a text beyond two shards is several."""
    bounds, raw = utf8(column)
    for lo, hi in shards(bounds, SHARD):
        own, part = bounds[lo : hi + 1] - bounds[lo], raw[bounds[lo] : bounds[hi]]
        if len(part) <= 2 * SHARD:
            h, doc, _, _ = words(own, part, LUT)
            yield lo, hi, [_runs(h, doc, hi - lo, size)]
        else:
            yield lo, hi, (_runs(h, np.zeros(len(h), np.int64), 1, size) if not lead or len(h) >= size else _runs(h[:0], h[:0], 1, size) for (h, *_), lead in pieces(part, LUT, SHARD, size - 1))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


# ---------------------------------------------------------------- frequencies


def cells_of(key: np.ndarray) -> list[np.ndarray]:
    """The cell of each hash in each row of the sketch."""
    return [((key >> np.uint64(64 - CELL_BITS * (r + 1))) & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64) for r in range(ROWS)]


class Frequencies:
    """The counting sketch, less what other tokens put into a cell on average: about the occurrences of a token, at the smaller of its cells."""

    def __init__(self, counts: np.ndarray):
        self.load = counts.mean(1)
        self.above = np.maximum(counts - self.load[:, None], 0).astype(np.float32)

    def __call__(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class, estimated occurrences, 1 at least)"""
        above = np.minimum.reduce([self.above[r][c] for r, c in enumerate(cells_of(key))])
        noise = 1.5 * np.sqrt(self.load.mean())  # chance seldom lifts both cells that far; a rare token that it does lift only comes later in the order
        group = np.where(above <= noise, 0, np.minimum(np.ceil(4 * np.log2(1 + above / 4)), 62))
        return group.astype(np.uint64), np.where(above <= noise, 1, np.maximum(above, 1)).astype(np.float32)


def frequencies(docs: DataFrame, size: int) -> Frequencies:
    """Counts of shingle hashes over all documents in a sketch of fixed size (2 rows of 2**21 cells).

    Each task adds up one table and sends it in chunks.  Chunks are added for 512 tasks at a time, then the sums; only the totals (16 MiB) come to the driver, piece by piece."""
    cells = 1 << CELL_BITS

    def narrow(x: np.ndarray) -> bytes:
        kind = next(k for k in ("u1", "<u2", "<u4", "<u8") if int(x.max()) < 1 << 8 * np.dtype(k).itemsize)
        return x.astype(kind).tobytes()

    def count(batches):
        total = np.zeros((ROWS, cells), np.int32)
        for b in batches:
            for _, _, parts in _pieces(b.column(0), size):
                for _, key in parts:
                    for r, c in enumerate(cells_of(key)):
                        total[r] += np.bincount(c, minlength=cells).astype(np.int32)
        if total.any():
            part = total.reshape(-1, CHUNK)
            task = np.full(len(part), TaskContext.get().partitionId() // 512, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int32()), pa.array(task), pa.array([narrow(p) for p in part], pa.binary())], ["chunk", "tasks", "counts"])

    def add(key, part):
        total = np.zeros(CHUNK, np.int64)
        for x in part.column("counts"):
            raw = x.as_py()
            total += np.frombuffer(raw, f"<u{len(raw) // CHUNK}").astype(np.int64)
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([narrow(total)], pa.binary())})

    rows = docs.select("text").mapInArrow(count, "chunk int, tasks int, counts binary")
    rows = rows.groupBy("chunk", "tasks").applyInArrow(add, "chunk int, counts binary").groupBy("chunk").applyInArrow(add, "chunk int, counts binary")
    out = np.zeros(ROWS * cells, np.float32)
    for r in rows.toLocalIterator():
        out[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, f"<u{len(r.counts) // CHUNK}")
    return Frequencies(out.reshape(ROWS, cells))


# ---------------------------------------------------------------- sets and prefixes


def sets(column: pa.Array, known: Frequencies, size: int):
    """Per shard (first text, one after the last, start of each text's tokens, tokens, estimated occurrences); tokens are distinct and in order.

    A token is 6 bits of frequency class, then 58 bits of hash.  Of a text in parts only the distinct tokens are held."""

    def ordered(doc, key):
        group, freq = known(key)
        token = (group << FREQ_SHIFT) | (mix(key) >> np.uint64(6))
        order = np.lexsort((token, doc))
        doc, token, freq = doc[order], token[order], freq[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])) if len(doc) else np.zeros(0, bool)
        return doc[new], token[new], freq[new]

    for lo, hi, parts in _pieces(column, size):
        if isinstance(parts, list):
            doc, token, freq = ordered(*parts[0])
            yield lo, hi, np.searchsorted(doc, np.arange(hi - lo + 1)), token, freq
            continue
        token, freq = np.zeros(0, np.uint64), np.zeros(0, np.float32)
        for doc, key in parts:
            _, t, f = ordered(doc, key)
            token, at = np.unique(np.append(token, t), return_index=True)
            freq = np.append(freq, f)[at]
        yield lo, hi, np.array([0, len(token)]), token, freq


def need(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap with any similar set."""
    return (num * n + den - 1) // den


def overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """The least overlap of similar sets whose sizes add up to ``total``."""
    return (num * total + num + den - 1) // (num + den)


def _choose(n: np.ndarray, start: np.ndarray, freq: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each set: its l, at the least estimated cost towards sets of its own size, and the length of its prefix."""
    total = np.append(0.0, np.cumsum(freq))
    o, own = need(n, num, den), overlap(2 * n, num, den)
    best, level = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for k in range(1, MOST_SHARED + 1):
        length = np.minimum(n - own + k, n)
        scan = total[start[:-1] + length] - total[start[:-1]]
        cost = np.where(k <= np.maximum(o, 1), scan + scan / k * (1 + n / 16), np.inf)
        level = np.where(cost < best, k, level)
        best = np.minimum(cost, best)
    return level, np.minimum(n - o + level, n)


def text_hash() -> F.Column:
    """128 bits of a text; of a null text null."""
    return F.md5(F.col("text").cast("binary"))


def _class_ids(start: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set, as two numbers, equal for equal sets."""
    out = []
    for salt in (0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3):
        total = np.append(np.uint64(0), np.cumsum(mix(mix(token + np.uint64(salt)) ^ np.uint64(salt >> 7))))
        n = np.diff(start).astype(np.uint64)
        out.append(_signed(mix(total[start[1:]] - total[start[:-1]] + n * np.uint64(0xE7037ED1A0B428DB))))
    return out[0], out[1]


def _describe(docs: DataFrame, sent, size: int, num: int, den: int) -> DataFrame:
    """(doc_id, h, row, n, ca, cb, l, weight, prefix) of each row; weight: mean occurrences of its prefix's tokens; row: a number of its own, settled once this is written."""

    def run(batches):
        for b in batches:
            for lo, hi, start, token, freq in sets(b.column(1), sent.value, size):
                n = np.diff(start)
                level, length = _choose(n, start, freq, num, den)
                offs = np.append(0, np.cumsum(length))
                take = np.repeat(start[:-1] - offs[:-1], length) + np.arange(offs[-1])
                weight = np.bincount(np.repeat(np.arange(len(n)), length), freq[take], len(n)) / np.maximum(length, 1)
                prefix = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(_signed(token[take]), pa.int64()))
                ids = [pa.array(x, pa.int64()) for x in _class_ids(start, token)]
                cols = [*(b.column(k).slice(lo, hi - lo) for k in (0, 2, 3)), pa.array(n, pa.int64()), *ids, pa.array(level, pa.int64()), pa.array(weight.astype(np.float32)), prefix]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "h", "row", "n", "ca", "cb", "l", "weight", "prefix"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", text_hash().alias("h"), F.monotonically_increasing_id().alias("row")).mapInArrow(run, f"doc_id {kind}, h string, row long, n long, ca long, cb long, l long, weight float, prefix array<long>")


# ---------------------------------------------------------------- candidates


def _gather(batches, width: int) -> list[np.ndarray]:
    cols = [[] for _ in range(width)]
    for b in batches:
        for k in range(width):
            cols[k].append(b.column(k).to_numpy(zero_copy_only=False))
    return [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]


def _shared(t: np.ndarray) -> np.ndarray:
    """Which rows of tokens in order have a neighbour of the same token."""
    same = t[1:] == t[:-1]
    return np.append(False, same) | np.append(same, False) if len(t) else np.zeros(0, bool)


def _pairs_out(a: np.ndarray, b: np.ndarray, asked: np.ndarray):
    """Distinct pairs with their counts and how many shared tokens they are asked for."""
    order = np.lexsort((b, a))
    a, b, asked = a[order], b[order], asked[order]
    new = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    k = np.diff(np.append(new, len(a)))
    for lo in range(0, len(new), 200_000):
        s = slice(lo, lo + 200_000)
        yield pa.RecordBatch.from_arrays([pa.array(a[new[s]], pa.int64()), pa.array(b[new[s]], pa.int64()), pa.array(k[s], pa.int64()), pa.array(asked[new[s]], pa.int64())], ["a", "b", "k", "asked"])


PAIRS = "a long, b long, k long, asked long"


def _stars(num: int, den: int):
    """Pairs of each member of a token's group with the weightiest of the same size class, the one that edits have left most like the others; sizes of a class may always be similar."""

    def run(batches):
        t, c, n, weight = _gather(batches, 4)
        order = np.argsort(t, kind="stable")
        t, c, n, weight = t[order], c[order], n[order], weight[order]
        keep = _shared(t)
        t, c, n, weight = t[keep], c[keep], n[keep], weight[keep]
        size = np.floor(np.log(np.maximum(n, 1)) / np.log(den / num) if num < den else n).astype(np.int64)
        order = np.lexsort((c, -weight, size, t))
        t, c, size = t[order], c[order], size[order]
        if not len(t):
            return
        first = np.append(True, (t[1:] != t[:-1]) | (size[1:] != size[:-1]))
        lead = np.flatnonzero(first)[np.cumsum(first) - 1]
        yield from _pairs_out(np.minimum(c[lead], c)[~first], np.maximum(c[lead], c)[~first], np.full((~first).sum(), 2))

    return run


def _cross(num: int, den: int, room: int = 4_000_000):
    """All pairs of a token's group that may be similar by sizes and places and are of different components.

    Members stand in order of size and are paired with those after them, distance by distance, so that memory stays with the group.  A pair of sizes n, n' that
    needs the overlap o has its first l shared tokens at places below n - o + l and n' - o + l; the token counts for it only there.  With (i, j) the
    token's places, at most min(i, j) tokens can be shared before it and the smaller rest after it."""

    def run(batches):
        t, c, n, m, place, level = _gather(batches, 6)
        order = np.lexsort((c, n, t))
        order = order[_shared(t[order])]
        t, c, n, m, place, level = (x[order] for x in (t, c, n, m, place, level))
        if not len(t):
            return
        start = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        mixed = np.minimum.reduceat(m, start) != np.maximum.reduceat(m, start)
        keep = np.repeat(mixed, np.diff(np.append(start, len(t))))
        t, c, n, m, place, level = (x[keep] for x in (t, c, n, m, place, level))
        own = place < n - overlap(2 * n, num, den) + level  # a larger partner asks for no less
        live, step, held, made = np.flatnonzero(own), 1, 0, []
        while len(live):
            live = live[live + step < len(t)]
            j = live + step
            on = (t[live] == t[j]) & (den * n[live] >= num * n[j])
            live, j = live[on], j[on]
            least = overlap(n[live] + n[j], num, den)
            reach = np.minimum(place[live], place[j]) + np.minimum(n[live] - place[live], n[j] - place[j])
            ell = np.minimum(level[live], level[j])
            new = (m[live] != m[j]) & (reach >= least) & (place[live] < n[live] - least + ell) & (place[j] < n[j] - least + ell)
            x, y, asked = live[new], j[new], ell[new]
            swap = c[x] > c[y]
            made.append((np.where(swap, c[y], c[x]), np.where(swap, c[x], c[y]), asked))
            held += len(x)
            step += 1
            if held > room:
                yield from _pairs_out(*(np.concatenate(z) for z in zip(*made, strict=True)))
                made, held = [], 0
        if held:
            yield from _pairs_out(*(np.concatenate(z) for z in zip(*made, strict=True)))

    return run


# ---------------------------------------------------------------- verification


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offs = col.offsets.to_numpy()
    return offs - offs[0], col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _may_be_similar(num: int, den: int):
    """Pairs whose prefixes leave the overlap that they need within reach."""

    def run(batches):
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
            (oa, ta), (ob, tb) = _lists(b.column(4)), _lists(b.column(5))
            least, ok = overlap(na + nb, num, den), np.zeros(b.num_rows, bool)
            for i in range(b.num_rows):
                x, y = ta[oa[i] : oa[i + 1]], tb[ob[i] : ob[i + 1]]
                if len(x) and len(y):
                    last = min(x[-1], y[-1])
                    px, py = np.searchsorted(x, last, "right"), np.searchsorted(y, last, "right")
                    seen = len(np.intersect1d(x[:px], y[:py], assume_unique=True))
                    ok[i] = seen + min(na[i] - px, nb[i] - py) >= least[i]
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return run


def _similar(num: int, den: int):
    """Pairs with den * intersection >= num * union, on whole sets."""

    def run(batches):
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            left, right = b.column(2), b.column(3)
            for i in range(b.num_rows):
                x, y = np.frombuffer(left[i].as_py(), "<u8"), np.frombuffer(right[i].as_py(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = den * both >= num * (len(x) + len(y) - both)
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], ["a", "b"])

    return run


def _wanted_filter(ids: DataFrame, bits_each: int = 16, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """A Bloom filter of ``ids`` (column id), of at most 16 MiB; beyond that it lets more rows through, which the join after it drops."""
    n = max(1, ids.count())
    bits = 1 << max(10, min(int(n * bits_each - 1).bit_length(), most_bits.bit_length() - 1))
    h = [F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(bits)) for k in range(3)]
    cells = ids.select(F.explode(F.array(*h)).alias("x")).selectExpr("shiftright(x, 5) w", "shiftleft(1L, cast(x % 32 as int)) v")
    out = np.zeros(bits // 32, np.uint32)
    for b in cells.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow().to_batches():
        out[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.uint32)
    return out, bits


def _fetch_sets(docs: DataFrame, wanted: DataFrame, sent, size: int) -> DataFrame:
    """(c, tokens) of the classes in ``wanted`` (c, ca, cb, id): whole sets, made again from the text of a document of each class that has the id.  A null id is looked for as -1, beside any real -1."""
    spark = docs.sparkSession
    bloom, bits = _wanted_filter(wanted.select("id"))
    held = spark.sparkContext.broadcast(bloom)

    def maybe(batches):
        table_ = held.value
        for b in batches:
            hs = [b.column(k).to_numpy() for k in range(2, 5)]
            ok = np.logical_and.reduce([(table_[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1 for x in hs])
            b = b.filter(pa.array(ok))
            for lo, hi, start, token, _ in sets(b.column(1), sent.value, size):
                ids = [pa.array(x, pa.int64()) for x in _class_ids(start, token)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *ids, pa.array([token[start[i] : start[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())], ["id", "ca", "cb", "tokens"])

    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("id"), "text")
    keyed = keyed.select("id", "text", *[F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(bits)).alias(f"h{k}") for k in range(3)])
    got = keyed.mapInArrow(maybe, "id long, ca long, cb long, tokens binary")
    return got.join(wanted, ["id", "ca", "cb"]).groupBy("c").agg(F.first("tokens").alias("tokens"))


# ---------------------------------------------------------------- the operator


def jaccard_components(docs: DataFrame, size: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, keeper) of each row of ``docs`` (doc_id, text): sets of ``size``-word shingles, links at Jaccard >= num/den.

    ``keeper`` marks the document to keep of each component: the smallest doc_id, then the smallest hash of its text (repeated rows are all marked).
    Null and empty texts have no shingles and are their own component; so is a row without words.  A text beyond two shards is read in pieces, and memory holds its distinct
    shingles.  Sets are the same class by 128 bits.  Ties of frequency are broken by hash, ties between leaders by the row.  Repeated rows are answered each.  A row
    with a null doc_id takes part; the component's number is the smallest that is not null, and null if there is none.  Nothing is capped: all documents and all pairs
    that prefixes bring together are looked at."""
    spark = docs.sparkSession
    docs = docs.select(docs["doc_id"], docs["text"])
    sent = spark.sparkContext.broadcast(frequencies(docs, size))
    rows = cut(_describe(docs, sent, size, num, den), "jaccard-rows")
    named = F.min("row").alias("c"), F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).alias("id")
    of_class = rows.where("n > 0").groupBy("ca", "cb").agg(*[F.first(x).alias(x) for x in ("n", "l", "weight", "prefix")], *named)  # a class is named after a row of it
    reps = cut(of_class, "jaccard-classes")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        a = reps.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("pa"))
        b = reps.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("pb"))
        likely = pairs.join(b, "b").join(a, "a").select("a", "b", "na", "nb", "pa", "pb").mapInArrow(_may_be_similar(num, den), "a long, b long")
        likely = cut(likely, f"jaccard-{name}")
        ends = likely.select(F.col("a").alias("c")).unionByName(likely.select(F.col("b").alias("c"))).distinct()
        full = cut(_fetch_sets(docs, ends.join(reps.select("c", "ca", "cb", "id"), "c"), sent, size), f"jaccard-{name}-sets")
        both = likely.join(full.select(F.col("c").alias("b"), F.col("tokens").alias("tb")), "b").join(full.select(F.col("c").alias("a"), F.col("tokens").alias("ta")), "a")
        links = cut(both.select("a", "b", "ta", "tb").mapInArrow(_similar(num, den), "a long, b long"), f"jaccard-{name}-links")
        drop_cut(full)
        drop_cut(likely)
        return links

    def counted(tokens: DataFrame, pairs) -> DataFrame:
        got = tokens.repartition("t").mapInArrow(pairs, PAIRS).groupBy("a", "b").agg(F.sum("k").alias("k"), F.max("asked").alias("asked"))
        return got.where("k >= asked").select("a", "b")

    tokens = reps.select(F.explode("prefix").alias("t"), "c", "n", "weight")
    first = verified(counted(tokens, _stars(num, den)), "stars")
    joined = connected_components(first, "a", "b")
    label = reps.join(joined, reps["c"] == joined["id"], "left").select("c", "n", "l", "prefix", F.coalesce("component_id", "c").alias("m"))
    tokens = label.select(F.posexplode("prefix").alias("place", "t"), "c", "n", "m", "l").select("t", "c", "n", "m", "place", "l")
    second = verified(counted(tokens, _cross(num, den)), "cross")
    linked = connected_components(first.unionByName(second), "a", "b")
    who = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("h").alias("h"))
    named = rows.where("n > 0").groupBy("ca", "cb").agg(F.min(who).alias("low"), F.min("row").alias("c")).join(linked, F.col("c") == F.col("id"), "left")
    named = named.select("ca", "cb", "low", F.coalesce("component_id", "c").alias("m"))
    least = named.groupBy("m").agg(F.min("low").alias("first"))
    of = named.join(least, "m").select("ca", "cb", "first")
    out = rows.select("doc_id", "h", "n", *[F.when(F.col("n") > 0, F.col(x)).alias(x) for x in ("ca", "cb")]).join(of, ["ca", "cb"], "left")
    some = F.col("n") > 0
    keeper = F.when(some, F.col("doc_id").eqNullSafe(F.col("first.id")) & F.col("h").eqNullSafe(F.col("first.h"))).otherwise(F.lit(True))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(some, F.col("first.id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("h").alias("text_hash"), keeper.alias("keeper"))
    out = cut(out, "jaccard")
    for x in (rows, reps, first, joined, second, linked):
        drop_cut(x)
    return out


def keep_one(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each component of ``docs``, with the columns of ``docs``: five-word shingles and 0.8 unless told otherwise.

    Texts without words are in no component and stay; of repeated rows (equal doc_id and text) one stays."""
    names = [f.name for f in docs.schema.fields]
    mark = "h"
    while mark in {n.lower() for n in names}:
        mark += "_"
    kept = jaccard_components(docs, size, num, den).where("keeper").select(F.col("doc_id").alias("kept id"), F.col("text_hash").alias("kept hash")).distinct()
    tagged = docs.withColumn(mark, text_hash())
    same = tagged["doc_id"].eqNullSafe(kept["kept id"]) & tagged[mark].eqNullSafe(kept["kept hash"])
    return tagged.join(kept, same, "left_semi").dropDuplicates(["doc_id", mark]).select(*[F.col(f"`{n}`") for n in names])


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")
