"""Removal of repeated byte strings, by suffix sorting in blocks with a difference cover.

Which suffixes belong together.  A window of LENGTH bytes holds a least K-byte string (by a hash, leftmost of equals), which depends on the window's bytes alone.  So
equal windows have equal least strings at equal offsets, and the windows of a document fall into runs with one least string each, about two for every
LENGTH - K bytes.  A run travels as four numbers; a suffix bucket is all runs of one least string.  A bucket of one run has no repeat; of runs with equal
bytes (the same least string at the same place in runs of the same length, and 64 bits of hash of all their bytes) all but the earliest are repeats.  What is left, earliest runs of different
bytes, is sorted.

How a bucket is sorted (Karkkainen's blockwise construction).  A block of buckets, BLOCK bytes of text at most unless one bucket is larger, is laid out as one text.  The
positions whose remainder modulo 13 is in the difference cover {0, 1, 3, 9} are ranked by their first 78 bytes, by doubling.  The suffixes of a bucket are sorted by
their first 13 bytes; longer ties are split around their earliest suffix, comparing ranks at the offset below 13 at which both are sample positions, and the last
22 bytes.  Memory holds one partition's runs and one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import _gather, _wanted_filter
from .shared import _powers, cut, drop_cut, mix, table, utf8

LENGTH = 100
K = 32
SHARD = 1 << 20
BLOCK = 8 << 20
V = 13
COVER = np.array([0, 1, 3, 9])
TAG_BITS = 18
FIRST = -(1 << 63)  # stands for a null id, which comes before all others

IN_COVER = np.zeros(V, bool)
IN_COVER[COVER] = True
#: For remainders a, b of two positions: the least d with both a + d and b + d in the cover.
MEET = np.array([[next(d for d in range(V) if IN_COVER[(a + d) % V] and IN_COVER[(b + d) % V]) for b in range(V)] for a in range(V)])

# ---------------------------------------------------------------- runs of windows


def _pieces(bounds: np.ndarray):
    """Shards of (document, first byte in it, from, to): texts, those beyond SHARD cut so that each window falls into one piece."""
    rows, total = [], 0
    for d, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        for base in range(0, max(b - a - LENGTH + 1, 0), SHARD):
            rows.append((d, base, a + base, min(b, a + base + SHARD + LENGTH - 1)))
            total += rows[-1][3] - rows[-1][2]
            if total >= SHARD:
                yield rows
                rows, total = [], 0
    if rows:
        yield rows


def runs(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows of the pieces text[bounds[i]:bounds[i+1]]: (piece, hash of the least string, hash of the run's bytes, its place, first window, last window)."""
    n, w = len(text), LENGTH - K + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    p, q = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    m = n - K + 1
    h = mix((total[K:] - total[:m]) * q[:m])
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    pad = -m % w
    blocks = np.append(key, np.full(pad + w, np.iinfo(np.uint64).max)).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - LENGTH + 1
    at = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & low).astype(np.int64)
    piece = np.searchsorted(bounds, np.arange(count), "right") - 1
    ok = np.arange(count) + LENGTH <= bounds[piece + 1]
    i = np.flatnonzero(ok)
    if not len(i):
        return none, none.astype(np.uint64), none.astype(np.uint64), none, none, none
    new = np.append(True, (at[i[1:]] != at[i[:-1]]) | (piece[i[1:]] != piece[i[:-1]]))
    lo = i[new]
    hi = np.append(i[np.flatnonzero(new)[1:] - 1], i[-1])
    place = at[lo]
    shape = ((place - lo) * 128 + (hi - lo)).astype(np.uint64)
    whole = mix((total[hi + LENGTH] - total[lo]) * q[lo] + mix(shape))
    return piece[lo], h[place], whole, place, lo, hi


def _pack(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, tag: np.ndarray) -> np.ndarray:
    return (place << 32) | ((place - lo) << 25) | ((hi - lo) << TAG_BITS) | tag


def _unpack(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """place, first window, last window, tag."""
    place = x >> 32
    lo = place - ((x >> 25) & 127)
    return place, lo, lo + ((x >> TAG_BITS) & 127), x & ((1 << TAG_BITS) - 1)


def _later(h: np.ndarray, whole: np.ndarray, ids: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which runs have the bytes of a run of the same least string that starts at a smaller (id, place)."""
    key = h ^ mix(whole)
    order = np.lexsort((packed, ids, key))
    same = np.append(False, key[order][1:] == key[order][:-1])
    lead = order[np.flatnonzero(~same)[np.cumsum(~same) - 1]] if len(order) else order
    out = np.zeros(len(h), bool)
    out[order] = same & ((ids[order] != ids[lead]) | (packed[order] >> 32 != packed[lead] >> 32))
    return out


def _runs_of(batches):
    """(id, tag, text) -> (h, id, packed, whole, done).

    Runs that repeat an earlier one of the same batch are known at once (done 1); they go on under a key of their own, so that frequent strings don't meet in one task."""
    for b in batches:
        bounds, raw = utf8(b.column(2))
        ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
        parts = []
        for rows in _pieces(bounds):
            doc, base, a, z = (np.array(x) for x in zip(*rows, strict=True))
            text = np.concatenate([raw[x:y] for x, y in zip(a, z, strict=True)])
            own = np.append(0, np.cumsum(z - a))
            piece, h, whole, place, lo, hi = runs(text, own)
            shift = base[piece] - own[piece]
            parts.append((h, whole, ids[doc[piece]], _pack(place + shift, lo + shift, hi + shift, tags[doc[piece]])))
        if not parts:
            continue
        h, whole, id_, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
        done = _later(h, whole, id_, packed)
        h = np.where(done, mix(packed.view(np.uint64) + mix(id_.astype(np.int64).view(np.uint64))), h)
        for k in range(0, len(h), 500_000):
            s = slice(k, k + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(h[s].view(np.int64)), pa.array(id_[s], pa.int64()), pa.array(packed[s]), pa.array(whole[s].view(np.int64)), pa.array(done[s].astype(np.int32))], ["h", "id", "packed", "whole", "done"])


def _settle(batches):
    """All runs of some buckets -> (id, packed, h, open): repeats of an earlier run's bytes (open 0), and earliest runs whose bucket has other bytes too (open 1)."""

    def out(ids, packed, h, state):
        for k in range(0, len(ids), 500_000):
            s = slice(k, k + 500_000)
            yield pa.RecordBatch.from_arrays([pa.array(ids[s], pa.int64()), pa.array(packed[s], pa.int64()), pa.array(h[s], pa.int64()), pa.array(state[s].astype(np.int32))], ["id", "packed", "h", "open"])

    h, ids, packed, whole, done = _gather(batches, 5)
    known, rest = np.flatnonzero(done == 1), np.flatnonzero(done != 1)
    yield from out(ids[known], packed[known], h[known], np.zeros(len(known)))
    order = rest[np.argsort(h[rest], kind="stable")]
    same = h[order][1:] == h[order][:-1] if len(order) else np.zeros(0, bool)
    keep = (np.append(False, same) | np.append(same, False)) if len(order) else np.zeros(0, bool)
    order = order[keep]
    h, whole, ids, packed = h[order], whole[order], ids[order], packed[order]
    order = np.lexsort((packed, ids, whole, h))
    h, whole, ids, packed = h[order], whole[order], ids[order], packed[order]
    if not len(h):
        return
    first = np.append(True, (h[1:] != h[:-1]) | (whole[1:] != whole[:-1]))
    lead = np.flatnonzero(first)[np.cumsum(first) - 1]
    later = (ids != ids[lead]) | (packed >> 32 != packed[lead] >> 32)
    bucket = np.append(True, h[1:] != h[:-1])
    kinds = np.add.reduceat(first.astype(np.int64), np.flatnonzero(bucket))[np.cumsum(bucket) - 1]
    state = np.where(later, 0, np.where(kinds > 1, 1, 2))
    some = np.flatnonzero(state < 2)
    yield from out(ids[some], packed[some], h[some], state[some])


# ---------------------------------------------------------------- suffix sorting of a block


def _word(text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """n <= 8 bytes from each place, big-endian."""
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | text[at + k].astype(np.uint64)
    return out


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of keys, as 64-bit numbers."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.uint64)
    out[order] = np.cumsum(new).astype(np.uint64)
    return out


class Sample:
    """Ranks of the sample positions of a text by their first 78 bytes."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = np.append(text, np.zeros(LENGTH + 8 * V, np.uint8))
        at = (np.arange(0, n + V, V)[:, None] + COVER[None, :]).ravel()
        r = _rank(_word(self.text, at, 8), _word(self.text, at + 8, V - 8))  # 13 bytes; the next block of 13 is four samples on
        for ahead in (4, 8, 8):  # 26, 52, 78 bytes
            r = _rank(r, np.append(r[ahead:], np.zeros(ahead, np.uint64)))
        self.rank = r
        self.slot = np.full(V, -1)
        self.slot[COVER] = np.arange(len(COVER))

    def at(self, p: np.ndarray) -> np.ndarray:
        return self.rank[(p // V) * len(COVER) + self.slot[p % V]]


def repeated(sample: Sample, bucket: np.ndarray, at: np.ndarray, age: np.ndarray) -> np.ndarray:
    """Which of the suffixes ``at`` of the sample's text have LENGTH bytes in common with an older one of their bucket.

    ``age`` orders suffixes; equal ages are the same start, of which none is a repeat of the other."""
    text, flag = sample.text, np.zeros(len(at), bool)
    head = _word(text, at, 8), _word(text, at + 8, V - 8)
    tail = [_word(text, at + k, min(8, LENGTH - k)) for k in range(6 * V, LENGTH, 8)]
    order = np.lexsort((age, head[1], head[0], bucket))
    new = np.append(True, (bucket[order][1:] != bucket[order][:-1]) | (head[0][order][1:] != head[0][order][:-1]) | (head[1][order][1:] != head[1][order][:-1])) if len(at) else np.zeros(0, bool)
    group = np.cumsum(new)
    while len(order):
        first = np.append(True, group[1:] != group[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(group)))
        live = np.repeat(size > 1, size)
        order, group, first = order[live], group[live], first[live]
        if not len(order):
            break
        pivot = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
        d = MEET[at[order] % V, at[pivot] % V]
        own, mid = sample.at(at[order] + d), sample.at(at[pivot] + d)
        side = np.where(own < mid, 0, np.where(own > mid, 2, 1))
        for t in tail:
            side = np.where(side == 1, np.where(t[order] < t[pivot], 0, np.where(t[order] > t[pivot], 2, 1)), side)
        equal = side == 1
        flag[order[equal]] = age[order[equal]] > age[pivot[equal]]
        order, group, side = order[~equal], group[~equal], side[~equal]
        sub = group * 3 + side
        turn = np.argsort(sub, kind="stable")
        order, sub = order[turn], sub[turn]
        group = np.cumsum(np.append(True, sub[1:] != sub[:-1])) if len(sub) else sub
    return flag


def _sort_blocks(batches):
    """Open runs with their bytes (h, id, packed, bytes) -> (id, packed) of runs of windows that repeat earlier ones."""
    cols, texts = [[], [], []], []
    for b in batches:
        for k in range(3):
            cols[k].append(b.column(k).to_numpy())
        texts.append(b.column(3).combine_chunks() if isinstance(b.column(3), pa.ChunkedArray) else b.column(3))
    if not cols[0]:
        return
    h, ids, packed = (np.concatenate(c) for c in cols)
    bounds, raw = utf8(pa.chunked_array(texts).combine_chunks())
    order = np.lexsort((packed, ids, h))
    size = np.diff(bounds)[order]
    start = np.flatnonzero(np.append(True, h[order][1:] != h[order][:-1]))
    weight = np.add.reduceat(size, start)
    block = np.cumsum(weight) // BLOCK
    for k in np.unique(block):
        own = start[block == k]
        end = start[np.flatnonzero(block == k)[-1] + 1] if np.flatnonzero(block == k)[-1] + 1 < len(start) else len(order)
        rows = order[own[0] : end]
        n = np.diff(bounds)[rows]
        to = np.append(0, np.cumsum(n))
        text = raw[np.repeat(bounds[rows] - to[:-1], n) + np.arange(to[-1])]
        place, lo, hi, tag = _unpack(packed[rows])
        many = hi - lo + 1
        run = np.repeat(np.arange(len(rows)), many)
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        bucket = np.cumsum(np.append(True, h[rows][1:] != h[rows][:-1]))[run] * 128 + (place - lo)[run] - step
        age = np.cumsum(np.append(True, (ids[rows][1:] != ids[rows][:-1]) | (place[1:] != place[:-1])))[run]  # rows of a bucket are in order of (id, place)
        flag = repeated(Sample(text), bucket, to[:-1][run] + step, age)
        i = np.flatnonzero(flag)
        if not len(i):
            continue
        new = np.append(True, (run[i[1:]] != run[i[:-1]]) | (step[i[1:]] != step[i[:-1]] + 1))
        a, z = i[new], np.append(i[np.flatnonzero(new)[1:] - 1], i[-1])
        r = run[a]
        first, last = lo[r] + step[a], lo[r] + step[z]
        yield pa.RecordBatch.from_arrays([pa.array(ids[rows[r]]), pa.array(_pack(last, first, last, tag[r]))], ["id", "packed"])


# ---------------------------------------------------------------- the operator


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), F.pmod(F.xxhash64("text"), F.lit(1 << TAG_BITS)).alias("tag"), "text")


def find_repeats(docs: DataFrame) -> DataFrame:
    """(id, tag, windows): for each text that repeats anything, its runs of repeated windows as packed numbers.  Texts are told apart by id and by a tag of their hash."""
    found = _keyed(docs).mapInArrow(_runs_of, "h long, id long, packed long, whole long, done int").repartition("h")
    settled = cut(found.mapInArrow(_settle, "id long, packed long, h long, open int"), "repeats-settled")
    mask = F.lit((1 << TAG_BITS) - 1)
    tagged = F.col("packed").bitwiseAND(mask).alias("tag")
    wanted = settled.where("open = 1").select("id", tagged, "h", "packed")
    bloom, bits = _wanted_filter(wanted.select("id").distinct())
    sent = docs.sparkSession.sparkContext.broadcast(bloom)

    def maybe(batches):
        t = sent.value
        for b in batches:
            ok = np.logical_and.reduce([(t[x >> 5] >> (x & 31).astype(np.uint32)) & 1 == 1 for x in (b.column(k).to_numpy() for k in range(3, 6))])
            yield b.filter(pa.array(ok)).select([0, 1, 2])

    hashed = _keyed(docs).select("id", "tag", "text", *[F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(bits)).alias(f"h{k}") for k in range(3)])
    texts = hashed.mapInArrow(maybe, "id long, tag long, text string")

    def bytes_of(batches):
        for b in batches:
            bounds, raw = utf8(b.column(2))
            keep, out, seen = [], [], set()
            offs = b.column(3).offsets.to_numpy()
            flat = b.column(3).flatten()
            hs, packs = (flat.field(k).to_numpy() for k in ("h", "packed"))
            ids = b.column(0).to_pylist()
            for i in range(b.num_rows):
                _, lo, hi, _ = _unpack(packs[offs[i] - offs[0] : offs[i + 1] - offs[0]])
                for j, (x, y) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
                    k = offs[i] - offs[0] + j
                    if bounds[i] + y + LENGTH <= bounds[i + 1] and (ids[i], packs[k]) not in seen:
                        keep.append((hs[k], ids[i], packs[k]))
                        out.append(raw[bounds[i] + x : bounds[i] + y + LENGTH].tobytes())
            if keep:
                h, ids_, packed = (pa.array(x, pa.int64()) for x in zip(*keep, strict=True))
                yield pa.RecordBatch.from_arrays([h, ids_, packed, pa.array(out, pa.binary())], ["h", "id", "packed", "bytes"])

    lists = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("h", "packed")).alias("runs"))
    opened = texts.join(lists, ["id", "tag"]).select("id", "tag", "text", "runs").mapInArrow(bytes_of, "h long, id long, packed long, bytes binary")
    ranked = opened.repartition("h").mapInArrow(_sort_blocks, "id long, packed long")
    every = settled.where("open = 0").select("id", "packed").unionByName(ranked)
    out = cut(every.select("id", tagged, "packed").groupBy("id", "tag").agg(F.collect_list("packed").alias("windows")), "repeats-windows")
    drop_cut(settled)
    return out


def spans(windows: np.ndarray) -> np.ndarray:
    """(k, 2) maximal [from, to) of bytes covered by packed runs of windows."""
    if not len(windows):
        return np.zeros((0, 2), np.int64)
    _, lo, hi, _ = _unpack(windows)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order] + LENGTH)
    new = np.append(True, lo[1:] > hi[:-1])
    return np.stack([lo[new], hi[np.append(np.flatnonzero(new)[1:] - 1, len(lo) - 1)]], 1)


def remove_repeats(docs: DataFrame, texts: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256, kept) of each row of ``docs`` (doc_id, text).

    A byte goes if a LENGTH-byte string over it also starts at a smaller (doc_id, byte); a null doc_id is the smallest.  Rows with
    equal doc_id and text are one document and get the same answer; texts of one doc_id start nowhere before each other (they are told apart by 18 bits of their hash, so two different
    texts of one id can be taken for one, once in 262,144).  Null texts count as empty.  A very long text is searched in pieces that share LENGTH - 1 bytes; when its repeats are taken out it is held
    once.  Of equal strings the first by (doc_id, byte) stays, so there are no ties.  ``kept`` holds
    the remaining bytes (null with ``texts`` off), which need not be valid UTF-8 where a repeat begins inside a character."""
    docs = docs.select(docs["doc_id"], docs["text"])
    windows = find_repeats(docs)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)).alias("id"), F.pmod(F.xxhash64("text"), F.lit(1 << TAG_BITS)).alias("tag"), "text")
    both = rows.join(windows, ["id", "tag"], "left").select("doc_id", "text", "windows")

    def run(batches):
        for b in batches:
            bounds, raw = utf8(b.column(1))
            lists = b.column(2)
            sizes, gone, all_spans, digests, kept = [], [], [], [], []
            for i in range(b.num_rows):
                text = raw[bounds[i] : bounds[i + 1]]
                w = lists[i].values
                s = spans(w.to_numpy()) if w is not None else np.zeros((0, 2), np.int64)
                on = np.ones(len(text), bool)
                for x, y in s.tolist():
                    on[x:y] = False
                rest = text[on].tobytes() if len(s) else text.tobytes()
                sizes.append(len(text))
                gone.append(len(text) - len(rest))
                all_spans.append(s.tolist())
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest if texts else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(all_spans, pa.list_(pa.list_(pa.int64()))), pa.array(digests, pa.string()), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, spans array<array<long>>, kept_sha256 string, kept binary")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that repeat 100 bytes from an earlier place."""
    out = remove_repeats(table(spark, sf_dir, "documents"), texts=False)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
