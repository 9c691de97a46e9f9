"""Benchmark decontamination with suffix arrays over the training text.

Each task reads its documents in shards of a few megabytes.  A shard's words become numbers of the benchmark's vocabulary (0: not in it), and
the suffixes of the shard that can match at all (as many words of the vocabulary in a row as a window has) are sorted into a suffix
array.  Every window-long start of every benchmark suffix is then binary-searched in it; the range that it finds holds all
occurrences, and comparing on from there gives the longest verbatim match of each and its place.  No shuffle: the work follows the documents.

The benchmark travels to the tasks in blocks of at most ``block_bytes`` of text (documented bound, 16 MiB); a benchmark of more than one block is searched in as
many passes, each of which is written to the shared folder and adds to the columns of the one before, so driver and executors hold one block.

Words are known by 128 bits of hash.  A text beyond two shards is read in pieces that overlap by a window less one word: memory stays with the piece, and
matches that run on are joined.  Ties don't arise: every occurrence counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import cut, drop_cut, pieces, shards, table, utf8, words

WINDOW = 10
SHARD = 4 << 20
BLOCK_BYTES = 16 << 20

#: Bytes of words: digits, a-z after lower-casing A-Z, and all of 0x80 and above.
LUT = np.zeros(256, np.uint8)
LUT[0x30:0x3A] = np.arange(0x30, 0x3A)
LUT[0x61:0x7B] = np.arange(0x61, 0x7B)
LUT[0x41:0x5B] = np.arange(0x61, 0x7B)
LUT[0x80:] = np.arange(0x80, 0x100)

MATCH = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("item_word", T.LongType()), T.StructField("doc_word", T.LongType()), T.StructField("words", T.LongType())]))
ADDED = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("matches", MATCH)])


class Block:
    """Benchmark items as numbers of their own vocabulary, and the windows that start at each of their suffixes."""

    def __init__(self, ids: list[str], texts: list[str], window: int):
        self.ids, self.window = ids, window
        bounds, raw = utf8(pa.array(texts, pa.large_string()))
        h, item, _, _, check = words(bounds, raw, LUT, 2)
        self.vocab, first = np.unique(h, return_index=True)
        self.check = check[first]
        self.w = np.append(np.searchsorted(self.vocab, h) + 1, 0).astype(np.int32)
        self.item = np.append(item, -1)
        n = np.bincount(item, minlength=len(ids)) if len(ids) else np.zeros(0, np.int64)
        first = np.cumsum(n) - n
        self.at = np.arange(len(h)) - first[item] if len(h) else np.zeros(0, np.int64)
        left = n[item] - self.at if len(h) else self.at
        size = np.minimum(n[item], window) if len(h) else self.at
        ok = left >= size
        self.windows = {int(k): np.flatnonzero(ok & (size == k)) for k in np.unique(size)}
        self.starts = {k: np.unique(self.w[s]) for k, s in self.windows.items()}


def _keys(w: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k numbers from each place as one big-endian byte string, so that byte order is word order."""
    m = w[at[:, None] + np.arange(k)[None, :]].astype(">u4")
    return np.ascontiguousarray(m).view(f"S{4 * k}").ravel()


def search(block: Block, h: np.ndarray, check: np.ndarray, doc: np.ndarray):
    """Of one shard's words, known by both hashes: (place, window size) hits, (doc, item) pairs, and maximal matches (doc, item, item word, word, words)."""
    v = block.vocab
    none = np.zeros(0, np.int64)
    if not len(h) or not len(v):
        return none, none, none, none, np.zeros((0, 5), np.int64)
    pos = np.searchsorted(v, h)
    pos[pos == len(v)] = 0
    w = np.where((v[pos] == h) & (block.check[pos] == check), pos + 1, 0).astype(np.int32)
    n = len(w)
    same = np.append((w[1:] != 0) & (w[:-1] != 0) & (doc[1:] == doc[:-1]), False)
    stop = np.flatnonzero(~same)  # the last word of each run of vocabulary words of a document
    run = np.where(w != 0, stop[np.searchsorted(stop, np.arange(n))] + 1 - np.arange(n), 0)
    hits, sizes, docs, items, found = [], [], [], [], []
    w1, d1 = np.append(w, -1), np.append(doc, -2)
    for k, suffixes in block.windows.items():
        at = np.flatnonzero(run >= k)
        at = at[np.isin(w[at], block.starts[k])]
        if not len(at):
            continue
        keys = _keys(w, at, k)
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        wanted = _keys(block.w, suffixes, k)
        lo, hi = np.searchsorted(keys, wanted, "left"), np.searchsorted(keys, wanted, "right")
        some = np.flatnonzero(hi > lo)
        for g in range(0, len(some), 512):
            sel = some[g : g + 512]
            cnt = hi[sel] - lo[sel]
            s = np.repeat(suffixes[sel], cnt)
            p = at[np.repeat(lo[sel] - (np.cumsum(cnt) - cnt), cnt) + np.arange(cnt.sum())]
            hits.append(u := np.unique(p))
            sizes.append(np.full(len(u), k, np.int64))
            pair = np.unique(np.stack([doc[p], block.item[s]], 1), axis=0)
            docs.append(pair[:, 0])
            items.append(pair[:, 1])
            before = (block.at[s] > 0) & (p > 0) & (d1[p - 1] == doc[p]) & (w1[p - 1] == block.w[s - 1])
            p, s = p[~before], s[~before]
            length, live = np.full(len(p), k, np.int64), np.arange(len(p))
            while len(live):
                a, b = p[live] + length[live], s[live] + length[live]
                on = (a < n) & (b < len(block.w) - 1)
                a, b = np.minimum(a, n), np.minimum(b, len(block.w) - 1)
                live = live[on & (w1[a] == block.w[b]) & (d1[a] == doc[p[live]]) & (block.item[b] == block.item[s[live]])]
                length[live] += 1
            found.append(np.stack([doc[p], block.item[s], block.at[s], p, length], 1))
    if not hits:
        return none, none, none, none, np.zeros((0, 5), np.int64)
    return np.concatenate(hits), np.concatenate(sizes), np.concatenate(docs), np.concatenate(items), np.concatenate(found)


def _found(block: Block, h: np.ndarray, check: np.ndarray, doc: np.ndarray, texts: int):
    """Per text of a shard's words: number of words, hit spans [from, to) in words, item ids, matches."""
    n = np.bincount(doc, minlength=texts)
    first = np.cumsum(n) - n
    hits, sizes, docs, items, found = search(block, h, check, doc)
    spans: dict[int, list[list[int]]] = {}
    if len(hits):
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + sizes, -1)
        cover = np.cumsum(edge[:-1]) > 0
        turn = np.append(True, doc[1:] != doc[:-1])
        s = np.flatnonzero(cover & (turn | ~np.append(False, cover[:-1])))
        e = np.flatnonzero(cover & np.append(turn[1:] | ~cover[1:], True)) + 1
        for d, x, y in zip(doc[s].tolist(), (s - first[doc[s]]).tolist(), (e - first[doc[s]]).tolist(), strict=True):
            spans.setdefault(d, []).append([x, y])
    of: dict[int, set[str]] = {}
    for d, i in zip(docs.tolist(), items.tolist(), strict=True):
        of.setdefault(d, set()).add(block.ids[i])
    by: dict[int, list] = {}
    for d, i, x, p, k in found.tolist():
        by.setdefault(d, []).append({"item_id": block.ids[i], "item_word": x, "doc_word": p - int(first[d]), "words": k})
    for d in range(texts):
        yield int(n[d]), spans.get(d, []), of.get(d, ()), by.get(d, [])


def _long(block: Block, raw: np.ndarray, window: int):
    """The same of one long text, piece by piece; matches that go on from piece to piece become one."""
    total, spans, items, matches = 0, [], set(), []
    for (h, doc, _, _, check), lead in pieces(raw, LUT, SHARD, window - 1, 2):
        base = total - lead
        n, s, i, m = next(_found(block, h, check, doc, 1))
        total = base + n
        spans = _union(spans, [[x + base, y + base] for x, y in s])
        items |= set(i)
        matches += [{**x, "doc_word": x["doc_word"] + base} for x in m]
    joined: list[dict] = []
    for m in sorted(matches, key=lambda x: (x["item_id"], x["doc_word"] - x["item_word"], x["doc_word"])):
        last = joined[-1] if joined else None
        if last and last["item_id"] == m["item_id"] and last["doc_word"] - last["item_word"] == m["doc_word"] - m["item_word"] and m["doc_word"] <= last["doc_word"] + last["words"]:
            last["words"] = max(last["words"], m["doc_word"] + m["words"] - last["doc_word"])
        else:
            joined.append(m)
    return total, spans, items, joined


def _scan(block: Block, column: pa.Array):
    """``_found`` of each text of one Arrow batch, shard by shard."""
    bounds, raw = utf8(column)
    for a, b in shards(bounds, SHARD):
        part = raw[bounds[a] : bounds[b]]
        if len(part) > 2 * SHARD:  # one text
            yield _long(block, part, block.window)
            continue
        h, doc, _, _, check = words(bounds[a : b + 1] - bounds[a], part, LUT, 2)
        yield from _found(block, h, check, doc, b - a)


def _union(a: list, b: list) -> list:
    out: list[list[int]] = []
    for x, y in sorted([*a, *b]):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return out


def _blocks(benchmark: DataFrame, block_bytes: int, window: int):
    """Blocks of at most block_bytes of text (one item at least), read row by row."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).toLocalIterator():
        if r.t:
            if ids and size + len(r.t) * 4 > block_bytes:
                yield Block(ids, texts, window)
                ids, texts, size = [], [], 0
            ids.append(r.i or "")
            texts.append(r.t)
            size += len(r.t) * 4
    yield Block(ids, texts, window)


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, only_clean: bool = False) -> DataFrame:
    """``docs`` with n_words, hit_spans ([from, to) in words), items (sorted item ids) and matches (maximal verbatim matches) after its columns.

    With ``only_clean`` the rows without any match instead, with the columns of ``docs`` alone.  ``docs`` needs a column text;
    names that it already has are replaced.  Rows stay as they are: repeated rows are answered each, null and empty texts
    have no words, an item without words matches nothing, and an empty benchmark leaves everything clean.  An item with a null id counts with the id ''."""
    spark = docs.sparkSession
    have = [f.name for f in docs.schema.fields]
    added = {f.name for f in ADDED.fields}
    keep = have if only_clean else [c for c in have if c.lower() not in added]
    df, k = docs.select(*[docs[f"`{c}`"] for c in keep]), keep.index(next(c for c in keep if c.lower() == "text"))
    width = len(keep)
    blocks = _blocks(benchmark, block_bytes, window)
    block, turn, held = next(blocks), 0, None
    while block is not None:
        sent, after = spark.sparkContext.broadcast(block), next(blocks, None)

        def scan(batches, sent=sent, k=k, width=width, later=turn > 0, clean=only_clean):
            for batch in batches:
                rows = list(_scan(sent.value, batch.column(k)))
                cols = list(batch.columns)[:width]
                if clean:
                    mask = pa.array([not r[1] for r in rows], pa.bool_())
                    yield pa.RecordBatch.from_arrays([c.filter(mask) for c in cols], batch.schema.names)
                    continue
                if later:
                    old = [batch.column(width + j).to_pylist() for j in range(1, 4)]
                    rows = [(n, _union(a, s), {*b, *i}, [*c, *m]) for (n, s, i, m), a, b, c in zip(rows, *old, strict=True)]
                new = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int64()))), pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))]
                kind = pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("words", pa.int64())]))
                new.append(pa.array([r[3] for r in rows], kind))
                yield pa.RecordBatch.from_arrays([*cols, *new], [*batch.schema.names[:width], "n_words", "hit_spans", "items", "matches"])

        plain = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields[:width]])
        df = df.mapInArrow(scan, plain if only_clean else T.StructType([*plain.fields, *ADDED.fields]))
        if after is not None:  # ends this block's pass, so that one block at a time is held
            df = cut(df, "decontaminate")
            sent.destroy()
            if held is not None:
                drop_cut(held)
            held = df
        block, turn = after, turn + 1
    return df


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of each benchmark item in every whole text of documents; see the module for the method."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_matches(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )
