"""Best-fit packing of token sequences, bounded-space and online.

Each task packs the documents of its own input split, in their order, with a fixed number of open bins.  A bitset holds for which amounts of
free space a bin is open; the best fit for a piece is the lowest set bit at or above its length, found with shifts.  If no open bin fits and all places are
taken, the fullest bin (the lowest set bit of all) closes to make room.  Memory is that of ``open_bins`` bins and one batch of texts.

Each task leaves bins open at its end, the more of the whole the more tasks there are.  So the pieces of sequences that are not FULL are packed once more, in the same way, in tasks of
REPACKED pieces by falling length; these are rows of a few numbers, no texts.
"""

from __future__ import annotations

import base64
import binascii
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_cut, table

CAPACITY = 1024
OPEN_BINS = 1024
END = 2
TOKENIZER = "byte_bpe_50k"
CACHE = 600_000
#: Share of a sequence from which it stays as it is, and pieces that a task packs once more.
FULL = 0.995
REPACKED = 1 << 18
#: Sequences of the second packing have numbers from here.
SECOND = 1 << 62


class Ids:
    """Token ids of a text as little-endian 32-bit bytes: the ids of the tokenizers file, by way of its twin vocabulary.

    A space between two characters that are no white space always begins a new piece of the vocabulary's pattern, so a text without
    white space before a space is cut at its spaces, and each different word is encoded once as long as it stays in the cache (at most CACHE words).  Any
    other text is encoded whole.  One that holds the file's special token goes to the tokenizers library itself, which gives that string its own id."""

    SPECIAL = "<|endoftext|>"
    LOOSE = re.compile(r"\s ")

    def __init__(self, folder: str | None = None, name: str = TOKENIZER):
        import public_tokenizers as P
        import tiktoken

        path = (lambda f: f"{folder}/{f}") if folder else P.path
        with open(path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        made = tiktoken.Encoding("packing", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.piece = made.encode_ordinary, made._core_bpe.encode_single_piece
        self.marks = {m: self._bytes(m) for m in ".,"}
        self.file, self.whole = path(f"{name}.json"), None
        self.known: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _word(self, w: str) -> bytes:
        """Of a word and the space before it.  Letters alone are one piece of the pattern; so is a full stop or comma after them."""
        if w.isalpha():
            if (p := self.known.get(w)) is None:
                p = self.known[w] = array("I", self.piece(f" {w}".encode())).tobytes()
            return p
        if w[-1:] in self.marks and w[:-1].isalpha():
            return self._word(w[:-1]) + self.marks[w[-1]]
        if (p := self.known.get(w)) is None:
            p = self.known[w] = self._bytes(" " + w)
        return p

    def __call__(self, text: str) -> bytes:
        if self.SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.LOOSE.search(text):
            return self._bytes(text)
        first, *rest = text.split(" ")
        known = self.known
        parts = list(map(known.get, rest))
        if None in parts:
            if len(known) > CACHE:
                known.clear()
            for k, p in enumerate(parts):
                if p is None:
                    parts[k] = self._word(rest[k])
        return self._bytes(first) + b"".join(parts)


class Bins:
    """At most ``places`` open bins of ``capacity``; ``put`` returns (number of the sequence, offset)."""

    def __init__(self, capacity: int, places: int):
        self.capacity, self.places = capacity, places
        self.free = 0  # bit f: some open bin has f free
        self.at: dict[int, list[int]] = {}
        self.open = self.next = 0

    def put(self, length: int) -> tuple[int, int]:
        fit = self.free >> length
        if fit:
            space = length + ((fit & -fit).bit_length() - 1)
            number = self._take(space)
        else:
            if self.open == self.places:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.next
            self.next += 1
        if rest := space - length:
            self.free |= 1 << rest
            self.at.setdefault(rest, []).append(number)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        held = self.at[space]
        number = held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def pieces(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``total`` ids: pieces of ``capacity``, the first shorter if need be."""
    first = total % capacity or min(total, capacity)
    return [(0, first), *((s, capacity) for s in range(first, total, capacity))]


SCHEMA = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, open_bins: int = OPEN_BINS, tokenizers: str | None = None) -> DataFrame:
    """One row per piece of each row of ``docs``: the id column, then SCHEMA.

    Null texts count as empty; an empty text is the one id 2.  Repeated rows are packed each, a null id like any other; columns but these two play no part.  Of bins with equal free space the one
    that came to it last is taken.  A very long text is encoded whole, in memory of some ten times its length, and cut into pieces.  A
    sequence's number is the task's partition number times 2**33 plus its number there, and SECOND more where it was packed once more.  What the first packing gives is written, so the second sees the same rows whatever runs again."""
    src = docs.select(docs[id_col].alias(id_col), docs[text_col].alias(text_col))

    def run(batches):
        ids, bins, base = Ids(tokenizers), Bins(capacity, open_bins), TaskContext.get().partitionId() << 33
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                rows: list[list] = [[] for _ in range(7)]
                for k, text in enumerate(part.column(1).to_pylist()):
                    data = (ids(text) if text else b"") + end
                    for j, (s, n) in enumerate(pieces(len(data) // 4, capacity)):
                        number, offset = bins.put(n)
                        for to, x in zip(rows, (k, j, s, n, binascii.crc32(data[4 * s : 4 * (s + n)]), base + number, offset), strict=True):
                            to.append(x)
                cols = [pc.take(part.column(0), pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])]
                yield pa.RecordBatch.from_arrays(cols, [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = src.schema[id_col].dataType.simpleString()
    first = cut(src.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}"), "packing-first")
    out = cut(_once_more(first, id_col, capacity, open_bins), "packing")
    drop_cut(first)
    return out


def _once_more(packed: DataFrame, id_col: str, capacity: int, open_bins: int) -> DataFrame:
    """``packed`` with the pieces of sequences that aren't FULL packed again."""
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("n")).where(F.col("fill") < FULL * capacity)
    again = fill.agg(F.sum("n")).first()[0] or 0
    if not again:
        return packed
    few = fill.select("sequence_id")
    kept = packed.join(few, "sequence_id", "left_anti").select(*packed.columns)
    tasks = -(-again // REPACKED)
    dealt = packed.join(few, "sequence_id", "left_semi").select(*packed.columns).repartition(tasks, F.xxhash64("sequence_id", "offset"))

    def run(batches):
        bins, base = Bins(capacity, open_bins), SECOND + (TaskContext.get().partitionId() << 33)
        for b in batches:
            new = [bins.put(n) for n in b.column(3).to_pylist()]
            numbers, offsets = ([x[k] for x in new] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([base + k for k in numbers], pa.int64()), pa.array(offsets, pa.int64())], b.schema.names)

    kind = packed.schema[id_col].dataType.simpleString()
    order = dealt.sortWithinPartitions(F.col("length").desc(), "sequence_id", "offset")
    return kept.unionByName(order.mapInArrow(run, f"`{id_col}` {kind}, {SCHEMA}"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
