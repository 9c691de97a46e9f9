"""Prefix trie of conversations by rolling fingerprints.

The fingerprint of d turns is the polynomial F(d) = F(d-1) * B + t(d) modulo 2**64 of their turns' hashes.  Conversations stand in the order of their turns over
range partitions; numpy scans give each partition's prefixes, and since fingerprints of runs compose (F(ab) = F(a) * B**len(b) + F(b)), what is open at a partition's
end is carried into the next by one row for each partition.  A conversation of any length is thus scanned by many tasks.  The same algebra replaces a conversation's first turns by
another's without a second scan, and gives a prefix's parent: F(d-1) = (F(d) - t(d)) / B.

Fingerprints only propose groups.  Texts with equal hashes are told apart by their contents (``s`` numbers them), and each group (d, F) is verified: the turn (t, s) of every member must be
that of the representative, the smallest conversation.  As B has an inverse, members of a group with equal last turns were together one turn before, so by induction
groups that all pass hold equal prefixes.  Members that differ are split off, and a prefix is then known by its fingerprint and the list of splits on its way (``x``).

The rollup to the parents needs no pass for each depth.  A node is owned by its smallest member; what a conversation owns is the end of its path, from some depth on.  Over the subtree
of a node, words of all members minus words of distinct nodes is the sum over its members of the words before the part that each owns, and leaves are members that own a leaf: both are sums by node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_cut, table

BASE = 0x9E3779B97F4A7C15
BLOCK = 20
#: Characters of role and text by which turns of equal numbers are dealt to partitions.
LEAD = 32
#: Bytes of a packed run of ids.
PACKED = 1 << 16


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n."""
    out, step = np.ones(max(n, 1), np.uint64), 1
    while step < n:
        out[step : 2 * step] = out[: min(step, n - step)] * np.uint64(pow(base, step, 1 << 64))
        step *= 2
    return out


def _power(base: int, k: np.ndarray) -> np.ndarray:
    """base**k modulo 2**64 for each k."""
    out, square = np.ones(len(k), np.uint64), base
    for bit in range(int(k.max()).bit_length() if len(k) else 0):
        on = (k >> bit) & 1 == 1
        out[on] *= np.uint64(square)
        square = square * square % (1 << 64)
    return out


def prefixes(t: np.ndarray, starts: np.ndarray, base: int) -> np.ndarray:
    """The fingerprint of each prefix of runs of turns that begin at ``starts``: with S the sums of t(i) * B**-i, F is (S - S before the run) * B**i."""
    sums = np.cumsum(t * powers(pow(base, -1, 1 << 64), len(t)))
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    return (sums - np.repeat(before, np.diff(np.append(starts, len(t))))) * powers(base, len(t))


def _scan(base: int):
    """(conv, t, s, w) in order -> adds the place, fingerprint and words within this partition, whether the turn belongs to the partition's first conversation, and the partition."""

    def run(batches):
        part, first, last, n, f, words = TaskContext.get().partitionId(), None, None, 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            conv, t, w = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(3).to_numpy()
            starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            size = np.diff(np.append(starts, len(conv)))
            p = np.arange(len(conv)) - np.repeat(starts, size) + 1
            fp = prefixes(t, starts, base)
            total = np.cumsum(w)
            total = total - np.repeat(total[starts] - w[starts], size)
            if conv[0] == last:  # the run of the batch before goes on
                k = slice(0, size[0])
                fp[k] += np.uint64(f) * _power(base, p[k])
                total[k] += words
                p[k] += n
            first = int(conv[0]) if first is None else first
            last, n, f, words = int(conv[-1]), int(p[-1]), int(fp[-1]), int(total[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array(fp.view(np.int64)), pa.array(total), pa.array(conv == first), pa.array(np.full(len(conv), part, np.int32))], ["conv", "t", "s", "w", "p", "f", "words", "head", "part"])

    return run


def _carries(ends: list, base: int) -> dict[int, tuple[int, int, int]]:
    """For each partition whose first conversation began before it: (turns, fingerprint, words) so far."""
    out, conv, state = {}, None, (0, 0, 0)
    for r in sorted(ends, key=lambda r: r["part"]):
        head, tail = r["first"], r["last"]
        if head["conv"] == conv:
            out[r["part"]] = state
            state = (state[0] + head["p"], (state[1] * pow(base, head["p"], 1 << 64) + head["f"]) % (1 << 64), state[2] + head["words"])
        if tail["conv"] != head["conv"] or head["conv"] != conv:
            conv, state = tail["conv"], (tail["p"], tail["f"] % (1 << 64), tail["words"])
    return out


def _carried(carries: dict[int, tuple[int, int, int]], base: int):
    def run(batches):
        for b in batches:
            p, f, words = (b.column(k).to_numpy().copy() for k in (4, 5, 6))
            f, head, part = f.view(np.uint64), b.column(7).to_numpy(zero_copy_only=False), b.column(8).to_numpy()
            for k in np.unique(part[head]).tolist():
                if k in carries:
                    rows = head & (part == k)
                    n, before, w = carries[k]
                    f[rows] += np.uint64(before) * _power(base, p[rows])
                    p[rows] += n
                    words[rows] += w
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p), pa.array(f.view(np.int64)), pa.array(words)], ["conv", "t", "s", "w", "p", "f", "words"])

    return run


def _moved(base: int):
    """(conv, p, f, t, s, w, words, h, put, from_f, to_f, from_w, to_w): own turns after the first h -> (conv, d, f, up, t, s, w, words) behind ``put`` turns of another conversation."""
    back = np.uint64(pow(base, -1, 1 << 64))

    def run(batches):
        for b in batches:
            col = {n: b.column(k).to_numpy() for k, n in enumerate(b.schema.names)}
            rest = col["p"] - col["h"]
            f = col["f"].view(np.uint64) + (col["to_f"].view(np.uint64) - col["from_f"].view(np.uint64)) * _power(base, rest)
            up = (f - col["t"].view(np.uint64)) * back
            out = [col["conv"], rest + col["put"], f.view(np.int64), up.view(np.int64), col["t"], col["s"], col["w"], col["words"] - col["from_w"] + col["to_w"]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["conv", "d", "f", "up", "t", "s", "w", "words"])

    return run


_NODE = "conv long, d long, f long, up long, t long, s long, w long, words long"


def _pack(batches):
    """(d, f, x, conv) in order -> a row for each run of ids of a node: the ids joined by commas, PACKED bytes or little more, and the first."""
    key, ids, size = None, [], 0
    rows: list[tuple] = []

    def flush():
        if ids:
            rows.append((*key, ids[0], ",".join(map(str, ids))))

    for b in batches:
        for d, f, x, c in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if (d, f, x) != key or size >= PACKED:
                flush()
                key, ids, size = (d, f, x), [], 0
            ids.append(c)
            size += 12
        if rows:
            yield _rows(rows)
            rows = []
    flush()
    if rows:
        yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    d, f, x, c, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(x, pa.string()), pa.array(c, pa.int64()), pa.array(ids, pa.string())], ["d", "f", "x", "conv", "ids"])


def _digests(batches):
    """Packed runs of ids in order -> (d, f, x, sha), one hash at a time."""
    key, sha, out = None, None, []
    for b in batches:
        for d, f, x, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if (d, f, x) != key:
                if sha is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = (d, f, x), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
        if out:
            yield _digest_rows(out)
            out = []
    if sha is not None:
        yield _digest_rows([*out, (*key, sha.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    d, f, x, sha = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(x, pa.string()), pa.array(sha, pa.string())], ["d", "f", "x", "sha"])


def _scanned(turns: DataFrame, base: int, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(conv, t, s, w, p, f, words): each turn with its hash, the number of its content among contents of that hash, its words, its place, and fingerprint and words up to it; and what to drop later."""
    mask = (1 << bits) - 1 if bits < 64 else -1
    rows = turns.select(turns["conv_id"].cast("long").alias("conv"), turns["turn"].alias("turn"), F.coalesce(turns["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(turns["text"].cast("string"), F.lit("")).alias("text"))
    rows = rows.where("conv is not null").withColumns({"t": F.xxhash64("role", "text").bitwiseAND(F.lit(mask).cast("long")), "w": F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})
    contents = rows.groupBy("t", "role", "text").agg(F.lit(1).alias("one"))
    clash = contents.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t")
    same = cut(contents.join(clash, "t", "left_semi").select("t", "role", "text", F.xxhash64("text", "role", F.lit(1)).alias("s")), "tree-clashes")
    drop = [same]
    if same.isEmpty():
        rows = rows.withColumn("s", F.lit(0).cast("long"))
    else:  # contents of one hash, told apart by their place among them
        same = same.select("t", "role", "text", F.row_number().over(_by("t").orderBy("role", "text")).cast("long").alias("s"))
        rows = rows.join(same, ["t", "role", "text"], "left").withColumn("s", F.coalesce("s", F.lit(0).cast("long")))
    lead = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, LEAD), F.substring("text", 1, LEAD)]
    placed = rows.repartitionByRange(*lead).sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    scanned = cut(placed.select("conv", "t", "s", "w").mapInArrow(_scan(base), "conv long, t long, s long, w long, p long, f long, words long, head boolean, part int"), "tree-scan")
    state = F.struct("conv", "p", "f", "words")
    ends = scanned.groupBy("part").agg(F.max_by(F.when(F.col("head"), state), F.when(F.col("head"), F.col("p"))).alias("first"), F.max_by(state, F.struct("conv", "p")).alias("last"))
    carries = _carries(ends.collect(), base)  # a row for each partition
    return scanned.mapInArrow(_carried(carries, base), "conv long, t long, s long, w long, p long, f long, words long"), [*drop, scanned]


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def _rebuilt(all_turns: DataFrame, base: int, block: int) -> DataFrame:
    """Turns of the rebuilt conversations, one of depth 0 for each conversation among them."""
    at = lambda k, c: F.max(F.when(F.col("p") == k, F.col(c))).alias(f"{c}{k}")
    heads = all_turns.groupBy("conv").agg(F.max("p").alias("n"), *[at(k, c) for k in (1, 2, 3) for c in ("f", "words", "t", "s", "w")])
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h")
    convs = heads.select("conv", "n", h, (F.col("conv") - F.col("conv") % block).alias("of"), *[f"{c}{k}" for c in ("f", "words") for k in (1, 2, 3)])
    bases = heads.where(F.col("conv") % block == 0).select(F.col("conv").alias("of"), F.col("n").alias("m"), *[F.col(f"{c}{k}").alias(f"b_{c}{k}") for c in ("f", "words", "t", "s", "w") for k in (1, 2, 3)])
    both = convs.join(bases, "of", "left").withColumn("put", F.least("h", F.coalesce("m", F.lit(0))))
    pick = lambda names, k: F.coalesce(*[F.when(F.col(k) == i, F.col(names.format(i))) for i in (1, 2, 3)], F.lit(0)).cast("long")
    both = both.select("*", pick("f{}", "h").alias("from_f"), pick("words{}", "h").alias("from_w"), pick("b_f{}", "put").alias("to_f"), pick("b_words{}", "put").alias("to_w"))
    change = both.where("n > h").select("conv", "h", "put", "from_f", "to_f", "from_w", "to_w")
    own = all_turns.join(change, "conv").where("p > h").select("conv", "p", "f", "t", "s", "w", "words", "h", "put", "from_f", "to_f", "from_w", "to_w").mapInArrow(_moved(base), _NODE)
    longs = lambda **k: [v.cast("long").alias(n) for n, v in k.items()]
    lead = F.array(F.struct(*longs(d=F.lit(0), f=F.lit(0), up=F.lit(None), t=F.lit(0), s=F.lit(0), w=F.lit(0), words=F.lit(0))), *[
        F.struct(*longs(d=F.lit(k), f=F.col(f"b_f{k}"), up=F.col(f"b_f{k - 1}") if k > 1 else F.lit(0), t=F.col(f"b_t{k}"), s=F.col(f"b_s{k}"), w=F.col(f"b_w{k}"), words=F.col(f"b_words{k}"))) for k in (1, 2, 3)
    ])
    copied = both.select("conv", F.explode(F.slice(lead, F.lit(1), (F.col("put") + 1).cast("int"))).alias("r")).select("conv", "r.*")
    return own.unionByName(copied)


def _split(rows: DataFrame) -> DataFrame:
    """Adds x and up_x: the splits on the way to the turn and to the one before, as ``depth:number`` joined by commas; empty where each turn is that of its group's representative."""
    turns = rows.groupBy("d", "f").agg(F.min(F.struct("t", "s")).alias("lo"), F.max(F.struct("t", "s")).alias("hi"))
    mixed = cut(turns.where("lo <> hi").select("d", "f"), "tree-mixed")
    if mixed.isEmpty():
        drop_cut(mixed)
        return rows.withColumns({"x": F.lit(""), "up_x": F.lit("")})
    each = rows.join(mixed, ["d", "f"], "left_semi").groupBy("d", "f", "t", "s").agg(F.min("conv").alias("low"))
    number = each.select("d", "f", "t", "s", (F.row_number().over(_by("d", "f").orderBy("low")) - 1).alias("number")).where("number > 0")
    splits = rows.join(number, ["d", "f", "t", "s"]).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("d", "number"))).alias("splits"))  # as long as a conversation has collisions
    path = lambda upto: F.array_join(F.transform(F.filter(F.coalesce("splits", F.array().cast("array<struct<d:bigint,number:int>>")), lambda r: r["d"] <= upto), lambda r: F.concat_ws(":", r["d"], r["number"])), ",")
    return rows.join(splits, "conv", "left").select(*rows.columns, path(F.col("d")).alias("x"), path(F.col("d") - 1).alias("up_x"))


def conversation_tree(turns: DataFrame, block: int = BLOCK, base: int = BASE, bits: int = 64) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node of the trie of rebuilt conversations, from ``turns`` (conv_id, turn, role, text).

    A conversation c is the first crc32(c) % 4 turns of conversation c - c % block and its own turns after as many.  Null roles and texts are empty; turns without a number come first, and turns of
    equal numbers in the order of role and text, repeated rows each.  A conv_id that no row has isn't there, and rows with a null conv_id are left out.  A conversation without turns of its own left and
    without a block's first is a member of the root alone.  The root has no words.  A very long text is read once by each of two passes and never meets Python; a very
    long conversation is spread over partitions.  Other columns, whatever their names, play no part.  An empty table has no nodes.

    ``base`` (odd) and ``bits`` of a turn's hash set how often fingerprints collide, never the result."""
    if base % 2 == 0:
        raise ValueError("base must be odd")
    scanned, spare = _scanned(turns, base, bits)
    flat = cut(_rebuilt(scanned, base, block), "tree-rebuilt")
    rows = cut(_split(flat), "tree-turns")
    node = ["d", "f", "x"]
    nodes = cut(rows.groupBy(*node).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("owner"), F.min("up").alias("up"), F.min("up_x").alias("up_x"), (F.min("words") - F.min("w")).alias("before")), "tree-nodes")
    up = [(F.col("d") - 1).alias("d"), F.col("up").alias("f"), F.col("up_x").alias("x")]
    children = nodes.where("d > 0").select(*up).groupBy(*node).agg(F.count(F.lit(1)).alias("n_children"))
    leaves = nodes.join(children, node, "left_anti").select("owner", F.lit(1).alias("leaf"))  # a conversation owns one leaf at most
    owned = nodes.groupBy(F.col("owner").alias("conv")).agg(F.min("before").alias("own_from"))
    ends = rows.groupBy("conv").agg(F.max_by(F.struct("f", "x", "words"), "d").alias("end"), F.max("d").alias("d"))
    each = ends.join(owned, "conv", "left").join(leaves.withColumnRenamed("owner", "conv"), "conv", "left")
    each = each.select("conv", F.coalesce("own_from", F.col("end.words")).alias("own_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    shared = F.greatest(F.col("own_from") - (F.col("words") - F.col("w")), F.lit(0))
    sums = rows.select("conv", *node, "w", "words").join(each, "conv").groupBy(*node).agg(F.sum(shared).alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves"))
    at = ends.select("d", F.col("end.f").alias("f"), F.col("end.x").alias("x"), "conv")
    packed = cut(at.repartitionByRange(*node, "conv").sortWithinPartitions(*node, "conv").mapInArrow(_pack, "d long, f long, x string, conv long, ids string"), "tree-ends")
    sha = packed.repartition(*node).sortWithinPartitions(*node, "conv").mapInArrow(_digests, "d long, f long, x string, sha string")
    parents = nodes.select((F.col("d") + 1).alias("pd"), F.col("f").alias("pf"), F.col("x").alias("px"), F.col("owner").alias("parent_conv_id"))
    out = nodes.join(parents, (F.col("d") == F.col("pd")) & (F.col("up") == F.col("pf")) & (F.col("up_x") == F.col("px")), "left").drop("pd", "pf", "px")
    out = out.join(children, node, "left").join(sums, node, "left").join(sha, node, "left")
    out = cut(out.select(
        F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    ), "tree-out")
    for x in (*spare, flat, rows, nodes, packed):
        drop_cut(x)
    return out


def op12_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of rebuilt conversations of the whole table."""
    return conversation_tree(table(spark, sf_dir, "conversations"))
