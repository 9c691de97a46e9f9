"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors of a label stand in the order of the concatenated signs of random projections, drawn anew for each pass, and each vector is
compared with its neighbours there: with its own block of BLOCK places and the block before, whatever partitions they lie in.  A pair at cosine c agrees in a
sign with probability 1 - acos(c)/pi, so a pair that one pass leaves apart meets in another; measured recall is in the README.  Verified pairs of all passes are united.

The passes only say which vectors hang together, for a window holds no more than a part of a large group.  Links are counted afterwards: all vectors of a
component are compared with each other, in blocks of GROUP and pair by pair of blocks, so links within a component are exact whatever its size.

Equal vectors of one label are one class before anything is compared, so copies cost nothing and are linked exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import connected_components, cut, drop_cut, table

THRESHOLD = 0.93
PASSES = 8
BLOCK = 512
GROUP = 2048
BITS = 60
SEED = 20


def _planes(which: int, dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, which, dim]).standard_normal((dim, BITS)).astype(np.float32)


def _keys(batches):
    """(c, label, v) -> a row for each pass with its sort key."""
    for b in batches:
        offs = b.column(2).offsets.to_numpy()
        flat = b.column(2).flatten().to_numpy(zero_copy_only=False)
        size = np.diff(offs)
        key = np.zeros((PASSES, b.num_rows), np.int64)
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            x = flat[(offs[rows] - offs[0])[:, None] + np.arange(dim)[None, :]].astype(np.float32)
            x = x / np.maximum(np.abs(x).max(1, keepdims=True), np.float32(1e-38))
            for p in range(PASSES):
                key[p, rows] = ((x @ _planes(p, int(dim))) > 0).astype(np.int64) @ (np.int64(1) << np.arange(BITS, dtype=np.int64)[::-1])
        for p in range(PASSES):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, p, np.int32)), b.column(1), pa.array(size.astype(np.int32)), pa.array(key[p]), b.column(0), b.column(2)], ["pass", "label", "dim", "key", "c", "v"])


def _numbered(batches):
    """Adds the partition and the place in it."""
    part, n = TaskContext.get().partitionId(), 0
    for b in batches:
        place = pa.array(np.arange(n, n + b.num_rows))
        n += b.num_rows
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part, np.int32)), place], [*b.schema.names, "part", "place"])


def _vectors(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, numbers) of a column of lists."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def _units(offs: np.ndarray, flat: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Vectors of one dimension, scaled to unit length in double precision."""
    dim = int(offs[rows[0] + 1] - offs[rows[0]])
    x = flat[offs[rows][:, None] + np.arange(dim)[None, :]].astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _roots(near: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The smallest place that each place reaches, where near[i, j] joins the places mine[i] and j."""
    n = near.shape[1]
    root = np.arange(n)
    while True:
        new = np.minimum(root, np.where(near, root[mine][:, None], n).min(0))
        new[mine] = np.minimum(new[mine], np.where(near, new[None, :], n).min(1))
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _compare(threshold: float):
    """An edge from each vector of a window to the first one that verified pairs of the window lead to."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        meta = [t.column(k).to_numpy() for k in ("pass", "label", "dim", "c", "spare")]
        offs, flat = _vectors(t.column("v"))
        group = np.lexsort(meta[2::-1])
        a, b = [], []
        start = np.flatnonzero(np.append(True, np.any([m[group][1:] != m[group][:-1] for m in meta[:3]], axis=0)))
        for lo, hi in zip(start, np.append(start[1:], len(group)), strict=True):
            rows = group[lo:hi]
            mine = np.flatnonzero(meta[4][rows] == 0)
            if not len(mine) or len(rows) < 2:
                continue
            x = _units(offs, flat, rows)
            root = _roots(x[mine] @ x.T >= threshold, mine)
            j = np.flatnonzero(root != np.arange(len(rows)))
            a.append(meta[3][rows[root[j]]])
            b.append(meta[3][rows[j]])
        ca, cb = (np.concatenate(k) if k else np.zeros(0, np.int64) for k in (a, b))
        pairs = np.unique(np.stack([np.minimum(ca, cb), np.maximum(ca, cb)]), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return run


def _count(threshold: float):
    """(c, n) of two blocks of a component, or of one with itself, or of whole small components: n is the sum of the copies of what c links with there."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        m, c, copies, side = (t.column(k).to_numpy() for k in ("m", "c", "copies", "side"))
        offs, flat = _vectors(t.column("v"))
        group = np.argsort(m, kind="stable")
        n = np.zeros(len(c))
        start = np.flatnonzero(np.append(True, m[group][1:] != m[group][:-1]))
        two = t.column("lo")[0].as_py() != t.column("hi")[0].as_py()
        for lo, hi in zip(start, np.append(start[1:], len(group)), strict=True):
            rows = group[lo:hi]
            left, right = (rows[side[rows] == 0], rows[side[rows] == 1]) if two else (rows, rows)
            if not len(left) or not len(right):
                continue
            x = _units(offs, flat, left)
            y = _units(offs, flat, right) if two else x
            for s in range(0, len(left), BLOCK):
                near = x[s : s + BLOCK] @ y.T >= threshold
                if not two:
                    near[np.arange(len(near)), s + np.arange(len(near))] = False
                near = near.astype(np.float64)
                n[left[s : s + BLOCK]] += near @ copies[right]
                if two:
                    n[right] += copies[left[s : s + BLOCK]] @ near
        return pa.table({"c": pa.array(c, pa.int64()), "n": pa.array(n.astype(np.int64))})

    return run


def _links(classes: DataFrame, size: DataFrame, joined: DataFrame, threshold: float) -> DataFrame:
    """(c, n): with how many vectors of its component each class links, its own copies left out.

    A component of more than GROUP classes is dealt into blocks by hash, and each pair of blocks is one group; small components share groups."""
    members = joined.select(F.col("id").alias("c"), F.col("component_id").alias("m"))
    total = members.count()
    large = members.groupBy("m").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > GROUP).select("m", F.ceil(F.col("k") / GROUP).cast("int").alias("blocks"))
    rows = members.join(classes.select("c", "v"), "c").join(size.select("c", "copies"), "c").join(F.broadcast(large), "m", "left")
    big = F.col("blocks").isNotNull()
    own = F.when(big, F.pmod(F.xxhash64("c", F.lit(SEED)), F.col("blocks"))).otherwise(F.pmod(F.xxhash64("m"), F.lit(-(-total // GROUP) or 1))).cast("int")
    rows = rows.select("m", "c", "copies", "v", F.coalesce("blocks", F.lit(0)).alias("blocks"), own.alias("own"))
    met = F.when(F.col("blocks") > 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    rows = rows.select("m", "c", "copies", "v", "blocks", "own", F.explode(met).alias("met"))
    rows = rows.select(F.when(F.col("blocks") > 0, F.col("m")).alias("g"), F.least("own", "met").alias("lo"), F.greatest("own", "met").alias("hi"), (F.col("own") > F.col("met")).cast("int").alias("side"), "m", "c", "copies", "v")
    return rows.groupBy("g", "lo", "hi").applyInArrow(_count(threshold), "c long, n long").groupBy("c").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding, label).

    Links join vectors of equal labels with cosine >= threshold in double precision.  A vector that is null, empty, zero or holds a null or a
    non-finite component, or whose label is null, links with nothing: 0 links, its own component, kept.  Repeated rows are answered each, and count
    once where they are linked; a row with a null id takes part, and its component's number is the smallest id that is not null.  Vectors are the same class by 128 bits of their label and
    numbers, and classes are named after a row of theirs.  Ties of sort keys are broken by the class.  A very long vector is one row; columns but these three play no part."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("v"), vectors["label"].cast("long").alias("label"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    plain = F.transform("v", lambda x: x + F.lit(0).cast("float"))  # -0.0 becomes 0.0
    digest = F.md5(F.to_json(F.struct("label", plain.alias("v"))).cast("binary"))
    once = cut(rows.withColumns({"d": F.when(valid, digest), "row": F.monotonically_increasing_id()}), "vectors-rows")
    held = cut(once.join(once.where("d is not null").groupBy("d").agg(F.min("row").alias("c")), "d", "left").select("vec_id", "v", "label", "c"), "vectors")
    drop_cut(once)
    ok = held.where("c is not null")
    classes = ok.groupBy("c").agg(F.first("label").alias("label"), F.first("v").alias("v"))
    keyed = classes.select("c", "label", "v").mapInArrow(_keys, "pass int, label long, dim int, key long, c long, v array<float>")
    order = ["pass", "label", "dim", "key", "c"]
    placed = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, "pass int, label long, dim int, key long, c long, v array<float>, part int, place long"), "vectors-placed")
    counts = {r["part"]: r["n"] for r in placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a number for each partition
    first, total = {}, 0
    for p in sorted(counts):
        first[p], total = total, total + counts[p]
    spark = vectors.sparkSession
    offsets = spark.createDataFrame([(p, n) for p, n in first.items()], "part int, before long")
    block = ((F.col("place") + F.col("before")) / BLOCK).cast("long")
    both = placed.join(F.broadcast(offsets), "part").select("pass", "label", "dim", "c", "v", F.explode(F.array(F.struct(block.alias("block"), F.lit(0).alias("spare")), F.struct((block + 1).alias("block"), F.lit(1).alias("spare")))).alias("x"))
    both = both.select("pass", "label", "dim", "c", "v", "x.block", "x.spare")
    links = cut(both.groupBy("block").applyInArrow(_compare(threshold), "a long, b long").distinct(), "vectors-links")
    drop_cut(placed)
    size = ok.groupBy("c").agg(F.countDistinct("vec_id").alias("copies"), F.min("vec_id").alias("low"))
    joined = connected_components(links, "a", "b")
    far = _links(classes, size, joined, threshold)
    named = size.join(joined, F.col("c") == F.col("id"), "left").select("c", "copies", "low", F.coalesce("component_id", "c").alias("m"))
    least = named.groupBy("m").agg(F.min("low").alias("component_id"))
    of = named.join(least, "m").join(far, "c", "left").select("c", "component_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    out = held.select("vec_id", "c").join(of, "c", "left")
    component = F.when(F.col("c").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.greatest(F.coalesce("n_links", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
    out = cut(out, "vectors-out")
    for x in (held, links, joined):
        drop_cut(x)
    return out


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of embeddings at cosine 0.93 or more within a label."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
