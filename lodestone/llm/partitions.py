"""Approximate nearest neighbours by learned partitions (Dong et al., "Learning Space Partitions for Nearest Neighbor Search", 2020).

A bounded sample of the vectors makes a graph of nearest neighbours, which is cut into parts of equal size with few edges between them (recursive bisection: a split at the median
of a smoothed vector, then swaps of equal numbers of vertices that lower the cut).  A small classifier learns from a vector the parts of its neighbours.  Every vector of the table goes to its most
probable part; a query goes to as many of its most probable parts as the sample needed for TARGET of its neighbours, and meets all vectors there.

A part of more than LEAF vectors is learned and divided once more from a sample of its own, so parts stay small where vectors crowd; whatever a part still holds is dealt into blocks of bounded
size, for vectors and for queries, so no task grows with the table.  Equal vectors are one class: a class is compared once and stands for its smallest ids.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, drop_cut, table

#: Vectors that a router is fitted on, about; those of the smallest hashes.  A bound, whatever the table.
SAMPLE = 8192
#: Vectors a part is meant to hold, most parts of one router, and vectors from which a part is divided again.
SIZE, PARTS, LEAF = 1024, 128, 65_536
LEVELS = 2
#: Share of the sample's nearest neighbours that the parts a query goes to must hold, at each level.
TARGET = 0.97
GRAPH = 10
HIDDEN = 128
EPOCHS = 30
#: Vectors and queries that meet in one group.
BLOCK, QUERIES = 4096, 1024
SEED = 11


# ---------------------------------------------------------------- a router


def _graph(u: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each unit vector."""
    out = np.empty((len(u), k), np.int64)
    for a in range(0, len(u), 1024):
        s = u[a : a + 1024] @ u.T
        s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out[a : a + 1024] = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
    return out


def _bisect(a: np.ndarray, b: np.ndarray, n: int, left: int, rng: np.random.Generator) -> np.ndarray:
    """Which of n vertices are on the first side, ``left`` of them, with few of the edges (a, b), given in both directions, between the sides."""
    degree = np.maximum(np.bincount(a, minlength=n), 1)
    x = rng.standard_normal(n)
    for _ in range(40):  # smoothing over the graph leaves the slowest modes
        x = 0.5 * x + 0.5 * np.bincount(a, x[b], n) / degree
        x -= x.mean()
        x /= max(np.abs(x).max(), 1e-30)
    side = np.zeros(n, bool)
    side[np.argsort(x, kind="stable")[:left]] = True
    best, least, share = side, (side[a] != side[b]).sum(), 0.5
    for _ in range(20):
        other = np.bincount(a, (side[a] != side[b]).astype(float), n)
        gain = 2 * other - np.bincount(a, minlength=n)
        one, two = np.flatnonzero(side), np.flatnonzero(~side)
        one, two = one[np.argsort(-gain[one], kind="stable")], two[np.argsort(-gain[two], kind="stable")]
        m = min(len(one), len(two))
        m = int((gain[one[:m]] + gain[two[:m]] > 0).sum() * share)
        if not m:
            break
        side = side.copy()
        side[one[:m]], side[two[:m]] = False, True
        if (now := (side[a] != side[b]).sum()) < least:
            best, least = side, now
        else:
            share /= 2
    return best


def balanced_partition(graph: np.ndarray, parts: int, seed: int = SEED) -> np.ndarray:
    """Part of each vertex of the graph (its neighbours by row): parts differ by one vertex at most, with few edges between them."""
    n, rng = len(graph), np.random.default_rng(seed)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.reshape(-1)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    out, todo = np.zeros(n, np.int64), [(np.arange(n), 0, parts)]
    while todo:
        own, first, k = todo.pop()
        if k == 1 or len(own) < 2:
            out[own] = first
            continue
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        inside = (place[a] >= 0) & (place[b] >= 0)
        q, r = divmod(len(own), k)  # r of the parts have one vertex more than q
        half = k // 2
        left = _bisect(place[a[inside]], place[b[inside]], len(own), q * half + min(r, half), rng)
        todo += [(own[left], first, half), (own[~left], first + half, k - half)]
    return out


def _forward(x: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ m["a"] + m["b"], 0)
    z = hidden @ m["c"] + m["d"]
    z = np.exp(z - z.max(1, keepdims=True))
    return hidden, z / z.sum(1, keepdims=True)


def _train(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> dict:
    """One hidden layer, cross-entropy with the shares y, Adam."""
    dim, parts = x.shape[1], y.shape[1]
    m = {"a": rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), "b": np.zeros(HIDDEN), "c": rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), "d": np.zeros(parts)}
    m = {k: v.astype(np.float32) for k, v in m.items()}
    first, second, step = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for s in range(0, len(x), 256):
            xs, ys = x[order[s : s + 256]], y[order[s : s + 256]]
            hidden, p = _forward(xs, m)
            dz = (p - ys) / len(xs)
            dh = (dz @ m["c"].T) * (hidden > 0)
            grad = {"a": xs.T @ dh, "b": dh.sum(0), "c": hidden.T @ dz, "d": dz.sum(0)}
            step += 1
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                m[k] = m[k] - np.float32(0.003) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)
    return {k: v.astype(np.float32) for k, v in m.items()}


def fit_router(u: np.ndarray, parts: int, target: float = TARGET) -> dict:
    """A router of unit vectors to ``parts`` parts, from a sample: weights, and the number of parts that a query goes to (``probes``)."""
    rng, k = np.random.default_rng(SEED), min(GRAPH, len(u) - 1)
    u = u.astype(np.float32)
    graph = _graph(u, k)
    label = balanced_partition(graph, parts)
    near = np.concatenate([label[:, None], label[graph]], axis=1)
    y = np.zeros((len(u), parts), np.float32)
    np.add.at(y, (np.repeat(np.arange(len(u)), k + 1), near.reshape(-1)), 1 / (k + 1))
    held = rng.random(len(u)) < 0.2  # probes are counted on vectors that the classifier hasn't seen
    scale = np.float32(np.sqrt(u.shape[1]))
    m = _train(u[~held] * scale, y[~held], rng) | {"scale": scale}
    _, p = _forward(u * scale, m)
    put = p.argmax(1)
    place = np.empty(p.shape, np.int64)
    np.put_along_axis(place, np.argsort(-p, axis=1, kind="stable"), np.arange(parts)[None, :].repeat(len(p), 0), 1)
    asked = np.flatnonzero(held) if held.any() else np.arange(len(u))
    needed = np.sort(place[asked[:, None], put[graph[asked, : min(5, k)]]].reshape(-1))
    m["probes"] = int(needed[max(0, int(np.ceil(target * len(needed))) - 1)]) + 1
    return m


def probabilities(u: np.ndarray, m: dict) -> np.ndarray:
    return _forward(u.astype(np.float32) * m["scale"], m)[1]


# ---------------------------------------------------------------- vectors to parts


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a batch in double precision, as they are and scaled to unit length."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    y = x / np.abs(x).max(1, keepdims=True)
    return x, y / np.sqrt((y * y).sum(1, keepdims=True))


def _fit(dim: int, sizes: dict[int, int], size: int, parts: int, target: float):
    """A group's sample (leaf, v) -> its router."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        leaf = t.column("leaf")[0].as_py()
        _, u = _units(t.column("v").chunk(0), dim)
        k = min(parts, max(1, -(-sizes[leaf] // size)), max(1, len(u) // 16))
        if k < 2:
            return pa.table({"leaf": pa.array([], pa.int64()), "router": pa.array([], pa.binary())})
        return pa.table({"leaf": pa.array([leaf], pa.int64()), "router": pa.array([pickle.dumps(fit_router(u, k, target))], pa.binary())})

    return run


def _route(dim: int, routers: dict[int, dict], several: bool):
    """(c, v, leaf) -> a row for each part of the leaf's router that the vector goes to; leaves without one stay."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            leaf, (_, u) = b.column(2).to_numpy(), _units(b.column(1), dim)
            rows, parts = [], []
            for k in np.unique(leaf).tolist():
                mine = np.flatnonzero(leaf == k)
                if k not in routers:
                    rows.append(mine)
                    parts.append(leaf[mine])
                    continue
                p, m = probabilities(u[mine], routers[k]), routers[k]["probes"] if several else 1
                to = np.argsort(-p, axis=1, kind="stable")[:, :m]
                rows.append(np.repeat(mine, to.shape[1]))
                parts.append(1 + k * (PARTS + 1) + to.reshape(-1))
            rows = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(rows)) for k in (0, 1)), pa.array(np.concatenate(parts))], ["c", "v", "leaf"])

    return run


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with that of y, in double precision, the same whatever stands beside them."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def _meet(dim: int, k: int):
    """A block of vectors and one of queries of a part (c, v, low, side) -> (q, c, low, score): the k best of the block for each query, ties by the smallest id."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        side = t.column("side").to_numpy()
        at, asked = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out: list[list] = [[], [], [], []]
        if len(at) and len(asked):
            c, low = t.column("c").to_numpy(), t.column("low").to_numpy()
            x, u = _units(t.column("v").chunk(0), dim)
            for s in range(0, len(asked), 256):
                q = asked[s : s + 256]
                near = u[q] @ u[at].T
                least = np.partition(near, len(at) - k, axis=1)[:, len(at) - k, None] - 1e-9 if len(at) > k else -np.inf
                i, j = np.nonzero(near >= least)
                score = cosines(x[q[i]], x[at[j]])
                order = np.lexsort((low[at[j]], -score, i))
                i, j, score = i[order], j[order], score[order]
                first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                keep = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < k
                for o, v in zip(out, (c[q[i]], c[at[j]], low[at[j]], score), strict=True):
                    o.append(v[keep])
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"q": pa.array(cols[0], pa.int64()), "c": pa.array(cols[1], pa.int64()), "low": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    return run


def _leaves(index: DataFrame, asked: DataFrame, dim: int, sample: int, size: int, parts: int, leaf: int, levels: int, target: float) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Classes and query classes (c, v) in the leaves of a tree of routers: (c, v, leaf) both, queries in several leaves."""
    spark, spare = index.sparkSession, []
    index, asked = index.withColumn("leaf", F.lit(0).cast("long")), asked.withColumn("leaf", F.lit(0).cast("long"))
    for level in range(levels):
        sizes = {r["leaf"]: r["n"] for r in index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # (PARTS + 1) ** level rows at most
        sizes = {k: n for k, n in sizes.items() if n > (leaf if level else size)}
        if not sizes:
            break
        share = spark.createDataFrame([(k, sample / n) for k, n in sizes.items()], "leaf long, share double")
        part = F.pmod(F.xxhash64("v", F.lit(SEED + level)), F.lit(1 << 30)) / float(1 << 30)
        fitted = index.join(F.broadcast(share), "leaf").where(part < F.col("share")).select("leaf", "v")
        fitted = fitted.groupBy("leaf").applyInArrow(_fit(dim, sizes, size, parts, target), "leaf long, router binary")
        routers = {r["leaf"]: pickle.loads(r["router"]) for r in fitted.collect()}  # of a bounded number and size
        index = cut(index.select("c", "v", "leaf").mapInArrow(_route(dim, routers, False), "c long, v array<float>, leaf long"), "partitions-index")
        asked = cut(asked.select("c", "v", "leaf").mapInArrow(_route(dim, routers, True), "c long, v array<float>, leaf long"), "partitions-asked")
        spare += [index, asked]
    return index, asked, spare


def nearest(vectors: DataFrame, is_query, k: int = 5, sample: int = SAMPLE, size: int = SIZE, parts: int = PARTS, leaf: int = LEAF, levels: int = LEVELS, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row of ``vectors`` (vec_id, embedding) for which the condition ``is_query`` of vec_id holds, the ``k`` nearest found among all other rows, by cosine in double precision.

    Ties go to the smaller vec_id; with fewer candidates found, all of them.  A vector that is null, empty, zero or holds a null or a non-finite component takes no part, nor does a row with a null vec_id or a vector of
    another length than that of the smallest vec_id that takes part.  Repeated rows of an id are one.  Vectors that are equal number by number are one class (by 128 bits), found together: a class gives its k + 1 smallest ids, as
    no more can be among the k nearest of a query.  A router is fitted on about ``sample`` classes, those of the smallest hashes; every row is indexed.  A very long vector is one row; columns but
    these two play no part.  An empty table gives no rows."""
    v = vectors["embedding"]
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(vectors["vec_id"].isNotNull() & v.isNotNull() & finite & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: (x + F.lit(0)).cast("float")).alias("v")).dropDuplicates(["vec_id", "v"])
    first = rows.orderBy("vec_id", "v").limit(1).collect()
    out_kind = "query_id long, rank int, vec_id long, score double"
    if not first:
        return vectors.sparkSession.createDataFrame([], out_kind)
    dim = len(first[0]["v"])
    rows = rows.where(F.size("v") == dim).withColumn("d", F.md5(F.to_json(F.struct("v")).cast("binary")))
    low = rows.groupBy("d").agg(F.min("vec_id").alias("low"), F.first("v").alias("v"))
    classes = cut(low.select("d", "low", "v", F.monotonically_increasing_id().alias("c")), "partitions-classes")
    members = cut(rows.select("d", "vec_id").join(classes.select("d", "c"), "d").select("c", "vec_id"), "partitions-members")
    smallest = members.withColumn("n", F.row_number().over(Window.partitionBy("c").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    smallest = smallest.groupBy("c").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # k + 1 at most
    asked_rows = members.where(is_query(F.col("vec_id"))).select("c", F.col("vec_id").alias("query_id"))
    asked = classes.join(asked_rows.select("c").distinct(), "c", "left_semi").select("c", "v")
    index, asked, spare = _leaves(classes.select("c", "v"), asked, dim, sample, size, parts, leaf, levels, target)
    blocks = index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("nb"))
    turns = asked.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("nq"))
    plan = F.broadcast(blocks.join(turns, "leaf"))  # a row for each leaf, (PARTS + 1) ** LEVELS at most
    own = lambda n: F.pmod(F.xxhash64("c", F.lit(SEED)), F.col(n)).cast("int")
    left = index.join(classes.select("c", "low"), "c").join(plan, "leaf").select("leaf", own("nb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"), "c", "v", "low", F.lit(0).alias("side"))
    right = asked.join(plan, "leaf").select("leaf", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("i"), own("nq").alias("j"), "c", "v", F.lit(0).cast("long").alias("low"), F.lit(1).alias("side"))
    found = left.unionByName(right).groupBy("leaf", "i", "j").applyInArrow(_meet(dim, k + 1), "q long, c long, low long, score double")
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "low")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).join(smallest, "c").select("q", "score", F.explode("ids").alias("vec_id"))
    best = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id")))  # (k + 1) ** 2 at most
    lists = found.groupBy(F.col("q").alias("c")).agg(best.alias("best"))
    other = F.slice(F.filter("best", lambda r: r["vec_id"] != F.col("query_id")), 1, k)
    out = asked_rows.distinct().join(lists, "c").select("query_id", F.posexplode(other).alias("rank", "r"))
    out = cut(out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("r.vec_id").alias("vec_id"), (-F.col("r.far")).alias("score")), "partitions-out")
    for x in (*spare, classes, members):
        drop_cut(x)
    return out


def op11_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found for each row of embeddings whose vec_id 50 divides, among all other rows."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)
