"""Exact nearest vectors by an index of pivots: what the triangle inequality rules out isn't compared."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import retrieval as R

PIVOTS = 64
SLACK = 1e-6


def _arccos(s):
    import numpy as np

    return np.arccos(np.clip(s, -1, 1))


# Distances that obey the triangle inequality, of the similarities of ``retrieval.MEASURES``.
DISTANCE = {"cosine": _arccos, "profile": lambda s: 1 - s}


def _stacked(column):
    """(length of each vector, -1 for null ones; a function from rows of one length to their matrix)."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array([-1 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    return sizes, lambda rows, d: np.array(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)


def _distances(x, y, measure: str):
    """Of all rows of both; nan where there is no similarity."""
    import numpy as np

    with np.errstate(all="ignore"):
        s = R.MEASURES[measure](x, y)
    return DISTANCE[measure](np.where(np.isfinite(s), s, np.nan))


@dataclass
class Index:
    """``rows`` (id, v, g, r): vectors by their nearest pivot g and the distance r to it, in ranges of (g, r), in the shared folder.  ``groups``: g -> (number of rows, least r, largest r).
    ``pivots``: the vectors of the pivots, their number is a parameter."""

    rows: DataFrame
    groups: dict[int, tuple[int, float, float]]
    pivots: list
    measure: str


def index(vectors: DataFrame, measure: str = "cosine", pivots: int = PIVOTS) -> Index:
    """Of vectors (id, v).  Pivots are those with the least hashes of their ids, so they follow the density of the data.

    Vectors that are null, zero (for cosines) or not finite are left out, as they have no similarity.  Vectors of a length that no pivot has make a group -1, which is never skipped.  Every vector is
    compared with ``pivots`` others and shuffled once; a group with most of the rows lies in many partitions."""
    import numpy as np

    spark = vectors.sparkSession
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)))
    if measure == "cosine":
        rows = rows.where(F.exists("v", lambda x: x != 0))
    chosen = [np.array(r.v) for r in rows.where(F.size("v") > 0).orderBy(F.xxhash64("id"), "id").limit(pivots).select("v").collect()]  # a fixed number
    sent = spark.sparkContext.broadcast(chosen)

    def assign(batches):
        import pyarrow as pa

        by_length = {d: [k for k, p in enumerate(sent.value) if len(p) == d] for d in {len(p) for p in sent.value}}
        for b in batches:
            sizes, matrix = _stacked(b.column(1))
            g, r = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for d, ks in by_length.items():
                at = np.flatnonzero(sizes == d)
                if len(at):
                    far = _distances(matrix(at, d), np.stack([sent.value[k] for k in ks]), measure)
                    far = np.where(np.isnan(far), np.inf, far)
                    near = far.argmin(1)
                    least = far[np.arange(len(at)), near]
                    ok = np.isfinite(least)
                    g[at[ok]], r[at[ok]] = np.array(ks)[near[ok]], least[ok]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(g), pa.array(r)], ["id", "v", "g", "r"])

    made = rows.mapInArrow(assign, "id long, v array<double>, g int, r double")
    kept = R.held(made.repartitionByRange(F.col("g"), F.col("r")).sortWithinPartitions("g", "r"))
    groups = {r.g: (r.n, r.lo, r.hi) for r in kept.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}  # a row for each pivot
    return Index(kept, groups, chosen, measure)


def first_groups(ix: Index, far, k: int):
    """For each query (a row of ``far``: distances to the pivots, nan where lengths differ) the nearest groups that have more than ``k`` vectors together."""
    import numpy as np

    n = np.array([ix.groups.get(g, (0,))[0] for g in range(len(ix.pivots))])
    order = np.argsort(np.where(np.isnan(far), np.inf, far), axis=1, kind="stable")
    held = np.cumsum(n[order], axis=1) - n[order]
    mask = np.zeros(far.shape, bool)
    np.put_along_axis(mask, order, held <= k, axis=1)
    return mask & ~np.isnan(far)


def reachable(ix: Index, far, bound):
    """For each query the groups that may hold a vector at most ``bound`` from it: all others are further by the triangle inequality."""
    import numpy as np

    lo, hi = (np.array([ix.groups.get(g, (0, np.inf, -np.inf))[s] for g in range(len(ix.pivots))]) for s in (1, 2))
    with np.errstate(invalid="ignore"):
        return np.maximum(far - hi, lo - far) <= bound[:, None] + SLACK


def _pass(ix: Index, qs, y, far, mask, bound, k: int, rest: bool, own: bool, digits: int) -> DataFrame:
    """(q, id, score) of the groups in ``mask``, and of group -1 with ``rest``, the ``k`` best of each group in a batch."""
    import numpy as np

    sent = ix.rows.sparkSession.sparkContext.broadcast((qs, y, far, mask, bound))
    measure = ix.measure

    def run(batches):
        import pyarrow as pa

        qs, y, far, mask, bound = sent.value
        for b in batches:
            ids, g, r = (b.column(i).to_numpy() for i in (0, 2, 3))
            sizes, matrix = _stacked(b.column(1))
            out = []
            for group in np.unique(g):
                who = np.flatnonzero(mask[:, group]) if group >= 0 else np.arange(len(qs)) if rest else np.zeros(0, int)
                at = np.flatnonzero((g == group) & (sizes == y.shape[1]))
                if group >= 0 and len(who):  # of a group only the ring that some query can reach
                    at = at[(r[at] >= (far[who, group] - bound[who]).min() - SLACK) & (r[at] <= (far[who, group] + bound[who]).max() + SLACK)]
                if not len(who) or not len(at):
                    continue
                with np.errstate(all="ignore"):
                    s = R.MEASURES[measure](matrix(at, y.shape[1]), y[who])
                if not own:
                    s[ids[at][:, None] == qs[who][None, :]] = np.nan
                s = np.where(np.isfinite(s), s, -np.inf)
                low = -np.inf if len(at) <= k else np.partition(s, len(at) - k, axis=0)[len(at) - k] - 10.0**-digits
                i, j = np.nonzero((s >= low) & (s > -np.inf))
                found = (qs[who[j]], ids[at[i]], s[i, j])
                keep = R.first_of(*found, k, digits)
                out.append(tuple(c[keep] for c in found))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["q", "id", "score"])

    needed = [int(x) for x in np.flatnonzero(mask.any(0))] + [-1] * rest
    return ix.rows.where(F.col("g").isin(needed)).mapInArrow(run, "q long, id long, score double")


def nearest(queries: DataFrame, ix: Index, k: int, own: bool = False, digits: int = 6, seen: dict | None = None) -> DataFrame:
    """(q, id, score) as ``retrieval.nearest`` gives it with ``k``: exact.

    Queries (q, v) go in blocks of ``retrieval.QUERY_BYTES`` at most.  The groups around a query that hold more than k vectors give a bound; then the groups that the bound can't rule out are read.  ``seen``
    collects how many pairs of query and group there are and how many are read."""
    import numpy as np

    spark, P = queries.sparkSession, len(ix.pivots)
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n * (8 * (dim or 1) + 64 + 9 * P) / R.QUERY_BYTES))
    out = spark.createDataFrame([], "q long, id long, score double")
    for block in range(blocks):
        rows = [(r.q, np.array(r.v, np.float64)) for r in queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "v").collect() if r.v and None not in r.v]  # one block, of bounded size
        for d in sorted({len(v) for _, v in rows}):
            qs, y = np.array([q for q, v in rows if len(v) == d]), np.stack([v for _, v in rows if len(v) == d])
            far = np.full((len(qs), P), np.nan)
            same = [g for g, p in enumerate(ix.pivots) if len(p) == d]
            if same:
                far[:, same] = _distances(y, np.stack([ix.pivots[g] for g in same]), ix.measure)
            first = first_groups(ix, far, k)
            got = R.held(_pass(ix, qs, y, far, first, np.full(len(qs), np.inf), k, True, own, digits))
            at = {r.q: r.s for r in _kth(got, k).collect()}  # a row for each query of the block
            bound = np.array([DISTANCE[ix.measure](at[q] - 10.0**-digits) if q in at else np.inf for q in qs.tolist()])
            second = reachable(ix, far, bound) & ~first
            out = out.unionByName(got).unionByName(_pass(ix, qs, y, far, second, bound, k, False, own, digits))
            if seen is not None:
                seen["pairs"] = seen.get("pairs", 0) + len(qs) * len(ix.groups)
                seen["read"] = seen.get("read", 0) + int((first | second).sum()) + len(qs) * (-1 in ix.groups)
    return out


def _kth(scores: DataFrame, k: int) -> DataFrame:
    """(q, s): the k-th best score of each query that has as many."""
    ranked = R.rank(scores, k).where(F.col("rank") == k)
    return ranked.select("q", F.col("score").alias("s"))
