"""Exact quantiles by distributed selection, and bootstrap by weights.

No group's values ever meet: a place in the order of a large group is bracketed by counts.  Each pass deals the values of a bracket into BINS of equal width, added up in the tasks, and goes on with the
bin that holds the place; the bin's own least and largest value are the next bracket.  When FETCH values or one value are left they are fetched.  A group of FETCH values at most is sorted at once.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import held

FETCH, BINS = 4096, 1024


def _place(n: Column, p: float) -> Column:
    return (n - 1) * F.lit(float(p))


def _between(a: Column, b: Column, at: Column) -> Column:
    """a and b are the values at the places around ``at``."""
    return a + (b - a) * (at - F.floor(at))


def quantiles(df: DataFrame, by: list[str], value: str, probs: list[float], fetch: int = FETCH, bins: int = BINS) -> DataFrame:
    """(by..., n, q): exact quantiles of each group at ``probs`` with linear interpolation, as an array; null and NaN values are left out, and groups of nothing else."""
    rows = df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    groups = held(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    many = groups.where(F.col("n") > fetch)
    few = rows.join(many.select(*by), by, "left_anti").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("v")).alias("s"))  # ``fetch`` values at most
    at = lambda s, k: F.get(s, k.cast("int"))
    pick = lambda s, n, p: _between(at(s, F.floor(_place(n, p))), at(s, F.ceil(_place(n, p))), _place(n, p))
    few = few.select(*by, "n", F.array(*[pick(F.col("s"), F.col("n"), p) for p in probs]).alias("q"))
    if many.isEmpty():
        return few
    places = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(_place(F.col("n"), p)), F.ceil(_place(F.col("n"), p))) for p in probs])))
    open_ = many.select(*by, "lo", "hi", F.lit(0).cast("long").alias("before"), F.col("n").alias("m"), F.explode(places).alias("k"))
    done = None
    while True:
        ready = (F.col("m") <= fetch) | (F.col("lo") == F.col("hi"))
        ended = open_.where(ready)
        done = ended if done is None else done.unionByName(ended)
        open_ = open_.where(~ready)
        if open_.isEmpty():
            break
        # a bin that is no wider than rounding is the bracket's first or last, so each pass parts lo from hi
        width = F.greatest(F.col("b.hi") / 2 - F.col("b.lo") / 2, F.lit(5e-324))
        bin_ = F.when(F.col("v") >= F.col("b.hi"), bins - 1).otherwise(F.least(F.floor((F.col("v") / 2 - F.col("b.lo") / 2) / width * bins).cast("int"), F.lit(bins - 2)))
        counts = _inside(rows, open_, by).groupBy(*by, F.col("b.k").alias("k"), F.col("b.before").alias("before"), bin_.alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        run = F.sum("m").over(Window.partitionBy(*by, "k").orderBy("bin"))  # ``bins`` rows
        counts = counts.withColumn("upto", F.col("before") + run)
        open_ = held(counts.where((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("m") <= F.col("k"))).select(*by, "lo", "hi", (F.col("upto") - F.col("m")).alias("before"), "m", "k"))
    done = held(done)
    got = _inside(rows, done.where("lo < hi"), by).groupBy(*by, F.col("b.k").alias("k"), F.col("b.before").alias("before")).agg(F.array_sort(F.collect_list("v")).alias("s"))  # ``fetch`` values at most
    found = got.select(*by, "k", at(F.col("s"), F.col("k") - F.col("before")).alias("x")).unionByName(done.where("lo = hi").select(*by, "k", F.col("lo").alias("x")))
    values = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("k", "x"))).alias("x"))
    of = lambda k: F.element_at("x", k.cast("long"))
    large = many.join(values, by).select(*by, "n", F.array(*[_between(of(F.floor(_place(F.col("n"), p))), of(F.ceil(_place(F.col("n"), p))), _place(F.col("n"), p)) for p in probs]).alias("q"))
    return few.unionByName(large)


def _inside(rows: DataFrame, brackets: DataFrame, by: list[str]) -> DataFrame:
    """(by..., v, b) for each value and each bracket of its group that holds it."""
    own = brackets.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "before", "k")).alias("bs"))  # two for each quantile at most
    both = rows.join(own, by)
    return both.select(*by, "v", F.explode(F.filter("bs", lambda b: (F.col("v") >= b["lo"]) & (F.col("v") <= b["hi"]))).alias("b"))


#: 16-bit limits of Poisson counts with mean 1: a draw is as many as there are limits at or under it.
LIMITS = [math.floor(65536 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(8)]


def bootstrap_means(df: DataFrame, by: str, name: str, value: str, replicates: int = 1000, seed: int = 0) -> DataFrame:
    """(by, k, m): the mean of each group in each replicate, where a value counts as often as a Poisson draw with mean 1 says.

    Draws are 16-bit pieces of SHA-256 of seed, group, name and block, so a replicate is the same whatever the partitions.  A task adds up weights and weighted values: a row for each group and replicate leaves it."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        blocks, sums = -(-replicates // 16), {}
        for b in batches:
            for c, u, v in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                raw = b"".join(hashlib.sha256(f"{seed}/{c}/{u}/{i}".encode()).digest() for i in range(blocks))
                w = np.searchsorted(LIMITS, np.frombuffer(raw, ">u2")[:replicates], "right")
                own = sums.setdefault(c, np.zeros((2, replicates)))
                own[0] += w * v
                own[1] += w
        for c, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * replicates), pa.array(range(replicates), pa.int32()), pa.array(own[0]), pa.array(own[1])], [by, "k", "s", "w"])

    rows = df.where(F.col(value).isNotNull()).select(by, name, F.col(value).cast("double"))
    added = rows.mapInArrow(run, f"{by} {dict(df.dtypes)[by]}, k int, s double, w double").groupBy(by, "k").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return added.select(by, "k", F.try_divide("s", "w").alias("m"))
