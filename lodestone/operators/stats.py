"""Statistics of paired conditions: ranks, correlations, paired tests, multiple testing, resampling and decision rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_average_rank(df: DataFrame, value: str, *by: str, name: str = "r", parts: int = 64) -> DataFrame:
    """Adds the rank of ``value`` from 1 within each group, ties sharing the mean of their places, and ``same``, the size of the tie.

    A group may hold a large part of all rows, so it isn't ranked in one window: different values are counted first, approximate quantiles cut each group into ``parts``
    ranges, a range is numbered in a window of its own, and the sizes of the ranges before it are added.  Any cuts give the same ranks."""
    n = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("same"))
    cuts = n.groupBy(*by).agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(1000)).alias("cuts"))
    x = n.join(cuts, list(by)).select(*by, value, "same", F.size(F.filter("cuts", lambda c: c < F.col(value))).alias("part"))
    size = x.groupBy(*by, "part").agg(F.sum("same").alias("size"))
    size = size.select(*by, "part", F.coalesce(F.sum("size").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("same").over(Window.partitionBy(*by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = x.withColumn("inside", F.coalesce(inside, F.lit(0))).join(size, [*by, "part"])
    ranks = ranks.select(*by, value, "same", (F.col("before") + F.col("inside") + (F.col("same") + 1) / 2.0).alias(name))
    return df.join(ranks, [*by, value])


def spearman(df: DataFrame, x: str, y: str, *by: str) -> DataFrame:
    """(by..., n, rho): Pearson's correlation of average ranks over rows where both are there; null where one is constant."""
    r = with_average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), x, *by, name="rx").drop("same")
    r = with_average_rank(r, y, *by, name="ry").drop("same")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")  # corr() itself fails on a constant column in ANSI mode
    return r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("rx", "ry"), spread).alias("rho"))


def column_pairs(long: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """(key, a, b, d): differences of all pairs of columns, a before b, of a long table."""
    x = long.select(key, F.col(column).alias("a"), F.col(value).alias("x"))
    y = long.select(key, F.col(column).alias("b"), F.col(value).alias("y"))
    return x.join(y, key).where("a < b").select(key, "a", "b", (F.col("x") - F.col("y")).alias("d"))


def signed_ranks(diffs: DataFrame) -> DataFrame:
    """(a, b, n, up, down, ties): numbers and rank sums of positive and negative differences, zeros dropped; ties is the sum of t**3 - t over groups of t equal sizes."""
    r = diffs.where("d <> 0").withColumn("m", F.abs("d"))
    r = with_average_rank(r, "m", "a", "b")
    return r.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("same") * F.col("same") - 1).alias("ties"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"))


def holm(df: DataFrame, p: str, *by: str, tie: str) -> DataFrame:
    """Adds holm: the running maximum of min(1, (m - rank) * p) in order of p, within each family."""
    w = Window.partitionBy(*by)
    order = w.orderBy(p, tie)
    step = F.least(F.lit(1.0), (F.count(F.lit(1)).over(w) - F.row_number().over(order) + 1) * F.col(p))
    return df.withColumn("step", step).withColumn("holm", F.max("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def hamilton(df: DataFrame, share: Column, total: int, tie: str) -> DataFrame:
    """Adds quota: whole parts of share * total, and one more for the largest remainders."""
    x = df.withColumn("exact", share * total).withColumn("floor", F.floor("exact"))
    left = F.lit(total) - F.sum("floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy((F.round(F.col("exact") - F.col("floor"), 9)).desc(), tie))
    return x.withColumn("quota", (F.col("floor") + F.when(place <= left, 1).otherwise(0)).cast("long")).drop("exact", "floor")


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|), by the continued fraction of the regularised incomplete beta function."""
    from math import exp, lgamma, log

    x, a, b = df / (df + t * t), df / 2, 0.5
    if x in (0.0, 1.0):
        return x

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
        out = d
        for m in range(1, 400):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + k * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + k / (c if abs(c) > tiny else tiny)
                out *= c * d
            if abs(c * d - 1) < 1e-15:
                break
        return out

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def wilcoxon_two_sided(w: float, n: int, ties: float) -> float:
    """P of a rank sum as small as ``w`` (the smaller one) or smaller, doubled: exact up to 50 differences without ties, else by the normal limit with the ties' variance taken off."""
    from math import erfc, sqrt

    if n == 0:
        return 1.0
    if n <= 50 and ties == 0:
        ways = [1]
        for k in range(1, n + 1):
            longer = ways + [0] * k
            for s, x in enumerate(ways):
                longer[s + k] += x
            ways = longer
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    z = (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
    return min(1.0, erfc(abs(z) / sqrt(2)))


def tournament(df: DataFrame, group: str, tolerance: float = 0.01, ties: tuple[tuple[str, int], ...] = (("m2", 1),)) -> DataFrame:
    """(group, name, place, decided_by) of entrants (group, name, m1, and the columns of ``ties``): repeatedly the largest m1; entrants within the tolerance of it tie, and the criteria
    of ``ties`` (column, 1 for the largest or -1 for the least; null loses) leave fewer and fewer, at last the name.  Each removal changes who ties, so groups are worked
    off one by one, in Python; a group is a handful of rows."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, out = pdf.to_dict("records"), []
        while left:
            best = max(r["m1"] for r in left)
            tied, by = [r for r in left if best - r["m1"] <= tolerance + 1e-9], "m1"
            for column, sign in ties:
                if len(tied) == 1:
                    break
                worth = [float("-inf") if pd.isna(r[column]) else sign * r[column] for r in tied]
                tied, by = [r for r, x in zip(tied, worth, strict=True) if x >= max(worth) - 1e-9], column
            pick, by = min(tied, key=lambda r: r["name"]), by if len(tied) == 1 else "name"
            out.append((pick[group], pick["name"], len(out) + 1, by))
            left.remove(pick)
        return pd.DataFrame(out, columns=[group, "name", "place", "decided_by"])

    kind = dict(df.dtypes)[group]
    return df.select(group, "name", "m1", *[c for c, _ in ties]).groupBy(group).applyInPandas(run, f"{group} {kind}, name string, place int, decided_by string")
