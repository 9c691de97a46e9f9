"""One-to-one matching of multisets, and what is counted from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import held


def match_passes(gold: DataFrame, found: DataFrame, group: list[str], passes: list[list[str]], order: list[str]) -> DataFrame:
    """(group..., gid, fid, pass): pairs of a gold and a found element, each used once.

    In each pass elements of equal keys are paired by their place in ``order``; what is left goes on to the next pass.  Pairing the n-th with the n-th equals the
    greedy choice of the first free partner, so no loop over rows is needed.  Both sides grow with the input, so they meet by a shuffle: a side that is sent to all tasks goes through the driver."""
    out = None
    left_g, left_f = gold, found
    for number, keys in enumerate(passes, 1):
        by = [*group, *keys]
        n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        a = left_g.withColumn("n", n).select(*by, "n", F.col("id").alias("gid"))
        b = left_f.withColumn("n", n).select(*by, "n", F.col("id").alias("fid"))
        pairs = a.join(b.hint("merge"), [*by, "n"]).select(*group, "gid", "fid", F.lit(number).alias("pass"))
        out = pairs if out is None else out.unionByName(pairs)
        if number < len(passes):
            left_g = left_g.join(pairs.select(*group, F.col("gid").alias("id")).hint("merge"), [*group, "id"], "left_anti")
            left_f = left_f.join(pairs.select(*group, F.col("fid").alias("id")).hint("merge"), [*group, "id"], "left_anti")
    return out


def mates(rows: DataFrame, gold: str, group: list[str], passes: list[list[str]], order: list[str]) -> DataFrame:
    """``rows`` of both sides (``gold`` tells them apart) with pass and mate, the row that each is paired with as ``match_passes`` pairs them, or null.

    All windows lie within ``group``, so rows are shuffled once by it and nothing is joined back.  Rows with a null key have no mate in that pass."""
    own = F.struct(*rows.columns)
    out = rows.withColumns({"pass": F.lit(None).cast("int"), "mate": F.when(F.lit(False), own)})
    kept = out.columns
    for number, keys in enumerate(passes, 1):
        by = [*group, *keys]
        some = F.lit(True)
        for k in by:
            some = some & F.col(k).isNotNull()
        out = out.withColumn("free", F.col("pass").isNull() & some)
        out = out.withColumn("n", F.row_number().over(Window.partitionBy(*by, gold, "free").orderBy(*order)))
        side = lambda wanted: F.max(F.when(F.col(gold) if wanted else ~F.col(gold), own)).over(Window.partitionBy(*by, "n", "free"))  # noqa: E731, B023  # one row of each side
        out = out.withColumns({"one": side(True), "two": side(False)}).withColumn("met", F.col("free") & F.col("one").isNotNull() & F.col("two").isNotNull())
        out = out.withColumns({"pass": F.when(F.col("met"), number).otherwise(F.col("pass")), "mate": F.when(F.col("met"), F.when(F.col(gold), F.col("two")).otherwise(F.col("one"))).otherwise(F.col("mate"))}).select(*kept)
    return out


def key_counts(gold: DataFrame, found: DataFrame, group: list[str], key: list[str]) -> DataFrame:
    """(group..., tp, fp, fn) of two multisets of keys."""
    side = lambda df, g, f: df.select(*group, *key, F.lit(g).alias("g"), F.lit(f).alias("f"))
    n = side(gold, 1, 0).unionByName(side(found, 0, 1)).groupBy(*group, *key).agg(F.sum("g").alias("g"), F.sum("f").alias("f"))
    tp = F.least("g", "f")
    return n.groupBy(*group).agg(F.sum(tp).alias("tp"), F.sum(F.col("f") - tp).alias("fp"), F.sum(F.col("g") - tp).alias("fn"))


STRUCTURAL = ("ClassBidirectional", "ClassUnidirectional", "ClassComposition", "ClassAggregation", "ClassDependency")
GENERAL = ("ClassInheritance", "ClassRealization")


def compare_elements(classes: tuple[DataFrame, DataFrame], attributes: tuple[DataFrame, DataFrame], edges: tuple[DataFrame, DataFrame], tokens) -> DataFrame:
    """(ex, level, kind, tp, fp, fn) of gold and found diagrams, each argument a pair (gold, found).

    ``classes``: (ex, id, name); ``attributes``: (ex, cid, id, name); ``edges``: (ex, id, src, tgt, typ).  Names match if equal in letters and digits, and on the level ``relaxed`` then
    by equal sets of ``tokens`` (a column function).  Attributes match inside matched classes, relations by their unordered pair of matched classes (the same type first), and
    generalisations by child and parent.  Names without a letter or digit never match."""
    bare = F.regexp_replace(F.lower("name"), "[^0-9a-z]", "")
    keyed = lambda df: df.withColumns({"norm": bare, "toks": tokens(F.col("name"))})
    order, passes = ["norm", "name", "id"], {"exact": [["norm"]], "relaxed": [["norm"], ["toks"]]}
    (gc, fc), (ga, fa) = map(keyed, classes), map(keyed, attributes)
    out = None

    def counted(level, kind, tp, gold, found):
        n = lambda df, c: df.select("ex", *[F.lit(int(c == k)).alias(k) for k in ("tp", "g", "f")])
        every = n(tp, "tp").unionByName(n(gold, "g")).unionByName(n(found, "f")).groupBy("ex").agg(F.sum("tp").alias("tp"), F.sum("g").alias("g"), F.sum("f").alias("f"))
        return every.select("ex", F.lit(level).alias("level"), F.lit(kind).alias("kind"), "tp", (F.col("f") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))

    for level, keys in passes.items():
        some = lambda df: df.where("norm <> ''")
        mapped = match_passes(some(gc), some(fc), ["ex"], keys, order).select("ex", "gid", "fid")
        owner = mapped.select("ex", F.col("gid").alias("cid"), F.col("fid").alias("own"))
        mine = some(fa).withColumnRenamed("cid", "own").join(owner.hint("merge"), ["ex", "own"]).drop("own")
        pairs = match_passes(some(ga).join(owner.select("ex", "cid").hint("merge"), ["ex", "cid"]), mine, ["ex", "cid"], keys, order)
        end = lambda e, c, n: e.join(mapped.select("ex", F.col("fid").alias(c), F.col("gid").alias(n)).hint("merge"), ["ex", c], "left")  # noqa: E731, B023
        found = end(end(edges[1], "src", "a"), "tgt", "b")
        both = lambda df, a, b: df.withColumns({"x": F.least(a, b), "y": F.greatest(a, b)})
        gold_r, found_r = both(edges[0].where(F.col("typ").isin(*STRUCTURAL)), F.col("src"), F.col("tgt")), found.where(F.col("typ").isin(*STRUCTURAL))
        linked = match_passes(gold_r, both(found_r.where("a is not null and b is not null"), F.col("a"), F.col("b")), ["ex"], [["x", "y", "typ"], ["x", "y"]], ["id"])
        gold_g, found_g = edges[0].where(F.col("typ").isin(*GENERAL)), found.where(F.col("typ").isin(*GENERAL))
        up = match_passes(gold_g.select("ex", "id", F.col("src").alias("a"), F.col("tgt").alias("b")), found_g.where("a is not null and b is not null").select("ex", "id", "a", "b"), ["ex"], [["a", "b"]], ["id"])
        for kind, tp, gold, made in (("classes", mapped, gc, fc), ("attributes", pairs, ga.where("norm <> ''"), fa.where("norm <> ''")), ("relations", linked, gold_r, found_r), ("generalizations", up, gold_g, found_g)):
            part = counted(level, kind, tp, gold, made)
            out = part if out is None else out.unionByName(part)
    return out


def ratio(a: Column, b: Column) -> Column:
    """Null where the denominator is 0."""
    return F.when(b != 0, a / b)


def precision(tp="tp", fp="fp") -> Column:
    return ratio(F.col(tp), F.col(tp) + F.col(fp))


def recall(tp="tp", fn="fn") -> Column:
    return ratio(F.col(tp), F.col(tp) + F.col(fn))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """2tp / (2tp + fp + fn): 0 if nothing matches but something is there, null if nothing is there at all."""
    return ratio(2 * F.col(tp), 2 * F.col(tp) + F.col(fp) + F.col(fn))


def components(edges: DataFrame) -> DataFrame:
    """(x, c): for each vertex of ``edges`` (u, v) the smallest vertex that it reaches.  Every vertex takes the smallest label around it, then its label's label, until nothing changes; each round is written."""
    both = held(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels, seen = held(both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.min("u")).alias("c"))), None
    while True:
        state = labels.agg(F.sum(F.xxhash64("x", "c").cast("decimal(20,0)"))).first()[0]
        if state == seen:
            return labels
        seen = state
        around = both.join(labels.select(F.col("x").alias("v"), "c"), "v").groupBy(F.col("u").alias("x")).agg(F.min("c").alias("near"))
        closer = held(labels.join(around, "x").select("x", F.least("c", "near").alias("c")))
        jump = closer.select(F.col("x").alias("c"), F.col("c").alias("far"))
        labels = held(closer.join(jump, "c").select("x", F.least("c", "far").alias("c")))


def transport(cost, supply, demand):
    """Flow (rows by columns, whole numbers) of least total cost that sends at most ``supply`` of each row and ``demand`` to each column; pairs of infinite cost take none.

    Shortest augmenting paths with potentials, as much as fits along each.  What isn't worth sending goes to a column of no cost and no limit that isn't returned."""
    import numpy as np

    rows, cols = cost.shape
    cost = np.concatenate([cost, np.zeros((rows, 1))], axis=1)
    room = np.append(np.asarray(demand, np.int64), np.iinfo(np.int64).max)
    flow, u, v = np.zeros((rows, cols + 1), np.int64), np.zeros(rows), np.zeros(cols + 1)
    for i in range(rows):
        left = int(supply[i])
        u[i] = (cost[i] - v).min()
        while left:
            dist, origin, done = cost[i] - u[i] - v, np.full(cols + 1, i), np.zeros(cols + 1, bool)
            at, came, j = {i: 0.0}, {}, -1
            while j < 0 or not room[j]:
                j = int(np.where(done, np.inf, dist).argmin())
                done[j] = True
                if not room[j]:
                    for r in np.flatnonzero(flow[:, j]).tolist():
                        if r not in at:
                            at[r], came[r] = dist[j], j
                            step = dist[j] + np.maximum(cost[r] - u[r] - v, 0)
                            better = ~done & (step < dist)
                            dist[better], origin[better] = step[better], r
            v[done] -= dist[j] - dist[done]
            for r, x in at.items():
                u[r] += dist[j] - x
            path, c = [], j
            while True:
                r = int(origin[c])
                path.append((r, c))
                if r == i:
                    break
                c = came[r]
            much = min(left, int(room[j]), *[int(flow[r, came[r]]) for r, _ in path[:-1]])
            for r, c in path:
                flow[r, c] += much
                if r != i:
                    flow[r, came[r]] -= much
            room[j] -= much
            left -= much
    return flow[:, :cols]


def assign_kinds(left: DataFrame, right: DataFrame, pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """(group, a, b, w): the assignment of largest total weight among pairs of at least ``threshold`` of elements ``left`` (group, a, ka) and ``right`` (group, b, kb), whose weights are those of their kinds, ``pairs`` (group, ka, kb, w).

    Elements of a kind are alike, so only how many of one kind go to each other is to be solved: pairs of kinds under the threshold join nothing, and each connected component of the others is a transport
    problem, solved in one task over its kinds.  Elements are then numbered within their kinds and meet by their places, so no pair is made that isn't returned."""
    import numpy as np
    import pandas as pd

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        (i, ka), (j, kb) = (pd.factorize(pdf[c], sort=True) for c in ("ka", "kb"))
        cost, supply, demand = np.full((len(ka), len(kb)), np.inf), np.zeros(len(ka), np.int64), np.zeros(len(kb), np.int64)
        cost[i, j], supply[i], demand[j] = -pdf["w"], pdf["na"], pdf["nb"]
        pdf["n"] = transport(cost, supply, demand)[i, j]
        return pdf.loc[pdf["n"] > 0, [group, "ka", "kb", "w", "n"]]

    def numbered(df: DataFrame, x: str) -> tuple[DataFrame, DataFrame]:
        """(elements with their places from 0 in their kind, sizes of kinds).  A kind is numbered in 64 parts."""
        kind = [group, f"k{x}"]
        df = df.withColumn("part", F.pmod(F.xxhash64(x), F.lit(64)))
        size = df.groupBy(*kind, "part").agg(F.count(F.lit(1)).alias("n"))
        before = size.withColumn("before", F.sum("n").over(Window.partitionBy(*kind).orderBy("part")) - F.col("n")).drop("n")
        place = F.row_number().over(Window.partitionBy(*kind, "part").orderBy(x)) - 1
        return df.withColumn("place", place).join(before, [*kind, "part"]).withColumn("place", F.col("place") + F.col("before")).drop("part", "before"), size.groupBy(*kind).agg(F.sum("n").alias(f"n{x}"))

    (a, na), (b, nb) = numbered(left, "a"), numbered(right, "b")
    kept = held(pairs.where(F.col("w") >= threshold).join(na, [group, "ka"]).join(nb, [group, "kb"]).select(group, "ka", "kb", F.col("w").cast("double").alias("w"), "na", "nb"))
    name = lambda side: F.to_json(F.struct(F.lit(side).alias("s"), F.col(group).alias("g"), F.col(f"k{side}").alias("i")))
    of = components(kept.select(name("a").alias("u"), name("b").alias("v")))
    kinds = dict(kept.dtypes)
    flow = kept.withColumn("x", name("a")).join(of, "x").drop("x").groupBy("c").applyInPandas(solve, f"{group} {kinds[group]}, ka {kinds['ka']}, kb {kinds['kb']}, w double, n long")
    start = lambda x, o: F.sum("n").over(Window.partitionBy(group, f"k{x}").orderBy(f"k{o}")) - F.col("n")
    flow = held(flow.withColumns({"start_a": start("a", "b"), "start_b": start("b", "a")}))

    def placed(df: DataFrame, x: str) -> DataFrame:
        mine = df.join(flow.select(group, "ka", "kb", "w", "n", F.col(f"start_{x}").alias("start")), [group, f"k{x}"]).where("place >= start and place < start + n")
        return mine.select(group, "ka", "kb", (F.col("place") - F.col("start")).alias("at"), x, *["w"] * (x == "a"))

    return placed(a, "a").join(placed(b, "b"), [group, "ka", "kb", "at"]).select(group, "a", "b", "w")


def assign(pairs: DataFrame, group: str, threshold: float) -> DataFrame:
    """``assign_kinds`` of elements that are a kind each, from their pairs (group, a, b, w) alone."""
    kept = held(pairs.where(F.col("w") >= threshold).select(group, "a", "b", "w"))
    side = lambda x: kept.select(group, x, F.col(x).alias(f"k{x}")).distinct()
    return assign_kinds(side("a"), side("b"), kept.select(group, F.col("a").alias("ka"), F.col("b").alias("kb"), "w"), group, threshold)
