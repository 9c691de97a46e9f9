"""Queries of statistics and decision rules over a table of exercises and conditions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import selection
from ..operators import stats as S
from ..sources.tables import dimension, table
from .registry import query

T = "T AS (SELECT user_id u, event_type c, round(avg(value),6) s FROM events GROUP BY ALL)"
D = f"{T}, D AS (SELECT x.u, x.c a, y.c b, round(x.s-y.s,6) d FROM T x JOIN T y ON x.u=y.u AND x.c<y.c)"
RANKS = f"{D}, R AS (SELECT *, rank() OVER (PARTITION BY a,b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a,b,abs(d))-1)/2.0::DOUBLE r FROM D WHERE d<>0), W AS (SELECT a, b, count(*) n, sum(CASE WHEN d>0 THEN r ELSE 0 END) up, sum(CASE WHEN d<0 THEN r ELSE 0 END) down FROM R GROUP BY ALL)"
MEANS = f"{T}, G AS (SELECT c, round(avg(s),6) m, count(*) n FROM T GROUP BY 1)"


def scores(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("c")).agg(F.round(F.avg("value"), 6).alias("s"))


def diffs(spark, d):
    return S.column_pairs(scores(spark, d), "u", "c", "s").withColumn("d", F.round("d", 6))


def means(spark, d):
    return scores(spark, d).groupBy("c").agg(F.round(F.avg("s"), 6).alias("m"), F.count(F.lit(1)).alias("n"))


@query("latency_stats", "SELECT event_type, round(avg(value),4) mean, round(median(value),4) median, min(value) low, max(value) high, round(stddev_samp(value),4) sd FROM events GROUP BY 1")
def latency_stats(spark, d):
    v, e = F.col("value"), table(spark, d, "events")
    half = selection.quantiles(e, ["event_type"], "value", [0.5]).select("event_type", F.round(F.col("q")[0], 4).alias("median"))
    rest = e.groupBy("event_type").agg(F.round(F.avg(v), 4).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.stddev_samp(v), 4).alias("sd"))
    return rest.join(half, "event_type", "left").select("event_type", "mean", "median", "low", "high", "sd")


@query("describe5", "SELECT event_type, round(min(value),4) q0, round(quantile_cont(value,0.25),4) q1, round(quantile_cont(value,0.5),4) q2, round(quantile_cont(value,0.75),4) q3, round(max(value),4) q4 FROM events GROUP BY 1")
def describe5(spark, d):
    q = selection.quantiles(table(spark, d, "events"), ["event_type"], "value", [0, 0.25, 0.5, 0.75, 1])
    return q.select("event_type", *[F.round(F.col("q")[k], 4).alias(f"q{k}") for k in range(5)])


@query("tertile_bands", f"WITH {T}, q AS (SELECT c, quantile_cont(s,1.0/3) t1, quantile_cont(s,2.0/3) t2 FROM T GROUP BY 1) SELECT T.c, CASE WHEN s<round(t1,6) THEN 'low' WHEN s<round(t2,6) THEN 'mid' ELSE 'high' END band, count(*) n FROM T JOIN q ON q.c=T.c GROUP BY ALL")
def tertile_bands(spark, d):
    t = scores(spark, d)
    q = selection.quantiles(t, ["c"], "s", [1 / 3, 2 / 3]).select("c", F.col("q")[0].alias("t1"), F.col("q")[1].alias("t2"))
    band = F.when(F.col("s") < F.round("t1", 6), "low").when(F.col("s") < F.round("t2", 6), "mid").otherwise("high")
    return t.join(q, "c").groupBy("c", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("score_band", "SELECT c_custkey, CASE WHEN c_acctbal<1000 THEN 'low' WHEN c_acctbal<5000 THEN 'mid' ELSE 'high' END band FROM customer")
def score_band(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b < 1000, "low").when(b < 5000, "mid").otherwise("high").alias("band"))


@query("avg_rank", f"WITH {T} SELECT u, c, rank() OVER (PARTITION BY c ORDER BY round(s,0)) + (count(*) OVER (PARTITION BY c,round(s,0))-1)/2.0::DOUBLE r FROM T")
def avg_rank(spark, d):
    t = scores(spark, d).withColumn("k", F.round("s", 0))
    return S.with_average_rank(t.select("u", "c", "k"), "k", "c").select("u", "c", "r")


@query("spearman_rho", f"WITH {T}, P AS (SELECT x.c a, y.c b, x.s x, y.s y FROM T x JOIN T y ON x.u=y.u AND x.c<y.c), R AS (SELECT a, b, rank() OVER (PARTITION BY a,b ORDER BY x)+(count(*) OVER (PARTITION BY a,b,x)-1)/2.0::DOUBLE rx, rank() OVER (PARTITION BY a,b ORDER BY y)+(count(*) OVER (PARTITION BY a,b,y)-1)/2.0::DOUBLE ry FROM P) SELECT a, b, count(*) n, round(corr(rx,ry),6) rho FROM R GROUP BY ALL")
def spearman_rho(spark, d):
    return _spearman(spark, d).select("a", "b", "n", F.round("rho", 6).alias("rho"))


def _spearman(spark, d):
    t = scores(spark, d)
    p = t.select("u", F.col("c").alias("a"), F.col("s").alias("x")).join(t.select("u", F.col("c").alias("b"), F.col("s").alias("y")), "u").where("a < b")
    return S.spearman(p, "x", "y", "a", "b")


@query("spearman_p")
def spearman_p(spark, d):
    """Two-sided p-values of the t-distribution for rho; one row for each pair of conditions."""
    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([S.student_two_sided(a, b - 2) if b > 2 and a == a else None for a, b in zip(t, n, strict=True)])

    r = F.col("rho")
    return _spearman(spark, d).select("a", "b", "n", F.round("rho", 6).alias("rho"), F.round(p(r * F.sqrt((F.col("n") - 2) / (1 - r * r)), F.col("n")), 8).alias("p"))


@query("paired_diffs", f"WITH {D} SELECT a, b, count(*) n, round(avg(d),6) mean, round(median(d),6) median, count(*) FILTER (d>0) wins_a, count(*) FILTER (d<0) wins_b FROM D GROUP BY ALL")
def paired_diffs(spark, d):
    return diffs(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.round(F.median("d"), 6).alias("median"), F.count_if(F.col("d") > 0).alias("wins_a"), F.count_if(F.col("d") < 0).alias("wins_b"))


@query("wilcoxon_w", f"WITH {RANKS} SELECT a, b, n, round(least(up,down),2) w FROM W")
def wilcoxon_w(spark, d):
    return S.signed_ranks(diffs(spark, d)).select("a", "b", "n", F.round(F.least("up", "down"), 2).alias("w"))


@query("rank_biserial", f"WITH {RANKS} SELECT a, b, round((up-down)/(up+down),6) r FROM W")
def rank_biserial(spark, d):
    return S.signed_ranks(diffs(spark, d)).select("a", "b", F.round((F.col("up") - F.col("down")) / (F.col("up") + F.col("down")), 6).alias("r"))


@query("paired_t", f"WITH {D} SELECT a, b, count(*) n, round(avg(d)/(stddev_samp(d)/sqrt(count(*))),5) t FROM D GROUP BY ALL")
def paired_t(spark, d):
    return diffs(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d"))), 5).alias("t"))


@query("holm_adjust", f"WITH {D}, pv AS (SELECT a, b, round(1/(1+abs(avg(d)/(stddev_samp(d)/sqrt(count(*))))),6) p FROM D GROUP BY ALL), h AS (SELECT *, least(1.0,(count(*) OVER (PARTITION BY a)-row_number() OVER (PARTITION BY a ORDER BY p,b)+1)*p) st FROM pv) SELECT a, b, p, round(max(st) OVER (PARTITION BY a ORDER BY p,b ROWS UNBOUNDED PRECEDING),6) holm FROM h")
def holm_adjust(spark, d):
    """Holm's step-down adjustment within each family; the p-values are a stand-in that SQL can make too."""
    t = diffs(spark, d).groupBy("a", "b").agg(F.round(1 / (1 + F.abs(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d"))))), 6).alias("p"))
    return S.holm(t, "p", "a", tie="b").select("a", "b", "p", F.round("holm", 6).alias("holm"))


@query("paired_tests")
def paired_tests(spark, d):
    """Both paired tests of all pairs of conditions with their p-values, Holm's adjustment of each over all pairs, and whether there is an effect (0.1 at least, adjusted p under 0.05)."""

    @F.pandas_udf("double")
    def p_signed(w: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([S.wilcoxon_two_sided(*x) for x in zip(w, n, ties, strict=True)])

    @F.pandas_udf("double")
    def p_student(x: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([S.student_two_sided(a, b - 1) if b > 1 and a == a else 1.0 for a, b in zip(x, n, strict=True)])

    every = diffs(spark, d)
    m = every.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), F.try_divide(F.avg("d"), F.stddev_samp("d") / F.sqrt(F.count("d"))).alias("t"))
    j = m.join(S.signed_ranks(every).select("a", "b", F.col("n").alias("m"), F.least("up", "down").alias("w"), "ties"), ["a", "b"], "left").na.fill(0, ["m", "w", "ties"])
    j = j.select("a", "b", "n", "mean", "w", "t", p_signed("w", "m", "ties").alias("p_w"), p_student(F.coalesce("t", F.lit(float("nan"))), "n").alias("p_t"), F.lit(1).alias("family"), F.concat_ws("/", "a", "b").alias("pair"))
    for k in ("w", "t"):
        j = S.holm(j, f"p_{k}", "family", tie="pair").withColumnRenamed("holm", f"holm_{k}")
    effect = F.when((F.abs("mean") >= 0.1) & (F.col("holm_w") < 0.05), "effect").when(F.abs("mean") >= 0.1, "unclear").otherwise("none")
    return j.select("a", "b", "n", F.round("mean", 6).alias("mean"), "w", F.round("p_w", 8).alias("p_w"), F.round("holm_w", 8).alias("holm_w"), F.round("t", 5).alias("t"), F.round("p_t", 8).alias("p_t"), F.round("holm_t", 8).alias("holm_t"), effect.alias("verdict"))


_DRAW = "+".join(f"(x>={x})::INT" for x in selection.LIMITS)


@query("bootstrap_ci", f"""WITH {T}, b AS (SELECT c, s, i, sha256('0/'||c||'/'||u||'/'||i) h FROM T, range(63) t(i)), w AS (SELECT c, k, s, {_DRAW} w FROM (SELECT c, s, i*16+j k, ('0x'||substr(h,4*j::INT+1,4))::INT x FROM b, range(16) r(j)) WHERE k<1000),
 m AS (SELECT c, k, round(sum(w*s)/sum(w),9) m FROM w GROUP BY ALL) SELECT c, round(quantile_cont(m,0.025),5) low, round(quantile_cont(m,0.975),5) high FROM m GROUP BY 1""")
def bootstrap_ci(spark, d):
    """Percentile interval of the mean over 1000 replicates, by weights that a hash draws."""
    m = selection.bootstrap_means(scores(spark, d), "c", "u", "s").withColumn("m", F.round("m", 9))
    return selection.quantiles(m, ["c"], "m", [0.025, 0.975]).select("c", F.round(F.col("q")[0], 5).alias("low"), F.round(F.col("q")[1], 5).alias("high"))


@query("within_demean", f"WITH {T} SELECT u, c, round(s-avg(s) OVER (PARTITION BY u),8) x FROM T")
def within_demean(spark, d):
    return scores(spark, d).select("u", "c", F.round(F.col("s") - F.avg("s").over(Window.partitionBy("u")), 8).alias("x"))


@query("half_split_rank", f"WITH {T}, h AS (SELECT u, row_number() OVER (ORDER BY round(avg(s),6), u) r, count(*) OVER () n FROM T GROUP BY 1) SELECT c, round(avg(s) FILTER (r<=n//2),5) hard, round(avg(s) FILTER (r>n//2),5) easy FROM T JOIN h USING(u) GROUP BY 1")
def half_split_rank(spark, d):
    """Means over the harder and the easier half of the exercises.  A sort finds the last of the harder half; all others are compared with that one row."""
    t = scores(spark, d)
    h = t.groupBy("u").agg(F.round(F.avg("s"), 6).alias("m")).select("u", F.struct("m", "u").alias("at"))
    n = h.count()
    edge = h.orderBy("at").offset(max(n // 2 - 1, 0)).limit(1).select(F.col("at").alias("edge"))
    hard = (F.col("at") <= F.col("edge")) & F.lit(n > 1)
    return t.join(h, "u").crossJoin(F.broadcast(edge)).groupBy("c").agg(F.round(F.avg(F.when(hard, F.col("s"))), 5).alias("hard"), F.round(F.avg(F.when(~hard, F.col("s"))), 5).alias("easy"))


@query("choose_with_tie", f"WITH {MEANS}, b AS (SELECT *, max(m) OVER () best FROM G) SELECT c choice, m FROM b WHERE best-m<=1.0+1e-9 ORDER BY length(c), c LIMIT 1")
def choose_with_tie(spark, d):
    """The best condition, or among those within the tolerance the simplest."""
    g = means(spark, d)
    best = g.agg(F.max("m").alias("best"))
    return g.crossJoin(F.broadcast(best)).where(F.col("best") - F.col("m") <= 1.0 + 1e-9).agg(F.min_by(F.struct("c", "m"), F.struct(F.length("c"), F.col("c"))).alias("x")).select(F.col("x.c").alias("choice"), F.col("x.m").alias("m"))


@query("lexi_decide", f"WITH {T}, G AS (SELECT c, round(avg(s),3) m1, round(stddev_samp(s),3) m2, count(*) m3 FROM T GROUP BY 1), p AS (SELECT x.c a, y.c b, CASE WHEN abs(x.m1-y.m1)>2 THEN 1 WHEN abs(x.m2-y.m2)>1 THEN 2 WHEN x.m3<>y.m3 THEN 3 ELSE 4 END criterion, CASE WHEN abs(x.m1-y.m1)>2 THEN x.m1>y.m1 WHEN abs(x.m2-y.m2)>1 THEN x.m2<y.m2 WHEN x.m3<>y.m3 THEN x.m3>y.m3 ELSE x.c<y.c END a_wins FROM G x JOIN G y ON x.c<y.c) SELECT * FROM p")
def lexi_decide(spark, d):
    """Criteria in order; the first whose threshold is crossed decides."""
    g = scores(spark, d).groupBy("c").agg(F.round(F.avg("s"), 3).alias("m1"), F.round(F.stddev_samp("s"), 3).alias("m2"), F.count(F.lit(1)).alias("m3"))
    x, y = (g.select(*[F.col(c).alias(f"{p}_{c}") for c in g.columns]) for p in "xy")
    j = x.join(y, F.col("x_c") < F.col("y_c"))
    rules = [(F.abs(F.col("x_m1") - F.col("y_m1")) > 2, F.col("x_m1") > F.col("y_m1")), (F.abs(F.col("x_m2") - F.col("y_m2")) > 1, F.col("x_m2") < F.col("y_m2")), (F.col("x_m3") != F.col("y_m3"), F.col("x_m3") > F.col("y_m3")), (F.lit(True), F.col("x_c") < F.col("y_c"))]
    first = F.array_min(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("k"), w.alias("w"))) for k, (c, w) in enumerate(rules, 1)])))
    return j.select(F.col("x_c").alias("a"), F.col("y_c").alias("b"), first["k"].alias("criterion"), first["w"].alias("a_wins"))


@query("tie_tournament")
def tie_tournament(spark, d):
    g = table(spark, d, "events").groupBy((F.col("user_id") % 10).alias("g"), F.col("event_type").alias("name")).agg(F.round(F.avg("value") / 100, 4).alias("m1"), F.round(F.stddev_samp("value"), 1).alias("m2"), F.count(F.lit(1)).alias("m3"), F.round(F.min("value"), 0).alias("m4"))
    return S.tournament(g, "g", 0.02, (("m2", -1), ("m3", 1), ("m4", 1)))


@query("choose_k", "WITH g AS (SELECT event_id%7 k, avg(value) m FROM events GROUP BY 1) SELECT min(k) k FROM g WHERE (SELECT max(m) FROM g)-m<=1.0+1e-9")
def choose_k(spark, d):
    """The smallest k within the tolerance of the best."""
    g = table(spark, d, "events").groupBy((F.col("event_id") % 7).alias("k")).agg(F.avg("value").alias("m"))
    best = g.agg(F.max("m").alias("best"))
    return g.crossJoin(F.broadcast(best)).where(F.col("best") - F.col("m") <= 1.0 + 1e-9).agg(F.min("k").alias("k"))


RULES = [("view_margin", "view", "click", -1.0), ("purchase_gain", "purchase", "view", 0.5), ("click_margin", "click", "purchase", -2.0)]
RULES_SQL = ", ".join(f"('{n}','{a}','{b}',{t})" for n, a, b, t in RULES)


@query("noninferiority", f"WITH {MEANS}, r AS (SELECT * FROM (VALUES {RULES_SQL}) v(rule,a,b,thr)) SELECT rule, round(x.m-y.m,6) delta, x.m-y.m>=thr-1e-9 adopt FROM r JOIN G x ON x.c=a JOIN G y ON y.c=b")
def noninferiority(spark, d):
    """One engine for all rules of the kind "a is not worse than b by more than": the rules are rows."""
    g = means(spark, d)
    r = F.broadcast(dimension(spark, RULES, "rule string, a string, b string, thr double"))
    j = g.select(F.col("c").alias("a"), F.col("m").alias("x")).join(r, "a").join(g.select(F.col("c").alias("b"), F.col("m").alias("y")), "b")
    return j.select("rule", F.round(F.col("x") - F.col("y"), 6).alias("delta"), (F.col("x") - F.col("y") >= F.col("thr") - 1e-9).alias("adopt"))


@query("rule_sensitivity", f"WITH {T}, G AS (SELECT c, round(avg(s),6) m, round(median(s),6) md FROM T GROUP BY 1), r AS (SELECT * FROM (VALUES {RULES_SQL}) v(rule,a,b,thr)) SELECT rule, x.m-y.m>=thr-1e-9 by_mean, x.md-y.md>=thr-1e-9 by_median, (x.m-y.m>=thr-1e-9)<>(x.md-y.md>=thr-1e-9) differs FROM r JOIN G x ON x.c=a JOIN G y ON y.c=b")
def rule_sensitivity(spark, d):
    """Rules again with another measure in place of the mean."""
    g = scores(spark, d).groupBy("c").agg(F.round(F.avg("s"), 6).alias("m"), F.round(F.median("s"), 6).alias("md"))
    r = F.broadcast(dimension(spark, RULES, "rule string, a string, b string, thr double"))
    j = g.select(F.col("c").alias("a"), F.col("m").alias("x"), F.col("md").alias("xd")).join(r, "a").join(g.select(F.col("c").alias("b"), F.col("m").alias("y"), F.col("md").alias("yd")), "b")
    j = j.select("rule", (F.col("x") - F.col("y") >= F.col("thr") - 1e-9).alias("by_mean"), (F.col("xd") - F.col("yd") >= F.col("thr") - 1e-9).alias("by_median"))
    return j.withColumn("differs", F.col("by_mean") != F.col("by_median"))


@query("exclusion_reasons", f"WITH {T}, G AS (SELECT c, avg(s) m, stddev_samp(s) sd, count(*) n, min(s) lo FROM T GROUP BY 1) SELECT c, array_to_string(list_filter([CASE WHEN m<50 THEN 'low mean' END, CASE WHEN sd>15 THEN 'unstable' END, CASE WHEN n<150 THEN 'incomplete' END, CASE WHEN lo<5 THEN 'floor' END], lambda x: x IS NOT NULL),'; ') reasons FROM G")
def exclusion_reasons(spark, d):
    g = scores(spark, d).groupBy("c").agg(F.avg("s").alias("m"), F.stddev_samp("s").alias("sd"), F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"))
    r = F.array_compact(F.array(F.when(F.col("m") < 50, "low mean"), F.when(F.col("sd") > 15, "unstable"), F.when(F.col("n") < 150, "incomplete"), F.when(F.col("lo") < 5, "floor")))
    return g.select("c", F.array_join(r, "; ").alias("reasons"))


@query("utility_threshold", "WITH g AS (SELECT event_id%5 lvl, avg(value) m FROM events GROUP BY 1) SELECT min(lvl) lvl FROM g WHERE m-(SELECT m FROM g WHERE lvl=0)>=0.05")
def utility_threshold(spark, d):
    """The lowest level whose gain over level 0 is large enough; null if none."""
    g = table(spark, d, "events").groupBy((F.col("event_id") % 5).alias("lvl")).agg(F.avg("value").alias("m"))
    base = g.where("lvl = 0").select(F.col("m").alias("base"))
    return g.crossJoin(F.broadcast(base)).where(F.col("m") - F.col("base") >= 0.05).agg(F.min("lvl").alias("lvl"))


@query("gain_vs_base", f"WITH {T} SELECT x.c, count(*) n, round(avg(x.s-y.s),5) gain, CASE WHEN avg(x.s-y.s)>=0.5 THEN 'adds' WHEN avg(x.s-y.s)<=-0.5 THEN 'dilutes' ELSE 'neutral' END verdict FROM T x JOIN T y ON x.u=y.u AND y.c='view' AND x.c<>'view' GROUP BY 1")
def gain_vs_base(spark, d):
    t = scores(spark, d)
    j = t.where("c <> 'view'").join(t.where("c = 'view'").select("u", F.col("s").alias("b")), "u")
    g = F.avg(F.col("s") - F.col("b"))
    return j.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.round(g, 5).alias("gain"), F.when(g >= 0.5, "adds").when(g <= -0.5, "dilutes").otherwise("neutral").alias("verdict"))


@query("dilution_verdict", f"""WITH {T}, g AS (SELECT x.c, round(avg(x.s-y.s),6) g FROM T x JOIN T y ON x.u=y.u AND y.c='view' AND x.c<>'view' GROUP BY 1), p AS (SELECT max(g) FILTER (c='click') g50, max(g) FILTER (c='purchase') g100, max(g) FILTER (c='error') gd, max(g) FILTER (c='signup') gc FROM g)
 SELECT g50, g100, gd, gc, CASE WHEN gd-g50>=-0.05-1e-9 THEN 'no dilution' ELSE 'dilution' END dilution, CASE WHEN gc>=g100-0.05-1e-9 THEN 'adds up' WHEN gc-g50>=0.1-1e-9 THEN 'adds up in part' ELSE 'does not add up' END additivity FROM p""")
def dilution_verdict(spark, d):
    """Gains over the baseline of a half, the whole, a diluted half and both halves: whether dilution costs more than 0.05, and whether the halves add up."""
    t = scores(spark, d)
    g = t.where("c <> 'view'").join(t.where("c = 'view'").select("u", F.col("s").alias("base")), "u").groupBy("c").agg(F.round(F.avg(F.col("s") - F.col("base")), 6).alias("g"))
    p = g.agg(*[F.max(F.when(F.col("c") == c, F.col("g"))).alias(n) for c, n in (("click", "g50"), ("purchase", "g100"), ("error", "gd"), ("signup", "gc"))])
    dilution = F.when(F.col("gd") - F.col("g50") >= -0.05 - 1e-9, "no dilution").otherwise("dilution")
    added = F.when(F.col("gc") >= F.col("g100") - 0.05 - 1e-9, "adds up").when(F.col("gc") - F.col("g50") >= 0.1 - 1e-9, "adds up in part").otherwise("does not add up")
    return p.select("*", dilution.alias("dilution"), added.alias("additivity"))


@query("effect_verdict", f"WITH {D} SELECT a, b, CASE WHEN abs(avg(d))>=0.1 AND abs(avg(d)/(stddev_samp(d)/sqrt(count(*))))>1.96 THEN 'effect' WHEN abs(avg(d))>=0.1 THEN 'unclear' ELSE 'none' END verdict FROM D GROUP BY ALL")
def effect_verdict(spark, d):
    m, t = F.abs(F.avg("d")), F.abs(F.avg("d") / (F.stddev_samp("d") / F.sqrt(F.count("d"))))
    return diffs(spark, d).groupBy("a", "b").agg(F.when((m >= 0.1) & (t > 1.96), "effect").when(m >= 0.1, "unclear").otherwise("none").alias("verdict"))


@query("eta_hours", "SELECT event_type, round(median(value)*count(*)/3600,5) AS hours FROM events GROUP BY 1")
def eta_hours(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median("value") * F.count(F.lit(1)) / 3600, 5).alias("hours"))


@query("progress_eta", "WITH e AS (SELECT user_id%10 run, count(*) FILTER (event_type<>'error') done, count(*)+7 expected, median(value) FILTER (event_type='purchase') m FROM events GROUP BY 1), g AS (SELECT median(value) m FROM events) SELECT run, done, expected, round((expected-done)*coalesce(e.m,g.m)/3600,5) hours_left FROM e, g")
def progress_eta(spark, d):
    ev = table(spark, d, "events")
    e = ev.groupBy((F.col("user_id") % 10).alias("run")).agg(F.count_if(F.col("event_type") != "error").alias("done"), (F.count(F.lit(1)) + 7).alias("expected"))
    bought = ev.where("event_type = 'purchase'").select((F.col("user_id") % 10).alias("run"), "value")
    m = selection.quantiles(bought, ["run"], "value", [0.5]).select("run", F.col("q")[0].alias("m"))
    g = selection.quantiles(ev.select(F.lit(1).alias("one"), "value"), ["one"], "value", [0.5]).select(F.col("q")[0].alias("all_m"))  # one row
    return e.join(m, "run", "left").crossJoin(F.broadcast(g)).select("run", "done", "expected", F.round((F.col("expected") - F.col("done")) * F.coalesce("m", "all_m") / 3600, 5).alias("hours_left"))


@query("copy_loop", """WITH w AS (SELECT p_brand g, p_partkey%2=1 made, split_part(p_name,' ',1) a, split_part(p_name,' ',2) b FROM part), s AS (SELECT g, count(*) FILTER (made) edges, count(DISTINCT (a,b)) FILTER (made) pairs, coalesce(list_distinct(list(a) FILTER (made)),[]) names, coalesce(list_distinct(list(a) FILTER (NOT made)),[]) gold, coalesce(list_distinct(list(a) FILTER ((NOT made AND b='bolt') OR (made AND b='ring'))),[]) examples FROM w GROUP BY 1)
 SELECT g, edges, pairs, CASE WHEN edges>0 THEN round(pairs/edges,6) END share, coalesce(pairs/nullif(edges,0)<0.6,false) looping, len(list_filter(names, lambda x: list_contains(examples,x) AND NOT list_contains(gold,x))) copied FROM s""")
def copy_loop(spark, d):
    """Signs of a response that goes round: few different pairs, and names taken from the examples that the gold answer doesn't have."""
    w = table(spark, d, "part").select(F.col("p_brand").alias("g"), (F.col("p_partkey") % 2 == 1).alias("made"), F.split("p_name", " ")[0].alias("a"), F.coalesce(F.get(F.split("p_name", " "), F.lit(1)), F.lit("")).alias("b"))
    example = (~F.col("made") & (F.col("b") == "bolt")) | (F.col("made") & (F.col("b") == "ring"))
    n = w.groupBy("g", "a").agg(F.count_if("made").alias("edges"), F.count_if(~F.col("made")).alias("gold"), F.count_if(example).alias("examples"), F.count_distinct(F.when(F.col("made"), F.col("b"))).alias("pairs"))
    s = n.groupBy("g").agg(F.sum("edges").alias("edges"), F.sum("pairs").alias("pairs"), F.count_if((F.col("edges") > 0) & (F.col("examples") > 0) & (F.col("gold") == 0)).alias("copied"))
    share = F.try_divide(F.col("pairs"), F.col("edges"))
    return s.select("g", "edges", "pairs", F.round(share, 6).alias("share"), F.coalesce(share < 0.6, F.lit(False)).alias("looping"), "copied")


@query("id_scheme", "SELECT CASE WHEN regexp_matches(k,'^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$') THEN 'uuid4' WHEN regexp_matches(k,'^[0-9a-f-]{36}$') THEN 'uuid-like' WHEN regexp_matches(k,'^[0-9]+$') THEN 'number' ELSE 'other' END scheme, count(*) n FROM (SELECT CASE c_custkey%3 WHEN 0 THEN c_custkey::VARCHAR WHEN 1 THEN c_name ELSE substr(sha256(c_name),1,8)||'-'||substr(sha256(c_name),9,4)||'-4'||substr(sha256(c_name),14,3)||'-a'||substr(sha256(c_name),18,3)||'-'||substr(sha256(c_name),21,12) END k FROM customer) GROUP BY 1")
def id_scheme(spark, d):
    h = F.sha2("c_name", 256)
    uuid = F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-a"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))
    m = F.col("c_custkey") % 3
    k = F.when(m == 0, F.col("c_custkey").cast("string")).when(m == 1, F.col("c_name")).otherwise(uuid)
    scheme = F.when(k.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), "uuid4").when(k.rlike("^[0-9a-f-]{36}$"), "uuid-like").when(k.rlike("^[0-9]+$"), "number").otherwise("other")
    return table(spark, d, "customer").groupBy(scheme.alias("scheme")).agg(F.count(F.lit(1)).alias("n"))


@query("spread_sample", "WITH n AS (SELECT c_nationkey g, c_custkey id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)-1 i, count(*) OVER (PARTITION BY c_nationkey) n FROM customer) SELECT g, id FROM n WHERE i IN (floor(0.5*n/3)::BIGINT, floor(1.5*n/3)::BIGINT, floor(2.5*n/3)::BIGINT)")
def spread_sample(spark, d):
    """Three evenly spaced members of each stratum."""
    w = Window.partitionBy("c_nationkey")
    n = table(spark, d, "customer").select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("id"), (F.row_number().over(w.orderBy("c_acctbal", "c_custkey")) - 1).alias("i"), F.count(F.lit(1)).over(w).alias("n"))
    picks = F.array(*[F.floor((k + 0.5) * F.col("n") / 3) for k in range(3)])
    return n.where(F.array_contains(picks, F.col("i").cast("long"))).select("g", "id")


@query("hamilton_quota", "WITH g AS (SELECT c_mktsegment seg, count(*) n FROM customer GROUP BY 1), x AS (SELECT seg, n, n::DOUBLE/sum(n) OVER ()*26 e FROM g), f AS (SELECT *, floor(e) fl, row_number() OVER (ORDER BY round(e-floor(e),9) DESC, seg) r, 26-sum(floor(e)) OVER () lft FROM x) SELECT seg, n, (fl+(r<=lft)::INT)::BIGINT quota FROM f")
def hamilton_quota(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg")).agg(F.count(F.lit(1)).alias("n"))
    return S.hamilton(g, F.col("n") / F.sum("n").over(Window.partitionBy()), 26, "seg")


@query("band_extremes", "SELECT c_mktsegment seg, (SELECT NULL) IS NULL ok, arg_min(c_custkey,(c_acctbal,c_custkey)) low_id, arg_max(c_custkey,(c_acctbal,-c_custkey)) high_id FROM customer GROUP BY 1")
def band_extremes(spark, d):
    """The least and the greatest of each band, ties by id."""
    c = table(spark, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("seg")).agg(F.lit(True).alias("ok"), F.min_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("low_id"), F.max_by("c_custkey", F.struct(F.col("c_acctbal"), -F.col("c_custkey"))).alias("high_id"))


@query("grid_layout", """WITH n AS (SELECT p_brand g, p_partkey id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1)//4 r, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)-1)%4 c, 20+p_size h FROM part), y AS (SELECT g, r, max(h) hm FROM n GROUP BY ALL), t AS (SELECT g, r, coalesce(sum(hm+10) OVER (PARTITION BY g ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT y FROM y),
 b AS (SELECT n.g, id, c*120 x, y, h FROM n JOIN t ON t.g=n.g AND t.r=n.r), m AS (SELECT g, least(1600.0::DOUBLE/max(x+100),780.0::DOUBLE/max(y+h),1.0) k FROM b GROUP BY 1) SELECT b.g, id, round(x*k,4) x, round(y*k,4) y, round(100*k,4) w, round(h*k,4) h FROM b JOIN m ON m.g=b.g""")
def grid_layout(spark, d):
    """Boxes in rows of four; a row's height is its tallest box, and tops are running sums.  A drawing beyond the canvas is scaled to it, never up."""
    i = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    n = table(spark, d, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("id"), i.alias("i"), (20 + F.col("p_size")).alias("h")).select("g", "id", F.floor(F.col("i") / 4).alias("r"), (F.col("i") % 4).alias("c"), "h")
    y = n.groupBy("g", "r").agg(F.max("h").alias("hm"))
    y = y.select("g", "r", F.coalesce(F.sum(F.col("hm") + 10).over(Window.partitionBy("g").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("y"))
    b = n.join(y, ["g", "r"]).select("g", "id", (F.col("c").cast("long") * 120).alias("x"), "y", "h")
    m = b.groupBy("g").agg(F.least(F.lit(1600.0) / F.max(F.col("x") + 100), F.lit(780.0) / F.max(F.col("y") + F.col("h")), F.lit(1.0)).alias("k"))
    return b.join(m, "g").select("g", "id", *[F.round(c * F.col("k"), 4).alias(a) for a, c in (("x", F.col("x")), ("y", F.col("y")), ("w", F.lit(100)), ("h", F.col("h")))])


@query("ordered_composite", "SELECT * FROM (SELECT seg, nat, n, CAST(row_number() OVER (ORDER BY n DESC, seg, nat) AS INTEGER) pos FROM (SELECT c_mktsegment seg, c_nationkey nat, count(*) n FROM customer GROUP BY ALL)) WHERE pos<=20")
def ordered_composite(spark, d):
    """The first twenty by a composite key."""
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat")).agg(F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.col("n").desc(), "seg", "nat").limit(20)
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("n").desc(), "seg", "nat")))


EVENTS, LEVELS = ("view", "signup", "click", "error", "purchase"), (("low", "value < 50"), ("high", "value >= 50"))
WIDE = {"n": "count(CASE WHEN {c} THEN 1 END)", "mean": "round(avg(CASE WHEN {c} THEN value END),6)", "least": "min(CASE WHEN {c} THEN value END)", "most": "max(CASE WHEN {c} THEN value END)", "sum": "round(sum(CASE WHEN {c} THEN value END),6)"}
COLUMNS = {f"{level}_{event}_{name}": made.format(c=f"event_type = '{event}' AND {cond}") for level, cond in LEVELS for event in EVENTS for name, made in WIDE.items()}


@query("metrics_wide_pivot", f"SELECT user_id, {', '.join(f'{made} AS {name}' for name, made in COLUMNS.items())} FROM events GROUP BY 1")
def metrics_wide_pivot(spark, d):
    """Level by type by measure as 50 columns, in one pass."""
    return table(spark, d, "events").groupBy("user_id").agg(*[F.expr(made).alias(name) for name, made in COLUMNS.items()])


@query("round4_export", "SELECT c_custkey, coalesce(round(c_acctbal/7,4)::VARCHAR,'') v, coalesce(nullif(c_mktsegment,'BUILDING'),'') seg FROM customer WHERE c_acctbal/7=round(c_acctbal/7,4) OR true")
def round4_export(spark, d):
    """Four digits at most, nothing for null.  What rounds to zero from below keeps its sign."""
    return table(spark, d, "customer").select("c_custkey", F.coalesce(X.rounded_text(F.col("c_acctbal") / 7, 4), F.lit("")).alias("v"), F.coalesce(F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")), F.lit("")).alias("seg"))


@query("partial_cells", "WITH c AS (SELECT user_id u, event_type t, count(*) FILTER (value>=50) valid FROM events GROUP BY ALL) SELECT t, count(*) cells, count(*) FILTER (valid<3) partial FROM c GROUP BY 1")
def partial_cells(spark, d):
    c = table(spark, d, "events").groupBy("user_id", F.col("event_type").alias("t")).agg(F.count_if(F.col("value") >= 50).alias("valid"))
    return c.groupBy("t").agg(F.count(F.lit(1)).alias("cells"), F.count_if(F.col("valid") < 3).alias("partial"))
