"""Queries of experiment data: loading, guards, resume, grids, selection of examples, data quality."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval as R
from ..operators.retrieval import shared_folder
from ..sources.published import Cache, Published, freeze
from ..sources.tables import content_digest_of, dimension, frozen_rows, table, verified
from .registry import query


@query("scan_project", "SELECT doc_id, lang, source FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL")
def scan_project(spark, d):
    return table(spark, d, "documents").where("text is not null and lang is not null").select("doc_id", "lang", "source")


@query("pool_union", "SELECT pool, count(*) n, sum(length(text))::BIGINT chars FROM (SELECT 'corpus' pool, text FROM documents UNION ALL SELECT 'test', text FROM benchmark) GROUP BY 1")
def pool_union(spark, d):
    a = table(spark, d, "documents").select(F.lit("corpus").alias("pool"), "text")
    b = table(spark, d, "benchmark").select(F.lit("test").alias("pool"), "text")
    return a.unionByName(b).groupBy("pool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("query_role_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality=1)")
def query_role_semi(spark, d):
    role = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return table(spark, d, "documents").select("doc_id", "lang").join(role, "doc_id", "left_semi")


@query("role_guard", "SELECT count(*) offending FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def role_guard(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti").agg(F.count(F.lit(1)).alias("offending"))


@query("split_leak_check", "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark) OR regexp_matches(source,'^DB[0-9]{2}_')")
def split_leak_check(spark, d):
    """Rows of the corpus that belong to the test split: none expected, found by text or by the shape of an id.  Digests meet, not texts."""
    docs, digest = table(spark, d, "documents"), F.sha2("text", 256).alias("h")
    same = docs.select("doc_id", digest).join(table(spark, d, "benchmark").select(digest), "h", "left_semi").select("doc_id")
    return same.unionByName(docs.where(F.col("source").rlike("^DB[0-9]{2}_")).select("doc_id")).distinct()


@query("dq_profile", "SELECT count(*) n, count(DISTINCT doc_id) ids, count(*) FILTER (text IS NULL OR trim(text)='') empty, count(*) FILTER (lang IS NULL) no_lang, count(*) FILTER (n_chars<>length(text)) wrong_length, count(DISTINCT source) sources FROM documents")
def dq_profile(spark, d):
    t = table(spark, d, "documents")
    return t.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"), F.count_if(F.col("text").isNull() | (F.trim("text") == "")).alias("empty"), F.count_if(F.col("lang").isNull()).alias("no_lang"), F.count_if(F.col("n_chars") != F.length("text")).alias("wrong_length"), F.countDistinct("source").alias("sources"))


@query("dq_vocab_violations", "SELECT lang, count(*) n FROM documents WHERE lang NOT IN ('en','de') GROUP BY 1")
def dq_vocab_violations(spark, d):
    known = F.broadcast(dimension(spark, [("en",), ("de",)], "lang string"))
    return table(spark, d, "documents").select("lang").join(known, "lang", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("inconsistent_groups", "SELECT o_custkey, count(DISTINCT o_orderpriority) n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority)>1")
def inconsistent_groups(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderpriority").alias("n")).where("n > 1")


# Conditions of an experiment and the settings that go with them.
CONDITIONS = ("zero_shot", "static", "random", "bm25", "oracle", "dense", "hybrid", "oracle_jt", "struct", "construct", "struct_construct", "oracle_self", "oracle_partial", "bm25_controllo")
ORACLES, STRIPPED = ("oracle_self", "oracle_partial"), ("oracle_self", "bm25_controllo")


def choice(of, *values):
    """One of ``values`` by the remainder of an expression, in an SQL that both engines read."""
    return f"CASE ({of})%{len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def one_of(*values):
    return "(" + ",".join(f"'{v}'" for v in values) + ")"


#: Specifications made of orders.
SPEC = {
    "cond": choice("o_orderkey", *CONDITIONS, "unknown"), "fmt": choice("o_orderkey%29", "apollon", "plantuml", "compact", "xml"), "variant": choice("o_custkey", "base", "targeted", "other"),
    "version": choice("o_custkey+o_orderkey", "v4", "v5", "v5b", "v5c", "v9"), "view_": choice("o_orderkey%11+o_custkey%3", "raw", "clean_v1", "none"), "block_": choice("o_orderkey%13", "standard", "libero", "standard", "wide"),
    "extra": choice("o_orderkey%17", "nessuno", "bm25_2", "nessuno", "complemento", "more"), "serial": choice("o_custkey%19", "compact", "pretty", "compact", "binary"), "layout": choice("o_custkey%23", "user_only", "system_user", "none"),
}
KEEP, STRIP = "CASE o_orderkey%5 WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 WHEN 2 THEN 0.0 ELSE 1.0 END", "o_orderkey%4=0"
#: The cross-field rules: a name and when it is broken.
SPEC_RULES = [
    ("strip", f"strip AND cond NOT IN {one_of(*STRIPPED)}"), ("extra_unknown", f"extra NOT IN {one_of('nessuno', 'bm25_2', 'complemento')}"), ("extra_condition", "extra<>'nessuno' AND cond<>'oracle_partial'"), ("complement_keep", "extra='complemento' AND keep<>0.5"),
    ("block_unknown", f"block_ NOT IN {one_of('standard', 'libero')}"), ("block_condition", f"block_<>'standard' AND cond NOT IN {one_of(*ORACLES)}"), ("partial_keep", "cond='oracle_partial' AND NOT (keep>0 AND keep<1)"), ("keep_condition", "cond<>'oracle_partial' AND keep<>1.0"),
    ("condition_unknown", f"cond NOT IN {one_of(*CONDITIONS)}"), ("format_unknown", f"fmt NOT IN {one_of('apollon', 'plantuml', 'compact')}"), ("variant_unknown", f"variant NOT IN {one_of('base', 'targeted')}"), ("targeted_format", f"variant='targeted' AND fmt NOT IN {one_of('plantuml', 'compact')}"),
    ("version_unknown", f"version NOT IN {one_of('v4', 'v5', 'v5b', 'v5c')}"), ("v5_format", f"version IN {one_of('v5', 'v5b', 'v5c')} AND fmt NOT IN {one_of('plantuml', 'compact')}"), ("v5b_format", "version='v5b' AND fmt<>'plantuml'"), ("v5c_format", "version='v5c' AND fmt<>'compact'"),
    ("v5_variant", f"version IN {one_of('v5', 'v5b', 'v5c')} AND variant<>'base'"), ("view_unknown", f"view_ NOT IN {one_of('raw', 'clean_v1')}"), ("serialization", f"serial NOT IN {one_of('compact', 'pretty')} OR layout NOT IN {one_of('user_only', 'system_user')}"),
]
SPEC_SQL = ", ".join(f"{x} AS {n}" for n, x in SPEC.items()) + f", {KEEP} AS keep, {STRIP} AS strip"


@query("spec_validity", f"SELECT o_orderkey, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{n}{chr(39)} END' for n, c in SPEC_RULES)}], lambda x: x IS NOT NULL),',') errors FROM (SELECT o_orderkey, {SPEC_SQL} FROM orders)")
def spec_validity(spark, d):
    """Rules across the fields of a specification; the names of those that each row breaks."""
    spec = table(spark, d, "orders").select("o_orderkey", *[F.expr(x).alias(n) for n, x in SPEC.items()], F.expr(KEEP).alias("keep"), F.expr(STRIP).alias("strip"))
    return spec.select("o_orderkey", F.array_join(F.array_compact(F.array(*[F.when(F.expr(c), n) for n, c in SPEC_RULES])), ",").alias("errors"))


@query("run_load_join", "SELECT o_orderkey, l_linenumber, c_mktsegment FROM orders JOIN lineitem ON l_orderkey=o_orderkey JOIN customer ON c_custkey=o_custkey WHERE o_orderstatus IN ('O','F') AND c_mktsegment IN ('BUILDING','MACHINERY') AND l_returnflag='R'")
def run_load_join(spark, d):
    """Manifest, responses and ground truth together; filters reach the scans."""
    o = table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", "o_custkey")
    l = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    c = table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")
    return l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "l_linenumber", "c_mktsegment")


@query("run_eligibility", "SELECT user_id, CASE WHEN count(*)=0 THEN 'missing' WHEN count(DISTINCT event_type)<5 THEN 'wrong_types' WHEN max(value)>=99.9 THEN 'overflow' WHEN count(*)<50 THEN 'incomplete' ELSE 'eligible' END verdict FROM events GROUP BY 1")
def run_eligibility(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_type").alias("t"), F.max("value").alias("m"))
    v = F.when(F.col("n") == 0, "missing").when(F.col("t") < 5, "wrong_types").when(F.col("m") >= 99.9, "overflow").when(F.col("n") < 50, "incomplete").otherwise("eligible")
    return g.select("user_id", v.alias("verdict"))


@query("embed_cache_miss", "SELECT count(*) wanted, count(*) FILTER (h IN (SELECT sha256(text) FROM documents WHERE lang='en')) cached FROM (SELECT DISTINCT sha256(text) h FROM documents)")
def embed_cache_miss(spark, d):
    """Texts whose vector a cache keyed by content already has."""
    docs = table(spark, d, "documents")
    have = docs.where("lang = 'en'").select(F.sha2("text", 256).alias("h")).distinct().withColumn("hit", F.lit(1))
    return docs.select(F.sha2("text", 256).alias("h")).distinct().join(have, "h", "left").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("cached"))


@query("vector_cache", "SELECT lang, count(DISTINCT text) texts, round(sum(n),4) total FROM (SELECT DISTINCT lang, text, length(text)::DOUBLE n FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) GROUP BY 1")
def vector_cache(spark, d):
    """Values that a cache on disk makes once for each text: half of the texts are put first, then all are asked for, and what is read back is counted."""
    docs = table(spark, d, "documents").where("text is not null and lang is not null").select(F.sha2("text", 256).alias("key"), "text", "lang")
    cache = Cache(spark, shared_folder(spark, "cache"))
    make = lambda rows: rows.select("key", F.array(F.length("text").cast("double")).alias("value"))
    cache.get(docs.where(F.col("key") < "8"), make)
    values = cache.get(docs, make)
    each = docs.select("key", "lang").distinct().join(values, "key")
    return each.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.round(F.sum(F.col("value")[0]), 4).alias("total"))


@query("frozen_merge", """WITH t AS (SELECT c_nationkey q, c_custkey id, c_acctbal s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) r, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) x FROM customer)
 SELECT 'best' retriever, q AS query, id, CAST(r AS INTEGER) AS rank FROM t WHERE r<=3 UNION ALL SELECT 'random', q, id, CAST(x AS INTEGER) FROM t WHERE x<=2""")
def frozen_merge(spark, d):
    """Rankings of two retrievers frozen, one of them frozen anew beside the other, and all read back."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("id"), "c_acctbal")
    w = Window.partitionBy("query")
    one = lambda name, order, k: c.select(F.lit(name).alias("retriever"), "query", "id", F.row_number().over(w.orderBy(*order)).alias("rank")).where(F.col("rank") <= k)
    frozen = Published(spark, shared_folder(spark, "frozen"))
    freeze(frozen, one("best", [F.col("c_acctbal").desc(), F.col("id")], 3).unionByName(one("random", [F.col("id").desc()], 2)))
    freeze(frozen, one("random", [F.col("id")], 2))
    return frozen.read()


@query("cache_key_dedup", "SELECT sha256(concat_ws('|',c_mktsegment,c_nationkey::VARCHAR)) k, count(*) n, min(c_custkey) first_id FROM customer GROUP BY 1")
def cache_key_dedup(spark, d):
    k = F.sha2(F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string")), 256)
    return table(spark, d, "customer").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first_id"))


@query("mock_lookup", "SELECT s_suppkey, coalesce(t,'default') response FROM supplier LEFT JOIN (VALUES (1,'one'),(2,'two'),(7,'seven')) m(k,t) ON k=s_suppkey")
def mock_lookup(spark, d):
    m = F.broadcast(dimension(spark, [(1, "one"), (2, "two"), (7, "seven")], "s_suppkey long, t string"))
    return table(spark, d, "supplier").select("s_suppkey").join(m, "s_suppkey", "left").select("s_suppkey", F.coalesce("t", F.lit("default")).alias("response"))


@query("resume_antijoin", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume_antijoin(spark, d):
    """What is planned and not yet in the log."""
    o, l = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select("l_orderkey")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti")


@query("frozen_explode", """WITH t AS (SELECT c_nationkey q, c_custkey id, c_acctbal s, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) r FROM customer QUALIFY r<=3), h AS (SELECT q, sha256(string_agg(id::VARCHAR, ',' ORDER BY r)) digest FROM t GROUP BY 1) SELECT q AS query, CAST(r AS INTEGER) AS rank, id, s score, digest, true ok FROM t JOIN h USING(q)""")
def frozen_explode(spark, d):
    """Frozen rankings as rows.  The three best of a query are found before they are gathered; a key that occurs twice, or content that isn't that of the recorded digest, isn't ok."""
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    top = table(spark, d, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), r.alias("r")).where("r <= 3")
    x = F.array_sort(F.collect_list(F.struct("r", "id", "score")))
    f = top.groupBy("query").agg(x.alias("x")).select("query", F.lit("bm25").alias("retriever"), F.lit(3).alias("k"), F.transform("x", lambda v: v["id"]).alias("ids"), F.transform("x", lambda v: v["score"]).alias("scores"), F.transform("x", lambda v: F.lit(1.0)).alias("score_norm"))
    f = f.withColumn("digest", content_digest_of(F.col("ids")))
    return frozen_rows(verified(f)).select("query", "rank", "id", "score", "digest", "ok")


@query("merge_overwrite_subset", "SELECT c_custkey, CASE WHEN c_mktsegment='BUILDING' THEN round(c_acctbal*2,4) ELSE c_acctbal END v, CASE WHEN c_mktsegment='BUILDING' THEN 'new' ELSE 'kept' END origin FROM customer")
def merge_overwrite_subset(spark, d):
    """A subset written anew, all other rows as they were."""
    c = table(spark, d, "customer")
    old = c.where("c_mktsegment <> 'BUILDING'").select("c_custkey", F.col("c_acctbal").alias("v"), F.lit("kept").alias("origin"))
    return old.unionByName(c.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.round(F.col("c_acctbal") * 2, 4).alias("v"), F.lit("new").alias("origin")))


@query("token_ratio", "WITH l AS (SELECT user_id, event_type, value, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id,event_type ORDER BY ts DESC, event_id DESC)=1) SELECT event_type, round(min(value/(1+event_id%97)),6) low, round(avg(value/(1+event_id%97)),6) mean, round(max(value/(1+event_id%97)),6) high FROM l GROUP BY 1")
def token_ratio(spark, d):
    """The last row of each key, then ratios."""
    ev = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max_by(F.struct("value", "event_id"), F.struct("ts", "event_id")).alias("x"))
    r = F.col("x.value") / (1 + F.col("x.event_id") % 97)
    return ev.groupBy("event_type").agg(F.round(F.min(r), 6).alias("low"), F.round(F.avg(r), 6).alias("mean"), F.round(F.max(r), 6).alias("high"))


@query("context_fit", "SELECT lang, win::INTEGER win, count(*) n, count(*) FILTER (ceil(length(text)/4.0)*1.1+256<=win) fits FROM documents, (VALUES (512),(1024),(4096)) w(win) GROUP BY ALL")
def context_fit(spark, d):
    """How many prompts fit into each window; the windows are exploded beside each row, not joined."""
    x = table(spark, d, "documents").select("lang", (F.ceil(F.length("text") / 4.0) * 1.1 + 256).alias("need"), F.explode(F.array(F.lit(512), F.lit(1024), F.lit(4096))).alias("win"))
    return x.groupBy("lang", "win").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("need") <= F.col("win")).alias("fits"))


# Orders of the pool for each kind of ranking, in an SQL that both engines read: stand-ins for the retrievers on the numbers of a supplier, the query's own (q_...) beside them.
NEARNESS = {
    "random": ("sha256(q||'|'||id)", "sha2(concat(q,'|',id),256)"), "bm25": ("-abs(bal-q_bal)",) * 2, "dense": ("-abs(id%97-q%97)",) * 2, "oracle": ("-abs(nat-q_nat)",) * 2, "oracle_jt": ("-abs(nat%5-q_nat%5)",) * 2,
    "struct": ("-abs(id%13-q%13)",) * 2, "construct": ("-abs(id%7-q%7)",) * 2,
}
FUSED = {"hybrid": ("bm25", "dense"), "struct_construct": ("struct", "construct")}
EXAMPLES = 3


def _ranked(name):
    direction = "ASC" if name == "random" else "DESC"
    return f"r_{name} AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY {NEARNESS[name][0]} {direction}, id) r FROM pairs)"


def _fused(name):
    a, b = FUSED[name]
    return f"r_{name} AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY round(1.0::DOUBLE/(60+x.r)+1.0::DOUBLE/(60+y.r),9) DESC, id) r FROM r_{a} x JOIN r_{b} y USING(q,id))"


def _branches():
    own = "SELECT q, '{0}' cond, q id, 1 pos, '{1}' view_ FROM qs"
    last = lambda n, c, v="raw": f"SELECT q, '{c}', id, {EXAMPLES}+1-r, '{v}' FROM r_{n} WHERE r<={EXAMPLES}"
    parts = [own.format("oracle_self", "raw"), own.format("oracle_partial", "half"), f"SELECT q, 'static', id, r, 'raw' FROM qs, (SELECT s_suppkey id, row_number() OVER (ORDER BY s_suppkey) r FROM supplier QUALIFY r<=2) WHERE id<>q", f"SELECT q, 'random', id, r, 'raw' FROM r_random WHERE r<={EXAMPLES}", last("bm25", "bm25_controllo", "stripped")]
    return " UNION ALL ".join(parts + [last(n, n) for n in (*[k for k in NEARNESS if k != "random"], *FUSED)])


@query("condition_union", f"WITH qs AS (SELECT s_suppkey q, s_acctbal q_bal, s_nationkey q_nat FROM supplier WHERE s_suppkey%100=0), pairs AS (SELECT q, q_bal, q_nat, s_suppkey id, s_acctbal bal, s_nationkey nat FROM qs JOIN supplier ON s_suppkey<>q), {', '.join([*map(_ranked, NEARNESS), *map(_fused, FUSED)])} SELECT q, cond, id, pos::INTEGER pos, view_ FROM ({_branches()})")
def condition_union(spark, d):
    """The examples of fourteen conditions for the query set (ids divisible by 100), each in the order of its prompt: rankings have the best last, draws as they come, zero_shot none."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("nat"))
    qs = s.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("bal").alias("q_bal"), F.col("nat").alias("q_nat"))
    # every ranking but the draws is by the distance of a number of the pool from the query's
    x = {"bm25": "bal", "dense": "id%97", "oracle": "nat", "oracle_jt": "nat%5", "struct": "id%13", "construct": "id%7"}
    pool = {n: s.select("id", F.expr(e).cast("double").alias("x")) for n, e in x.items()}
    asked = {n: qs.select("q", F.lit(0).alias("s"), "q_bal", "q_nat").select("q", "s", F.expr(e.replace("id", "q").replace("nat", "q_nat").replace("bal", "q_bal")).cast("double").alias("x")) for n, e in x.items()}
    firsts = lambda df, order: df.select("q", "id", F.row_number().over(Window.partitionBy("q").orderBy(order, "id")).alias("r")).where(F.col("r") <= EXAMPLES)  # noqa: E731  # of some rows a query

    def ranked(name):
        if name == "random":
            drawn = R.draws(s, qs, F.sha2(F.concat("q", F.lit("|"), "id"), 256), EXAMPLES)
            return firsts(drawn, F.col("h"))
        return R.blockmax.top(R.spread(pool[name]), asked[name], EXAMPLES, own=False, digits=None).select("q", "id", F.col("rank").alias("r"))

    def fused(name):
        a, b = FUSED[name]
        score = R.fused([R.spread(pool[a]), R.spread(pool[b])], [asked[a], asked[b]], EXAMPLES, own=False, digits=None)
        return firsts(score, F.round("score", 9).desc())

    def branch(df, cond, pos, view="raw"):
        return df.select("q", F.lit(cond).alias("cond"), "id", pos.cast("int").alias("pos"), F.lit(view).alias("view_"))

    last, own = EXAMPLES + 1 - F.col("r"), qs.select("q", F.col("q").alias("id"))
    two = s.select("id").orderBy("id").limit(2)
    static = qs.select("q").crossJoin(F.broadcast(two.withColumn("r", F.row_number().over(Window.orderBy("id"))))).where("id <> q")  # two rows
    parts = [branch(own, "oracle_self", F.lit(1)), branch(own, "oracle_partial", F.lit(1), "half"), branch(static, "static", F.col("r")), branch(ranked("random").where(F.col("r") <= EXAMPLES), "random", F.col("r")), branch(ranked("bm25").where(F.col("r") <= EXAMPLES), "bm25_controllo", last, "stripped")]
    parts += [branch(ranked(n).where(F.col("r") <= EXAMPLES), n, last) for n in NEARNESS if n != "random"] + [branch(fused(n).where(F.col("r") <= EXAMPLES), n, last) for n in FUSED]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("experiment_grid", "SELECT r_name cond, k::INTEGER k, rep::INTEGER rep, ('0x'||substr(sha256(r_name||'|'||k||'|'||rep),1,8))::BIGINT seed FROM region, (VALUES (0),(1),(3)) a(k), range(1,4) b(rep) WHERE NOT (r_name='ASIA' AND k=0)")
def experiment_grid(spark, d):
    """Conditions by k by repetition, cells that mean nothing left out, with a seed each."""
    g = table(spark, d, "region").select(F.col("r_name").alias("cond"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("k")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(3)))).where("not (cond = 'ASIA' and k = 0)")
    h = F.sha2(F.concat_ws("|", "cond", F.col("k").cast("string"), F.col("rep").cast("string")), 256)
    return g.withColumn("seed", F.conv(F.substring(h, 1, 8), 16, 10).cast("long"))


@query("slot_quality", "WITH t AS (SELECT c_nationkey q, c_custkey id, c_mktsegment seg, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) r FROM customer), k AS (SELECT q, seg FROM t WHERE r<=3) SELECT count(*) slots, round(count(*) FILTER (seg='BUILDING')/count(*),6) share, (SELECT count(*) FROM (SELECT q FROM k GROUP BY 1 HAVING bool_or(seg='BUILDING'))) queries_with FROM k")
def slot_quality(spark, d):
    """The share of slots with a property, and the queries that have one."""
    r = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    k = table(spark, d, "customer").select(F.col("c_nationkey").alias("q"), (F.col("c_mktsegment") == "BUILDING").alias("hit"), r.alias("r")).where("r <= 3")
    per = k.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    return per.agg(F.sum("n").alias("slots"), F.round(F.sum("h") / F.sum("n"), 6).alias("share"), F.count_if(F.col("h") > 0).alias("queries_with"))
