"""Queries of retrieval: BM25, vectors, fusion, re-ranking, near-duplicates and ranking measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bags, blockmax, pivots
from ..operators import retrieval as R
from ..sources.tables import dimension, table
from .registry import query

STOP = ["a", "an", "and", "are", "as", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with", "de", "la", "le", "et", "der", "die", "das", "und", "que"]
STOP_SQL = "(" + ",".join(f"'{w}'" for w in STOP) + ")"

TOKENS = r"regexp_extract_all(lower(text),'[\p{L}\p{N}]+')"
TOK = f"tok AS (SELECT doc_id id, unnest({TOKENS}) t FROM documents)"
INDEX = f"""{TOK},
 tf AS (SELECT id, t, count(*) f FROM tok GROUP BY ALL), dl AS (SELECT id, count(*) dl FROM tok GROUP BY 1),
 st AS (SELECT (SELECT count(*) FROM documents) nd, (SELECT count(*) FROM tok) total, (SELECT count(*) FROM tok)::DOUBLE/(SELECT count(*) FROM documents) avgdl),
 df AS (SELECT t, count(*) df FROM tf GROUP BY 1)"""
IDF = """raw AS (SELECT t, df, ln(nd-df+0.5)-ln(df+0.5) w FROM df, st),
 idf AS (SELECT t, df, CASE WHEN w<0 THEN 0.25*(SELECT avg(w) FROM raw) ELSE w END w FROM raw)"""
QT = f"qt AS (SELECT item_id q, t, count(*) c FROM (SELECT item_id, unnest({TOKENS}) t FROM benchmark) GROUP BY ALL)"


def bm25_sql(k1="1.5", b="0.75"):
    return f"sum(c*w*f*({k1}+1)/(f+{k1}*(1-{b}+{b}*dl/avgdl)))"


def all_sql(queries="SELECT DISTINCT item_id q FROM benchmark", ids="SELECT DISTINCT doc_id id FROM documents", extra=""):
    """Scores of all documents for all queries: 0 where no term is shared."""
    return f"s AS (SELECT q, id, coalesce(score,0.0) score FROM ({queries}) CROSS JOIN ({ids}) LEFT JOIN s0 USING(q,id) {extra})"


SCORED = f"s0 AS (SELECT q, id, round({bm25_sql()},6) score FROM qt JOIN tf USING(t) JOIN idf USING(t) JOIN dl USING(id) CROSS JOIN st GROUP BY ALL)"
SCORES = f"{SCORED}, {all_sql()}"
RANKED = "rk AS (SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) rank FROM s)"
BM25 = f"WITH {INDEX}, {IDF}, {QT}, {SCORES}, {RANKED}"


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def bench(spark, d):
    return table(spark, d, "benchmark")


def ix(spark, d):
    return R.index(docs(spark, d), "doc_id", "text", packed=True)


def ids(spark, d):
    return docs(spark, d).select(F.col("doc_id").alias("id")).distinct()


def items(spark, d):
    return bench(spark, d).select(F.col("item_id").alias("q"))


def bm25(spark, d):
    """The documents and the items as queries, for ``blockmax``."""
    index = ix(spark, d)
    return index["docs"], R.written(R.bm25_queries(index, R.query_terms(bench(spark, d), "item_id", "text", packed=True), items(spark, d)))


def best(spark, d, k, spans=False):
    """The first k of all documents, also of those that share no term with the query."""
    return blockmax.top(*bm25(spark, d), k, spans=spans).drop("s")


@query("tokenize_counts", f"SELECT doc_id, coalesce(len({TOKENS}),0) n_tokens, coalesce(len(list_distinct({TOKENS})),0) n_distinct FROM documents")
def tokenize_counts(spark, d):
    t = F.coalesce(R.token_array(F.col("text")), F.array().cast("array<string>"))
    return docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def stopwords(spark):
    """The words of the file that the setting ``spark.lodestone.stopwords`` names, one a line; without it a short list of function words."""
    path = spark.conf.get("spark.lodestone.stopwords", None)
    return [r.value.strip() for r in spark.read.text(path).where("trim(value) <> ''").collect()] if path else STOP


@query("tokenize_stop", f"SELECT doc_id, coalesce(len(list_filter({TOKENS}, lambda t: t NOT IN {STOP_SQL})),0) n_tokens FROM documents")
def tokenize_stop(spark, d):
    kept = F.filter(F.coalesce(R.token_array(F.col("text")), F.array().cast("array<string>")), lambda t: ~t.isin(stopwords(spark)))
    return docs(spark, d).select("doc_id", F.size(kept).cast("long").alias("n_tokens"))


@query("bm25_topk", f"{BM25} SELECT q item_id, id doc_id, score, rank FROM rk WHERE rank<=3")
def bm25_topk(spark, d):
    return best(spark, d, 3).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query("bm25_score_norm", f"""{BM25}, qd AS (SELECT q, sum(c) dl FROM qt GROUP BY 1),
 self AS (SELECT q, sum(c*w*c*2.5/(c+1.5*(0.25+0.75*dl/avgdl))) self FROM qt JOIN idf USING(t) JOIN qd USING(q) CROSS JOIN st GROUP BY 1)
 SELECT q item_id, id doc_id, rank, CASE WHEN coalesce(self,0)=0 THEN 0.0 ELSE round(score/self,5) END score_norm FROM rk LEFT JOIN self USING(q) WHERE rank<=5""")
def bm25_score_norm(spark, d):
    index, q = ix(spark, d), R.query_terms(bench(spark, d), "item_id", "text", packed=True)
    top = blockmax.top(index["docs"], R.bm25_queries(index, q, items(spark, d)), 5).join(R.bm25_self(index, q), "q", "left")
    return top.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.when(F.coalesce("self", F.lit(0.0)) == 0, 0.0).otherwise(F.round(F.col("score") / F.col("self"), 5)).alias("score_norm"))


LOO = f"""WITH {INDEX}, m AS (SELECT doc_id q FROM documents WHERE doc_id % 100 = 0),
 own AS (SELECT m.q, tf.t, f c, df FROM m JOIN tf ON tf.id=m.q JOIN df USING(t)),
 dfq AS (SELECT m.q, df.t, df.df - (CASE WHEN own.t IS NULL THEN 0 ELSE 1 END) d FROM m CROSS JOIN df LEFT JOIN own ON own.q=m.q AND own.t=df.t),
 rawq AS (SELECT q, t, ln(nd-1-d+0.5)-ln(d+0.5) w FROM dfq, st WHERE d>0), mean AS (SELECT q, avg(w) mean FROM rawq GROUP BY 1),
 len AS (SELECT q, (total-sum(c))::DOUBLE/(nd-1) avgdl FROM own, st GROUP BY q, total, nd),
 s0 AS (SELECT own.q, tf.id, round(sum(c*(CASE WHEN w<0 THEN 0.25*mean ELSE w END)*f*2.5/(f+1.5*(0.25+0.75*dl/len.avgdl))),6) score
  FROM own JOIN rawq USING(q,t) JOIN mean USING(q) JOIN len USING(q) JOIN tf ON tf.t=own.t AND tf.id<>own.q JOIN dl ON dl.id=tf.id GROUP BY own.q, tf.id), {all_sql('SELECT q FROM m', extra='WHERE q<>id')}, {RANKED}"""


@query("loo_bm25", f"{LOO} SELECT q, id doc_id, score, rank FROM rk WHERE rank<=10")
def loo_bm25(spark, d):
    """Leave-one-out ranking of the query set (ids divisible by 100) against all documents."""
    index, members = ix(spark, d), ids(spark, d).where("id % 100 = 0").select(F.col("id").alias("q"))
    return blockmax.top(index["docs"], R.bm25_leave_one_out(index, members), 10, own=False).select("q", F.col("id").alias("doc_id"), "score", "rank")


GRID = [(k, b) for k in (0.9, 1.2, 1.5, 2.0) for b in (0.5, 0.75, 0.9)]


@query("bm25_grid", f"""WITH v AS (SELECT unnest([true,false]) stop), tk AS (SELECT stop, id, t FROM v, (SELECT doc_id id, unnest({TOKENS}) t FROM documents) WHERE NOT (stop AND t IN {STOP_SQL})), tf AS (SELECT stop, id, t, count(*) f FROM tk GROUP BY ALL), dl AS (SELECT stop, id, count(*) dl FROM tk GROUP BY ALL),
 st AS (SELECT stop, (SELECT count(*) FROM documents) nd, count(*)::DOUBLE/(SELECT count(*) FROM documents) avgdl FROM tk GROUP BY 1), df AS (SELECT stop, t, count(*) df FROM tf GROUP BY ALL), raw AS (SELECT stop, t, ln(nd-df+0.5)-ln(df+0.5) w FROM df JOIN st USING(stop)), mw AS (SELECT stop, avg(w) mean FROM raw GROUP BY 1),
 idf AS (SELECT stop, t, CASE WHEN w<0 THEN 0.25*mean ELSE w END w FROM raw JOIN mw USING(stop)), qt AS (SELECT stop, q, t, count(*) c FROM v, (SELECT item_id q, unnest({TOKENS}) t FROM benchmark) WHERE NOT (stop AND t IN {STOP_SQL}) GROUP BY ALL),
 g AS (SELECT * FROM (VALUES (0.9::DOUBLE),(1.2),(1.5),(2.0)) a(k1), (VALUES (0.5::DOUBLE),(0.75),(0.9)) b(b)),
 s0 AS (SELECT stop, k1, b, q, id, round({bm25_sql('k1', 'b')},6) score FROM qt JOIN tf USING(stop,t) JOIN idf USING(stop,t) JOIN dl USING(stop,id) JOIN st USING(stop) CROSS JOIN g GROUP BY ALL),
 s AS (SELECT stop, k1, b, q, id, coalesce(score,0.0) score FROM v CROSS JOIN g CROSS JOIN (SELECT DISTINCT item_id q FROM benchmark) CROSS JOIN (SELECT DISTINCT doc_id id FROM documents) LEFT JOIN s0 USING(stop,k1,b,q,id)),
 r AS (SELECT stop, k1, b, q, id, row_number() OVER (PARTITION BY stop,k1,b,q ORDER BY score DESC, id) rank FROM s QUALIFY rank<=3), l AS (SELECT doc_id id, max(quality) g FROM labels GROUP BY 1),
 m AS (SELECT stop, k1, b, q, avg(coalesce(g,0)) FILTER (rank=1) m1, avg(coalesce(g,0)) m3 FROM r LEFT JOIN l USING(id) GROUP BY ALL), z AS (SELECT q, m1 z1, m3 z3 FROM m WHERE stop AND k1=1.5 AND b=0.75),
 x AS (SELECT stop, k1, b, m1, m3, m1-z1 d1, m3-z3 d3 FROM m JOIN z USING(q)),
 y AS (SELECT stop, k1, b, round(avg(m1),6) at1, round(avg(m3),6) at3, round(avg(d1),6) d1, round(stddev_samp(d1)/sqrt(count(*)),6) se1, round(avg(d3),6) d3, round(stddev_samp(d3)/sqrt(count(*)),6) se3 FROM x GROUP BY ALL)
 SELECT stop, false stem, k1, b, at1, at3, d1, se1, d3, se3, abs(d1)>2*se1 OR abs(d3)>2*se3 beyond_2se FROM y""")
def bm25_grid(spark, d):
    """The settings without stems of ``bm25_grid48``, which SQL can make too."""
    return _grid(spark, d, [(True, False), (False, False)])


@query("bm25_grid48")
def bm25_grid48(spark, d):
    """Stopwords by stems by k1 by b, 48 settings: quality at 1 and at 3, and paired differences to the standard setting with standard errors."""
    return _grid(spark, d, [(stop, stem) for stop in (True, False) for stem in (True, False)])


def _grid(spark, d, variants):
    from ..functions.stem import stem_lists

    settings = F.broadcast(dimension(spark, [(i, *x) for i, x in enumerate(GRID)], "s int, k1 double, b double"))  # twelve rows
    good = table(spark, d, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("g"))
    words, hashes = R.spread(docs(spark, d).select(F.col("doc_id").alias("id"), "text")).select("id", R.token_array(F.col("text")).alias("words")), lambda c: F.transform(c, lambda t: F.xxhash64(t))
    if any(stem for _, stem in variants):
        words = words.withColumn("stems", stem_lists(F.col("words")))
    # texts are split and stemmed once, for all variants: a stem stands at the place of its word
    lists, tops = R.written(words.select("id", *[hashes(c).alias(c) for c in words.columns[1:]])), None
    for stop, stem in variants:
        out, change, kept = stopwords(spark) if stop else None, stem_lists if stem else None, F.col("stems" if stem else "words")
        if out:
            dropped = spark.range(1).select(F.array(*[F.xxhash64(F.lit(w)) for w in out])).first()[0]
            kept = F.filter(kept, lambda t, i: ~F.get("words", i).isin(dropped)) if stem else F.filter(kept, lambda t: ~t.isin(dropped))  # noqa: B023
        index = R.index_of(lists.select("id", kept.alias("toks")))
        q = R.query_terms(bench(spark, d), "item_id", "text", out, change, packed=True)
        top = blockmax.top(index["docs"], R.bm25_queries(index, q, items(spark, d), GRID), 3).join(settings, "s").select(F.lit(stop).alias("stop"), F.lit(stem).alias("stem"), "k1", "b", "q", "id", "rank")
        tops = top if tops is None else tops.unionByName(top)
    g = F.coalesce("g", F.lit(0)).cast("double")
    m = tops.join(good, "id", "left").groupBy("stop", "stem", "k1", "b", "q").agg(F.avg(F.when(F.col("rank") == 1, g)).alias("m1"), F.avg(g).alias("m3"))
    standard = F.col("stop") & (F.col("stem") == variants[0][1]) & (F.col("k1") == 1.5) & (F.col("b") == 0.75)
    w = Window.partitionBy("q")
    x = m.withColumns({f"d{k}": F.col(f"m{k}") - F.max(F.when(standard, F.col(f"m{k}"))).over(w) for k in (1, 3)})
    se = lambda c: F.round(F.stddev_samp(c) / F.sqrt(F.count(c)), 6)
    out = x.groupBy("stop", "stem", "k1", "b").agg(*[F.round(F.avg(f"m{k}"), 6).alias(f"at{k}") for k in (1, 3)], *[f for k in (1, 3) for f in (F.round(F.avg(f"d{k}"), 6).alias(f"d{k}"), se(f"d{k}").alias(f"se{k}"))])
    return out.withColumn("beyond_2se", (F.abs("d1") > 2 * F.col("se1")) | (F.abs("d3") > 2 * F.col("se3")))


DOT = "list_sum(list_transform(list_zip(a.embedding,b.embedding), lambda x: x[1]::DOUBLE*x[2]::DOUBLE))/sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE*x::DOUBLE))*list_sum(list_transform(b.embedding, lambda x: x::DOUBLE*x::DOUBLE)))"
DENSE = f"WITH s AS (SELECT a.vec_id q, b.vec_id id, round({DOT},6) score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id<>b.vec_id), {RANKED}"


def dense_scores(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = v.where("id % 100 = 0").select(F.col("id").alias("q"), "v")
    return R.nearest(q, v, 5)


@query("dense_topk", f"{DENSE} SELECT q, id vec_id, score, rank FROM rk WHERE rank<=5")
def dense_topk(spark, d):
    """Cosine neighbours of the query set (ids divisible by 100) among all vectors."""
    return R.rank(dense_scores(spark, d), 5).select("q", F.col("id").alias("vec_id"), "score", "rank")


@query("dense_pivots", f"{DENSE} SELECT q, id vec_id, score, rank FROM rk WHERE rank<=5")
def dense_pivots(spark, d):
    """The same neighbours by an index of pivots, which pays off where vectors lie in clusters."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    q = v.where("id % 100 = 0").select(F.col("id").alias("q"), "v")
    return R.rank(pivots.nearest(q, pivots.index(v), 5), 5).select("q", F.col("id").alias("vec_id"), "score", "rank")


@query("topk_tiebreak", """SELECT q, id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) rank FROM
 (SELECT c_nationkey q, c_custkey id, round(c_acctbal/1000,0) score FROM customer) WHERE true QUALIFY rank<=5""")
def topk_tiebreak(spark, d):
    s = table(spark, d, "customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("id"), F.round(F.col("c_acctbal") / 1000, 0).alias("score"))
    return R.rank(s, 5, digits=0)


@query("retrieve_sql", """SELECT q, id, score, seg, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) rank FROM (SELECT c_nationkey q, c_custkey id, round(c_acctbal/1000,0) score, c_mktsegment seg FROM customer) WHERE true QUALIFY rank<=4""")
def retrieve_sql(spark, d):
    """The first four of each query by SQL text alone, with the table function ``retrieve``."""
    from ..operators import udtf

    udtf.register(spark)
    rows = table(spark, d, "customer")
    return spark.sql("SELECT q, id, score, seg, rank FROM retrieve(TABLE(SELECT c_nationkey q, c_custkey id, round(c_acctbal/1000,0) score, c_mktsegment seg FROM {rows}), 4)", rows=rows)


@query("exclude_ids", f"{BM25}, ok AS (SELECT * FROM s WHERE id NOT IN (SELECT doc_id FROM labels WHERE toxic=1)) SELECT q item_id, id doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) rank FROM ok QUALIFY rank<=3")
def exclude_ids(spark, d):
    """Exclusion before the cut."""
    bad = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id"))
    every, queries = bm25(spark, d)
    return blockmax.top(every.join(bad, "id", "left_anti"), queries, 3).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def encode_sql(name, toks, by="id"):
    """Unit vectors of signed counts of hashed tokens, in long form: (by..., i, v)."""
    return f"""{name}h AS (SELECT {by}, ('0x'||substr(md5(t),1,8))::BIGINT % 16 i, CASE WHEN ('0x'||substr(md5(t),9,1))::BIGINT%2=0 THEN 1.0 ELSE -1.0 END::DOUBLE s FROM {toks}), {name}s AS (SELECT {by}, i, sum(s) v FROM {name}h GROUP BY ALL),
 {name}n AS (SELECT {by}, sqrt(sum(v*v)) l FROM {name}s GROUP BY ALL), {name} AS (SELECT {by}, i, v/l v FROM {name}s JOIN {name}n USING({by}) WHERE l>0)"""


QTOK = f"qtok AS (SELECT item_id id, unnest({TOKENS}) t FROM benchmark)"
RUN_B = f"""{QTOK}, {encode_sql('ev', 'tok')}, {encode_sql('eq', 'qtok')}, dot AS (SELECT eq.id q, ev.id id, round(sum(eq.v*ev.v),6) score FROM eq JOIN ev USING(i) GROUP BY ALL),
 rb AS (SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY coalesce(dot.score,0.0) DESC, id) AS INTEGER) rank FROM (SELECT q, id FROM s) x LEFT JOIN dot USING(q,id))"""


def dense(spark, d):
    """The encoded texts of documents and items, for ``blockmax``; those without words have no vector, and score 0."""
    lists = lambda df, c: R.encode_lists(R.spread(df.select(F.col(c).alias("id"), "text")).select("id", R.token_array(F.col("text")).alias("toks")))
    v, q = lists(docs(spark, d), "doc_id"), lists(bench(spark, d).dropDuplicates(["item_id"]), "item_id").withColumnRenamed("id", "q")
    return v, q.select("q", F.lit(0).alias("s"), "v")


@query("rrf_fusion", f"{BM25}, {RUN_B}, f AS (SELECT q, id, sum(1.0::DOUBLE/(60+rank)) score FROM (SELECT q,id,rank FROM rk UNION ALL SELECT q,id,rank FROM rb) GROUP BY ALL) SELECT q item_id, id doc_id, round(score,8) score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score,8) DESC, id) AS INTEGER) rank, round(score/(2.0::DOUBLE/61),8) score_norm FROM f QUALIFY rank<=10")
def rrf_fusion(spark, d):
    """The hybrid of BM25 and vectors, by ranks over the full lists of both."""
    (texts, asked), (vectors, meant) = bm25(spark, d), dense(spark, d)
    norm = R.fused([texts, vectors], [asked, meant], 10).withColumn("score_norm", F.round(F.col("score") / (2.0 / 61), 8))
    return R.rank(norm, 10, 8).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank", "score_norm")


@query("minmax_norm", f"{BM25} SELECT q item_id, id doc_id, rank, round(CASE WHEN max(score) OVER w=min(score) OVER w THEN 1.0 ELSE (score-min(score) OVER w)/(max(score) OVER w-min(score) OVER w) END,6) norm FROM rk WINDOW w AS (PARTITION BY q) QUALIFY rank<=10")
def minmax_norm(spark, d):
    """The first ten, scaled by the least and the largest score of the whole ranking, documents of score 0 included."""
    norm = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return best(spark, d, 10, spans=True).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round(norm, 6).alias("norm"))


@query("random_topk", "SELECT q item_id, id doc_id, 0.0::DOUBLE score, rank FROM (SELECT item_id q, doc_id id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY sha256(concat_ws('|','7',sha256(coalesce(b.text,'')),doc_id::VARCHAR)), doc_id) AS INTEGER) rank FROM benchmark b, documents) WHERE rank<=5")
def random_topk(spark, d):
    """A random baseline, fixed by seed and query text, independent of the order of rows."""
    q = bench(spark, d).select("item_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("qt"))
    h = F.sha2(F.concat_ws("|", F.lit("7"), "qt", F.col("doc_id").cast("string")), 256)
    draws = lambda q: docs(spark, d).select("doc_id").crossJoin(F.broadcast(q)).select("item_id", "doc_id", h.alias("h"))  # noqa: E731  # one for each query and document is the definition
    # draws are uniform, so about 64 of a query lie under this one; where five do, they hold its first five, and other queries keep all
    n = docs(spark, d).count()
    low = F.col("h") < (f"{(64 << 32) // n:08x}" if n > 64 else "g")
    few = R.held(draws(q).where(low))
    full = few.groupBy(F.col("item_id").alias("i")).agg(F.count(F.lit(1)).alias("n")).where("n >= 5")
    rest = R.held(q.join(full, F.col("item_id").eqNullSafe(F.col("i")), "left_anti"))
    every = few if rest.isEmpty() else few.unionByName(draws(rest).where(~low))
    r = F.row_number().over(Window.partitionBy("item_id").orderBy("h", "doc_id"))
    return every.select("item_id", "doc_id", F.lit(0.0).alias("score"), r.alias("rank")).where("rank <= 5")


@query("random_seed", "SELECT doc_id, rep::INTEGER rep, ('0x'||substr(sha256('random|'||doc_id||'|'||rep),1,8))::BIGINT seed FROM documents, range(1,4) t(rep)")
def random_seed(spark, d):
    """A 32-bit seed of each exercise and repetition."""
    x = docs(spark, d).select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rep"))
    h = F.sha2(F.concat_ws("|", F.lit("random"), F.col("doc_id").cast("string"), F.col("rep").cast("string")), 256)
    return x.select("doc_id", "rep", F.conv(F.substring(h, 1, 8), 16, 10).cast("long").alias("seed"))


def camel(text):
    """Words of identifiers: case changes, digits and underscores end a word."""
    x = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z])([A-Z][a-z])", "$1 $2")
    return F.transform(F.regexp_extract_all(x, F.lit("[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+"), F.lit(0)), F.lower)


CAMEL_SQL = r"list_transform(regexp_extract_all(regexp_replace(regexp_replace(x,'([a-z0-9])([A-Z])','\1 \2','g'),'([A-Z])([A-Z][a-z])','\1 \2','g'),'[A-Z][a-z]+|[A-Z]+|[a-z]+|[0-9]+'), lambda y: lower(y))"


@query("camel_tokens", f"SELECT p_partkey, array_to_string({CAMEL_SQL},',') words FROM (SELECT p_partkey, 'HTTPRequest'||p_brand||replace(p_type,' ','')||'_Log'||p_size x FROM part)")
def camel_tokens(spark, d):
    x = F.concat(F.lit("HTTPRequest"), "p_brand", F.regexp_replace("p_type", " ", ""), F.lit("_Log"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.array_join(camel(x), ",").alias("words"))


@query("struct_bm25", f"""WITH base AS (SELECT p_partkey doc_id, array_to_string({CAMEL_SQL},' ') text FROM (SELECT p_partkey, p_brand||replace(initcap_type,' ','') x FROM (SELECT p_partkey, p_brand, p_type initcap_type FROM part))),
 tok AS (SELECT doc_id id, unnest({TOKENS}) t FROM base), tf AS (SELECT id, t, count(*) f FROM tok GROUP BY ALL), dl AS (SELECT id, count(*) dl FROM tok GROUP BY 1),
 st AS (SELECT (SELECT count(*) FROM base) nd, (SELECT count(*) FROM tok)::DOUBLE/(SELECT count(*) FROM base) avgdl), df AS (SELECT t, count(*) df FROM tf GROUP BY 1), {IDF},
 qt AS (SELECT p_size q, t, count(*) c FROM (SELECT p_size, unnest(regexp_extract_all(lower(min(p_type)),'[\\p{{L}}\\p{{N}}]+')) t FROM part GROUP BY 1) GROUP BY ALL),
 {SCORED}, {all_sql('SELECT DISTINCT p_size q FROM part', 'SELECT doc_id id FROM base')}, {RANKED} SELECT q p_size, id p_partkey, score, rank FROM rk WHERE rank<=3""")
def struct_bm25(spark, d):
    """BM25 over the words of identifiers instead of running text."""
    p = table(spark, d, "part")
    base = p.select("p_partkey", F.array_join(camel(F.concat("p_brand", F.regexp_replace("p_type", " ", ""))), " ").alias("text"))
    q = p.groupBy("p_size").agg(F.min("p_type").alias("text"))
    index = R.index(base, "p_partkey", "text")
    s = blockmax.top(index["docs"], R.bm25_queries(index, R.query_terms(q, "p_size", "text"), q.select(F.col("p_size").alias("q"))), 3)
    return s.select(F.col("q").alias("p_size"), F.col("id").alias("p_partkey"), "score", "rank")


@query("mmr_top3", f"""{BM25}, n AS (SELECT *, CASE WHEN max(score) OVER w=min(score) OVER w THEN 1.0 ELSE (score-min(score) OVER w)/(max(score) OVER w-min(score) OVER w) END rel FROM rk WINDOW w AS (PARTITION BY q)),
 tk AS (SELECT doc_id id, list_distinct({TOKENS}) toks FROM documents), c AS (SELECT n.*, toks FROM n JOIN tk USING(id)),
 p1 AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7*rel,9) DESC, rank)=1),
 c2 AS (SELECT c.*, len(list_intersect(c.toks,p1.toks))/len(list_distinct(c.toks||p1.toks)) m FROM c JOIN p1 ON c.q=p1.q AND c.id<>p1.id),
 p2 AS (SELECT * FROM c2 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7*rel-0.3*m,9) DESC, rank)=1),
 c3 AS (SELECT c2.q, c2.id, c2.rank, c2.rel, greatest(c2.m, len(list_intersect(c2.toks,p2.toks))/len(list_distinct(c2.toks||p2.toks))) m FROM c2 JOIN p2 ON c2.q=p2.q AND c2.id<>p2.id),
 p3 AS (SELECT * FROM c3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(0.7*rel-0.3*m,9) DESC, rank)=1)
 SELECT q item_id, id doc_id, 1 pick FROM p1 UNION ALL SELECT q, id, 2 FROM p2 UNION ALL SELECT q, id, 3 FROM p3""")
def mmr_top3(spark, d):
    """Relevance is scaled over, and chosen among, the whole ranking."""
    picks = R.mmr_whole(*bm25(spark, d), 3)
    return picks.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "pick")


CUES = [("license", "license|licence"), ("caps", "[A-Z]{4,}!!"), ("table", r"\|")]


@query("cue_boost", f"""{BM25}, cu AS (SELECT doc_id id, coalesce(regexp_matches(text,'license|licence')::INT+regexp_matches(text,'[A-Z]{{4,}}!!')::INT+regexp_matches(text,'\\|')::INT,0) n FROM documents),
 qc AS (SELECT item_id q, strlen(text)>150 cue FROM benchmark), rc AS (SELECT q, id, CAST(row_number() OVER (PARTITION BY q ORDER BY n DESC, id) AS INTEGER) rank FROM rk JOIN cu USING(id)),
 f AS (SELECT q, id, sum(x) score FROM (SELECT q, id, 1.0::DOUBLE/(60+rank) x FROM rk UNION ALL SELECT q, id, 1.0::DOUBLE/(60+rank) FROM rc JOIN qc USING(q) WHERE cue) GROUP BY ALL)
 SELECT q item_id, id doc_id, round(score,8) score, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score,8) DESC, id) AS INTEGER) rank FROM f QUALIFY rank<=3""")
def cue_boost(spark, d):
    """Fusion with a ranking by constructs, for queries that cue them; others keep the base ranking."""
    every, queries = bm25(spark, d)
    n = F.coalesce(sum((F.col("text").rlike(p).cast("double") for _, p in CUES), F.lit(0.0)), F.lit(0.0))
    # the cosine of (n, 1) with (1, 0) grows with n
    cues = docs(spark, d).select(F.col("doc_id").alias("id"), F.array(n, F.lit(1.0)).alias("v"))
    cued = bench(spark, d).where(F.octet_length("text") > 150).select(F.col("item_id").alias("q")).distinct().select("q", F.lit(0).alias("s"), F.array(F.lit(1.0), F.lit(0.0)).alias("v"))
    return R.rank(R.fused([every, cues], [queries, cued], 3), 3, 8).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query("quality_weighted", f"{BM25}, w AS (SELECT q, id, round(score*(CASE WHEN quality IS NULL THEN 0.5 ELSE quality END),6) score FROM s LEFT JOIN labels ON doc_id=id) SELECT q item_id, id doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS INTEGER) rank FROM w QUALIFY rank<=3")
def quality_weighted(spark, d):
    lab = table(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    every, queries = bm25(spark, d)
    weighted = every.join(lab, "id", "left").select("id", "toks", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("factor"))
    return blockmax.top(weighted, queries, 3).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


PROFILE = """WITH e AS (SELECT l_suppkey id, l_returnflag k, count(*) n FROM lineitem GROUP BY ALL), z AS (SELECT id, sum(n) tot FROM e GROUP BY 1),
 pr AS (SELECT s.s_suppkey id, f.k, coalesce(n,0)::DOUBLE/nullif(coalesce(tot,0),0) p FROM supplier s CROSS JOIN (VALUES ('A'),('N'),('R')) f(k) LEFT JOIN e ON e.id=s.s_suppkey AND e.k=f.k LEFT JOIN z ON z.id=s.s_suppkey)"""


QUERY_SET = "JOIN (SELECT s_suppkey qq FROM supplier WHERE s_suppkey%100=0) ON qq=a.id"


@query("profile_similarity", PROFILE + f""", l1 AS (SELECT a.id q, b.id id, sum(abs(coalesce(a.p,0)-coalesce(b.p,0))) d FROM pr a JOIN pr b ON a.k=b.k AND a.id<>b.id {QUERY_SET} GROUP BY ALL)
 SELECT q, l1.id id, round(0.5*((1-0.5*d)+CASE WHEN coalesce(x.tot,0)=0 AND coalesce(y.tot,0)=0 THEN 1 ELSE least(coalesce(x.tot,0),coalesce(y.tot,0))::DOUBLE/greatest(coalesce(x.tot,0),coalesce(y.tot,0)) END),6) s FROM l1 LEFT JOIN z x ON x.id=q LEFT JOIN z y ON y.id=l1.id""")
def profile_similarity(spark, d):
    """Half the likeness of edge-type profiles, half the ratio of sizes, of the query set (ids divisible by 100) and all graphs; graphs without edges have a zero profile, two of them the ratio 1."""
    p = _profiles(spark, d)
    n = p.select("id", "n")
    pairs = R.nearest(p.where("id % 100 = 0").select(F.col("id").alias("q"), F.col("p").alias("v")), p.select("id", F.col("p").alias("v")), measure="profile")
    pairs = pairs.join(n.select(F.col("id").alias("q"), F.col("n").alias("a_n")), "q").join(n.select("id", F.col("n").alias("b_n")), "id")
    ratio = F.when(F.greatest("a_n", "b_n") == 0, 1.0).otherwise(F.least("a_n", "b_n") / F.greatest("a_n", "b_n"))
    return pairs.select("q", "id", F.round(0.5 * (F.col("score") + ratio), 6).alias("s"))


def _profiles(spark, d):
    """(id, n, p): edges of each graph and the shares of their types."""
    e = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("id")).pivot("l_returnflag", ["A", "N", "R"]).count().na.fill(0)
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")).join(e, "id", "left").na.fill(0)
    tot = F.col("A") + F.col("N") + F.col("R")
    return p.select("id", tot.alias("n"), F.array(*[F.when(tot > 0, F.col(c) / tot).otherwise(0.0) for c in "ANR"]).alias("p"))


@query("measure_at_k", f"{DENSE}, g AS (SELECT rk.*, (x.label=y.label)::INT rel FROM rk JOIN embeddings x ON x.vec_id=q JOIN embeddings y ON y.vec_id=id WHERE rank<=5), m AS (SELECT k::INTEGER k, q, avg(rel) m FROM g, (VALUES (1),(3),(5)) t(k) WHERE rank<=k GROUP BY ALL) SELECT k, round(avg(m),6) measure FROM m GROUP BY 1")
def measure_at_k(spark, d):
    """Mean over queries of the mean relevance of the first k."""
    lab = table(spark, d, "embeddings").select("vec_id", "label")
    top = R.rank(dense_scores(spark, d), 5).join(lab.select(F.col("vec_id").alias("q"), F.col("label").alias("lq")), "q").join(lab.select(F.col("vec_id").alias("id"), F.col("label").alias("li")), "id")
    per = top.select("q", "rank", (F.col("lq") == F.col("li")).cast("int").alias("rel"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("k")).where("rank <= k").groupBy("k", "q").agg(F.avg("rel").alias("m"))
    return per.groupBy("k").agg(F.round(F.avg("m"), 6).alias("measure"))


L1 = f"l1 AS (SELECT a.id a, b.id b, round(1-0.5*sum(abs(coalesce(a.p,0)-coalesce(b.p,0))),6) sim FROM pr a JOIN pr b ON a.k=b.k AND a.id<>b.id {QUERY_SET} GROUP BY ALL)"


@query("oracle_topk", f"{PROFILE}, {L1} SELECT a q, b id, sim, CAST(row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS INTEGER) rank FROM l1 QUALIFY rank<=3")
def oracle_topk(spark, d):
    """The most similar graphs by their profiles, for the query set (ids divisible by 100)."""
    return _oracle(spark, d).select("q", "id", F.col("score").alias("sim"), "rank")


def _oracle(spark, d):
    p = _profiles(spark, d).select("id", F.col("p").alias("v"))
    return R.rank(pivots.nearest(p.where("id % 100 = 0").select(F.col("id").alias("q"), "v"), pivots.index(p, "profile"), 3), 3)


@query("oracle_at_k", f"{PROFILE}, {L1}, r AS (SELECT a, sim, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) rank FROM l1), m AS (SELECT k::INTEGER k, a, avg(sim) m FROM r, (VALUES (1),(3)) t(k) WHERE rank<=k GROUP BY ALL) SELECT k, round(avg(m),6) best FROM m GROUP BY 1")
def oracle_at_k(spark, d):
    """The best that any ranking could reach at k."""
    top = _oracle(spark, d).select("q", "score", "rank", F.explode(F.array(F.lit(1), F.lit(3))).alias("k")).where("rank <= k")
    return top.groupBy("k", "q").agg(F.avg("score").alias("m")).groupBy("k").agg(F.round(F.avg("m"), 6).alias("best"))


@query("hubness", f"{BM25}, f AS (SELECT id, count(*) FILTER (rank=1) n1, count(*) FILTER (rank<=3) n3 FROM rk GROUP BY 1), a AS (SELECT doc_id, coalesce(n1,0) n1, coalesce(n3,0) n3 FROM documents LEFT JOIN f ON id=doc_id) SELECT count(*) FILTER (n1>0) distinct_top1, count(*) FILTER (n3>0) distinct_top3, count(*) FILTER (n3=0) never, arg_min(doc_id,(-n3,doc_id)) hub, max(n3) hub_n, arg_min(doc_id,(-n1,doc_id)) hub1, max(n1) hub1_n FROM a")
def hubness(spark, d):
    n = best(spark, d, 3).groupBy(F.col("id").alias("doc_id")).agg(F.count_if(F.col("rank") == 1).alias("n1"), F.count(F.lit(1)).alias("n3"))
    a = docs(spark, d).select("doc_id").join(n, "doc_id", "left").na.fill(0)
    hub = lambda c: F.min_by("doc_id", F.struct(-F.col(c), "doc_id"))
    return a.agg(F.count_if(F.col("n1") > 0).alias("distinct_top1"), F.count_if(F.col("n3") > 0).alias("distinct_top3"), F.count_if(F.col("n3") == 0).alias("never"), hub("n3").alias("hub"), F.max("n3").alias("hub_n"), hub("n1").alias("hub1"), F.max("n1").alias("hub1_n"))


@query("topk_overlap", f"{BM25}, {RUN_B}, o AS (SELECT a.q, count(b.id) n, bool_or(a.rank=1 AND b.rank=1) same1 FROM (SELECT * FROM rk WHERE rank<=3) a LEFT JOIN (SELECT * FROM rb WHERE rank<=3) b ON a.q=b.q AND a.id=b.id GROUP BY 1) SELECT q item_id, n overlap, round(n/3.0,6) share, coalesce(same1,false) same_top1 FROM o")
def topk_overlap(spark, d):
    """What the first three of BM25 and of the vectors have in common."""
    a = best(spark, d, 3)
    b = blockmax.top(*dense(spark, d), 3).select("q", "id", F.col("rank").alias("rank_b"))
    j = a.join(b, ["q", "id"], "left").groupBy("q").agg(F.count("rank_b").alias("overlap"), F.coalesce(F.bool_or((F.col("rank") == 1) & (F.col("rank_b") == 1)), F.lit(False)).alias("same_top1"))
    return j.select(F.col("q").alias("item_id"), "overlap", F.round(F.col("overlap") / 3.0, 6).alias("share"), "same_top1")


@query("tie_report", f"{BM25}, l AS (SELECT *, lead(score) OVER (PARTITION BY q ORDER BY rank) nxt FROM rk) SELECT q item_id, count(*) FILTER (rank<3 AND score=nxt) inside, coalesce(bool_or(rank=3 AND score=nxt),false) boundary, count(DISTINCT score) distinct_scores FROM l GROUP BY 1")
def tie_report(spark, d):
    """Ties inside the first three and at their edge, and how many scores the whole ranking has."""
    s = blockmax.scores(*bm25(spark, d))
    r = best(spark, d, 4).withColumn("nxt", F.lead("score").over(Window.partitionBy("q").orderBy("rank")))
    tie = F.col("score") == F.col("nxt")
    top = r.groupBy("q").agg(F.count_if((F.col("rank") < 3) & tie).alias("inside"), F.coalesce(F.bool_or((F.col("rank") == 3) & tie), F.lit(False)).alias("boundary"))
    nd = ids(spark, d).agg(F.count(F.lit(1)).alias("nd"))
    n = s.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("score").alias("k"), F.bool_or(F.col("score") == 0).alias("zero"))
    zeros = F.when((F.coalesce("n", F.lit(0)) < F.col("nd")) & ~F.coalesce("zero", F.lit(False)), 1).otherwise(0)
    return top.join(n, "q", "left").crossJoin(F.broadcast(nd)).select(F.col("q").alias("item_id"), "inside", "boundary", (F.coalesce("k", F.lit(0)) + zeros).alias("distinct_scores"))


WORDS2 = r"regexp_extract_all(lower(text),'[\p{L}\p{N}_]{2,}')"


def tfidf_sql(base):
    return f"""tk AS (SELECT id, unnest({WORDS2}) t FROM {base}), tf AS (SELECT id, t, count(*) f FROM tk GROUP BY ALL), n AS (SELECT count(*) n FROM {base}),
 df AS (SELECT t, count(*) df FROM tf GROUP BY 1), wr AS (SELECT id, t, (1+ln(f))*(ln((1+n)/(1+df))+1) w FROM tf JOIN df USING(t), n),
 w AS (SELECT id, t, w/sqrt(sum(w*w) OVER (PARTITION BY id)) w FROM wr)"""


def word_array(text):
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


@query("tfidf_leakage", f"WITH base AS (SELECT doc_id id, text FROM documents UNION ALL SELECT -1-item_id, text FROM benchmark), {tfidf_sql('base')} SELECT -1-a.id item_id, b.id doc_id, round(sum(a.w*b.w),6) sim FROM w a JOIN w b ON a.t=b.t AND a.id<0 AND b.id>=0 GROUP BY a.id, b.id HAVING round(sum(a.w*b.w),6)>=0.4")
def tfidf_leakage(spark, d):
    """Benchmark items and documents whose TF-IDF cosine is 0.4 or more."""
    base = R.spread(docs(spark, d).select(F.col("doc_id").alias("id"), "text")).unionByName(bench(spark, d).select((-1 - F.col("item_id")).alias("id"), "text"))
    p = bags.matches(bags.bags(base.select("id", word_array(F.col("text")).alias("toks"))), 0.4, F.col("id") < 0)
    return p.select((-1 - F.col("a")).alias("item_id"), F.col("b").alias("doc_id"), "sim")


NEAR = f"WITH base AS (SELECT doc_id id, text FROM documents), {tfidf_sql('base')}, p AS (SELECT a.id a, b.id b, round(sum(a.w*b.w),6) sim FROM w a JOIN w b ON a.t=b.t AND a.id<b.id GROUP BY a.id, b.id HAVING round(sum(a.w*b.w),6)>=0.8)"


def near_classes(spark, d):
    """Classes of documents with equal bags of words (id, rep), and pairs of representatives whose TF-IDF cosine is 0.8 or more."""
    base = R.spread(docs(spark, d).select(F.col("doc_id").alias("id"), "text"))
    rows = bags.bags(base.select("id", word_array(F.col("text")).alias("toks")))
    n, rows = rows.count(), bags.merged(rows)
    c = bags.classes(rows)
    return c, bags.near(bags.vectors(rows, n, c.where("id = rep").select("id")), 0.8, R.LEVELS)


@query("near_dup_pairs", f"{NEAR}, c AS (SELECT id, min(id) OVER (PARTITION BY bag) rep, count(*) OVER (PARTITION BY bag) n FROM (SELECT id, list_sort({WORDS2}) bag FROM base) WHERE len(bag)>0) SELECT a, b, sim, x.n copies_a, y.n copies_b FROM p JOIN c x ON x.id=a AND x.rep=a JOIN c y ON y.id=b AND y.rep=b")
def near_dup_pairs(spark, d):
    """Pairs of documents whose TF-IDF cosine is 0.8 or more, one of each class of equal bags of words, with the size of both classes."""
    c, p = near_classes(spark, d)
    n = c.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n.select(F.col("rep").alias("a"), F.col("n").alias("copies_a")), "a").join(n.select(F.col("rep").alias("b"), F.col("n").alias("copies_b")), "b").select("a", "b", "sim", "copies_a", "copies_b")


@query("pair_partners", f"{NEAR} SELECT id doc_id, count(*) n, min(o) first_partner FROM (SELECT a id, b o FROM p UNION ALL SELECT b, a FROM p) GROUP BY 1")
def pair_partners(spark, d):
    """How many partners each document has, and the first: its own copies, and all copies of what its class is similar to."""
    c, p = near_classes(spark, d)
    n = c.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id") != F.col("rep"), F.col("id"))).alias("second"))
    both = p.select(F.col("a").alias("rep"), F.col("b").alias("o")).unionByName(p.select(F.col("b").alias("rep"), F.col("a").alias("o")))
    far = both.join(n.select(F.col("rep").alias("o"), F.col("n").alias("m")), "o").groupBy("rep").agg(F.sum("m").alias("m"), F.min("o").alias("o"))
    x = c.join(n, "rep").join(far, "rep", "left")
    own = F.when(F.col("id") == F.col("rep"), F.col("second")).otherwise(F.col("rep"))
    x = x.select(F.col("id").alias("doc_id"), (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n"), F.least(own, F.col("o")).alias("first_partner"))
    return x.where("n > 0")


@query("jaccard_pairs", f"WITH tk AS (SELECT doc_id, list_distinct({TOKENS}) a FROM documents), q AS (SELECT item_id, list_distinct({TOKENS}) b FROM benchmark) SELECT item_id, doc_id, CASE WHEN len(list_distinct(a||b))=0 THEN 0.0 ELSE round(len(list_intersect(a,b))/len(list_distinct(a||b)),6) END jac FROM tk, q WHERE len(list_intersect(a,b))>=3")
def jaccard_pairs(spark, d):
    """Jaccard of the word sets of items and documents that share three words; counted by a join on words."""
    a = docs(spark, d).select(F.col("doc_id"), F.array_distinct(R.token_array(F.col("text"))).alias("x")).select("doc_id", F.size("x").alias("nx"), F.explode("x").alias("t"))
    b = bench(spark, d).select("item_id", F.array_distinct(R.token_array(F.col("text"))).alias("y")).select("item_id", F.size("y").alias("ny"), F.explode("y").alias("t"))
    both = a.join(b, "t").groupBy("item_id", "doc_id", "nx", "ny").agg(F.count(F.lit(1)).alias("c")).where("c >= 3")
    return both.select("item_id", "doc_id", F.round(F.col("c") / (F.col("nx") + F.col("ny") - F.col("c")), 6).alias("jac"))


PIECE = 64


@query("chunk_mean_vec", f"""WITH w AS (SELECT doc_id id, unnest(a) t, (generate_subscripts(a,1)-1)//{PIECE} p FROM (SELECT doc_id, {TOKENS} a FROM documents)), {encode_sql('e', 'w', 'id, p')},
 np AS (SELECT id, max(p)+1 n FROM w GROUP BY 1), m AS (SELECT id, i, sum(v)/n e FROM e JOIN np USING(id) GROUP BY id, i, n), l AS (SELECT id, sqrt(sum(e*e)) l FROM m GROUP BY 1)
 SELECT d.doc_id, x.i::INTEGER i, round(coalesce(e/nullif(l,0),0.0),5) v FROM (SELECT id doc_id FROM np) d CROSS JOIN range(16) x(i) LEFT JOIN m ON m.id=d.doc_id AND m.i=x.i LEFT JOIN l ON l.id=d.doc_id""")
def chunk_mean_vec(spark, d):
    """Texts in pieces of 64 words, each encoded as a unit vector; the mean of a text's pieces, scaled to unit length again."""
    t = docs(spark, d).select(F.col("doc_id").alias("id"), F.posexplode(R.token_array(F.col("text"))).alias("at", "t")).withColumn("p", F.floor(F.col("at") / PIECE))
    piece = R.encode(t, "id", "p")
    m = piece.groupBy("id").agg(*[F.avg(F.col("v")[k]).alias(f"m{k}") for k in range(R.DIM)])
    norm = F.sqrt(sum((F.col(f"m{k}") * F.col(f"m{k}") for k in range(1, R.DIM)), F.col("m0") * F.col("m0")))
    unit = F.array(*[F.round(F.coalesce(F.try_divide(F.col(f"m{k}"), norm), F.lit(0.0)), 5) for k in range(R.DIM)])
    return m.select(F.col("id").alias("doc_id"), F.posexplode(unit).alias("i", "v"))


@query("hash_encoder", f"WITH {TOK}, {encode_sql('e', 'tok')} SELECT d.id doc_id, x.i::INTEGER i, round(coalesce(e.v,0.0),6) v FROM (SELECT DISTINCT id FROM tok) d CROSS JOIN range(16) x(i) LEFT JOIN e ON e.id=d.id AND e.i=x.i")
def hash_encoder(spark, d):
    """A stand-in for an encoder: signed feature hashing of words into 16 numbers, scaled to unit length."""
    v = R.encode(R.tokens(docs(spark, d), "doc_id", "text"), "id")
    return v.select(F.col("id").alias("doc_id"), F.posexplode("v").alias("i", "v")).select("doc_id", "i", F.round("v", 6).alias("v"))


@query("struct_dense", f"""WITH base AS (SELECT p_partkey id, {CAMEL_SQL} a FROM (SELECT p_partkey, p_brand||replace(p_type,' ','') x FROM part)), tok AS (SELECT id, unnest(a) t FROM base),
 qtok AS (SELECT p_size id, unnest(regexp_extract_all(lower(min(p_type)),'[\\p{{L}}\\p{{N}}]+')) t FROM part GROUP BY 1), {encode_sql('ev', 'tok')}, {encode_sql('eq', 'qtok')},
 s AS (SELECT q, id, coalesce(score,0.0) score FROM (SELECT DISTINCT id q FROM qtok) CROSS JOIN (SELECT DISTINCT id FROM tok) LEFT JOIN (SELECT eq.id q, ev.id id, round(sum(eq.v*ev.v),6) score FROM eq JOIN ev USING(i) GROUP BY ALL) USING(q,id)), {RANKED}
 SELECT q p_size, id p_partkey, score, rank FROM rk WHERE rank<=3""")
def struct_dense(spark, d):
    """Vectors of the words of identifiers instead of running text."""
    p = table(spark, d, "part")
    words = p.select(F.col("p_partkey").alias("id"), F.explode(camel(F.concat("p_brand", F.regexp_replace("p_type", " ", "")))).alias("t"))
    q = R.tokens(p.groupBy("p_size").agg(F.min("p_type").alias("text")), "p_size", "text").withColumn("id", F.col("id").cast("long"))
    s = R.nearest(R.encode(q, "id").select(F.col("id").alias("q"), "v"), R.encode(words, "id"), 3, own=True)
    top = R.rank(R.with_zeros(s, q.select(F.col("id").alias("q")), words.select("id").distinct(), 3), 3)
    return top.select(F.col("q").alias("p_size"), F.col("id").alias("p_partkey"), "score", "rank")


@query("stem_tokens")
def stem_tokens(spark, d):
    """English stems, computed for each different word once."""
    from ..functions.stem import stem_column

    t = R.tokens(docs(spark, d), "doc_id", "text").groupBy(F.col("t")).agg(F.count(F.lit(1)).alias("n"))
    return t.select("t", "n", stem_column("t").alias("stem"))
