"""Retrieval: tokens, postings, BM25 with leave-one-out statistics, vectors, fusion, re-ranking and ranking measures."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blockmax

TOKEN = r"[\p{L}\p{N}]+"


def token_array(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def tokens(df: DataFrame, id_col: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """(id, t): a row for each token occurrence, stopwords left out."""
    out = df.select(F.col(id_col).alias("id"), F.explode(token_array(F.col(text))).alias("t"))
    return out.where(~F.col("t").isin(stop)) if stop else out


def postings(toks: DataFrame) -> DataFrame:
    """(id, t, f)"""
    return toks.groupBy("id", "t").agg(F.count(F.lit(1)).alias("f"))


def _idf_raw(n: Column, d: Column) -> Column:
    return F.log(n - d + 0.5) - F.log(d + 0.5)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if it comes in fewer (a small file of one row group); as it is otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def index(docs: DataFrame, id_col: str, text: str, stop: list[str] | None = None, toks: DataFrame | None = None, change=None, packed: bool = False) -> dict[str, DataFrame]:
    """Documents as token lists (id, toks), document frequencies of terms (t, df) and corpus figures as one row; postings (tf) and lengths for those who need them.

    Ids are unique.  Only different terms of a document are shuffled for the frequencies, added up in the tasks first.  ``toks`` (id, t): tokens made elsewhere.  ``change``: a column
    function of a document's list of tokens, after stopwords; lists stay where they are.  ``packed``: words are 64-bit hashes, and the lists are written once, so that no text is split again by what reads them."""
    if toks is None:
        lists = spread(docs.select(F.col(id_col).alias("id"), F.col(text).alias("toks"))).withColumn("toks", token_array(F.col("toks")))
        lists = lists.withColumn("toks", F.filter("toks", lambda t: ~t.isin(stop))) if stop else lists
        lists = lists.withColumn("toks", change(F.col("toks"))) if change else lists
    else:
        lists = spread(docs.select(F.col(id_col).alias("id")).join(toks.groupBy("id").agg(F.collect_list("t").alias("toks")), "id", "left"))  # a document's own tokens
    return index_of(written(blockmax.hashed(lists)) if packed else lists)


def index_of(lists: DataFrame) -> dict[str, DataFrame]:
    """The index of documents as token lists (id, toks), as ``index`` returns it."""
    tf = postings(lists.select("id", F.explode("toks").alias("t")))
    length = lists.where(F.size("toks") > 0).select("id", F.size("toks").cast("long").alias("dl"))
    size = F.coalesce(F.sum(F.greatest(F.size("toks"), F.lit(0))), F.lit(0))
    figures = lists.agg(F.count(F.lit(1)).alias("nd"), size.cast("long").alias("total")).select("nd", "total", (F.col("total") / F.col("nd")).alias("avgdl"))
    df = lists.select(F.explode(F.array_distinct("toks")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    return {"docs": lists, "tf": tf, "length": length, "figures": figures, "df": df}


def _mean_idf(ix: dict[str, DataFrame]) -> DataFrame:
    """The mean raw idf of the vocabulary, as one row.  Terms are counted by their frequency first: a sum term by term errs by some 1e-12 of it at 900,000 terms, as most add the same number, which lets roundings add up."""
    spectrum = ix["df"].groupBy("df").agg(F.count(F.lit(1)).alias("h")).crossJoin(F.broadcast(ix["figures"]))
    return spectrum.agg((F.sum(F.col("h") * _idf_raw(F.col("nd"), F.col("df"))) / F.sum("h")).alias("mean"))


def idf(ix: dict[str, DataFrame], floor: float = 0.25) -> DataFrame:
    raw = ix["df"].crossJoin(F.broadcast(ix["figures"])).select("t", "df", _idf_raw(F.col("nd"), F.col("df")).alias("w"))
    return raw.crossJoin(F.broadcast(_mean_idf(ix))).select("t", "df", F.when(F.col("w") < 0, F.lit(floor) * F.col("mean")).otherwise(F.col("w")).alias("w"))


def bm25_weight(w: Column, f: Column, dl: Column, avgdl: Column, k1: float | Column = 1.5, b: float | Column = 0.75) -> Column:
    return w * f * (k1 + 1) / (f + k1 * (1 - b + b * dl / avgdl))


def bm25(ix: dict[str, DataFrame], queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(q, id, score) of documents that share a term with the query; ``queries``: (q, t, c) with c occurrences.

    The join is on terms, so only postings of query terms move."""
    terms = queries.join(idf(ix, floor), "t")
    hits = ix["tf"].join(terms, "t").join(ix["length"], "id").crossJoin(F.broadcast(ix["figures"]))
    return hits.groupBy("q", "id").agg(F.sum(F.col("c") * bm25_weight(F.col("w"), F.col("f"), F.col("dl"), F.col("avgdl"), k1, b)).alias("score"))


def bm25_self(ix: dict[str, DataFrame], queries: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """(q, self): the score of each query taken as a document of the index."""
    size = queries.groupBy("q").agg(F.sum("c").alias("dl"))
    terms = queries.join(idf(ix, floor), "t").join(size, "q").crossJoin(F.broadcast(ix["figures"]))
    return terms.groupBy("q").agg(F.sum(F.col("c") * bm25_weight(F.col("w"), F.col("c"), F.col("dl"), F.col("avgdl"), k1, b)).alias("self"))


def bm25_leave_one_out(ix: dict[str, DataFrame], members: DataFrame, k1: float = 1.5, b: float = 0.75, floor: float = 0.25) -> DataFrame:
    """Queries for ``blockmax.top`` of documents of the index (``members``: q), each left out of the statistics it is scored by.

    The index is built once.  What changes without q is algebra: one document and its tokens less, document frequencies of its terms less one, and the mean
    of raw idfs over the vocabulary, which depends on frequencies only through how many terms have each frequency."""
    one = F.broadcast(ix["figures"])
    mine = ix["docs"].join(members.select(F.col("q").alias("id")).distinct(), "id", "left_semi")
    own = postings(mine.select("id", F.explode("toks").alias("t"))).select(F.col("id").alias("q"), "t", F.col("f").alias("c"))
    own = own.join(ix["df"], "t")
    spectrum = ix["df"].groupBy("df").agg(F.count(F.lit(1)).alias("h"))
    vocabulary = spectrum.crossJoin(one).agg(F.sum(F.col("h") * _idf_raw(F.col("nd") - 1, F.col("df"))).alias("all"), F.sum("h").alias("v"))
    g = lambda d: _idf_raw(F.col("nd") - 1, d)
    change = own.crossJoin(one).groupBy("q").agg(
        F.sum(g(F.col("df"))).alias("out"), F.sum(F.when(F.col("df") > 1, g(F.col("df") - 1)).otherwise(0.0)).alias("back"),
        F.sum(F.when(F.col("df") == 1, 1).otherwise(0)).alias("gone"), F.sum("c").alias("own"),
    )
    change = change.crossJoin(F.broadcast(vocabulary)).crossJoin(one)
    change = change.select("q", ((F.col("all") - F.col("out") + F.col("back")) / (F.col("v") - F.col("gone"))).alias("mean"), ((F.col("total") - F.col("own")) / (F.col("nd") - 1)).alias("avgdl"), (F.col("nd") - 1).alias("n1"))
    terms = own.where("df > 1").join(change, "q")
    raw = _idf_raw(F.col("n1"), F.col("df") - 1)
    terms = terms.select("q", "t", "c", "avgdl", F.when(raw < 0, F.lit(floor) * F.col("mean")).otherwise(raw).alias("w"))
    given = terms.groupBy("q").agg(F.first("avgdl").alias("avgdl"), F.collect_list(F.struct("t", (F.col("c") * F.col("w")).alias("w"))).alias("terms"))
    out = members.select("q").distinct().join(given, "q", "left")
    return out.select("q", F.lit(0).alias("s"), F.lit(k1).alias("k1"), F.lit(b).alias("b"), "avgdl", "terms")


def bm25_queries(ix: dict[str, DataFrame], queries: DataFrame, items: DataFrame, settings: list[tuple[float, float]] = ((1.5, 0.75),), floor: float = 0.25) -> DataFrame:
    """Queries for ``blockmax.top``: ``items`` (q) with terms ``queries`` (q, t, c), once for each of ``settings`` (k1, b), numbered from 0; items without terms have none."""
    terms = queries.join(idf(ix, floor), "t").groupBy("q").agg(F.collect_list(F.struct("t", (F.col("c") * F.col("w")).alias("w"))).alias("terms"))  # a query's own terms
    out = items.select("q").distinct().join(terms, "q", "left").crossJoin(F.broadcast(ix["figures"].select("avgdl")))  # one row
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(k1)).alias("k1"), F.lit(float(b)).alias("b")) for i, (k1, b) in enumerate(settings)]))
    return out.select("q", "avgdl", "terms", each.alias("x")).select("q", "x.s", "x.k1", "x.b", "avgdl", "terms")


def rank(scores: DataFrame, k: int | None = None, digits: int = 6, by: tuple[str, ...] = ("q",)) -> DataFrame:
    """Adds rank from 1 by (score descending, id ascending), scores rounded first so that equal sums tie; at most ``k`` per query."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id"))
    out = scores.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def query_terms(queries: DataFrame, id_col: str, text: str, stop: list[str] | None = None, change=None, packed: bool = False) -> DataFrame:
    """(q, t, c); ``change`` and ``packed`` as for ``index``."""
    toks = tokens(queries, id_col, text, stop)
    if change:
        lists = queries.select(F.col(id_col).alias("id"), F.filter(token_array(F.col(text)), lambda t: ~t.isin(stop or [])).alias("toks"))
        toks = lists.withColumn("toks", change(F.col("toks"))).select("id", F.explode("toks").alias("t"))
    toks = toks.withColumn("t", F.xxhash64("t")) if packed else toks
    return toks.groupBy(F.col("id").alias("q"), "t").agg(F.count(F.lit(1)).alias("c"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _cosines(x, y):
    import numpy as np

    return (x / np.sqrt((x * x).sum(1, keepdims=True))) @ (y / np.sqrt((y * y).sum(1, keepdims=True))).T


def _profiles(x, y):
    """One less half the L1 distance, a block of rows at a time."""
    import numpy as np

    return 1 - 0.5 * np.concatenate([np.abs(x[k : k + 256, None, :] - y[None, :, :]).sum(2) for k in range(0, len(x), 256)])


MEASURES = {"cosine": _cosines, "profile": _profiles}
QUERY_BYTES = 32 << 20


def first_of(q, ids, score, k: int, digits: int = 6):
    """Places of the first ``k`` of each query by (score rounded, descending, id), so that many equal vectors don't all go on."""
    import numpy as np

    order = np.lexsort((ids, -blockmax.half_up(score, digits), q))
    start = np.flatnonzero(np.append(True, q[order][1:] != q[order][:-1])) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    return order[place < k]


def nearest(queries: DataFrame, vectors: DataFrame, k: int | None = None, measure: str = "cosine", own: bool = False, digits: int = 6) -> DataFrame:
    """(q, id, score): of each query (q, v) at least the ``k`` best of all vectors (id, v) by (score rounded to ``digits``, smaller id), with ``own`` off but its own id; all of them without ``k``.

    Queries are sent in blocks of QUERY_BYTES at most, one pass over the vectors for each block, so what is broadcast is bounded.  As many vectors meet a block in one product as
    ``blockmax.CELLS`` scores hold, and a task lets only its own k best go on.  Vectors that are null, of other length than the query's, or (for cosines) zero or not finite have no score."""
    import math

    spark = queries.sparkSession
    n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = max(1, math.ceil(n * (8 * (dim or 1) + 64) / QUERY_BYTES))

    def table_of(part: DataFrame):
        import numpy as np

        rows = [(r.q, np.array(r.v, dtype=np.float64)) for r in part.collect() if r.v is not None and None not in r.v]  # one block, of bounded size
        return {d: (np.array([q for q, v in rows if len(v) == d]), np.stack([v for _, v in rows if len(v) == d])) for d in {len(v) for _, v in rows}}

    def product(sent):
        def run(batches):
            import numpy as np
            import pyarrow as pa

            best = {d: blockmax.Best(len(qs), k) for d, (qs, _) in sent.value.items()} if k is not None else {}
            for b in batches:
                every, lists = b.column(0).to_numpy(), b.column(1)
                sizes = np.array([-1 if x is None else x for x in lists.value_lengths().to_pylist()])
                for d, (qs, y) in sent.value.items():
                    rows = np.flatnonzero(sizes == d)
                    rows = rows[np.argsort(every[rows], kind="stable")]
                    step = max(1, blockmax.CELLS // len(qs))
                    for lo in range(0, len(rows) if d else 0, step):
                        ids = every[rows[lo : lo + step]]
                        x = np.array(lists.take(pa.array(rows[lo : lo + step])).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, d)
                        with np.errstate(all="ignore"):
                            s = MEASURES[measure](x, y).T
                        if not own:
                            s[qs[:, None] == ids[None, :]] = np.nan
                        s[~np.isfinite(s)] = -np.inf
                        if k is not None:
                            best[d].merge_first(s, ids, digits)
                            continue
                        i, j = np.nonzero(s > -np.inf)
                        yield pa.RecordBatch.from_arrays([pa.array(qs[i], pa.int64()), pa.array(ids[j], pa.int64()), pa.array(s[i, j])], ["q", "id", "score"])
            for d, found in best.items():
                i, j = np.nonzero(found.score > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(sent.value[d][0][i], pa.int64()), pa.array(found.id[i, j], pa.int64()), pa.array(found.exact[i, j])], ["q", "id", "score"])

        return run

    out = None
    for block in range(blocks):
        part = table_of(queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block))
        got = vectors.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(product(spark.sparkContext.broadcast(part)), "q long, id long, score double")
        out = got if out is None else out.unionByName(got)
    return out


DIM = 16


def encode(toks: DataFrame, *by: str) -> DataFrame:
    """(by..., v): a stand-in for an encoder.  Each token adds 1 or -1 at one of DIM places, both by its MD5; the sum is scaled to unit length (zero stays zero)."""
    h = F.md5("t")
    digit = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("long")
    x = toks.select(*by, F.pmod(digit(1, 8), F.lit(DIM)).alias("i"), F.when(digit(9, 1) % 2 == 0, 1.0).otherwise(-1.0).alias("s"))
    v = x.groupBy(*by).agg(*[F.sum(F.when(F.col("i") == k, F.col("s")).otherwise(0.0)).alias(f"v{k}") for k in range(DIM)])
    norm = F.sqrt(sum((F.col(f"v{k}") * F.col(f"v{k}") for k in range(1, DIM)), F.col("v0") * F.col("v0")))
    return v.select(*by, F.array(*[F.coalesce(F.try_divide(F.col(f"v{k}"), norm), F.lit(0.0)) for k in range(DIM)]).alias("v"))


def encode_lists(lists: DataFrame) -> DataFrame:
    """(id, v) of documents (id, toks) as ``encode`` makes them, where they lie; null without tokens.  Each different word of a batch is hashed once."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            col = b.column(1)
            size = pc.fill_null(col.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = col.flatten().dictionary_encode()
            hexes = [hashlib.md5(w.encode()).hexdigest() for w in words.dictionary.to_pylist()]
            place, sign = np.array([int(h[7], 16) % DIM for h in hexes], np.int64), np.array([1.0 if int(h[8], 16) % 2 == 0 else -1.0 for h in hexes])
            at = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), size)
            v = np.bincount(row * DIM + place[at], sign[at], b.num_rows * DIM).reshape(-1, DIM) if len(at) else np.zeros((b.num_rows, DIM))
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v = np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)
            some = np.flatnonzero(size)
            offsets = np.append(0, np.cumsum(np.where(size > 0, DIM, 0))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[some].reshape(-1)), mask=pa.array(size == 0))], ["id", "v"])

    return lists.select("id", "toks").mapInArrow(run, f"id {dict(lists.dtypes)['id']}, v array<double>")


def draws(pool: DataFrame, queries: DataFrame, h: Column, k: int) -> DataFrame:
    """(q, id, h) of the first ``k`` of each query's draws, and some more: of all (q, id), q <> id, ``h`` is a uniform draw in hex digits.

    About 64 of a query lie under a bound; where k do, they hold its first k, and other queries keep all."""
    n = pool.count()
    low = F.col("h") < (f"{(64 << 32) // n:08x}" if n > 64 else "g")
    every = lambda q: spread(pool.select("id")).crossJoin(F.broadcast(q.select("q"))).where("id <> q").select("q", "id", h.alias("h"))  # noqa: E731  # one draw for each pair is the definition
    few = written(every(queries).where(low))
    full = few.groupBy("q").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    rest = written(queries.select("q").join(full, "q", "left_anti"))
    return few if rest.isEmpty() else few.unionByName(every(rest).where(~low))


def with_zeros(scores: DataFrame, queries: DataFrame, docs: DataFrame, k: int, own: bool = True, digits: int = 6) -> DataFrame:
    """``scores`` (q, id, score) and enough documents of score 0 to fill the first ``k`` places of every query: those of the smallest ids.

    Only queries with fewer than k scores above 0 meet the documents (id); with ``own`` off a query isn't filled with the document of its own id."""
    n = scores.groupBy("q").agg(F.count_if(F.round("score", digits) > 0).alias("above"))
    short = queries.select("q").distinct().join(n, "q", "left").where(F.coalesce("above", F.lit(0)) < k).select("q")
    fill = docs.select("id").crossJoin(short)
    fill = (fill if own else fill.where("id <> q")).join(scores.select("q", "id"), ["q", "id"], "left_anti")
    fill = fill.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("id"))).where(F.col("n") <= k)
    return scores.select("q", "id", "score").unionByName(fill.select("q", "id", F.lit(0.0).alias("score")))


def reciprocal_rank_fusion(runs: list[DataFrame], c: int = 60) -> DataFrame:
    """(q, id, score) of runs (q, id, rank): the sum of 1 / (c + rank); a side without the id adds nothing."""
    every = [r.select("q", "id", (F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("s")) for r in runs]
    out = every[0]
    for r in every[1:]:
        out = out.unionByName(r)
    return out.groupBy("q", "id").agg(F.sum("s").alias("score"))


def fusion_depth(k: int, runs: int = 2, c: int = 60) -> int:
    """From how many places of each of ``runs`` full rankings the first ``k`` of their fusion come.

    The first k of one ranking have 1 / (c + k) at least, so k documents do; one beyond the depth in all rankings has runs / (c + depth + 1) at most, which is less."""
    return runs * (c + k) - c


def fused(docs: list[DataFrame], queries: list[DataFrame], k: int, c: int = 60, own: bool = True, digits: int | None = 6) -> DataFrame:
    """(q, id, score) of all documents that can be among the first ``k`` of the fusion of full rankings, by scorers (documents, queries) as ``blockmax.top`` takes them.

    A threshold algorithm whose stop is known beforehand: the first ``fusion_depth`` places of each ranking are the candidates, and what they are worth elsewhere are their places there, counted
    without a ranking.  Documents are read three times for each ranking, so their words (as hashes) or vectors are written once."""
    depth = fusion_depth(k, len(docs), c)
    docs = [written(blockmax.contents(d.drop("factor"), blockmax.kind_of(q))) for d, q in zip(docs, queries, strict=True)]
    firsts = [blockmax.top(d, q, depth, own, digits).select("q", "id", "rank") for d, q in zip(docs, queries, strict=True)]
    candidates = firsts[0].select("q", "id")
    for f in firsts[1:]:
        candidates = candidates.unionByName(f.select("q", "id"))
    candidates = held(candidates.distinct())
    return reciprocal_rank_fusion([blockmax.ranks(d, q, candidates, digits, own) for d, q in zip(docs, queries, strict=True)], c)


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session that names none gets a temporary one."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodestone-"))
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder there."""
    return f"{shared_root(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex[:12]}"


def held(df: DataFrame) -> DataFrame:
    """``df`` made once, in the shared folder."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` made once, as Parquet in the shared folder: unlike a checkpoint it is made in one pass, and packed."""
    path = shared_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def min_max(scores: DataFrame) -> DataFrame:
    """Adds norm: the score on [0, 1] within its query, 1 where all are equal."""
    w = Window.partitionBy("q")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("norm", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


def mmr(candidates: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(q, id, pick) of candidates (q, id, rank, rel, toks): at each step the largest weight * rel - (1 - weight) * the largest Jaccard
    similarity with what is chosen; ties in the base order.  The steps are unrolled, one window each."""
    chosen = F.col("chosen")
    pool = candidates.withColumn("most", F.lit(0.0)).withColumn("pick", F.lit(None).cast("int"))
    for step in range(1, k + 1):
        value = F.when(F.col("pick").isNull(), F.round(F.lit(weight) * F.col("rel") - F.lit(1 - weight) * F.col("most"), 9))
        first = F.row_number().over(Window.partitionBy("q").orderBy(value.desc_nulls_last(), F.col("rank")))
        pool = pool.withColumn("n", first).withColumn("pick", F.when((F.col("n") == 1) & F.col("pick").isNull(), step).otherwise(F.col("pick")))
        if step < k:
            pool = pool.withColumn("chosen", F.max(F.when(F.col("pick") == step, F.col("toks"))).over(Window.partitionBy("q")))
            union = F.size(F.array_union("toks", chosen))
            sim = F.when(union > 0, F.size(F.array_intersect("toks", chosen)) / union).otherwise(0.0)
            pool = pool.withColumn("most", F.greatest("most", F.coalesce(sim, F.lit(0.0)))).drop("chosen")
    return pool.where("pick is not null").select("q", "id", "pick")


def mmr_whole(docs: DataFrame, queries: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """(q, id, pick) as ``mmr``, chosen among all ``docs`` (id, toks) for each of ``queries``, both as ``blockmax.top`` takes them.

    Relevance is the score on [0, 1] within the whole ranking.  Each pick is a pass over the documents: queries travel with the word sets of what they have chosen, a task looks only at documents whose
    relevance alone could beat its best so far, and one row for each query and task leaves it.  What is chosen, ``k`` documents a query, is written between the passes."""
    rows = written(blockmax.hashed(docs).select("id", "toks").withColumn("words", F.array_sort(F.array_distinct(F.coalesce("toks", F.array().cast("array<bigint>"))))))
    first = blockmax.top(rows.select("id", "toks"), queries, 1, spans=True).select("q", "id", "lo", "hi")
    state = held(first.join(rows.select("id", "words"), "id").select("q", F.array("id").alias("ids"), F.array("words").alias("sets"), "lo", "hi"))
    for _ in range(1, k):
        got = blockmax.next_picks(rows, queries.join(state, "q"), weight)
        grown = state.join(got, "q", "left").select("q", F.when(F.col("id").isNull(), F.col("ids")).otherwise(F.array_append("ids", F.col("id"))).alias("ids"), F.when(F.col("id").isNull(), F.col("sets")).otherwise(F.array_append("sets", F.col("words"))).alias("sets"), "lo", "hi")
        state = held(grown)
    return state.select("q", F.posexplode("ids").alias("pos", "id")).select("q", "id", (F.col("pos") + 1).alias("pick"))


def classes(toks: DataFrame) -> DataFrame:
    """(id, rep): documents of equal token multisets, named after the smallest id; documents without tokens aren't there."""
    bag = postings(toks).groupBy("id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("t", "f")))), 256).alias("bag"))
    return bag.select("id", "bag").join(bag.groupBy("bag").agg(F.min("id").alias("rep")), "bag").select("id", "rep")


def tfidf(toks: DataFrame, corpus: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, t, df, w): sublinear tf times smoothed idf, scaled to unit length.  ``corpus``: all ids, texts without tokens too.  ``only`` (id): documents to weigh; frequencies are those of all."""
    tf = postings(toks)
    n = corpus.agg(F.count(F.lit(1)).alias("n"))
    df = tf.groupBy("t").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("t", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = tf if only is None else tf.join(only, "id", "left_semi")
    raw = tf.join(df, "t").select("id", "t", "df", ((1 + F.log("f")) * F.col("idf")).alias("w"))
    return raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id"))))


def _dots(batches):
    """(a, b, terms and weights of one, of the other) -> (a, b, sim)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = []
        for k in (2, 4):
            t, w = batch.column(k), batch.column(k + 1)
            lists.append((t.offsets.to_numpy() - t.offsets[0].as_py(), t.flatten().to_numpy(), w.flatten().to_numpy()))
        row = [np.repeat(np.arange(batch.num_rows), np.diff(o)) for o, _, _ in lists]
        # one merge over the batch: a term that both sides of a row have stands twice in a row
        r, t, w = (np.concatenate(x) for x in (row, [x[1] for x in lists], [x[2] for x in lists]))
        order = np.lexsort((t, r))
        r, t, w = r[order], t[order], w[order]
        same = np.flatnonzero((r[1:] == r[:-1]) & (t[1:] == t[:-1]))
        sim = np.bincount(r[same], w[same] * w[same + 1], batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "sim"])


#: Quarters of an octave of document frequencies that profiles of vectors tell apart.
LEVELS = 64


def similar_pairs(weights: DataFrame, threshold: float, left: Column | None = None) -> DataFrame:
    """``vector_pairs`` of vectors with a row for each term (id, t, df, w), which are put together first."""
    x = weights.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("t").alias("t"), F.col("df").cast("long").alias("df"), "w")).alias("x"))  # a document's own terms
    return vector_pairs(x.select("id", "x.t", "x.df", "x.w"), threshold, left)


def vector_pairs(vectors: DataFrame, threshold: float, left: Column | None = None) -> DataFrame:
    """(a, b, sim) with a < b and sim >= threshold of unit vectors (id, and as lists t, df, w: terms as 64-bit hashes, their document frequencies and weights).

    By a join of heads, whose candidates are shuffled: for two sides, or few vectors.  ``bags.near`` finds the same among many.
    A pair at the threshold shares a term among the rarest terms of each that come before the rest's length falls under it (its head), so only those terms make candidates.  A
    candidate goes on if the length of the two rests after their first shared term leaves the threshold within reach, and if what their heads share does so together with what can follow where the first head
    ends: the length there of that side's rest times that of the other's, which a profile of lengths by frequency bounds.  Heads are made in the tasks, and the product is taken of whole vectors.
    ``left`` splits the ids in two sides, of which pairs take one each."""
    from . import bags

    least = threshold - 1e-6
    kind = dict(vectors.dtypes)["id"]
    x = vectors.select("id", "t", "df", "w").mapInArrow(bags.heads(least, LEVELS), f"id {kind}, t long, w double, rest double, end double, at int, profile string")
    x = x.withColumn("profile", F.lit("")) if left is not None else x  # two sides are one small one: its rests alone do
    x = x.withColumn("side", left if left is not None else F.lit(True))
    a, b = (x.select("t", *[F.col(c).alias(c + s) for c in ("id", "w", "rest", "end", "at", "profile", "side")]) for s in "ab")
    ok = F.col("ida") < F.col("idb") if left is None else (F.col("sidea") & ~F.col("sideb"))
    follows = lambda s, o: F.col(f"end{s}") * (F.ascii(F.substring(F.col(f"profile{o}"), F.col(f"at{s}") + 1, F.lit(1))) - 32) / 94
    if left is not None:
        follows = lambda s, o: F.col(f"end{s}")
    most = F.when(F.col("ata") < F.col("atb"), follows("a", "b")).when(F.col("atb") < F.col("ata"), follows("b", "a")).otherwise(F.greatest(follows("a", "b"), follows("b", "a")))
    met = a.join(b, "t").where(ok).select(F.col("ida").alias("a"), F.col("idb").alias("b"), (F.col("wa") * F.col("wb")).alias("both"), most.alias("rest"), (F.col("resta") * F.col("restb")).alias("most"))
    pairs = met.groupBy("a", "b").agg(F.max("most").alias("most"), (F.sum("both") + F.greatest(F.max("rest"), F.lit(0.0))).alias("sum")).where((F.col("most") >= least) & (F.col("sum") >= least)).select("a", "b")
    whole = lambda s: vectors.select(F.col("id").alias(s), F.col("t").alias(f"t{s}"), F.col("w").alias(f"w{s}"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    sims = both.select("a", "b", "ta", "wa", "tb", "wb").mapInArrow(_dots, f"a {kind}, b {kind}, sim double")
    return sims.withColumn("sim", F.round("sim", 6)).where(F.col("sim") >= threshold)
