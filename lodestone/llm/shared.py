"""What the operators of this subpackage have in common: places to write, byte views of text columns,
word hashes, the held-out fold, and connected components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------- places to write


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests, a laptop) a temporary folder is set instead; a cluster without one is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm.isDefined():
            return jvm.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/lodestone-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends in files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestone_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing reads it any more."""
    path = getattr(df, "_lodestone_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    """crc32 of doc_id written as text, modulo 4, is 2.  A null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


# ---------------------------------------------------------------- bytes of a text column


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, bytes): text i is bytes[bounds[i]:bounds[i+1]].  Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if offs is None or len(column) == 0:
        return np.zeros(len(column) + 1, np.int64), np.zeros(0, np.uint8)
    bounds = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[bounds[0] : bounds[-1]]
    return bounds - bounds[0], raw


def shards(bounds: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of whole texts of about ``most`` bytes each; a longer text is a run of its own."""
    out, a, n = [], 0, len(bounds) - 1
    while a < n:
        b = int(np.searchsorted(bounds, bounds[a] + most, "right")) - 1
        b = min(max(b, a + 1), n)
        out.append((a, b))
        a = b
    return out


_P = 0x9E3779B97F4A7C15 | 1
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    have = len(_POW.get("p", ()))
    if have < n:
        n = 1 << (int(n) - 1).bit_length()
        for key, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
            out, step = np.ones(n, np.uint64), 1
            while step < n:
                out[step : 2 * step] = out[:step] * np.uint64(pow(base, step, 1 << 64))
                step *= 2
            _POW[key] = out
    return _POW["p"], _POW["q"]


def mix(h: np.ndarray) -> np.ndarray:
    """A finalizer that spreads 64 bits (constants of the public splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
#: Words of more bytes than this are hashed by BLAKE2b, one call each; shorter ones eight bytes at a time, all at once.
_LONG = 64
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_STEP = 1 << 20


def _ends(bounds: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each run of bytes other than 0, and the byte after it; runs end where texts do.  Works block by block."""
    n = len(b)
    kind = np.int64 if n < 1 << 24 else np.int32 if n < 1 << 31 else np.int64
    starts, stops, before = [], [], False
    edges = np.unique(bounds[:-1])
    for lo in range(0, n, _STEP):
        on = b[lo : lo + _STEP] != 0
        prev = np.append(before, on[:-1])
        brk = np.zeros(len(on), bool)
        i, j = np.searchsorted(edges, (lo, lo + len(on)))
        brk[edges[i:j] - lo] = True
        starts.append((np.flatnonzero(on & (~prev | brk)) + lo).astype(kind))
        stops.append((np.flatnonzero(prev & (~on | brk)) + lo).astype(kind))
        before = bool(on[-1])
    if before:
        stops.append(np.array([n], kind))
    return (np.concatenate(starts), np.concatenate(stops)) if starts else (np.zeros(0, kind), np.zeros(0, kind))


def _hashes(padded: np.ndarray, s: np.ndarray, e: np.ndarray, lane: int) -> np.ndarray:
    """64-bit hash of each padded[s:e]: eight bytes at a time through a mixing step that has an inverse, so words of seven bytes at most never collide."""
    at = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    out, seed = np.empty(len(s), np.uint64), _SEEDS[lane]
    for k in range(0, len(s), _STEP):
        x, n = s[k : k + _STEP], (e[k : k + _STEP] - s[k : k + _STEP]).astype(np.int64)
        h = at[x] & _LOW[np.minimum(n, 8)]
        h = mix((h | np.where(n < 8, n, 0).astype(np.uint64) << np.uint64(56)) ^ seed)
        live, done = np.flatnonzero((n > 8) & (n <= _LONG)), 8
        while len(live):
            more = at[x[live] + done] & _LOW[np.minimum(n[live] - done, 8)]
            h[live] = mix(h[live] * seed + more + np.uint64(done))
            done += 8
            live = live[n[live] > done]
        long = np.flatnonzero((n > 8) & (n <= _LONG))
        h[long] = mix(h[long] ^ n[long].astype(np.uint64))
        for i in np.flatnonzero(n > _LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(padded[x[i] : x[i] + n[i]], digest_size=8, salt=bytes([lane])).digest(), "little")
        out[k : k + _STEP] = h
    return out


def words(bounds: np.ndarray, raw: np.ndarray, lut: np.ndarray, lanes: int = 1) -> tuple[np.ndarray, ...]:
    """Maximal runs of bytes that ``lut`` maps to other than 0, never across texts.

    Returns (hash, text number, start byte, end byte) of each run, in order; equal runs (after ``lut``) have equal hashes.  With ``lanes`` 2 a second,
    independent hash comes last: both together are 128 bits, for decisions that a chance collision must not take."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    for k in range(0, len(raw), _STEP):
        np.take(lut, raw[k : k + _STEP], out=padded[k : min(k + _STEP, len(raw))])
    s, e = _ends(bounds, padded[: len(raw)])
    doc = (np.searchsorted(bounds, s, "right") - 1).astype(s.dtype)
    return (_hashes(padded, s, e, 0), doc, s, e, *(_hashes(padded, s, e, k) for k in range(1, lanes)))


def pieces(raw: np.ndarray, lut: np.ndarray, most: int, carry: int, lanes: int = 1):
    """The words of one long text in pieces of about ``most`` bytes, cut between words: (words as ``words`` gives them, how many of them were in the piece before).

    Each piece begins with the last ``carry`` words of the one before, so runs of carry + 1 words are whole in some piece.  All but the last piece have new
    words, and more than ``carry`` words.  Places are those in the whole text."""
    at, end, kept = 0, 0, None
    while end < len(raw):
        end = min(end + most, len(raw))
        while end < len(raw):
            gap = np.flatnonzero(lut[raw[end : end + _STEP]] == 0)
            if len(gap):
                end += int(gap[0])
                break
            end = min(end + _STEP, len(raw))
        h, doc, s, e, *more = words(np.array([0, end - at]), raw[at:end], lut, lanes)
        lead = 0 if kept is None else len(kept[0])
        if len(h) + lead <= carry and end < len(raw):
            continue
        own = [h, doc.astype(np.int64), s.astype(np.int64) + at, e.astype(np.int64) + at, *more]
        if lead:
            own = [np.concatenate(x) for x in zip(kept, own, strict=True)]
        yield own, lead
        kept, at = [x[max(0, len(x) - carry) :] for x in own], end


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive hashes; len(h)-n+1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = h[:m].copy()
    for k in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m] + np.uint64(k))
    return out


# ---------------------------------------------------------------- connected components


def _forest(batches):
    """Union-find over one partition's edges: one edge from each vertex to the smallest vertex that it reaches here."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    us = [u for u in root if find(u) != u]
    for k in range(0, len(us), 100_000):
        part = us[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(u) for u in part], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id): for each vertex of ``edges`` the smallest vertex that it reaches.

    Each partition first shrinks its edges to a forest; then large-star and small-star steps alternate until
    nothing changes (Kiveris et al., "Connected Components in MapReduce and Beyond").  Every round is written to the shared folder, so that
    no lineage grows and a lost executor costs one round at most.  Nothing but two sums comes to the driver."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = cut(e.mapInArrow(_forest, "u long, v long").distinct(), "cc")
    seen = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        step = small.unionByName(least.select("u", F.col("m").alias("v"))).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        nxt = cut(step.where("u <> v").distinct(), "cc")
        drop_cut(e)
        e = nxt
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    out = cut(e.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots), "components")
    drop_cut(e)
    return out
