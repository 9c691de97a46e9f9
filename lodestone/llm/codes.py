"""Compression of vectors to short codes: integer parts, a codebook for each part position, and an exact search for the nearest entry.

Exponion search (Newling and Fleuret, "Fast k-means with accurate bounds", 2016): a part starts at the entry it had in the round before, at squared distance u.  An
entry that is nearer, or as near with a lower index, lies within 2 * sqrt(u) of the starting entry by the triangle inequality, so only the start of that entry's list of neighbour
entries, sorted by distance, is scanned: those at squared distances up to 4 * u.  All of it is integer arithmetic, so the bound is exact and ties are ties.

Rows never meet: a round is one pass over the vectors with the codebooks (ENTRIES vectors, whatever the input) sent along, sums of each entry are added up in the
tasks first, and what a round assigned is written beside the vectors for the next to start from.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_cut, table

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256


def neighbours(book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, distance): for each entry all entries by (squared distance from it, index), and those distances."""
    far = ((book[:, None, :] - book[None, :, :]) ** 2).sum(2)
    order = np.argsort(far, axis=1, kind="stable")
    return order, np.take_along_axis(far, order, 1)


def nearest_entries(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(entry, squared distance, entries looked at) of each row of ``x``: the nearest of ``book``, ties to the lower index, found from ``start``."""
    order, far = neighbours(book)
    best = start.astype(np.int64)
    low = ((x - book[best]) ** 2).sum(1)
    reach = np.empty(len(x), np.int64)
    by = np.argsort(start, kind="stable")
    edges = np.searchsorted(start[by], np.arange(len(book) + 1))
    for e in np.flatnonzero(np.diff(edges)):
        rows = by[edges[e] : edges[e + 1]]
        reach[rows] = np.searchsorted(far[e], 4 * low[rows], "right")
    live = np.argsort(-reach, kind="stable")
    many, looked = np.sort(reach)[::-1], len(x)
    for k in range(int(many[0]) if len(x) else 0):
        rows = live[: len(many) - np.searchsorted(many[::-1], k, "right")]
        j = order[start[rows], k]
        d = ((x[rows] - book[j]) ** 2).sum(1)
        better = (d < low[rows]) | ((d == low[rows]) & (j < best[rows]))
        low[rows[better]], best[rows[better]] = d[better], j[better]
        looked += len(rows)
    return best, low, looked


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assign(books: np.ndarray, dim: int):
    """(v, code, ...) -> the same with the code of these codebooks, and the error."""

    def run(batches):
        step = dim // PARTS
        for b in batches:
            x, n = _matrix(b.column(0), dim), b.num_rows
            old = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, PARTS)
            code, error = np.empty((n, PARTS), np.uint8), np.zeros(n, np.int64)
            for p in range(PARTS):
                best, low, _ = nearest_entries(x[:, p * step : (p + 1) * step], old[:, p].astype(np.int64), books[p])
                code[:, p] = best
                error += low
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in code], pa.binary()), *b.columns[2:], pa.array(error)], [*b.schema.names, "error"])

    return run


def _sums(entries: int, dim: int):
    """(v, code) -> (part, entry, n, sums): a row for each entry that a task has used."""

    def run(batches):
        step, total, count = dim // PARTS, np.zeros((PARTS, entries, dim // PARTS), object), np.zeros((PARTS, entries), np.int64)
        for b in batches:
            x, n = _matrix(b.column(0), dim), b.num_rows
            code = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, PARTS)
            for p in range(PARTS):
                part = np.zeros((entries, step), np.int64)  # a batch: far from the end of 64 bits
                np.add.at(part, code[:, p], x[:, p * step : (p + 1) * step])
                total[p] += part
                count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        if len(p):
            at = np.tile(np.arange(step), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(p, step), pa.int32()), pa.array(np.repeat(e, step), pa.int32()), pa.array(at, pa.int32()), pa.array(np.repeat(count[p, e], step)), pa.array([str(s) for s in total[p, e].reshape(-1)])], ["part", "entry", "at", "n", "s"])

    return run


def _updated(rows: DataFrame, books: np.ndarray, dim: int) -> np.ndarray:
    """Codebooks after a round: floor(sum / count) of each used entry.  Sums are decimals, so no number of vectors is too many; as many numbers as the codebooks hold come here."""
    each = rows.select("v", "code").mapInArrow(_sums(books.shape[1], dim), "part int, entry int, at int, n long, s string")
    new = books.copy()
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        new[r["part"], r["entry"], r["at"]] = int(r["s"]) // r["n"]
    return new


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> tuple[DataFrame, np.ndarray | None]:
    """(rows, codebooks): rows are those of ``vectors`` (vec_id, embedding, label) that are kept: vec_id, label, code (an entry number for each part, as bytes) and error (of the final codes); codebooks
    are integers by part, entry and place (None if no row is kept).

    A vector that is null or holds a null or a non-finite component is dropped, and so is one whose length isn't that of the first kept vector (by vec_id, null last, then by its integers), or any if that
    length is 0 or PARTS doesn't divide it.  Repeated rows count and are answered each; fewer than ``entries`` kept rows give as many entries.  Of equal vec_ids
    the smaller vector (by components) comes first into the codebook.  A component of sqrt(2**59 / dimension) / 256 or more in size (some 370,000 for 64 dimensions) is an error: its squares leave 64 bits.  A vector is one row, whatever its
    length; columns but these three play no part.  An empty table gives no rows."""
    spark = vectors.sparkSession
    v = vectors["embedding"]
    fine = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = vectors.where(fine).select(whole.alias("v"), vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].alias("label"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(first[0]["v"]) if first else 0
    if not dim or dim % PARTS:
        return rows.where(F.lit(False)).select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), None
    rows = rows.where(F.size("v") == dim)
    largest = math.isqrt((1 << 59) // dim)  # four times the squared distance of two such vectors is under 2**63
    if (most := rows.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))).first()[0]) >= largest:
        raise ValueError(f"a component of {most} / {SCALE} is too large for exact distances in 64 bits")
    start = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(len(start), PARTS, dim // PARTS).swapaxes(0, 1).copy()
    kind = dict(rows.dtypes)["label"]
    state = rows.select("v", F.lit(bytes(PARTS)).alias("code"), "vec_id", "label")
    held = None
    for _ in range(rounds):
        done = cut(state.mapInArrow(_assign(books, dim), f"v array<long>, code binary, vec_id long, label {kind}, error long").drop("error"), "codes")
        if held is not None:
            drop_cut(held)
        books, held = _updated(done, books, dim), done
        state = done
    out = cut(state.mapInArrow(_assign(books, dim), f"v array<long>, code binary, vec_id long, label {kind}, error long").drop("v"), "codes-out")
    if held is not None:
        drop_cut(held)
    return out, books


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors of embeddings in 16 bytes each, their errors, the error of each label, and a digest of the codebooks."""
    rows, books = compress(table(spark, sf_dir, "embeddings"))
    each = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = rows.join(each, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books) if books is not None else None).alias("codebooks_sha256"))
