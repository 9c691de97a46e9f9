"""Tables and files of the engine: explicit schemas, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """``df`` dealt out row by row over four partitions a core, for work that is heavy for each row: a file of many splits may have all its rows in one, as a row group is read by one task."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped, missing fields are null."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_folder(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, folder, name, content) of whole text files below folders that don't begin with an underscore, in the order of their paths."""
    rows = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    parts = F.split("path", "/")
    rows = rows.select("path", F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), "content")
    return rows.where(~F.col("folder").startswith("_")).orderBy("path")


def read_ops(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, pos, op) of YAML files that hold a list of flat mappings (``- key: value`` and further ``key: value`` lines): op maps keys to text, quotes taken off.

    Blank lines and comments don't count; a line that is neither is an error."""

    def run(batches):
        import re

        import pyarrow as pa

        item = re.compile(r"^(-\s+|\s+)([\w.-]+):(?:\s+(.*?))?\s*$")
        for b in batches:
            out = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ops: list[dict] = []
                for line in text.splitlines():
                    if not line.strip() or line.lstrip().startswith("#"):
                        continue
                    m = item.match(line)
                    if not m or not (m[1].startswith("-") or ops):
                        raise ValueError(f"{path}: not an entry of a list of mappings: {line!r}")
                    if m[1].startswith("-"):
                        ops.append({})
                    value = m[3] or ""
                    ops[-1][m[2]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
                out += [(path, i, list(op.items())) for i, op in enumerate(ops, 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.string(), pa.int32(), pa.map_(pa.string(), pa.string())), strict=True)], ["path", "pos", "op"])

    files = spark.read.text(pattern, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(run, "path string, pos int, op map<string,string>")


def write_csv(df: DataFrame, path: str, digits: int = 4) -> None:
    """CSV with rounded floats and empty strings for nulls."""
    kinds = dict(df.dtypes)
    cols = [F.round(c, digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    df.select(*cols).write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def frozen_rows(frozen: DataFrame) -> DataFrame:
    """One row per retrieved id of parallel arrays ids, scores, score_norm, ranked from 1."""
    rest = [c for c in frozen.columns if c not in ("query", "retriever", "k", "ids", "scores", "score_norm")]
    z = frozen.select("query", "retriever", "k", *rest, F.posexplode(F.arrays_zip("ids", "scores", "score_norm")).alias("pos", "x"))
    return z.select("query", "retriever", "k", (F.col("pos") + 1).alias("rank"), F.col("x.ids").alias("id"), F.col("x.scores").alias("score"), F.col("x.score_norm").alias("score_norm"), *rest)


def content_digest_of(ids) -> F.Column:
    """SHA-256 of the ids of a frozen ranking, in order."""
    return F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256)


def verified(frozen: DataFrame) -> DataFrame:
    """Adds ok: the key (query, retriever, k) occurs once, and the ids have the recorded ``digest``."""
    from pyspark.sql import Window

    once = F.count(F.lit(1)).over(Window.partitionBy("query", "retriever", "k")) == 1
    return frozen.withColumn("ok", once & (F.col("digest") == content_digest_of(F.col("ids"))))


def dimension(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table (its size is that of the literal), safe to broadcast."""
    return spark.createDataFrame(rows, schema)
