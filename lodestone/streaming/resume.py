"""An extension: the run log as a stream.  A file source of JSON lines, calls kept once, sums per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "call_id string, condition string, level int, latency_s double, timestamp timestamp"


def manifest_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", files_per_trigger).json(path)


def done_calls(stream: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each call once, state kept for as long as lines may come late."""
    return stream.withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["call_id"])


def progress(stream: DataFrame, lateness: str = "1 hour", every: str = "10 minutes") -> DataFrame:
    """Calls, valid calls and latency per condition and window."""
    w = F.window("timestamp", every)
    return done_calls(stream, lateness).groupBy(w, "condition").agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("level") >= 3).alias("valid"), F.avg("latency_s").alias("latency_s"))


def append_once(stream: DataFrame, log: str, checkpoint: str, before_commit=None):
    """Appends a stream to a log of JSON lines so that a restart writes nothing twice: a batch has a folder of its own by its number, and a batch that is tried again replaces what the first try left there.

    ``before_commit`` is called with the number of a batch that is written and not yet committed."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{log}/batch={number:012d}")
        if before_commit:
            before_commit(number)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def logged(spark: SparkSession, log: str, schema: str) -> DataFrame:
    """What ``append_once`` has written."""
    return spark.read.schema(schema).json(log)
