"""Retrieval as a table function of SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import IntegerType, StructType


@udtf
class Retrieve:
    """``retrieve(TABLE scores, k)``: of each q of a table with columns q, id and score, whatever else it has, the first k rows by (score descending, id), with rank.

    The table is dealt by q and sorted by Spark; a task counts to k and holds no more than a row."""

    @staticmethod
    def analyze(scores: AnalyzeArgument, k: AnalyzeArgument) -> AnalyzeResult:
        missing = {"q", "id", "score"} - set(scores.dataType.names)
        if missing:
            raise ValueError(f"the table lacks {', '.join(sorted(missing))}")
        return AnalyzeResult(schema=StructType([*scores.dataType.fields]).add("rank", IntegerType()), partitionBy=[PartitioningColumn("q")], orderBy=[OrderingColumn("score", ascending=False), OrderingColumn("id")])

    def __init__(self):
        self.rank = 0

    def eval(self, scores, k: int):
        self.rank += 1
        if self.rank <= k:
            yield (*scores, self.rank)


def register(spark: SparkSession) -> None:
    spark.udtf.register("retrieve", Retrieve)
