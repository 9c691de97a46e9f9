"""F3 of round 4: scores of common terms depend on the mean of all idfs, which is exact."""

import math

from pyspark.sql import functions as F

from lodestone.operators import retrieval as R


def test_mean_of_many_equal_idfs(spark):
    """900,000 terms, most of one document: the mean is the exact one but for the last digits, so no score of a common term is rounded the wrong way by what sums leave."""
    nd = 51_282
    df = spark.range(900_000, numPartitions=3).select(F.col("id").alias("t"), F.when(F.col("id") < 10, nd - 1).when(F.col("id") % 7 == 0, F.col("id") % 900 + 1).otherwise(1).cast("long").alias("df"))
    ix = {"df": df, "figures": spark.createDataFrame([(nd, 1, 1.0)], "nd long, total long, avgdl double")}
    got = R.idf(ix).where("t = 0").first().w
    every = [math.log(nd - d + 0.5) - math.log(d + 0.5) for d in (nd - 1 if k < 10 else k % 900 + 1 if k % 7 == 0 else 1 for k in range(900_000))]
    assert abs(got - 0.25 * math.fsum(every) / len(every)) < 1e-14
