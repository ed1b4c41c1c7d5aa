"""Rounds of joins between checkpoints keep the driver's memory."""

from pyspark.sql import functions as F

from rasterlake.plans.tables import checkpointed


def test_estimates_do_not_grow_with_rounds(spark):
    """Each round's estimate is the third power of the one before: without a limit its digits triple."""
    df = checkpointed(spark.range(100).select(F.col("id").alias("a"), (F.col("id") * 2).alias("b")))
    for _ in range(9):
        df = checkpointed(df.join(df.select("a", F.col("b").alias("c")), "a").join(df.select("a", F.col("b").alias("d")), "a").select("a", "b"))
    assert sorted(map(tuple, df.collect())) == [(i, 2 * i) for i in range(100)]
    assert df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() <= 512
