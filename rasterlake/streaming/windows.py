"""Incremental forms: resumable composites of arriving scenes, and tumbling windows over acquisition dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Scenes as they arrive; a checkpoint makes a later run read new files only."""
    return spark.readStream.schema(schema).parquet(folder)


def window_means(stream: DataFrame, value: str = "vv", days: int = 12, late: str = "24 days") -> DataFrame:
    """n and mean of each pixel's samples in tumbling windows; samples later than `late` are dropped with their state."""
    at = stream.withColumn("at", F.col("acq_date").cast("timestamp")).withWatermark("at", late)
    w = at.groupBy(F.window("at", f"{days} days").alias("w"), "row", "col").agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return w.select(F.col("w.start").cast("date").alias("w_start"), "row", "col", "n", "mean")


def append_new(stream: DataFrame, make, target: str, checkpoint: str) -> StreamingQuery:
    """Applies make to each batch of new scenes and appends its result, all that there is now, then stops."""

    def batch(df: DataFrame, epoch: int) -> None:
        made = make(df).withColumn("epoch", F.lit(epoch))
        made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch").parquet(target)  # a batch that runs again replaces itself

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
