"""Per-pixel operators over time: composites, statistics, deltas, speckle filtering and date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import linear_to_db
from .stencil import box_mean

PIXEL = ["row", "col"]
#: Scene classes that are no ground: no data, saturated, dark, shadow, water, clouds, cirrus, snow.
EXCLUDED_CLASSES = [0, 1, 2, 3, 6, 8, 9, 10, 11]


def median(x: str | Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def median_composite(df: DataFrame, bands: list[str]) -> DataFrame:
    """Independent median of each band's positive power, in dB, by pixel; a pixel without any has mask 0."""
    dbs = [median(linear_to_db(b)).alias(b) for b in bands]
    out = df.groupBy(*PIXEL).agg(*dbs)
    any_band = F.coalesce(*[F.col(b) for b in bands]).isNotNull()
    return out.withColumn("mask", any_band.cast("int"))


def clear(df: DataFrame) -> DataFrame:
    return df.where(~F.col("scl").isin(EXCLUDED_CLASSES) & (F.col("mask") == 1))


def bare_soil_composite(df: DataFrame, bands, most_ndvi: float = 0.4) -> DataFrame:
    """Median of each band over clear observations of bare soil."""
    ndvi = (F.col("b08") - F.col("b04")) / (F.col("b08") + F.col("b04") + 1e-9)
    return clear(df).where(ndvi <= most_ndvi).groupBy(*PIXEL).agg(*[median(b).alias(b) for b in bands])


def seasonal_indices(df: DataFrame, indices: dict[str, Column]) -> DataFrame:
    """Median over clear observations of an index of each."""
    return clear(df).groupBy(*PIXEL).agg(*[median(x).alias(n) for n, x in indices.items()])


def temporal_stats(df: DataFrame, value: str = "v") -> DataFrame:
    """mean, std (population), p10, p90, amplitude; NULL samples are skipped, a pixel without samples has NULLs."""
    out = df.groupBy(*PIXEL).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(0.1)).alias("p10"), F.percentile(value, F.lit(0.9)).alias("p90"))
    return out.withColumn("amplitude", F.col("p90") - F.col("p10"))


def wet_dry_delta(df: DataFrame, value: str, season: Column) -> DataFrame:
    """Mean of the wet season less that of the dry one; NULL if either has no sample."""
    mean = lambda s: F.avg(F.when(season == s, F.col(value)))
    return df.groupBy(*PIXEL).agg((mean("wet") - mean("dry")).alias("delta"))


def speckle_filter(df: DataFrame, value: str, window: int = 7) -> DataFrame:
    """Multi-temporal filter of a dense stack in linear power: local mean times the pixel's mean ratio to its local means."""
    local = box_mean(df, value, window, ["t"], "m")
    ratio = F.when((F.col("m") > 0) & F.col(value).isNotNull(), F.col(value) / F.col("m"))
    mean = F.avg(ratio).over(Window.partitionBy(*PIXEL))
    return local.withColumn("filtered", F.when(F.col(value).isNotNull(), F.col("m") * mean)).drop("m")


def date_windows(spark: SparkSession, start: str, end: str, step_days: int = 12) -> DataFrame:
    """Closed windows of step_days, the last cut at end: w_start, w_end."""
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval {int(step_days)} days)")).alias("w_start"))
    return days.withColumn("w_end", F.least(F.date_add("w_start", step_days - 1), F.lit(end).cast("date")))


def mosaic(df: DataFrame, order: str, values: list[str]) -> DataFrame:
    """The first tile that has a value wins at each pixel."""
    return df.where(F.col(values[0]).isNotNull()).groupBy(*PIXEL).agg(*[F.min_by(v, order).alias(v) for v in values], F.min(order).alias(order))
