"""Precipitation sums, normals and the standardised precipitation index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import digamma, gamma_p, normal_quantile


def rolling_sum(df: DataFrame, value: str = "precip", window: int = 3, out: str = "acc") -> DataFrame:
    """Trailing sum over `window` months of a pixel, NULL before the first full window."""
    w = Window.partitionBy("pixel").orderBy("month").rowsBetween(1 - window, 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == window, F.sum(value).over(w)))


def normals(df: DataFrame, values: list[str]) -> DataFrame:
    return df.groupBy("pixel").agg(*[F.avg(v).alias(v) for v in values])


def _shape(s: Column) -> Column:
    return (3 - s + F.sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s)


def gamma_fit(df: DataFrame, by: list[str], value: str = "acc", steps: int = 5) -> DataFrame:
    """q (probability of no precipitation), shape, scale and n by maximum likelihood at location 0.

    The shape solves ln k - digamma(k) = ln mean - mean ln: a closed-form start, then Newton steps as column
    expressions, with digamma's slope by a central difference.
    """
    x = F.when(F.col(value) > 0, F.col(value))
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("all"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg(F.log(x)).alias("logs"))
    g = g.withColumn("s", F.log("mean") - F.col("logs"))
    g = g.withColumn("shape", F.when((F.col("n") > 0) & (F.col("s") > 1e-12), _shape(F.col("s"))))
    for _ in range(steps):
        k = F.col("shape")
        h = F.greatest(k * 1e-4, F.lit(1e-6))
        g = g.withColumns({"_d": digamma(k), "_up": digamma(k + h), "_down": digamma(k - h)})
        slope = 1 / k - (F.col("_up") - F.col("_down")) / (2 * h)
        g = g.withColumn("shape", F.greatest(F.lit(1e-3), k - (F.log(k) - F.col("_d") - F.col("s")) / slope)).drop("_d", "_up", "_down")
    return g.select(*by, ((F.col("all") - F.col("n")) / F.col("all")).alias("q"), "shape", (F.col("mean") / F.col("shape")).alias("scale"), "n")


def spi(df: DataFrame, scale: int = 3, value: str = "precip") -> DataFrame:
    """pixel, month, spi: sums over `scale` months, a gamma law for each calendar month (the whole series' if it has fewer than three positive sums), as a normal quantile.

    A pixel whose series is constant or has a gap has NULLs.
    """
    acc = rolling_sum(df, value, scale).withColumn("m", F.month("month"))
    good = df.groupBy("pixel").agg((F.stddev_pop(value) > 0).alias("varies"), (F.count(value) == F.count("*")).alias("whole"))
    by_month = gamma_fit(acc, ["pixel", "m"])
    whole = gamma_fit(acc, ["pixel"]).select("pixel", *[F.col(c).alias("all_" + c) for c in ("q", "shape", "scale")])
    few = F.coalesce(F.col("n"), F.lit(0)) < 3
    x = acc.join(by_month, ["pixel", "m"], "left").join(whole, "pixel", "left").join(good, "pixel")
    x = x.withColumns({c: F.when(few, F.col("all_" + c)).otherwise(F.col(c)) for c in ("q", "shape", "scale")})
    x = x.withColumn("g", gamma_p(F.col("shape"), F.col("acc") / F.col("scale")))
    h = F.when(F.col("acc") > 0, F.col("q") + (1 - F.col("q")) * F.col("g")).when(F.col("acc").isNotNull(), F.col("q") / 2)
    x = x.withColumn("h", F.when(F.col("varies") & F.col("whole") & h.isNotNull(), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), h))))
    return x.select("pixel", "month", normal_quantile(F.col("h")).alias("spi"))


def spi_latest(df: DataFrame, scale: int = 3) -> DataFrame:
    return spi(df, scale).groupBy("pixel").agg(F.max_by("spi", "month").alias("spi"))
