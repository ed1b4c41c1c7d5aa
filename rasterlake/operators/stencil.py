"""Neighbourhood operators on dense grids: separable box filters and 3 x 3 stencils by window functions.

Two passes of lag and lead, down the columns and along the rows, reach all eight neighbours; each window is a row or a
column of a raster, so tasks grow with the side of a raster and not with its area.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _padded_sum(x: Column, along: str, keys: list[str], k: int) -> Column:
    """Sum over -k..k along an axis whose borders are repeated."""
    order = Window.partitionBy(*keys).orderBy(along)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at, n = F.row_number().over(order) - 1, F.count(F.lit(1)).over(Window.partitionBy(*keys))
    head, tail = F.first(x).over(whole), F.last(x).over(whole)
    inside = F.sum(x).over(order.rowsBetween(-k, k))
    return inside + head * F.greatest(F.lit(0), k - at) + tail * F.greatest(F.lit(0), at + k - (n - 1))


def box_mean(df: DataFrame, value: str, window: int, keys: list[str], out: str) -> DataFrame:
    """Mean over an odd window of the values there are; borders are repeated. NULL if the window has none."""
    if window % 2 != 1:
        raise ValueError("the window must be odd")
    k = window // 2
    there = df.withColumns({"_v": F.coalesce(value, F.lit(0.0)), "_n": F.when(F.col(value).isNotNull(), 1.0).otherwise(0.0)})
    down = there.withColumns({"_v1": _padded_sum(F.col("_v"), "row", [*keys, "col"], k), "_n1": _padded_sum(F.col("_n"), "row", [*keys, "col"], k)})
    both = down.withColumns({"_v2": _padded_sum(F.col("_v1"), "col", [*keys, "row"], k), "_n2": _padded_sum(F.col("_n1"), "col", [*keys, "row"], k)})
    return both.withColumn(out, F.when(F.col("_n2") > 0, F.col("_v2") / F.col("_n2"))).drop("_v", "_n", "_v1", "_n1", "_v2", "_n2")


def neighbours(df: DataFrame, value: str = "elev") -> DataFrame:
    """Columns a b c / d e f / g h i of each pixel's 3 x 3 window, row by row; NULL beyond the border."""
    down, along = Window.partitionBy("col").orderBy("row"), Window.partitionBy("row").orderBy("col")
    x = df.withColumns({"_u": F.lag(value).over(down), "_d": F.lead(value).over(down)})
    side = {}
    for name, source in (("a", "_u"), ("d", value), ("g", "_d")):
        side[name] = F.lag(source).over(along)
    for name, source in (("c", "_u"), ("f", value), ("i", "_d")):
        side[name] = F.lead(source).over(along)
    return x.withColumns(side).withColumns({"b": F.col("_u"), "e": F.col(value), "h": F.col("_d")}).drop("_u", "_d")


def _all_nine() -> Column:
    out = F.lit(True)
    for n in "abcdefghi":
        out = out & F.col(n).isNotNull()
    return out


def gradients(cell: float) -> tuple[Column, Column]:
    """Third-order finite differences of a 3 x 3 window, weighted 1 2 1."""
    a, b, c, d, f, g, h, i = (F.col(n) for n in "abcdfghi")
    return ((c + f * 2 + i) - (a + d * 2 + g)) / (8 * cell), ((g + h * 2 + i) - (a + b * 2 + c)) / (8 * cell)


def terrain(df: DataFrame, cell: float = 30.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """slope (degrees), aspect (compass degrees, NULL if flat), roughness, hillshade (1 to 255); NULL at the border."""
    dx, dy = gradients(cell)
    x = neighbours(df).withColumns({"dx": F.when(_all_nine(), dx), "dy": F.when(_all_nine(), dy)})
    slope = F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))))
    theta = F.degrees(F.atan2(F.col("dy"), -F.col("dx")))
    turned = F.when(theta > 90, 450 - theta).otherwise(90 - theta)
    aspect = F.when((F.col("dx") == 0) & (F.col("dy") == 0), None).otherwise(F.when(turned == 360, 0.0).otherwise(turned))
    nine = [F.col(n) for n in "abcdefghi"]
    rough = F.when(_all_nine(), F.greatest(*nine) - F.least(*nine))
    zenith, sun = F.lit(90.0 - altitude), F.radians(F.lit(360.0 - azimuth + 90.0))
    s, facing = F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))), F.atan2(F.col("dy"), -F.col("dx"))
    light = F.cos(F.radians(zenith)) * F.cos(s) + F.sin(F.radians(zenith)) * F.sin(s) * F.cos(sun - facing)
    shade = F.when(_all_nine(), 1 + 254 * F.greatest(F.lit(0.0), light))
    return x.select("row", "col", slope.alias("slope"), aspect.alias("aspect"), rough.alias("roughness"), shade.alias("hillshade"))


def _gradient(x: str, along: str, other: str, cell: float) -> Column:
    w = Window.partitionBy(other).orderBy(along)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    first, last = F.lag(along).over(w).isNull(), F.lead(along).over(w).isNull()
    return F.when(first, (after - F.col(x)) / cell).when(last, (F.col(x) - before) / cell).otherwise((after - before) / (2 * cell))


def curvature(df: DataFrame, value: str = "elev", cell: float = 30.0) -> DataFrame:
    """-(z_xx + z_yy), each by a gradient of a gradient: central inside, one-sided at the borders."""
    x = df.withColumns({"_zx": _gradient(value, "col", "row", cell), "_zy": _gradient(value, "row", "col", cell)})
    x = x.withColumns({"_zxx": _gradient("_zx", "col", "row", cell), "_zyy": _gradient("_zy", "row", "col", cell)})
    return x.select("row", "col", (-(F.col("_zxx") + F.col("_zyy"))).alias("curvature"))
