"""Per-pixel column functions. Missing data is NULL; every one of them stays inside whole-stage code generation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NODATA = -9999.0
BANDS = ("b02", "b03", "b04", "b08", "b8a", "b11", "b12")


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def from_nodata(x: str | Column, nodata: float = NODATA) -> Column:
    """At the scan: the sentinel and NaN become NULL."""
    x = c(x)
    return F.when((x != nodata) & ~F.isnan(x), x)


def to_nodata(x: str | Column, nodata: float = NODATA) -> Column:
    """At the sink: NULL becomes the sentinel."""
    return F.coalesce(c(x), F.lit(nodata))


def db_to_linear(x: str | Column) -> Column:
    return F.pow(F.lit(10.0), c(x) / 10)


def linear_to_db(x: str | Column) -> Column:
    """NULL where power is not positive."""
    x = c(x)
    return F.when(x > 0, F.log10(x) * 10)


def ratio_db(vv: str | Column, vh: str | Column) -> Column:
    return c(vv) - c(vh)


def db_to_linear_libm(x: str | Column) -> Column:
    """db_to_linear by the C library's power, as DuckDB has it. The JVM's may differ in the last bit, which ranks of values
    that are almost ties tell apart."""

    @F.pandas_udf("double")
    def power(v: pd.Series) -> pd.Series:
        return pd.Series([None if math.isnan(x) else math.pow(10.0, x) for x in v.to_list()], dtype="float64")

    return power(c(x) / 10)


def nddi(wet: str | Column, dry: str | Column, linear=db_to_linear) -> Column:
    """Normalised difference of two dB bands in linear power; NULL where their sum vanishes."""
    w, d = linear(wet), linear(dry)
    return F.when(w + d >= 1e-12, (w - d) / (w + d))


def normalized(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the denominator is below 1e-9."""
    return F.when(a.isNull() | b.isNull(), None).when(F.abs(a + b) < 1e-9, 0.0).otherwise((a - b) / (a + b))


def quotient(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where |b| is below 1e-9."""
    return F.when(F.abs(c(b)) >= 1e-9, c(a) / c(b))


def valid(bands=BANDS) -> Column:
    """All bands are there."""
    out = F.lit(True)
    for b in bands:
        out = out & c(b).isNotNull()
    return out


def bsi() -> Column:
    return normalized(c("b11") + c("b04"), c("b08") + c("b02"))


def ndvi() -> Column:
    return normalized(c("b08"), c("b04"))


def ndwi() -> Column:
    return normalized(c("b03"), c("b08"))


def clay_index() -> Column:
    return quotient("b11", "b12")


def iron_oxide() -> Column:
    return quotient("b04", "b02")


#: The five optical indices of a pixel with all bands.
INDICES = {"bsi": bsi, "clay_index": clay_index, "ndvi": ndvi, "ndwi": ndwi, "iron_oxide": iron_oxide}


def observed_index(a: str, b: str) -> Column:
    """The per-observation index, with 1e-9 in the denominator."""
    return (c(a) - c(b)) / (c(a) + c(b) + 1e-9)


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def moisture_index(now: str | Column, dry: str | Column, wet: str | Column) -> Column:
    d = c(wet) - c(dry)
    return F.when(F.abs(d) >= 1e-6, clamp((c(now) - c(dry)) / d))


def floored_tan(slope: str | Column, least: float = 0.1) -> Column:
    return F.tan(F.radians(F.greatest(c(slope), F.lit(least))))


def twi(area: str | Column, slope: str | Column) -> Column:
    return F.when(c(area) > 0, F.log(c(area) / floored_tan(slope)))


def stream_power(area: str | Column, slope: str | Column) -> Column:
    return c(area) * floored_tan(slope)


def season(date: str | Column, wet: list[int], dry: list[int]) -> Column:
    """By the month; wet is tested first."""
    m = F.month(c(date))
    return F.when(m.isin(wet), "wet").when(m.isin(dry), "dry")


def block_id(row: str, col: str, size: int, width: int) -> Column:
    return F.floor(c(row) / size).cast("long") * (width // size + 1) + F.floor(c(col) / size).cast("long")


def java(method: str, *args: Column) -> Column:
    """A static method of the math library on Spark's class path, NULL where an argument is."""
    known = F.lit(True)
    for a in args:
        known = known & a.isNotNull()
    cls, name = method.rsplit(".", 1)
    return F.when(known, F.java_method(F.lit(cls), F.lit(name), *args).cast("double"))


SPECIAL = "org.apache.commons.math3.special."


def gamma_p(shape: Column, x: Column) -> Column:
    return java(SPECIAL + "Gamma.regularizedGammaP", shape, x)


def gamma_q(shape: Column, x: Column) -> Column:
    return java(SPECIAL + "Gamma.regularizedGammaQ", shape, x)


def digamma(x: Column) -> Column:
    """Of a positive x: ten steps up, then the asymptotic series. The math library's own series has a wrong sign, which moves
    shapes near 50 by a millionth."""
    y = x + 10
    z = 1 / (y * y)
    series = 0.0
    for b in (691 / 32760, -1 / 132, 1 / 240, -1 / 252, 1 / 120, -1 / 12):
        series = (series + b) * z
    return F.log(y) - 1 / (2 * y) + series - sum((1 / (x + i) for i in range(1, 10)), 1 / x)


def beta_i(x: Column, a: Column, b: Column) -> Column:
    return java(SPECIAL + "Beta.regularizedBeta", x, a, b)


def normal_quantile(p: Column) -> Column:
    return F.lit(math.sqrt(2)) * java(SPECIAL + "Erf.erfInv", p * 2 - 1)


def _utm_series() -> tuple[float, float, float]:
    """Third flattening, its square root's factor e, and the rectifying radius of the WGS 84 ellipsoid."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    return n, 2 * math.sqrt(n) / (1 + n), a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)


def utm(lon: str | Column, lat: str | Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Easting and northing of a UTM zone on the WGS 84 ellipsoid, by the Krueger series; northings of the southern half begin at 10,000 km."""
    n, e, radius = _utm_series()
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    phi, lam = F.radians(c(lat)), F.radians(c(lon) - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, x in enumerate(alpha, 1):
        east = east + x * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + x * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000.0 + 0.9996 * radius * east, (1e7 if south else 0.0) + 0.9996 * radius * north


def lonlat(easting: str | Column, northing: str | Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """Longitude and latitude of UTM coordinates: the series the other way."""
    n, _, radius = _utm_series()
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi = (c(northing) - (1e7 if south else 0.0)) / (0.9996 * radius)
    eta = (c(easting) - 500000.0) / (0.9996 * radius)
    x, y = xi, eta
    for j, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        y = y - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, d in enumerate(delta, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.lit(float(zone * 6 - 183)) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(phi)
