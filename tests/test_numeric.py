"""Values that rounding or ranks tell apart from almost equal ones."""

import math

from pyspark.sql import functions as F

from rasterlake.functions import scalar as S
from rasterlake.operators import climate


def test_digamma_to_the_last_digits(spark):
    euler = 0.5772156649015329
    want = {k: -euler + math.fsum(1 / i for i in range(1, k)) for k in (1, 2, 20, 50, 90)}
    rows = spark.createDataFrame([(float(k),) for k in want], "x double").select("x", S.digamma(F.col("x")).alias("d")).collect()
    assert all(abs(r["d"] - want[int(r["x"])]) < 1e-13 for r in rows)


def test_gamma_shape_solves_its_equation(spark):
    """A shape near 44, where an error of 1e-9 in digamma moves the shape by 1e-5."""
    x = [1.0 + 0.15 * math.sin(3 * i) + 0.01 * i for i in range(40)]
    got = climate.gamma_fit(spark.createDataFrame([(0, v) for v in x], "pixel int, acc double"), ["pixel"]).first()
    k, s = got["shape"], math.log(math.fsum(x) / len(x)) - math.fsum(map(math.log, x)) / len(x)
    up = lambda k: math.log(k + 50) - 1 / (2 * (k + 50)) - 1 / (12 * (k + 50) ** 2) + 1 / (120 * (k + 50) ** 4) - math.fsum(1 / (k + i) for i in range(50))
    assert 20 < k < 200 and abs(math.log(k) - up(k) - s) < 1e-12


def test_index_of_the_c_library_bit_by_bit(spark):
    pairs = [(-25 + i * 0.04, -24.96 + (i * 37 % 1000) * 0.04) for i in range(2000)]
    rows = spark.createDataFrame(pairs + [(None, 1.0)], "wet double, dry double").select("wet", "dry", S.nddi("wet", "dry", S.db_to_linear_libm).alias("x")).collect()
    for r in rows:
        if r["wet"] is None:
            assert r["x"] is None
            continue
        w, d = math.pow(10.0, r["wet"] / 10), math.pow(10.0, r["dry"] / 10)
        assert r["x"] == (w - d) / (w + d)
