"""Virtual rasters: relations keyed by pixel over the star-schema tables, with NULL as missing data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Of each band: factor and offset of its pattern.
BAND_PATTERN = {"b02": (31, 7), "b03": (37, 11), "b04": (41, 13), "b08": (43, 17), "b8a": (47, 19), "b11": (53, 23), "b12": (59, 29)}
DEM_WIDTH, S1_WIDTH, DATES = 100, 25, 8
WET, DRY = [1, 2, 3], [7, 8, 9]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _div(x: str, n: int):
    return F.floor(F.col(x) / n).cast("int")


def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, row, col, acq_date, vv, vh: a stack of eight dates, in dB, a fifth of it missing."""
    e = table(spark, sf_dir, "events")
    t = (F.col("event_id") % DATES).cast("int")
    e = e.select(t.alias("t"), _div("event_id", DATES).alias("p"), "user_id", F.when(F.col("event_type") != "error", F.col("value") / 25 - 25).alias("vv"))
    return e.select("t", _div("p", S1_WIDTH).alias("row"), (F.col("p") % S1_WIDTH).alias("col"), F.date_add(F.lit("2023-01-01").cast("date"), F.col("t") * 34).alias("acq_date"), "vv", (F.col("vv") - 5 - F.col("user_id") % 7).alias("vh"))


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col, elev."""
    o = table(spark, sf_dir, "orders")
    return o.select(_div("o_orderkey", DEM_WIDTH).alias("row"), (F.col("o_orderkey") % DEM_WIDTH).cast("int").alias("col"), (F.col("o_totalprice") / 1000 + 1000).alias("elev"))


def _bands(key: str, zero, missing):
    return [F.when(missing, None).when(zero, 0.0).otherwise((F.col(key) * a + b) % 491 / 1000).alias(name) for name, (a, b) in BAND_PATTERN.items()]


def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row, col and seven bands on the grid of dem."""
    o = table(spark, sf_dir, "orders")
    bands = _bands("o_orderkey", F.col("o_orderkey") % 97 == 0, F.col("o_orderstatus") == "P")
    return o.select(_div("o_orderkey", DEM_WIDTH).alias("row"), (F.col("o_orderkey") % DEM_WIDTH).cast("int").alias("col"), *bands)


def s2_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """obs, row, col, scl, mask and seven bands on the grid of s1."""
    e = table(spark, sf_dir, "events").withColumn("p", _div("event_id", DATES))
    bands = _bands("event_id", F.col("event_id") % 97 == 0, F.lit(False))
    return e.select((F.col("event_id") % DATES).cast("int").alias("obs"), _div("p", S1_WIDTH).alias("row"), (F.col("p") % S1_WIDTH).alias("col"), (F.col("user_id") % 12).cast("int").alias("scl"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("mask"), *bands)


def precip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pixel, month, precip: 25 pixels by 80 months, 0 where nothing was ordered."""
    o, cu = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    sums = o.join(cu, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("pixel"), F.trunc("o_orderdate", "month").alias("month")).agg(F.sum("o_totalprice").alias("s"))
    months = spark.range(1).select(F.explode(F.expr("sequence(date'1995-01-01', date'2001-08-01', interval 1 month)")).alias("month"))
    pixels = spark.range(25).select(F.col("id").cast("int").alias("pixel"))  # a grid of fixed size
    grid = pixels.withColumn("one", F.lit(1)).join(months.withColumn("one", F.lit(1)), "one").drop("one")
    return grid.join(sums, ["pixel", "month"], "left").select("pixel", "month", F.coalesce(F.col("s") / 1e5, F.lit(0.0)).alias("precip"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, row, col, obs: points on the grid of dem, some off it, some without a value."""
    k = F.col("c_custkey") * 10 + F.col("c_custkey") % 10
    cu = table(spark, sf_dir, "customer").withColumn("k", k)
    return cu.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 50 == 0, -1).otherwise(_div("k", DEM_WIDTH)).alias("row"), (F.col("k") % DEM_WIDTH).cast("int").alias("col"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("obs"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quantity, discount, tax, price, block."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_quantity").alias("quantity"), (F.col("l_discount") + 0.0).alias("discount"), (F.col("l_tax") + 0.0).alias("tax"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("block"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, obs, pred, lo, hi, fold."""
    p = table(spark, sf_dir, "part")
    pred = F.col("p_size") * 2 + 950.0
    return p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("obs"), pred.alias("pred"), (pred - 60).alias("lo"), (pred + 60).alias("hi"), (F.col("p_partkey") % 5).cast("int").alias("fold"))


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred, target in {0, 1}, target NULL for a part of the rows: to be ignored."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(F.col("toxic").alias("pred"), F.when(F.col("doc_id") % 11 != 0, F.col("quality")).alias("target"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c, id, v, label: channels of vectors in long form."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("c", "v")).select("c", "id", F.when(F.col("id") % 13 != 0, F.col("v").cast("double")).alias("v"), "label")


#: The same relations for DuckDB.
VIEWS = {
    "vr_s1": """SELECT (event_id % 8)::INT AS t, ((event_id // 8) // 25)::INT AS "row", ((event_id // 8) % 25)::INT AS col, (DATE '2023-01-01' + (34 * (event_id % 8))::INT)::DATE AS acq_date, CASE WHEN event_type <> 'error' THEN value / 25 - 25 END AS vv, CASE WHEN event_type <> 'error' THEN value / 25 - 25 - 5 - user_id % 7 END AS vh FROM events""",
    "vr_dem": """SELECT (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col, o_totalprice / 1000 + 1000 AS elev FROM orders""",
    "vr_s2": 'SELECT (o_orderkey // 100)::INT AS "row", (o_orderkey % 100)::INT AS col, ' + ", ".join(f"CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderkey % 97 = 0 THEN 0.0::DOUBLE ELSE ((o_orderkey * {a} + {b}) % 491)::DOUBLE / 1000 END AS {n}" for n, (a, b) in BAND_PATTERN.items()) + " FROM orders",
    "vr_obs": """SELECT (event_id % 8)::INT AS obs, ((event_id // 8) // 25)::INT AS "row", ((event_id // 8) % 25)::INT AS col, (user_id % 12)::INT AS scl, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS mask, """ + ", ".join(f"CASE WHEN event_id % 97 = 0 THEN 0.0::DOUBLE ELSE ((event_id * {a} + {b}) % 491)::DOUBLE / 1000 END AS {n}" for n, (a, b) in BAND_PATTERN.items()) + " FROM events",
    "vr_precip": """SELECT p.pixel, m.month, coalesce(s.s / 1e5, 0.0) AS precip FROM (SELECT range::INT AS pixel FROM range(25)) p CROSS JOIN (SELECT range::DATE AS month FROM range(DATE '1995-01-01', DATE '2001-09-01', INTERVAL 1 MONTH)) m LEFT JOIN (SELECT c_nationkey AS pixel, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice) AS s FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) s ON s.pixel = p.pixel AND s.month = m.month""",
    "vr_points": """SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN -1 ELSE (c_custkey * 10 + c_custkey % 10) // 100 END::INT AS "row", ((c_custkey * 10 + c_custkey % 10) % 100)::INT AS col, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS obs FROM customer""",
    "vr_feat": "SELECT l_quantity AS quantity, l_discount + 0.0 AS discount, l_tax + 0.0 AS tax, l_extendedprice AS price, l_suppkey AS block FROM lineitem",
    "vr_pred": "SELECT p_partkey AS id, p_retailprice AS obs, p_size * 2 + 950.0::DOUBLE AS pred, p_size * 2 + 890.0::DOUBLE AS lo, p_size * 2 + 1010.0::DOUBLE AS hi, (p_partkey % 5)::INT AS fold FROM part",
    "vr_class": "SELECT toxic AS pred, CASE WHEN doc_id % 11 <> 0 THEN quality END AS target FROM labels",
    "vr_cube": "SELECT c - 1 AS c, id, CASE WHEN id % 13 <> 0 THEN v::DOUBLE END AS v, label FROM (SELECT vec_id AS id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS c FROM embeddings)",
}


def with_views(sql: str) -> str:
    """sql after a WITH of the views that it names."""
    used = [f"{n} AS ({q})" for n, q in VIEWS.items() if n in sql]
    return ("WITH RECURSIVE " + ", ".join(used) + ("," if sql.lstrip().upper().startswith("WITH ") else " ") + (sql.lstrip()[5:] if sql.lstrip().upper().startswith("WITH ") else sql)) if used else sql
