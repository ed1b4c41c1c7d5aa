"""Registered queries over the virtual rasters, each with the SQL that DuckDB must agree with where there is one.

A docstring names the inventory IDs that a query covers. Results are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from .tables import checkpointed
from ..operators import climate, hydrology, ml, resample, stats, stencil, temporal, tiles
from ..sources import acquire
from ..sources import virtual as V
from ..sources.files import catalog, coverage_url

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = V.with_views(sql)
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to some decimals, without negative zeros."""
    return df.select(*[(F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


def r12(x: str) -> str:
    """For means of short decimals, whose sixth may be a tie."""
    return f"round({x}, 12) + 0.0"


def r8(x: str) -> str:
    """For values of seven decimals, whose sixth would be a tie."""
    return f"round({x}, 8) + 0.0"


def linear(df: DataFrame) -> DataFrame:
    return df.withColumns({"vv": S.db_to_linear("vv"), "vh": S.db_to_linear("vh")})


SEASON = "CASE WHEN month(acq_date) IN (1, 2, 3) THEN 'wet' WHEN month(acq_date) IN (7, 8, 9) THEN 'dry' END"
COMPOSITES = """wet AS (SELECT "row", col, quantile_cont(vv, 0.5) AS wet FROM vr_s1 WHERE t <= 2 GROUP BY 1, 2),
    dry AS (SELECT "row", col, quantile_cont(vv, 0.5) AS dry FROM vr_s1 WHERE t >= 6 GROUP BY 1, 2),
    pairs AS (SELECT wet."row", wet.col, wet, dry, pow(10, wet / 10) AS w, pow(10, dry / 10) AS d FROM wet JOIN dry USING ("row", col)),
    index_ AS (SELECT "row", col, CASE WHEN w + d >= 1e-12 THEN (w - d) / (w + d) END AS nddi FROM pairs)"""


def season_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median wet and dry composites of each pixel, in one pass."""
    s1 = V.s1(spark, sf_dir)
    return s1.groupBy("row", "col").agg(F.percentile(F.when(F.col("t") <= 2, F.col("vv")), F.lit(0.5)).alias("wet"), F.percentile(F.when(F.col("t") >= 6, F.col("vv")), F.lit(0.5)).alias("dry"))


def nddi_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return season_pair(spark, sf_dir).withColumn("nddi", S.nddi("wet", "dry"))


# scenes, composites and statistics over time


@query(f"""SELECT "row", col, {r6("quantile_cont(10 * log10(pow(10, vv / 10)), 0.5)")} AS vv, {r6("quantile_cont(10 * log10(pow(10, vh / 10)), 0.5)")} AS vh, CASE WHEN count(vv) > 0 THEN 1 ELSE 0 END AS mask FROM vr_s1 GROUP BY 1, 2""")
def s1_median_composite(spark, sf_dir):
    """A1, F3, S1"""
    return rounded(temporal.median_composite(linear(V.s1(spark, sf_dir)), ["vv", "vh"]))


@query(f"""SELECT "row", col, {r6("vv")} AS vv, {r6("vh")} AS vh FROM vr_s1 WHERE t = 3""")
def s1_single_scene_db(spark, sf_dir):
    """P12, S5"""
    one = linear(V.s1(spark, sf_dir).where("t = 3"))
    return rounded(one.select("row", "col", S.linear_to_db("vv").alias("vv"), S.linear_to_db("vh").alias("vh")))


@query(f"""SELECT t, "row", col, acq_date, {r6("vv")} AS vv FROM vr_s1 WHERE acq_date BETWEEN DATE '2023-02-01' AND DATE '2023-06-30' AND "row" BETWEEN 2 AND 20 AND col BETWEEN 3 AND 15""")
def s1_scan_filtered(spark, sf_dir):
    """Time and box predicates"""
    x = V.s1(spark, sf_dir).where(F.col("acq_date").between("2023-02-01", "2023-06-30") & F.col("row").between(2, 20) & F.col("col").between(3, 15))
    return rounded(x.select("t", "row", "col", "acq_date", "vv"))


@query("""SELECT s::DATE AS w_start, least((s + INTERVAL 11 DAY)::DATE, DATE '2023-12-31') AS w_end FROM generate_series(DATE '2023-01-01', DATE '2023-12-31', INTERVAL 12 DAY) x(s)""")
def date_windows(spark, sf_dir):
    """T13"""
    return temporal.date_windows(spark, "2023-01-01", "2023-12-31", 12)


@query(f"""SELECT {SEASON} AS season, count(*) AS n, count(vv) AS n_valid FROM vr_s1 GROUP BY 1""")
def season_index(spark, sf_dir):
    """F10"""
    s = S.season("acq_date", V.WET, V.DRY)
    return V.s1(spark, sf_dir).groupBy(s.alias("season")).agg(F.count("*").alias("n"), F.count("vv").alias("n_valid"))


@query(f"""SELECT t, "row", col, {r6("vv - vh")} AS ratio FROM vr_s1""")
def vv_vh_ratio(spark, sf_dir):
    """P1"""
    return rounded(V.s1(spark, sf_dir).select("t", "row", "col", S.ratio_db("vv", "vh").alias("ratio")))


@query(f"""WITH {COMPOSITES} SELECT "row", col, {r6("nddi")} AS nddi FROM index_""")
def nddi(spark, sf_dir):
    """P2, J1"""
    return rounded(nddi_pixels(spark, sf_dir).select("row", "col", "nddi"))


@query(f"""SELECT t, "row", col, {r6("10 * log10(pow(10, vv / 10))")} AS vv, {r6("greatest(0, least(1, (vv - vh) / 10))")} AS depth FROM vr_s1""")
def db_roundtrip(spark, sf_dir):
    """P11"""
    x = V.s1(spark, sf_dir)
    return rounded(x.select("t", "row", "col", S.linear_to_db(S.db_to_linear("vv")).alias("vv"), F.when(F.col("vv").isNotNull(), S.clamp((F.col("vv") - F.col("vh")) / 10)).alias("depth")))


ORACLES["db_roundtrip"] = V.with_views(f"""SELECT t, "row", col, {r6("10 * log10(pow(10, vv / 10))")} AS vv, {r6("CASE WHEN vv IS NOT NULL THEN greatest(0.0, least(1.0, (vv - vh) / 10)) END")} AS depth FROM vr_s1""")

_ND = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN abs(({a}) + ({b})) < 1e-9 THEN 0.0::DOUBLE ELSE (({a}) - ({b})) / (({a}) + ({b})) END"
OPTICAL_SQL = {
    "bsi": _ND.format(a="b11 + b04", b="b08 + b02"),
    "clay_index": "CASE WHEN abs(b12) >= 1e-9 THEN b11 / b12 END",
    "ndvi": _ND.format(a="b08", b="b04"),
    "ndwi": _ND.format(a="b03", b="b08"),
    "iron_oxide": "CASE WHEN abs(b02) >= 1e-9 THEN b04 / b02 END",
}


def _optical(name: str):
    def one(spark, sf_dir):
        return rounded(V.s2(spark, sf_dir).select("row", "col", F.when(S.valid(), S.INDICES[name]()).alias(name)))

    one.__name__, one.__doc__ = name, "P3 to P7, P9, S16"
    query(f"""SELECT "row", col, {r6(OPTICAL_SQL[name])} AS {name} FROM vr_s2""")(one)


for _name in S.INDICES:
    _optical(_name)


@query('SELECT "row", col, ' + ", ".join(f"{r6(x)} AS {n}" for n, x in OPTICAL_SQL.items()) + " FROM vr_s2")
def optical_all(spark, sf_dir):
    """All indices in one projection"""
    return rounded(V.s2(spark, sf_dir).select("row", "col", *[F.when(S.valid(), x()).alias(n) for n, x in S.INDICES.items()]))


_CLEAR = "mask = 1 AND scl NOT IN (0, 1, 2, 3, 6, 8, 9, 10, 11)"


@query(f"""SELECT "row", col, {", ".join(f"{r6(f'quantile_cont({b}, 0.5)')} AS {b}" for b in S.BANDS)} FROM vr_obs WHERE {_CLEAR} AND (b08 - b04) / (b08 + b04 + 1e-9) <= 0.4 GROUP BY 1, 2""")
def bare_soil_composite(spark, sf_dir):
    """A2, F1, F2, S4"""
    return rounded(temporal.bare_soil_composite(V.s2_observations(spark, sf_dir), S.BANDS))


@query(f"""SELECT "row", col, {r6("quantile_cont((b08 - b04) / (b08 + b04 + 1e-9), 0.5)")} AS ndvi, {r6("quantile_cont((b08 - b11) / (b08 + b11 + 1e-9), 0.5)")} AS ndmi FROM vr_obs WHERE {_CLEAR} GROUP BY 1, 2""")
def seasonal_ndvi_ndmi(spark, sf_dir):
    """A3, P10, S6"""
    return rounded(temporal.seasonal_indices(V.s2_observations(spark, sf_dir), {"ndvi": S.observed_index("b08", "b04"), "ndmi": S.observed_index("b08", "b11")}))


@query(f"""SELECT "row", col, {r6("avg(vv)")} AS mean, {r6("stddev_pop(vv)")} AS std, {r6("quantile_cont(vv, 0.1)")} AS p10, {r6("quantile_cont(vv, 0.9)")} AS p90, {r6("quantile_cont(vv, 0.9) - quantile_cont(vv, 0.1)")} AS amplitude FROM vr_s1 GROUP BY 1, 2""")
def temporal_stats(spark, sf_dir):
    """A4, A4b"""
    return rounded(temporal.temporal_stats(V.s1(spark, sf_dir), "vv"))


@query(f"""SELECT "row", col, {r6(f"avg(vv) FILTER ({SEASON} = 'wet') - avg(vv) FILTER ({SEASON} = 'dry')")} AS delta FROM vr_s1 GROUP BY 1, 2""")
def wet_dry_delta(spark, sf_dir):
    """A5"""
    return rounded(temporal.wet_dry_delta(V.s1(spark, sf_dir), "vv", S.season("acq_date", V.WET, V.DRY)))


@query(f"""WITH g AS (SELECT t, "row", col, pow(10, vv / 10) AS v FROM vr_s1),
    e AS (SELECT max("row") AS hr, max(col) AS hc FROM g),
    k AS (SELECT range AS k FROM range(-3, 4)),
    down AS (SELECT g.t, g."row", g.col, sum(coalesce(n.v, 0)) AS s, count(n.v) AS c FROM g CROSS JOIN k CROSS JOIN e JOIN g n ON n.t = g.t AND n.col = g.col AND n."row" = greatest(0, least((SELECT max(x."row") FROM g x WHERE x.t = g.t AND x.col = g.col), g."row" + k.k)) GROUP BY 1, 2, 3),
    both_ AS (SELECT d.t, d."row", d.col, sum(n.s) AS s, sum(n.c) AS c FROM down d CROSS JOIN k JOIN down n ON n.t = d.t AND n."row" = d."row" AND n.col = greatest(0, least((SELECT max(x.col) FROM g x WHERE x.t = d.t AND x."row" = d."row"), d.col + k.k)) GROUP BY 1, 2, 3),
    m AS (SELECT t, "row", col, g.v, CASE WHEN c > 0 THEN s / c END AS m FROM both_ JOIN g USING (t, "row", col))
    SELECT t, "row", col, {r6("CASE WHEN v IS NOT NULL THEN m * avg(CASE WHEN m > 0 THEN v / m END) OVER (PARTITION BY \"row\", col) END")} AS filtered FROM m""")
def speckle_filter(spark, sf_dir):
    """W1, A23"""
    out = temporal.speckle_filter(linear(V.s1(spark, sf_dir)), "vv", 7)
    return rounded(out.select("t", "row", "col", "filtered"))


# terrain and hydrology

_NINE = """n AS (SELECT "row", col, elev AS e, lag(elev) OVER dn AS b, lead(elev) OVER dn AS h FROM vr_dem WINDOW dn AS (PARTITION BY col ORDER BY "row")),
    w AS (SELECT *, lag(b) OVER al AS a, lead(b) OVER al AS c, lag(e) OVER al AS d, lead(e) OVER al AS f, lag(h) OVER al AS g, lead(h) OVER al AS i FROM n WINDOW al AS (PARTITION BY "row" ORDER BY col)),
    grad AS (SELECT *, a + b + c + d + e + f + g + h + i IS NOT NULL AS ok, ((c + f * 2 + i) - (a + d * 2 + g)) / 240 AS dx0, ((g + h * 2 + i) - (a + b * 2 + c)) / 240 AS dy0 FROM w),
    gr AS (SELECT *, CASE WHEN ok THEN dx0 END AS dx, CASE WHEN ok THEN dy0 END AS dy FROM grad)"""
_SLOPE = "degrees(atan(sqrt(dx * dx + dy * dy)))"


@query(f"""WITH {_NINE} SELECT "row", col, {r6(_SLOPE)} AS slope FROM gr""")
def slope(spark, sf_dir):
    """W7, W13"""
    return rounded(stencil.terrain(V.dem(spark, sf_dir)).select("row", "col", "slope"))


@query(f"""WITH {_NINE}, th AS (SELECT "row", col, dx, dy, degrees(atan2(dy, -dx)) AS th FROM gr), az AS (SELECT *, CASE WHEN th > 90 THEN 450 - th ELSE 90 - th END AS az FROM th)
    SELECT "row", col, {r6("CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN az = 360 THEN 0 ELSE az END")} AS aspect FROM az""")
def aspect(spark, sf_dir):
    """W8"""
    return rounded(stencil.terrain(V.dem(spark, sf_dir)).select("row", "col", "aspect"))


@query(f"""WITH {_NINE} SELECT "row", col, {r6("CASE WHEN ok THEN greatest(a, b, c, d, e, f, g, h, i) - least(a, b, c, d, e, f, g, h, i) END")} AS roughness FROM gr""")
def roughness(spark, sf_dir):
    """W9"""
    return rounded(stencil.terrain(V.dem(spark, sf_dir)).select("row", "col", "roughness"))


@query(f"""WITH {_NINE} SELECT "row", col, {r6("CASE WHEN ok THEN 1 + 254 * greatest(0.0, cos(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + sin(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(dy, -dx))) END")} AS hillshade FROM gr""")
def hillshade(spark, sf_dir):
    """W10"""
    return rounded(stencil.terrain(V.dem(spark, sf_dir)).select("row", "col", "hillshade"))


def _grad_sql(x: str, along: str, other: str) -> str:
    w = f'(PARTITION BY "{other}" ORDER BY "{along}")'
    return f"CASE WHEN lag(\"{along}\") OVER {w} IS NULL THEN (lead({x}) OVER {w} - {x}) / 30 WHEN lead(\"{along}\") OVER {w} IS NULL THEN ({x} - lag({x}) OVER {w}) / 30 ELSE (lead({x}) OVER {w} - lag({x}) OVER {w}) / 60 END"


@query(f"""WITH g AS (SELECT "row", "col", {_grad_sql("elev", "col", "row")} AS zx, {_grad_sql("elev", "row", "col")} AS zy FROM vr_dem)
    SELECT "row", "col", {r6(f"-(({_grad_sql('zx', 'col', 'row')}) + ({_grad_sql('zy', 'row', 'col')}))")} AS curvature FROM g""")
def curvature(spark, sf_dir):
    """W12"""
    return rounded(stencil.curvature(V.dem(spark, sf_dir)))


_DROPS = ", ".join(f"{{'o': {k}, 'dr': {dr}, 'dc': {dc}, 'drop': (e - {n}) / {float((dr * dr + dc * dc) ** 0.5)!r}}}" for k, (n, (dr, dc)) in enumerate(hydrology.STEPS.items()))
D8 = f"""n AS (SELECT "row", col, elev AS e, lag(elev) OVER dn AS b, lead(elev) OVER dn AS h FROM vr_dem WINDOW dn AS (PARTITION BY col ORDER BY "row")),
    w AS (SELECT *, lag(b) OVER al AS a, lead(b) OVER al AS c, lag(e) OVER al AS d, lead(e) OVER al AS f, lag(h) OVER al AS g, lead(h) OVER al AS i FROM n WINDOW al AS (PARTITION BY "row" ORDER BY col)),
    s AS (SELECT "row", col, unnest([{_DROPS}]) AS s FROM w),
    p AS (SELECT "row", col, "row" + s.dr AS tr, col + s.dc AS tc FROM s WHERE s.drop > 0 QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY s.drop DESC, s.o) = 1),
    walk AS (SELECT "row", col FROM vr_dem UNION ALL SELECT p.tr, p.tc FROM walk JOIN p ON p."row" = walk."row" AND p.col = walk.col),
    acc AS (SELECT "row", col, count(*) AS cells FROM walk GROUP BY 1, 2)"""


@query(f"""WITH {D8} SELECT "row"::INT AS "row", col::INT AS col, cells FROM acc""")
def d8_accumulation(spark, sf_dir):
    """Accumulation over the unfilled surface"""
    return hydrology.d8_accumulation(V.dem(spark, sf_dir), checkpoint=checkpointed)


def _nine_sql(columns: str, source: str, more: str = "") -> str:
    """source's rows with the 3 x 3 neighbours of some columns, suffixed a to i."""
    names = columns.split()
    down = ", ".join(f"lag({n}) OVER dn AS {n}_b, {n} AS {n}_e, lead({n}) OVER dn AS {n}_h" for n in names)
    along = ", ".join(f"lag({n}_{m}) OVER al AS {n}_{x}, {n}_{m}, lead({n}_{m}) OVER al AS {n}_{y}" for n in names for x, m, y in ("abc", "def", "ghi"))
    return f"""(SELECT r, c, {more} {along} FROM (SELECT r, c, {more} {down} FROM {source} WINDOW dn AS (PARTITION BY c ORDER BY r)) WINDOW al AS (PARTITION BY r ORDER BY c))"""


# relaxation: a cell's level falls to the lowest of its neighbours', but not below its height, until none falls any more
_EDGE = "r IN ((SELECT min(\"row\") FROM vr_dem), (SELECT max(\"row\") FROM vr_dem)) OR c IN ((SELECT min(col) FROM vr_dem), (SELECT max(col) FROM vr_dem))"
FILL = f"""f0 AS (SELECT "row" AS r, col AS c, elev AS z FROM vr_dem),
    f AS (SELECT 0 AS n, r, c, z, CASE WHEN {_EDGE} THEN z ELSE 1e300::DOUBLE END AS w, true AS go FROM f0
        UNION ALL SELECT n + 1, r, c, z, v, bool_or(v < w) OVER () FROM
            (SELECT n, r, c, z, w, greatest(z, least(w, min(u) OVER (PARTITION BY r ORDER BY c ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))) AS v FROM
                (SELECT *, min(w) OVER (PARTITION BY c ORDER BY r ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS u FROM f WHERE go))),
    filled AS (SELECT r, c, w FROM f WHERE n = (SELECT max(n) FROM f))"""
# steepest descent, and the number of steps over cells of one height to a cell that has it or stands at the border
_STEP_LIST = ", ".join(f"{{'o': {k}, 'dr': {dr}, 'dc': {dc}, 'drop': (w_e - w_{n}) / {float((dr * dr + dc * dc) ** 0.5)!r}}}" for k, (n, (dr, dc)) in enumerate(hydrology.STEPS.items()))
_FLAT_LIST = ", ".join(f"CASE WHEN w_{n} = w_e THEN d_{n} END" for n in hydrology.STEPS)
_NEARER_LIST = ", ".join(f"{{'o': {k}, 'dr': {dr}, 'dc': {dc}, 'ok': w_{n} = w_e AND d_{n} = d_e - 1}}" for k, (n, (dr, dc)) in enumerate(hydrology.STEPS.items()))
FILLED_ACC = f"""{FILL},
    p0 AS (SELECT r, c, w_e AS w, list_filter([{_STEP_LIST}], lambda x: x.drop > 0) AS s FROM {_nine_sql("w", "filled")}),
    p1 AS (SELECT r, c, w, CASE WHEN len(s) > 0 THEN list_reduce(s, lambda x, y: CASE WHEN y.drop > x.drop THEN y ELSE x END) END AS s FROM p0),
    g AS (SELECT 0 AS n, r, c, w, s, CASE WHEN s IS NOT NULL OR {_EDGE} THEN 0 ELSE 1000000000 END AS d, true AS go FROM p1
        UNION ALL SELECT n + 1, r, c, w_e, s, v, bool_or(v < d_e) OVER () FROM (SELECT n, r, c, s, w_e, d_e, least(d_e, 1 + coalesce(list_min([{_FLAT_LIST}]), 1000000000)) AS v FROM {_nine_sql("w d", "(SELECT * FROM g WHERE go)", "n, s,")})),
    h AS (SELECT r, c, s, list_filter([{_NEARER_LIST}], lambda x: x.ok)[1] AS q, d_e AS d FROM {_nine_sql("w d", "(SELECT * FROM g WHERE n = (SELECT max(n) FROM g))", "s,")}),
    pp AS (SELECT r, c, CASE WHEN s IS NOT NULL THEN r + s.dr ELSE r + q.dr END AS tr, CASE WHEN s IS NOT NULL THEN c + s.dc ELSE c + q.dc END AS tc FROM h WHERE s IS NOT NULL OR d > 0),
    walk AS (SELECT r, c FROM f0 UNION ALL SELECT pp.tr, pp.tc FROM walk JOIN pp ON pp.r = walk.r AND pp.c = walk.c),
    acc AS (SELECT r AS "row", c AS col, count(*) AS cells FROM walk GROUP BY 1, 2)"""


@query(f"""WITH {FILL} SELECT r::INT AS "row", c::INT AS col, {r6("w")} AS filled FROM filled""")
def fill_depressions(spark, sf_dir):
    """filling"""
    return rounded(hydrology.fill_depressions(V.dem(spark, sf_dir), checkpoint=checkpointed))


@query(f"""WITH {FILLED_ACC} SELECT "row"::INT AS "row", col::INT AS col, cells FROM acc""")
def d8_accumulation_filled(spark, sf_dir):
    """Accumulation over the filled surface"""
    return hydrology.accumulate_filled(V.dem(spark, sf_dir), checkpoint=checkpointed)


def _wet(spark, sf_dir):
    dem = V.dem(spark, sf_dir)
    return hydrology.wetness(hydrology.accumulate_filled(dem, checkpoint=checkpointed), stencil.terrain(dem))


_ACC = f"""{FILLED_ACC}, {_NINE},
    sl AS (SELECT gr."row", gr.col, cells * 30.0 AS area, CASE WHEN ok THEN {_SLOPE} END AS slope FROM gr JOIN acc ON acc."row" = gr."row" AND acc.col = gr.col)"""


@query(f"""WITH {_ACC} SELECT "row", col, {r6("CASE WHEN slope IS NOT NULL THEN ln(area / tan(radians(greatest(slope, 0.1)))) END")} AS twi FROM sl""")
def twi(spark, sf_dir):
    """Depressions filled first; the slope is that of the surface as it is"""
    return rounded(_wet(spark, sf_dir).select("row", "col", "twi"))


@query(f"""WITH {_ACC} SELECT "row", col, {r6("CASE WHEN slope IS NOT NULL THEN area * tan(radians(greatest(slope, 0.1))) END")} AS stream_power FROM sl""")
def stream_power(spark, sf_dir):
    """P14, W15"""
    return rounded(_wet(spark, sf_dir).select("row", "col", "stream_power"))


@query(f"""WITH {_NINE}, x AS (SELECT gr."row", gr.col, {OPTICAL_SQL["ndvi"]} AS mi, gr.e - 1000 AS fa, {_SLOPE} AS slope FROM gr JOIN vr_s2 s ON s."row" = gr."row" AND s.col = gr.col),
    v AS (SELECT * FROM x WHERE mi IS NOT NULL AND fa IS NOT NULL AND slope IS NOT NULL), m AS (SELECT max(ln(1 + fa)) AS f, max(slope) AS s FROM v)
    SELECT "row", col, {r6("greatest(0.0, least(1.0, mi)) * 0.5 + ln(1 + fa) / (f + 1e-9) * 0.3 + greatest(0.0, least(1.0, 1 - slope / (s + 1e-9))) * 0.2")} AS risk FROM v, m""")
def construction_risk(spark, sf_dir):
    """P15"""
    dem = V.dem(spark, sf_dir)
    x = stencil.terrain(dem).join(dem.select("row", "col", (F.col("elev") - 1000).alias("fa")), ["row", "col"]).join(V.s2(spark, sf_dir).select("row", "col", S.ndvi().alias("mi")), ["row", "col"])
    return rounded(hydrology.construction_risk(x, "mi", "fa", "slope"))


@query(f"""WITH p AS (SELECT quantile_cont(elev, 0.02) AS lo, quantile_cont(elev, 0.98) AS hi FROM vr_dem) SELECT "row", col, {r6("greatest(0.0, least(1.0, (elev - lo) / (hi - lo + 1e-9)))")} AS scaled FROM vr_dem, p""")
def minmax_p2_p98(spark, sf_dir):
    """P16"""
    return rounded(hydrology.percentile_scaled(V.dem(spark, sf_dir), "elev", "scaled").select("row", "col", "scaled"))


@query(f"""WITH {_NINE}, x AS (SELECT gr."row", gr.col, {_SLOPE} AS slope, {OPTICAL_SQL["ndvi"]} AS veg FROM gr JOIN vr_s2 s ON s."row" = gr."row" AND s.col = gr.col),
    p AS (SELECT quantile_cont(slope, 0.02) AS sl, quantile_cont(slope, 0.98) AS sh, quantile_cont(veg, 0.02) AS vl, quantile_cont(veg, 0.98) AS vh FROM x)
    SELECT "row", col, {r6("greatest(0.0, least(1.0, (slope - sl) / (sh - sl + 1e-9))) * (1 - greatest(0.0, least(1.0, (veg - vl) / (vh - vl + 1e-9))))")} AS risk FROM x, p WHERE slope IS NOT NULL AND veg IS NOT NULL""")
def erosion_risk(spark, sf_dir):
    """P17, P16"""
    x = stencil.terrain(V.dem(spark, sf_dir)).select("row", "col", "slope").join(V.s2(spark, sf_dir).select("row", "col", S.ndvi().alias("veg")), ["row", "col"])
    x = hydrology.percentile_scaled(hydrology.percentile_scaled(x, "slope", "s"), "veg", "v")
    return rounded(x.where("s IS NOT NULL AND v IS NOT NULL").select("row", "col", (F.col("s") * (1 - F.col("v"))).alias("risk")))


# grids


@query(f"""WITH s AS (SELECT floor((max("row") + 1) * 2.5)::BIGINT AS h, floor((max(col) + 1) * 2.5)::BIGINT AS w FROM vr_dem),
    t AS (SELECT r."row", c.col, (r."row" + 0.5) / 2.5 - 0.5 AS y, (c.col + 0.5) / 2.5 - 0.5 AS x FROM (SELECT unnest(range(h)) AS "row" FROM s) r, (SELECT unnest(range(w)) AS col FROM s) c),
    q AS (SELECT *, floor(y)::INT AS r0, floor(x)::INT AS c0, y - floor(y) AS fy, x - floor(x) AS fx FROM t),
    n AS (SELECT "row", col, unnest([{{'sr': r0, 'sc': c0, 'w': (1 - fy) * (1 - fx)}}, {{'sr': r0, 'sc': c0 + 1, 'w': (1 - fy) * fx}}, {{'sr': r0 + 1, 'sc': c0, 'w': fy * (1 - fx)}}, {{'sr': r0 + 1, 'sc': c0 + 1, 'w': fy * fx}}]) AS n FROM q)
    SELECT n."row"::INT AS "row", n.col::INT AS col, {r8("CASE WHEN sum(CASE WHEN elev IS NOT NULL THEN n.w END) > 1e-12 THEN sum(n.w * elev) / sum(CASE WHEN elev IS NOT NULL THEN n.w END) END")} AS elev FROM n LEFT JOIN vr_dem d ON d."row" = n.sr AND d.col = n.sc GROUP BY 1, 2""")
def resample_bilinear(spark, sf_dir):
    """The whole raster on cells of 1 / 2.5 of its size"""
    dem = V.dem(spark, sf_dir)
    return rounded(resample.bilinear(dem, resample.finer_grid(dem, 2.5), "elev", 2.5), 8)


@query("""WITH g AS (SELECT id, 32.004::DOUBLE + col / 50.0::DOUBLE AS lon, 36.9997::DOUBLE - "row" / 1000.0::DOUBLE AS lat FROM vr_points)
    SELECT id, d.elev FROM g LEFT JOIN vr_dem d ON d."row" = floor((37.0005::DOUBLE - lat) / 0.001::DOUBLE) AND d.col = floor((lon - 31.99::DOUBLE) / 0.02::DOUBLE)""")
def sample_lonlat(spark, sf_dir):
    """Points by longitude and latitude into a raster with a transform; off the raster NULL"""
    g = V.points(spark, sf_dir).select("id", (F.col("col") / 50 + 32.004).alias("lon"), (36.9997 - F.col("row") / 1000).alias("lat"))
    placed = resample.cells_of(g, "lon", "lat", resample.Transform(31.99, 37.0005, 0.02, 0.001, 1 << 30, V.DEM_WIDTH))
    return resample.sample_points(placed, V.dem(spark, sf_dir), "elev").select("id", "elev")


@query(f"""SELECT ("row" // 7)::INT AS "row", (col // 7)::INT AS col, {r12("avg(b04)")} AS b04, {r12("avg(b08)")} AS b08 FROM vr_s2 GROUP BY 1, 2""")
def aggregate_coarse(spark, sf_dir):
    """J5"""
    return rounded(resample.coarsen(V.s2(spark, sf_dir), 7, ["b04", "b08"]), 12)


@query(f"""WITH e AS (SELECT max("row") + 1 AS h, max(col) + 1 AS w FROM vr_s2) SELECT ("row" // 8)::INT AS "row", (col // 8)::INT AS col, {r12("avg(b11)")} AS b11 FROM vr_s2, e WHERE "row" < h - h % 8 AND col < w - w % 8 GROUP BY 1, 2""")
def block_mean(spark, sf_dir):
    """A14"""
    s2 = V.s2(spark, sf_dir)
    e = s2.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))
    return rounded(resample.coarsen(s2.join(F.broadcast(e)), 8, ["b11"], F.col("h"), F.col("w")), 12)


@query(" UNION ALL ".join(f"""SELECT {f} AS factor, ("row" // {f})::INT AS "row", (col // {f})::INT AS col, {r12("avg(b02)")} AS b02 FROM vr_s2 GROUP BY 2, 3""" for f in (2, 4, 8, 16)))
def overview_pyramid(spark, sf_dir):
    """K2"""
    return rounded(resample.overviews(V.s2(spark, sf_dir), "b02"), 12)


@query(f"""SELECT a."row", a.col, {r8("a.v")} AS power, b.label FROM (SELECT ("row" // 2)::INT AS "row", (col // 2)::INT AS col, avg(elev) AS v FROM vr_dem GROUP BY 1, 2) a JOIN (SELECT ("row" // 2)::INT AS "row", (col // 2)::INT AS col, CASE WHEN elev > 1200 THEN 1 ELSE 0 END AS label FROM vr_dem WHERE "row" % 2 = 1 AND col % 2 = 1) b ON a."row" = b."row" AND a.col = b.col""")
def chip_decimate(spark, sf_dir):
    """Averaged power joined with the nearest label"""
    dem = V.dem(spark, sf_dir)
    power = resample.coarsen(dem, 2, ["elev"]).withColumnRenamed("elev", "power")
    label = resample.decimate_nearest(dem.withColumn("label", F.when(F.col("elev") > 1200, 1).otherwise(0)), 2, "label")
    return rounded(power.join(label, ["row", "col"]), 8)


@query(f"""WITH x AS (SELECT "row", col, obs, b04 FROM (SELECT "row", col, obs, b04 FROM vr_obs WHERE scl IN (4, 5, 7)) QUALIFY row_number() OVER (PARTITION BY "row", col ORDER BY obs) = 1) SELECT "row", col, {r6("b04")} AS b04, obs FROM x""")
def mosaic_first_wins(spark, sf_dir):
    """U1, U5"""
    return rounded(temporal.mosaic(V.s2_observations(spark, sf_dir).where(F.col("scl").isin(4, 5, 7)), "obs", ["b04"]))


@query(f"""SELECT (range % 3)::INT AS tx, (range // 3)::INT AS ty, {r6("32.0 + (range % 3) * 0.1")} AS west, {r6("37.0 + (range // 3) * 0.2")} AS south, {r6("32.0 + (range % 3 + 1) * 0.1")} AS east, {r6("37.0 + (range // 3 + 1) * 0.2")} AS north FROM range(9)""")
def bbox_split(spark, sf_dir):
    """U2"""
    return rounded(resample.split_bbox(spark, 32.0, 37.0, 32.3, 37.6, 3, 3))


def _cube(spark, sf_dir):
    s2, dem = V.s2(spark, sf_dir), V.dem(spark, sf_dir)
    features = {"ndvi": s2.select("row", "col", F.when(S.valid(), S.ndvi()).alias("v")), "elev": dem.select("row", "col", F.col("elev").alias("v")), "slope": stencil.terrain(dem).select("row", "col", F.col("slope").alias("v"))}
    return resample.feature_cube(dem, features)


_CUBE = f"""{_NINE}, cube AS (SELECT gr."row", gr.col, gr.e AS elev, CASE WHEN s.b02 IS NOT NULL THEN {OPTICAL_SQL["ndvi"]} END AS ndvi, {_SLOPE} AS slope FROM gr JOIN vr_s2 s ON s."row" = gr."row" AND s.col = gr.col)"""


@query(f"""WITH {_CUBE} SELECT "row", col, {r6("elev")} AS elev, {r6("ndvi")} AS ndvi, {r6("slope")} AS slope FROM cube""")
def feature_cube(spark, sf_dir):
    """J2, J7, U4"""
    return rounded(_cube(spark, sf_dir))


@query(f"""WITH {_CUBE} SELECT c."row", c.col, {r6("elev")} AS elev, {r6("ndvi")} AS ndvi, {r6("slope")} AS slope, {r6("p.obs")} AS label, (c."row" // 20) * (100 // 20 + 1) + c.col // 20 AS block_id FROM cube c JOIN vr_points p ON p."row" = c."row" AND p.col = c.col WHERE elev IS NOT NULL AND ndvi IS NOT NULL AND slope IS NOT NULL AND p.obs IS NOT NULL""")
def training_matrix(spark, sf_dir):
    """J3, J6, F5, T7"""
    labels = V.points(spark, sf_dir).select("row", "col", F.col("obs").alias("label"))
    return rounded(resample.training_matrix(_cube(spark, sf_dir), labels, 20, V.DEM_WIDTH))


@query("""SELECT count(DISTINCT ("row" // 20) * (100 // 20 + 1) + col // 20) AS blocks, count(*) AS n FROM vr_dem""")
def block_ids(spark, sf_dir):
    """T7, A27"""
    return V.dem(spark, sf_dir).agg(F.countDistinct(S.block_id("row", "col", 20, V.DEM_WIDTH)).alias("blocks"), F.count("*").alias("n"))


@query(f"""SELECT p.id, {r6("p.obs")} AS obs, {r6("d.elev")} AS elev FROM vr_points p LEFT JOIN vr_dem d ON d."row" = p."row" AND d.col = p.col""")
def sample_points(spark, sf_dir):
    """J8, S18"""
    return rounded(resample.sample_points(V.points(spark, sf_dir), V.dem(spark, sf_dir), "elev").select("id", "obs", "elev"))


def _metric_sql(o: str, p: str) -> str:
    return f"count(*) AS n, CASE WHEN count(*) >= 2 AND var_pop({o}) > 0 THEN {r6(f'1 - sum(({p} - {o}) * ({p} - {o})) / (var_pop({o}) * count(*))')} END AS r2, {r6(f'sqrt(avg(({p} - {o}) * ({p} - {o})))')} AS rmse, {r6(f'avg(abs({p} - {o}))')} AS mae, {r6(f'avg({p} - {o})')} AS bias"


@query(f"""WITH x AS (SELECT p.obs, d.elev * 4 AS pred, s.b04 * 10000 AS base FROM vr_points p JOIN vr_dem d ON d."row" = p."row" AND d.col = p.col LEFT JOIN vr_s2 s ON s."row" = p."row" AND s.col = p.col WHERE p.obs IS NOT NULL),
    a AS (SELECT 'model' AS source, {_metric_sql("obs", "pred")} FROM x), b AS (SELECT 'baseline' AS source, {_metric_sql("obs", "base")} FROM x WHERE base IS NOT NULL),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT *, {r6("(SELECT rmse FROM b) - (SELECT rmse FROM a)")} AS rmse_improvement, (SELECT rmse FROM a) < (SELECT rmse FROM b) AS model_beats FROM u""")
def insitu_validation(spark, sf_dir):
    """J9, F7, P24"""
    x = resample.sample_points(V.points(spark, sf_dir), V.dem(spark, sf_dir), "elev").withColumn("pred", F.col("elev") * 4)
    x = resample.sample_points(x, V.s2(spark, sf_dir), "b04").withColumn("base", F.col("b04") * 10000)
    model = stats.regression_metrics(x, "obs", "pred").withColumn("source", F.lit("model"))
    base = stats.regression_metrics(x, "obs", "base").withColumn("source", F.lit("baseline"))
    both = model.select(F.col("rmse").alias("m")).join(F.broadcast(base.select(F.col("rmse").alias("b"))))
    both = both.select((F.col("b") - F.col("m")).alias("rmse_improvement"), (F.col("m") < F.col("b")).alias("model_beats"))
    return rounded(rounded(model.unionByName(base)).join(F.broadcast(both)))


_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)


def _utm_sql() -> str:
    n = _N
    e = 2 * n**0.5 / (1 + n)
    al = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    radius = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    east = " + ".join(["eta", *(f"{a!r}::DOUBLE * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(al, 1))])
    north = " + ".join(["xi", *(f"{a!r}::DOUBLE * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(al, 1))])
    return f"""WITH g AS (SELECT id, 32 + col / 50.0::DOUBLE AS lon, 37 + "row" / 1000.0::DOUBLE AS lat FROM vr_points),
        t AS (SELECT *, radians(lon - 33) AS lam, sinh(atanh(sin(radians(lat))) - {e!r}::DOUBLE * atanh({e!r}::DOUBLE * sin(radians(lat)))) AS t FROM g),
        x AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
        SELECT id, round(500000 + {0.9996 * radius!r}::DOUBLE * ({east}), 3) + 0.0 AS easting, round({0.9996 * radius!r}::DOUBLE * ({north}), 3) + 0.0 AS northing FROM x"""


@query(_utm_sql())
def lonlat_to_utm(spark, sf_dir):
    """J11"""
    g = V.points(spark, sf_dir).select("id", (F.col("col") / 50 + 32).alias("lon"), (F.col("row") / 1000 + 37).alias("lat"))
    east, north = S.utm("lon", "lat", 36)
    return g.select("id", (F.round(east, 3) + F.lit(0.0)).alias("easting"), (F.round(north, 3) + F.lit(0.0)).alias("northing"))


# statistics


def _strata(spark, sf_dir):
    return stats.quantile_strata(V.features(spark, sf_dir), "quantity", 4)


_STRATA = """q AS (SELECT quantile_cont(quantity, [0.25, 0.5, 0.75]) AS e FROM vr_feat), s AS (SELECT f.*, len(list_filter(e, lambda x: x <= quantity))::INT AS stratum FROM vr_feat f, q)"""


@query(f"WITH {_STRATA} SELECT stratum, count(*) AS n, {r6('min(quantity)')} AS least, {r6('max(quantity)')} AS most FROM s GROUP BY 1")
def quantile_strata(spark, sf_dir):
    """A6"""
    return rounded(_strata(spark, sf_dir).groupBy("stratum").agg(F.count("*").alias("n"), F.min("quantity").alias("least"), F.max("quantity").alias("most")))




@query(f"WITH {_STRATA} SELECT stratum, round(avg(price), 4) + 0.0 AS mean, {r6('quantile_cont(price, 0.5)')} AS median, round(stddev_pop(price), 4) + 0.0 AS std, {r6('quantile_cont(price, 0.25)')} AS q25, {r6('quantile_cont(price, 0.75)')} AS q75, count(*) AS n FROM s GROUP BY 1")
def stratum_stats(spark, sf_dir):
    """A7"""
    out = stats.stratum_stats(_strata(spark, sf_dir), "price")
    return rounded(out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4)}))


_SUMMARY = f"count(nddi) AS n, {r6('avg(nddi)')} AS mean, {r6('stddev_pop(nddi)')} AS std, {r6('quantile_cont(nddi, 0.1)')} AS p10, {r6('quantile_cont(nddi, 0.9)')} AS p90, {r6('avg(CASE WHEN nddi > 0.05 THEN 1.0 WHEN nddi <= 0.05 THEN 0.0 END) * 100')} AS wet_pct, {r6('avg(CASE WHEN nddi < -0.05 THEN 1.0 WHEN nddi >= -0.05 THEN 0.0 END) * 100')} AS dry_pct, {r6('avg(CASE WHEN abs(nddi) <= 0.05 THEN 1.0 WHEN abs(nddi) > 0.05 THEN 0.0 END) * 100')} AS neutral_pct"


@query(f"WITH {COMPOSITES} SELECT {_SUMMARY} FROM index_")
def nddi_summary(spark, sf_dir):
    """The flagship: composites, index, summary"""
    return rounded(stats.change_summary(nddi_pixels(spark, sf_dir), "nddi"))


def _rank(x: str, by: str = "") -> str:
    return f"rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2.0::DOUBLE"


@query(f"WITH r AS (SELECT {_rank('quantity')} AS a, {_rank('price')} AS b FROM vr_feat) SELECT count(*) AS n, {r6('corr(a, b)')} AS rho FROM r")
def spearman(spark, sf_dir):
    """A21, W3"""
    return rounded(stats.spearman(V.features(spark, sf_dir), "quantity", "price").select("n", "rho"))


_KW = """WITH x AS (SELECT {v} AS v, {g} AS g FROM {t} WHERE {v} IS NOT NULL AND {g} IS NOT NULL), r AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x),
    s AS (SELECT g, sum(r) AS s, count(*)::DOUBLE AS m FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x GROUP BY v)),
    h AS (SELECT sum(s * s / m) AS ss, sum(m) AS n FROM s) SELECT n::BIGINT AS n, round((12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) + 0.0 AS h FROM h, t"""


@query(_KW.format(v="price", g="discount", t="vr_feat"))
def kruskal_wallis(spark, sf_dir):
    """A20, W3"""
    return stats.kruskal_wallis(V.features(spark, sf_dir), "price", "discount").select("n", (F.round("h", 4) + F.lit(0.0)).alias("h"))


def _gamma_p_sql(a: str, x: str) -> str:
    """The regularised lower incomplete gamma function by its series; x a few times a at most."""
    return f"CASE WHEN ({x}) <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, list_sum(list_transform(range(0, 700), lambda i: exp((({a}) + i) * ln({x}) - ({x}) - lgamma(({a}) + i + 1))))) END"


# Student's t by Simpson's rule, chi-squared by the incomplete gamma function
_SPEARMAN_P = f"""sr AS (SELECT {_rank('discount')} AS a, {_rank('tax')} AS b FROM vr_feat), s1 AS (SELECT corr(a, b) AS rho, count(*) - 2.0::DOUBLE AS v FROM sr), s2 AS (SELECT *, abs(rho) * sqrt(v / (1 - rho * rho)) AS t FROM s1),
    s3 AS (SELECT 'spearman' AS test, rho AS statistic, 1 - 2 * exp(lgamma((v + 1) / 2) - lgamma(v / 2)) / sqrt(v * pi()) * t / 6000 * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i % 2000 = 0 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * pow(1 + (t * i / 2000) ** 2 / v, -(v + 1) / 2))) AS p FROM s2)"""


def _h_sql(v: str, g: str, t: str, name: str) -> str:
    """CTEs of a Kruskal-Wallis test, the last one with n, k, h."""
    return f"""x{name} AS (SELECT {v} AS v, {g} AS g FROM {t} WHERE {v} IS NOT NULL AND {g} IS NOT NULL), r{name} AS (SELECT v, g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM x{name}),
        g{name} AS (SELECT g, sum(r) AS s, count(*)::DOUBLE AS m FROM r{name} GROUP BY 1), t{name} AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*)::DOUBLE AS c FROM x{name} GROUP BY v)),
        {name} AS (SELECT sum(m) AS n, count(*) AS k, (12.0::DOUBLE / (sum(m) * (sum(m) + 1)) * sum(s * s / m) - 3 * (sum(m) + 1)) / (1 - any_value(ties) / (sum(m) ** 3 - sum(m))) AS h FROM g{name}, t{name})"""


@query(f"""WITH {_SPEARMAN_P}, {_h_sql("tax", "discount", "vr_feat", "kw")} SELECT test, {r6("statistic")} AS statistic, {r6("p")} AS p FROM s3 UNION ALL SELECT 'kruskal_wallis', {r6("h")}, {r6(f"1 - ({_gamma_p_sql('(k - 1) / 2.0::DOUBLE', 'h / 2')})")} FROM kw""")
def rank_p_values(spark, sf_dir):
    """P-values"""
    f = V.features(spark, sf_dir)
    a = stats.spearman(f, "discount", "tax").select(F.lit("spearman").alias("test"), F.col("rho").alias("statistic"), "p")
    return rounded(a.unionByName(stats.kruskal_wallis(f, "tax", "discount").select(F.lit("kruskal_wallis").alias("test"), F.col("h").alias("statistic"), "p")))


def _report_sql() -> str:
    """A long table of the report: name, statistic or value. Its rasters are wet, dry, nddi and two made from the pixel's place."""
    x = f"""{COMPOSITES}, base AS (SELECT i."row", i.col, wet, dry, nddi, (i."row" * 7 + i.col * 3) % 97 + 0.0::DOUBLE AS twi, (i."row" * 5 + i.col * 11) % 31 + 0.0::DOUBLE AS slope FROM index_ i JOIN pairs p ON p."row" = i."row" AND p.col = i.col WHERE wet IS NOT NULL AND dry IS NOT NULL AND nddi IS NOT NULL),
        e AS (SELECT quantile_cont(twi, [0.25, 0.5, 0.75]) AS te, quantile_cont(slope, [0.25, 0.5, 0.75]) AS se FROM base),
        v AS (SELECT base.*, len(list_filter(te, lambda z: z <= twi))::INT AS ts, len(list_filter(se, lambda z: z <= slope))::INT AS ss FROM base, e)"""
    parts = []
    for a, b in (("nddi", "twi"), ("nddi", "slope"), ("wet", "dry"), ("wet", "twi")):
        parts.append(f"SELECT 'spearman_{a}_{b}' AS name, {r6('corr(a, b)')} AS value FROM (SELECT {_rank(a)} AS a, {_rank(b)} AS b FROM v)")
    for k, (value, group, name) in enumerate((("wet", "ts", "twi"), ("dry", "ts", "twi"), ("nddi", "ts", "twi"), ("wet", "ss", "slope"))):
        x += ", " + _h_sql(value, group, "v", f"kw{k}")
        parts.append(f"SELECT 'kruskal_{value}_by_{name}', round(h, 4) + 0.0 FROM kw{k}")
    for value in ("wet", "dry"):
        for out, expr in (("mean", f"avg({value})"), ("median", f"quantile_cont({value}, 0.5)"), ("std", f"stddev_pop({value})"), ("q25", f"quantile_cont({value}, 0.25)"), ("q75", f"quantile_cont({value}, 0.75)"), ("n", "count(*)::DOUBLE")):
            parts.append(f"SELECT '{value}_{out}_' || ts, {r6(expr)} FROM v GROUP BY ts")
    for out, expr in (("mean", "avg(nddi)"), ("std", "stddev_pop(nddi)"), ("p10", "quantile_cont(nddi, 0.1)"), ("p90", "quantile_cont(nddi, 0.9)"), ("wet_pct", "avg(CASE WHEN nddi > 0.05 THEN 100.0 ELSE 0.0 END)"), ("dry_pct", "avg(CASE WHEN nddi < -0.05 THEN 100.0 ELSE 0.0 END)"), ("neutral_pct", "avg(CASE WHEN abs(nddi) <= 0.05 THEN 100.0 ELSE 0.0 END)")):
        parts.append(f"SELECT 'nddi_{out}', {r6(expr)} FROM v")
    return f"WITH {x} " + " UNION ALL ".join(parts)


@query(_report_sql())
def stats_report(spark, sf_dir):
    """Rank statistics by wetness and slope quartiles, strata of both seasons and the index's summary as one relation"""
    x = season_pair(spark, sf_dir).withColumn("nddi", S.nddi("wet", "dry", S.db_to_linear_libm)).withColumn("twi", (F.col("row") * 7 + F.col("col") * 3) % 97 + 0.0).withColumn("slope", (F.col("row") * 5 + F.col("col") * 11) % 31 + 0.0)
    return stats.report(checkpointed(x.where("wet IS NOT NULL AND dry IS NOT NULL AND nddi IS NOT NULL")), "wet", "dry", "nddi", "twi", "slope", checkpointed)


@query(f"SELECT {_metric_sql('obs', 'pred')} FROM vr_pred")
def regression_metrics(spark, sf_dir):
    """A9"""
    return rounded(stats.regression_metrics(V.predictions(spark, sf_dir)))


@query(f"WITH r AS (SELECT obs, pred, {_rank('obs')} AS a, {_rank('pred')} AS b FROM vr_pred) SELECT {_metric_sql('obs', 'pred')}, {r6('corr(obs, pred)')} AS pearson, {r6('regr_r2(obs, pred)')} AS r2_corrected, {r6('corr(a, b)')} AS spearman FROM r")
def transfer_metrics(spark, sf_dir):
    """A10"""
    return rounded(stats.transfer_metrics(V.predictions(spark, sf_dir)))


@query(f"SELECT {r6('avg(CASE WHEN obs BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END)')} AS coverage, {r6('avg(CASE WHEN obs BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) - 0.9')} AS gap, {r6('avg(hi - lo)')} AS width, {r6('avg(greatest((obs - pred) * 0.5, (obs - pred) * -0.5))')} AS pinball FROM vr_pred")
def interval_calibration(spark, sf_dir):
    """A18"""
    return rounded(stats.interval_calibration(V.predictions(spark, sf_dir), "obs", "lo", "hi", "pred"))


@query(f"WITH f AS (SELECT fold, 1 - sum((pred - obs) * (pred - obs)) / (var_pop(obs) * count(*)) AS r2, sqrt(avg((pred - obs) * (pred - obs))) AS rmse, avg(abs(pred - obs)) AS mae FROM vr_pred GROUP BY 1) SELECT " + ", ".join(f"{r6(f'avg({m})')} AS {m}_mean, {r6(f'stddev_pop({m})')} AS {m}_std" for m in ("r2", "rmse", "mae")) + " FROM f")
def cv_summary(spark, sf_dir):
    """A19"""
    return rounded(ml.summary(stats.regression_metrics(V.predictions(spark, sf_dir), by=["fold"])))


_CONF = """c AS (SELECT k AS class, sum(CASE WHEN pred = k AND target = k THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = k AND target <> k THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN pred <> k AND target = k THEN 1 ELSE 0 END) AS fn FROM vr_class, (SELECT range::INT AS k FROM range(2)) WHERE target IS NOT NULL GROUP BY 1)"""


@query(f"WITH {_CONF} SELECT {r6('avg(CASE WHEN tp + fp + fn > 0 THEN tp::DOUBLE / (tp + fp + fn) END)')} AS miou FROM c")
def mean_iou(spark, sf_dir):
    """A11, F8"""
    return rounded(stats.mean_iou(V.classes(spark, sf_dir), 2))


@query(f"WITH {_CONF} SELECT class, {r6('CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp::DOUBLE / (2 * tp + fp + fn) ELSE 0 END')} AS f1 FROM c")
def per_class_f1(spark, sf_dir):
    """A12, F8"""
    return rounded(stats.per_class_scores(V.classes(spark, sf_dir), 2).select("class", "f1"))


@query(f"WITH {_CONF} SELECT {r6('max(CASE WHEN class = 1 THEN 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) END)')} AS f1_water, {r6('avg(tp::DOUBLE / nullif(tp + fp + fn, 0))')} AS miou FROM c")
def flood_metrics(spark, sf_dir):
    """A13"""
    s = stats.per_class_scores(V.classes(spark, sf_dir), 2)
    return rounded(s.agg(F.max(F.when(F.col("class") == 1, F.col("f1"))).alias("f1_water"), F.avg("iou").alias("miou")))


@query("SELECT target, count(*) AS n FROM vr_class GROUP BY 1")
def class_histogram(spark, sf_dir):
    """A25"""
    return V.classes(spark, sf_dir).groupBy("target").agg(F.count("*").alias("n"))


@query(f"SELECT {r6('avg(CASE WHEN elev > 1100 THEN 100.0 ELSE 0.0 END)')} AS over_1100, {r6('avg(CASE WHEN elev > 1300 THEN 100.0 ELSE 0.0 END)')} AS over_1300, {r6('min(elev)')} AS least, {r6('max(elev)')} AS most, {r6('avg(elev)')} AS mean, {r6('100.0 * count(elev) / count(*)')} AS valid_pct FROM vr_dem")
def exceedance_pct(spark, sf_dir):
    """A26, A24"""
    d = V.dem(spark, sf_dir)
    return rounded(d.agg(stats.share(F.col("elev") > 1100).alias("over_1100"), stats.share(F.col("elev") > 1300).alias("over_1300"), F.min("elev").alias("least"), F.max("elev").alias("most"), F.avg("elev").alias("mean"), (F.count("elev") * 100.0 / F.count("*")).alias("valid_pct")))


# tiles and channels

def _offsets_sql(extent: str, tile: int, overlap: int) -> str:
    return f"CASE WHEN {extent} <= {tile} THEN [0] ELSE list_sort(list_distinct(list_concat(range(0, {extent} - {tile} + 1, {tile - overlap}), [{extent} - {tile}]))) END"


def tiles_sql(view: str, tile: int, overlap: int) -> str:
    """tiles (r0, c0, h, w) of a raster's whole extent."""
    return f"""x AS (SELECT max("row")::BIGINT + 1 AS eh, max(col)::BIGINT + 1 AS ew FROM {view}),
        tiles AS (SELECT r.o AS r0, c.o AS c0, least({tile}, eh) AS h, least({tile}, ew) AS w FROM x, (SELECT unnest({_offsets_sql("eh", tile, overlap)}) AS o FROM x) r, (SELECT unnest({_offsets_sql("ew", tile, overlap)}) AS o FROM x) c)"""


def _extent(df: DataFrame) -> tuple[int, int]:
    """Height and width of a raster: two numbers on the driver."""
    r = df.agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w")).first()
    return (r["h"] or 0), (r["w"] or 0)


_TILES = """o AS (SELECT unnest(list_sort(list_distinct(list_concat(range(0, 1745, 224), [1744])))) AS o), o2 AS (SELECT unnest(list_sort(list_distinct(list_concat(range(0, 1245, 224), [1244])))) AS o), tiles AS (SELECT o.o::INT AS r0, o2.o::INT AS c0, 256 AS h, 256 AS w FROM o, o2)"""


@query(f"WITH {_TILES} SELECT * FROM tiles")
def tile_index(spark, sf_dir):
    """T8"""
    return tiles.tile_index(spark, 2000, 1500)


@query(f"WITH {_TILES}, b AS (SELECT *, r0 // 500 AS br, c0 // 500 AS bc FROM tiles) SELECT r0, c0, h, w, (br * ((SELECT max(bc) FROM b) + 2) + bc)::BIGINT AS block_id FROM b")
def tile_blocks(spark, sf_dir):
    """T9"""
    return tiles.tile_blocks(tiles.tile_index(spark, 2000, 1500), 5, 10)


@query(f"""WITH {_TILES}, b AS (SELECT DISTINCT r0 // 500 AS br, c0 // 500 AS bc FROM tiles), n AS (SELECT count(*) AS n FROM b)
    SELECT unnest(['train', 'val', 'test']) AS split, unnest([round(n * 0.7), round(n * 0.15), n - round(n * 0.7) - round(n * 0.15)])::BIGINT AS blocks, 0::BIGINT AS shared FROM n""")
def block_split(spark, sf_dir):
    """The blocks of each split, and how many of them another split has"""
    x = tiles.assign_split(tiles.tile_blocks(tiles.tile_index(spark, 2000, 1500), 5, 10))
    many = x.groupBy("block_id").agg(F.countDistinct("split").alias("k"))
    return x.join(many, "block_id").groupBy("split").agg(F.countDistinct("block_id").alias("blocks"), F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("long").alias("shared"))


@query("""WITH n AS (SELECT count(DISTINCT doc_id) AS n FROM documents)
    SELECT unnest(['train', 'val', 'test']) AS split, unnest([floor(n * 0.7), floor(n * 0.15), n - floor(n * 0.7) - floor(n * 0.15)])::BIGINT AS chips FROM n""")
def chip_split(spark, sf_dir):
    """Chips, whose counts are cut off and not rounded"""
    chips = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chip"))
    return tiles.assign_split(chips, "chip", rounded=False).groupBy("split").agg(F.countDistinct("chip").alias("chips"))


@query("""WITH f AS (SELECT 'chip' || o_orderkey || CASE WHEN o_orderkey % 3 = 0 THEN '_S1Hand.tif' WHEN o_orderkey % 3 = 1 THEN '_LabelHand.tif' ELSE '_S1Hand.tif.aux' END AS name FROM orders UNION ALL SELECT 'chip' || o_orderkey || '_LabelHand.tif' FROM orders WHERE o_orderkey % 6 = 0),
    a AS (SELECT substr(name, 1, length(name) - 11) AS key, name AS "left" FROM f WHERE ends_with(name, '_S1Hand.tif')), b AS (SELECT substr(name, 1, length(name) - 14) AS key, name AS "right" FROM f WHERE ends_with(name, '_LabelHand.tif'))
    SELECT key, "left", "right" FROM a JOIN b USING (key)""")
def chip_pairs(spark, sf_dir):
    """Scenes and labels of the same chip, by their names"""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    name = lambda end: F.concat(F.lit("chip"), F.col("k").cast("string"), end).alias("name")
    kind = F.when(F.col("k") % 3 == 0, "_S1Hand.tif").when(F.col("k") % 3 == 1, "_LabelHand.tif").otherwise("_S1Hand.tif.aux")
    files = o.select(name(kind)).unionByName(o.where("k % 6 = 0").select(name(F.lit("_LabelHand.tif"))))
    return tiles.paired(files, "_S1Hand.tif", "_LabelHand.tif")


@query(f"""SELECT r.range::INT AS "row", c.range::INT AS col, {r6("coalesce(s.b04, 0.0)")} AS b04, {r6("coalesce(s.b08, -9999.0)")} AS b08 FROM range(32) r CROSS JOIN range(32) c LEFT JOIN vr_s2 s ON s."row" = r.range + 5 AND s.col = c.range + 80""")
def tile_pad(spark, sf_dir):
    """T12, P19"""
    return rounded(tiles.pad_tile(V.s2(spark, sf_dir), 5, 80, 32, {"b04": 0.0, "b08": -9999.0}))


_OPS = {"hflip": ("lr", "w - 1 - lc"), "vflip": ("h - 1 - lr", "lc"), "rot90": ("w - 1 - lc", "lr")}


@query(f"""WITH {tiles_sql("vr_s2", 32, 8)}, p AS (SELECT r0, c0, h, w, "row" - r0 AS lr, col - c0 AS lc, b04, b08 FROM vr_s2 JOIN tiles ON "row" >= r0 AND "row" < r0 + h AND col >= c0 AND col < c0 + w) """
    + " UNION ALL ".join(f"""SELECT '{n}' AS op, r0::INT AS r0, c0::INT AS c0, ({r})::INT AS "row", ({c})::INT AS col, {r6("b04")} AS x, {r6("b08")} AS y FROM p""" for n, (r, c) in _OPS.items()))
def augment_flip_rot(spark, sf_dir):
    """Every tile of the raster, its feature and its label together"""
    s2 = V.s2(spark, sf_dir).select("row", "col", F.col("b04").alias("x"), F.col("b08").alias("y"))
    cut = tiles.cut(s2, tiles.tile_index(spark, *_extent(s2), 32, 8), 32)
    out = [tiles.augment(cut, op, F.col("h"), F.col("w")).withColumn("op", F.lit(op)).select("op", "r0", "c0", "row", "col", "x", "y") for op in _OPS]
    return rounded(out[0].unionByName(out[1]).unionByName(out[2]))


_NORM = "SELECT c, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 1e-12)) AS std FROM vr_cube GROUP BY c"


@query(f"WITH n AS ({_NORM}) SELECT c, {r6('mean')} AS mean, {r6('std')} AS std FROM n")
def norm_stats(spark, sf_dir):
    """A15, A16"""
    return rounded(tiles.channel_stats(V.cube(spark, sf_dir)))


@query(f"WITH n AS ({_NORM}) SELECT x.c, x.id, {r6('coalesce((v - mean) / std, 0.0)')} AS z FROM vr_cube x JOIN n ON n.c = x.c")
def normalize_channels(spark, sf_dir):
    """P18, P19, P20"""
    x = V.cube(spark, sf_dir)
    return rounded(tiles.normalize(x, tiles.channel_stats(x)).select("c", "id", "z"))


@query(f"""WITH {tiles_sql("vr_dem", 32, 8)}, m AS (SELECT d."row", d.col, d.elev, count(*) AS k FROM vr_dem d JOIN tiles ON d."row" >= r0 AND d."row" < r0 + h AND d.col >= c0 AND d.col < c0 + w GROUP BY ALL)
    SELECT {r6("sum(k * elev) / sum(k)")} AS mean, {r6("sqrt(greatest(sum(k * elev * elev) / sum(k) - (sum(k * elev) / sum(k)) * (sum(k * elev) / sum(k)), 1e-12))")} AS std, sum(k)::BIGINT AS samples FROM m""")
def tile_norm_stats(spark, sf_dir):
    """Pixels count once for each tile that holds them"""
    dem = V.dem(spark, sf_dir)
    m = tiles.tile_multiplicity(dem, tiles.tile_index(spark, *_extent(dem), 32, 8), 32).withColumn("c", F.lit(0))
    s = tiles.channel_stats(m, "c", "elev", F.col("tiles").cast("double"))
    return rounded(s.join(F.broadcast(m.agg(F.sum("tiles").alias("samples")))).select("mean", "std", "samples"))


# climate


@query(f"""SELECT pixel, month, {r8('CASE WHEN count(*) OVER w = 3 THEN sum(precip) OVER w END')} AS acc FROM vr_precip WINDOW w AS (PARTITION BY pixel ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_precip_sum(spark, sf_dir):
    """W2"""
    return rounded(climate.rolling_sum(V.precip(spark, sf_dir)).select("pixel", "month", "acc"), 8)


@query(f"SELECT pixel, {r6('avg(precip)')} AS precip FROM vr_precip GROUP BY 1")
def climate_normals(spark, sf_dir):
    """A17"""
    return rounded(climate.normals(V.precip(spark, sf_dir), ["precip"]))


def _digamma_sql(x: str) -> str:
    y = f"(({x}) + 8)"
    shift = " + ".join(f"1.0::DOUBLE / (({x}) + {i})" for i in range(8))
    return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8) - ({shift}))"


def _fit_sql(by: str) -> tuple[str, str]:
    """CTEs of a gamma law by maximum likelihood for each group, and the last one's name."""
    n = by.replace(", ", "_")
    start = f"""a_{n} AS (SELECT {by}, count(*)::DOUBLE AS k, count(CASE WHEN acc > 0 THEN 1 END) AS n, avg(CASE WHEN acc > 0 THEN acc END) AS mean, avg(CASE WHEN acc > 0 THEN ln(acc) END) AS logs FROM acc WHERE acc IS NOT NULL GROUP BY {by}),
        s0_{n} AS (SELECT *, ln(mean) - logs AS s FROM a_{n}), g0_{n} AS (SELECT *, CASE WHEN n > 0 AND s > 1e-12 THEN (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) END AS shape FROM s0_{n})"""
    for i in range(8):
        d = _digamma_sql("shape")
        slope = f"(1 / shape - ({_digamma_sql('shape * 1.0001')} - {_digamma_sql('shape * 0.9999')}) / (0.0002 * shape))"
        start += f", g{i + 1}_{n} AS (SELECT * EXCLUDE (shape), shape - (ln(shape) - {d} - s) / {slope} AS shape FROM g{i}_{n})"
    return start, f"g8_{n}"


def _normal_sql(p: str) -> str:
    """A normal quantile: bisection of the distribution function, which is an incomplete gamma function of z * z / 2."""
    # 0.5 * P(1/2, z * z / 2) = |p - 0.5| is solved for z in [0, 6]
    half = _gamma_p_sql("0.5::DOUBLE", "((x.a + x.b) / 2) ** 2 / 2")
    step = f"lambda x, y: CASE WHEN 0.5 * {half} < x.t THEN {{'a': (x.a + x.b) / 2, 'b': x.b, 't': x.t}} ELSE {{'a': x.a, 'b': (x.a + x.b) / 2, 't': x.t}} END"
    seed = f"{{'a': 0.0::DOUBLE, 'b': 6.0::DOUBLE, 't': abs(({p}) - 0.5::DOUBLE)}}"
    return f"sign(({p}) - 0.5) * list_reduce(list_transform(range(0, 42), lambda i: {seed}), {step}).a"


_FIT_MONTH, _BY_MONTH = _fit_sql("pixel, m")
_FIT_ALL, _BY_PIXEL = _fit_sql("pixel")
SPI = f"""acc AS (SELECT pixel, month, month(month) AS m, CASE WHEN count(precip) OVER w = 3 THEN sum(precip) OVER w END AS acc FROM vr_precip WINDOW w AS (PARTITION BY pixel ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    good AS (SELECT pixel, stddev_pop(precip) > 0 AND count(precip) = count(*) AS good FROM vr_precip GROUP BY 1), {_FIT_MONTH}, {_FIT_ALL},
    law AS (SELECT x.pixel, x.month, x.acc, g.good, CASE WHEN coalesce(b.n, 0) < 3 THEN (a.k - a.n) / a.k ELSE (b.k - b.n) / b.k END AS q,
        CASE WHEN coalesce(b.n, 0) < 3 THEN a.shape ELSE b.shape END AS shape, CASE WHEN coalesce(b.n, 0) < 3 THEN a.mean / a.shape ELSE b.mean / b.shape END AS scale
        FROM acc x LEFT JOIN {_BY_MONTH} b ON b.pixel = x.pixel AND b.m = x.m LEFT JOIN {_BY_PIXEL} a ON a.pixel = x.pixel JOIN good g ON g.pixel = x.pixel),
    h AS (SELECT pixel, month, CASE WHEN good THEN greatest(1e-6, least(1 - 1e-6, CASE WHEN acc > 0 THEN q + (1 - q) * ({_gamma_p_sql("shape", "acc / scale")}) WHEN acc IS NOT NULL THEN q / 2 END)) END AS h, acc FROM law),
    spi AS (SELECT pixel, month, CASE WHEN acc IS NOT NULL AND h IS NOT NULL THEN {_normal_sql("h")} END AS spi FROM h)"""


@query(f"WITH {SPI} SELECT pixel, month, round(spi, 4) + 0.0 AS spi FROM spi")
def spi(spark, sf_dir):
    """W4, W5, F9"""
    return rounded(climate.spi(V.precip(spark, sf_dir)), 4)


@query(f"WITH {SPI} SELECT pixel, round(arg_max(spi, month), 4) + 0.0 AS spi FROM spi GROUP BY 1")
def spi_latest(spark, sf_dir):
    """W6"""
    return rounded(climate.spi_latest(V.precip(spark, sf_dir)), 4)


# folds and models

FEATURES, KEY = ["quantity", "discount", "tax"], "id"


def _table(spark, sf_dir):
    """One row per part: mean features, mean price as the target, a block."""
    li = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_extendedprice").alias("price"))
    return li.withColumn("block", (F.col("id") % 20).cast("long"))


@query()
def kfold_assign(spark, sf_dir):
    """T5"""
    return tiles.kfold(_table(spark, sf_dir), "id").groupBy("fold").agg(F.count("*").alias("n"))


@query()
def group_kfold_assign(spark, sf_dir):
    """T6"""
    return tiles.group_kfold(V.features(spark, sf_dir), "block").groupBy("fold").agg(F.countDistinct("block").alias("groups"), F.count("*").alias("n"))


@query()
def subsample(spark, sf_dir):
    """T4: a sampling operator"""
    return tiles.subsample(_table(spark, sf_dir), 500, "id")


@query()
def surface_response_classes(spark, sf_dir):
    """M1, F6"""
    return ml.surface_classes(_table(spark, sf_dir), F.col("quantity") + F.col("discount") * 0.05 - F.col("tax") * 0.01, FEATURES).select("id", "class", "name")


@query()
def behaviour_clusters(spark, sf_dir):
    """M2"""
    return ml.cluster(_table(spark, sf_dir), FEATURES, 6).groupBy("cluster").agg(F.count("*").alias("n"))


@query()
def rf_cv(spark, sf_dir):
    """M3, A19"""
    return ml.forest_cv(_table(spark, sf_dir), FEATURES, "price", "id", 5)


@query()
def rf_predict(spark, sf_dir):
    """M4"""
    x = _table(spark, sf_dir).withColumn("tax", F.when(F.col("id") % 17 != 0, F.col("tax")))
    return ml.fit_predict(x, x, FEATURES, "price", ml.forest(), ["id"])


@query()
def gbm_spatial_cv(spark, sf_dir):
    """M5, M6"""
    return ml.spatial_cv(_table(spark, sf_dir), FEATURES, "price", "block", 3, rounds=10)


@query()
def gbm_predict(spark, sf_dir):
    """M8"""
    x = _table(spark, sf_dir)
    return ml.fit_predict(x, x, FEATURES, "price", ml.boosted(10), ["id"])


@query()
def quantile_intervals(spark, sf_dir):
    """Intervals for blocks that the model has not seen"""
    out = ml.quantile_cv(_table(spark, sf_dir), FEATURES, "price", "block", "id")
    return stats.interval_calibration(out, "price", "q0", "q2", "q1")


@query()
def model_comparison(spark, sf_dir):
    """The model with the best score, of a forest and a single tree on the same folds"""
    x = tiles.kfold(_table(spark, sf_dir), "id", 3)
    scores = [ml.summary(ml.cross_validate(x, FEATURES, "price", m)).select(F.lit(n).alias("model"), F.col("r2_mean").alias("r2")) for n, m in (("forest", ml.forest(50, 8)), ("tree", ml.forest(1, 8)))]
    return ml.best_model(scores[0].unionByName(scores[1]), "r2")


@query()
def cross_region_transfer(spark, sf_dir):
    """M9, J10, P21"""
    x = _table(spark, sf_dir)
    return ml.transfer(x.where("block < 10"), x.where("block >= 10"), FEATURES, ["tax", "quantity", "price"], "price", "id", rounds=10)


@query()
def flood_pixel_classifier(spark, sf_dir):
    """M10, P22, A13"""
    s1 = V.s1(spark, sf_dir).withColumns({"ratio": S.ratio_db("vv", "vh"), "target": F.when(F.col("row") % 9 != 0, F.when(F.col("vv") < -17, 1).otherwise(0))})
    out = ml.pixel_classifier(s1.where("t < 5"), s1.where("t >= 5"), ["vv", "vh", "ratio"], "target", rounds=5)
    return stats.per_class_scores(out, 2)


@query()
def topk_importances(spark, sf_dir):
    """T2, M18"""
    x = _table(spark, sf_dir)
    model = ml.forest().fit(ml.assemble(x, FEATURES).withColumnRenamed("price", "label"))
    return tiles.first_k(ml.importances(model, FEATURES, spark), F.desc("importance"), 2)


@query("""SELECT * FROM (VALUES ('ndvi', 'indices/ndvi.parquet', 'index'), ('slope', 'terrain/slope.parquet', 'terrain'), ('twi', 'hydrology/twi.parquet', 'hydrology')) t(name, path, type)""")
def product_catalog(spark, sf_dir):
    """K6, T1"""
    return catalog(spark, [{"name": n, "path": f"{f}/{n}.parquet", "type": t} for n, f, t in (("twi", "hydrology", "hydrology"), ("ndvi", "indices", "index"), ("slope", "terrain", "terrain"))])


@query("""WITH a AS (SELECT unnest(['ndvi', 'slope', 'twi', 'vv']) AS name), b AS (SELECT unnest(['slope', 'vv', 'elev']) AS name) SELECT 'common' AS part, name FROM (SELECT name FROM a INTERSECT SELECT name FROM b) UNION ALL SELECT 'missing', name FROM (SELECT name FROM a EXCEPT SELECT name FROM b)""")
def feature_name_ops(spark, sf_dir):
    """U3, U6, J10"""
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    a, b = names("ndvi", "slope", "twi", "vv"), names("slope", "vv", "elev")
    return a.intersect(b).select(F.lit("common").alias("part"), "name").union(a.subtract(b).select(F.lit("missing"), "name"))


@query("""SELECT p AS property, 'https://maps.isric.org/mapserv?map=/map/' || p || '.map&SERVICE=WCS&VERSION=2.0.1&REQUEST=GetCoverage&COVERAGEID=' || p || '_0-5cm_mean&FORMAT=image/tiff&SUBSETTINGCRS=http://www.opengis.net/def/crs/EPSG/0/4326&SUBSET=X(32.0,32.5)&SUBSET=Y(37.0,37.5)' AS url FROM (SELECT unnest(['clay', 'sand', 'soc']) AS p)""")
def coverage_urls(spark, sf_dir):
    """S8"""
    return spark.createDataFrame([(p, coverage_url(p, "0-5cm", 32.0, 37.0, 32.5, 37.5)) for p in ("clay", "sand", "soc")], "property string, url string")


@query("""SELECT 'chirps-v2.0.' || y || '.' || lpad(m::VARCHAR, 2, '0') || '.tif.gz' AS name, 'https://data.chc.ucsb.edu/products/CHIRPS-2.0/global_monthly/tifs/chirps-v2.0.' || y || '.' || lpad(m::VARCHAR, 2, '0') || '.tif.gz' AS url FROM (SELECT unnest(range(1995, 2002)) AS y), (SELECT unnest(range(1, 13)) AS m)""")
def rain_files(spark, sf_dir):
    """What a download of monthly precipitation has to fetch"""
    return acquire.monthly_rain(spark, 1995, 2001, "rain").select("name", "url")


@query("""WITH n AS (SELECT o_orderkey // 100 AS page, o_orderkey % 100 AS place, CASE WHEN o_orderkey % 3 = 0 THEN 'S1Hand' ELSE 'LabelHand' END AS kind, 'c' || o_orderkey || CASE WHEN o_orderkey % 7 = 0 THEN '.json' ELSE '.tif' END AS name FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY page, place) AS k FROM n WHERE ends_with(name, '.tif'))
    SELECT name, 'https://storage.googleapis.com/sen1floods11/v1.1/data/flood_events/HandLabeled/' || kind || '/' || name AS url, 'floods/' || kind || '/' || name AS target FROM r WHERE k <= 40""")
def flood_files(spark, sf_dir):
    """The first chips and labels of a listing in pages"""
    o = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    kind = F.when(F.col("k") % 3 == 0, "S1Hand").otherwise("LabelHand")
    name = F.concat(F.lit(acquire.FLOOD_FOLDER + "/"), kind, F.lit("/c"), F.col("k").cast("string"), F.when(F.col("k") % 7 == 0, ".json").otherwise(".tif"))
    pages = o.groupBy(F.floor(F.col("k") / 100).alias("page")).agg(F.transform(F.sort_array(F.collect_list(F.struct((F.col("k") % 100).alias("i"), name.alias("n")))), lambda x: x["n"]).alias("names"))
    return acquire.flood_chips(pages, "floods", 40)


@query(f"""WITH p AS (SELECT pixel, month, precip, 40 - pixel // 5 * 0.25::DOUBLE AS latitude, 30 + (24 - pixel) % 5 * 0.25::DOUBLE AS longitude FROM vr_precip)
    SELECT (dense_rank() OVER (ORDER BY latitude DESC) - 1)::INT AS "row", (dense_rank() OVER (ORDER BY longitude) - 1)::INT AS col, month, {r8("precip")} AS precip FROM p""")
def climate_grid(spark, sf_dir):
    """A table of coordinates, with its axes' own names, as a grid from the north"""
    x = V.precip(spark, sf_dir).select("month", "precip", (40 - F.floor(F.col("pixel") / 5) * 0.25).alias("latitude"), (30 + (24 - F.col("pixel")) % 5 * 0.25).alias("longitude"))
    return rounded(acquire.north_up(x, {"latitude": "lat", "longitude": "lon", "valid_time": "month"}).select("row", "col", "month", "precip"), 8)


@query(f"""WITH x AS (SELECT "row", col, avg(vv) FILTER (t = 4) AS now, min(vv) AS dry, max(vv) AS wet FROM vr_s1 GROUP BY 1, 2) SELECT "row", col, {r6("CASE WHEN abs(wet - dry) >= 1e-6 AND now IS NOT NULL THEN greatest(0.0, least(1.0, (now - dry) / (wet - dry))) END")} AS moisture FROM x""")
def moisture_index(spark, sf_dir):
    """the index of the design documents"""
    x = V.s1(spark, sf_dir).groupBy("row", "col").agg(F.avg(F.when(F.col("t") == 4, F.col("vv"))).alias("now"), F.min("vv").alias("dry"), F.max("vv").alias("wet"))
    return rounded(x.select("row", "col", F.when(F.col("now").isNotNull(), S.moisture_index("now", "dry", "wet")).alias("moisture")))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: seasonal composites, their difference index and its summary."""
    return nddi_summary(spark, sf_dir)
