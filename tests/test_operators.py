"""Properties of the operators on small grids."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.functions import scalar as S
from rasterlake.plans.tables import checkpointed
from rasterlake.operators import climate, hydrology, ml, resample, stats, stencil, temporal, tiles
from rasterlake.operators import forest as trees
from rasterlake.sources import files
from rasterlake.streaming.windows import append_new, arriving, window_means


def grid(spark, z, name="elev"):
    return spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(z.shape[0]) for c in range(z.shape[1])], f"row int, col int, {name} double")


def dense(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def stack(spark, x, name="v"):
    return spark.createDataFrame([(t, r, c, None if np.isnan(x[t, r, c]) else float(x[t, r, c])) for t in range(x.shape[0]) for r in range(x.shape[1]) for c in range(x.shape[2])], f"t int, row int, col int, {name} double")


SMALL = np.array([[[0, 5], [10, np.nan]], [[1, 5], [np.nan, np.nan]], [[2, 5], [20, np.nan]], [[3, 5], [30, np.nan]]], float)


def test_temporal_stats_skip_missing_samples(spark):
    s = {(r["row"], r["col"]): r for r in temporal.temporal_stats(stack(spark, SMALL)).collect()}
    assert s[0, 0]["mean"] == 1.5 and s[0, 1]["std"] == 0 and s[1, 0]["mean"] == 20 and s[1, 1]["mean"] is None
    assert math.isclose(s[0, 0]["p90"], 2.7) and math.isclose(s[0, 0]["amplitude"], 2.4)


def test_wet_dry_delta(spark):
    season = F.when(F.col("t") >= 2, "wet").when(F.col("t") < 2, "dry")
    d = {(r["row"], r["col"]): r["delta"] for r in temporal.wet_dry_delta(stack(spark, SMALL), "v", season).collect()}
    assert d == {(0, 0): 2.0, (0, 1): 0.0, (1, 0): 15.0, (1, 1): None}


def test_speckle_filter(spark):
    rng = np.random.default_rng(42)
    x = rng.gamma(3, 1 / 3, (4, 12, 12))
    x[:, 0, 0] = np.nan
    x[1, 5, 5] = np.nan
    out = temporal.speckle_filter(stack(spark, x), "v", 5).collect()
    got = np.full(x.shape, np.nan)
    for r in out:
        got[r["t"], r["row"], r["col"]] = np.nan if r["filtered"] is None else r["filtered"]
    pad = np.pad(x, ((0, 0), (2, 2), (2, 2)), mode="edge")
    m = np.array([[[np.nanmean(pad[t, r : r + 5, c : c + 5]) for c in range(12)] for r in range(12)] for t in range(4)])
    want = m * np.nanmean(np.where(np.isnan(x), np.nan, x / m), axis=0)
    assert np.allclose(got, np.where(np.isnan(x), np.nan, want), equal_nan=True)
    assert np.nanvar(got) < np.nanvar(x)
    flat = temporal.speckle_filter(stack(spark, np.full((2, 4, 4), 2.5)), "v", 3)
    assert flat.where(F.abs(F.col("filtered") - 2.5) > 1e-9).count() == 0
    with pytest.raises(ValueError):
        stencil.box_mean(flat, "v", 4, ["t"], "m")


def test_indices(spark):
    row = spark.createDataFrame([(0.1, 0.1, 0.1, 0.5, 0.1, 0.3, 0.2), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0.1, 0.1, None, 0.1, 0.1, 0.1, 0.1)], ", ".join(f"{b} double" for b in S.BANDS))
    a, zero, gap = row.select(*[F.when(S.valid(), x()).alias(n) for n, x in S.INDICES.items()]).collect()
    assert math.isclose(a["ndvi"], 0.4 / 0.6) and a["clay_index"] > 1 and a["ndwi"] < 0 and -1 <= a["bsi"] <= 1
    assert zero["ndvi"] == 0 and zero["clay_index"] is None and zero["iron_oxide"] is None and set(gap) == {None}
    pair = spark.createDataFrame([(-10.0, -15.0), (-10.0, -10.0), (None, -3.0)], "wet double, dry double")
    got = [r[0] for r in pair.select(S.nddi("wet", "dry")).collect()]
    assert 0 < got[0] < 1 and got[1] == 0 and got[2] is None
    assert spark.range(1).select(S.linear_to_db(F.lit(0.0))).first()[0] is None


def test_terrain_of_a_plane(spark):
    r, c = np.indices((6, 7))
    t = stencil.terrain(grid(spark, 3.0 * c + 0.0 * r), 30.0)
    inner = t.where("row BETWEEN 1 AND 4 AND col BETWEEN 1 AND 5").collect()
    assert all(math.isclose(x["slope"], math.degrees(math.atan(0.1))) and x["aspect"] == 270 and x["roughness"] == 6 and 1 <= x["hillshade"] <= 255 for x in inner)
    assert t.where("row = 0").where("slope IS NOT NULL").count() == 0
    assert stencil.terrain(grid(spark, np.ones((3, 3)))).where("aspect IS NOT NULL").count() == 0
    z = np.random.default_rng(1).normal(size=(6, 7))
    g = np.gradient(z, 30.0)
    want = -(np.gradient(g[1], 30.0, axis=1) + np.gradient(g[0], 30.0, axis=0))
    assert np.allclose(dense(stencil.curvature(grid(spark, z)), "curvature", z.shape), want)


def brute_fill(z):
    """The lowest level that lets water out, by relaxation; missing cells and the border let it out."""
    h, w = z.shape
    big = np.full((h + 2, w + 2), np.nan)
    big[1:-1, 1:-1] = z
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    beside = lambda x, i, j: x[1 + i : h + 1 + i, 1 + j : w + 1 + j]
    out = np.any([np.isnan(beside(big, i, j)) for i, j in steps], axis=0)
    level = np.where(out, z, np.inf)
    while True:
        frame = np.full((h + 2, w + 2), np.inf)
        frame[1:-1, 1:-1] = np.where(np.isnan(z), np.inf, level)
        new = np.where(np.isnan(z), np.nan, np.maximum(z, np.minimum(level, np.min([beside(frame, i, j) for i, j in steps], axis=0))))
        if np.array_equal(new, level, equal_nan=True):
            return new, out
        level = new


def brute_cells(f, out):
    """Cells that drain through each, over a filled surface: steepest descent, and over flats to the nearest way out."""
    h, w = f.shape
    steps = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
    near = lambda r, c: [(k, r + i, c + j, math.hypot(i, j)) for k, (i, j) in enumerate(steps) if 0 <= r + i < h and 0 <= c + j < w and not np.isnan(f[r + i, c + j])]
    cells = [(r, c) for r in range(h) for c in range(w) if not np.isnan(f[r, c])]
    to, dist = {}, {}
    for r, c in cells:
        best = max(((f[r, c] - f[i, j]) / d, -k, i, j) for k, i, j, d in near(r, c)) if near(r, c) else (0,)
        if best[0] > 0:
            to[r, c] = best[2:]
        if best[0] > 0 or out[r, c]:
            dist[r, c] = 0
    front = list(dist)
    while front:
        front, last = [], front
        for r, c in last:
            for _, i, j, _ in near(r, c):
                if f[i, j] == f[r, c] and (i, j) not in dist:
                    dist[i, j] = dist[r, c] + 1
                    front.append((i, j))
    for r, c in cells:
        if dist[r, c]:
            to[r, c] = next((i, j) for _, i, j, _ in near(r, c) if f[i, j] == f[r, c] and dist[i, j] == dist[r, c] - 1)
    n = np.where(np.isnan(f), np.nan, 0)
    for at in cells:
        while at:
            n[at] += 1
            at = to.get(at)
    return n


def surface(kind, shape=(23, 31)):
    rng = np.random.default_rng(len(kind))
    z = rng.uniform(0, 100, shape)
    if kind == "bowls":  # few large depressions, and flats
        r, c = np.indices(shape)
        z = np.round(20 + 10 * np.sin(r / 3) * np.cos(c / 4) + rng.uniform(0, 2, shape))
    if kind == "holes":
        z[rng.random(shape) < 0.1] = np.nan
    if kind == "flat":
        z[:] = 7.0
    if kind == "spiral":  # one long way out
        z = np.full(shape, 50.0)
        at, step, level = [0, 0], (0, 1), 49.0
        for _ in range(1000):
            z[tuple(at)] = level
            level -= 0.01
            ahead = at[0] + 2 * step[0], at[1] + 2 * step[1]
            if not (0 <= ahead[0] < shape[0] and 0 <= ahead[1] < shape[1]) or z[ahead] < 50:
                step = step[1], -step[0]
                ahead = at[0] + 2 * step[0], at[1] + 2 * step[1]
                if not (0 <= ahead[0] < shape[0] and 0 <= ahead[1] < shape[1]) or z[ahead] < 50:
                    break
            at = [at[0] + step[0], at[1] + step[1]]
    return z


@pytest.mark.parametrize("kind", ["noise", "bowls", "holes", "flat", "spiral"])
def test_hydrology_on_filled_surfaces(spark, kind):
    z = surface(kind)
    want, out = brute_fill(z)
    df = grid(spark, z).cache()
    cells = brute_cells(want, out)
    tile = 64 if kind == "noise" else 8
    assert np.array_equal(dense(hydrology.fill_depressions(df, checkpoint=checkpointed, tile=tile), "filled", z.shape), want, equal_nan=True)
    assert np.array_equal(dense(hydrology.accumulate_filled(df, checkpoint=checkpointed, tile=tile), "cells", z.shape), cells, equal_nan=True)


def test_spill_levels_in_rounds(spark):
    """The joined rounds agree with the solution in memory, also on ties and long chains."""
    rng = np.random.default_rng(3)
    edges = [(k, k + 1, float(rng.integers(0, 9))) for k in range(40)] + [(int(a), int(b), float(rng.integers(0, 30))) for a, b in rng.integers(0, 41, (60, 2))]
    df = spark.createDataFrame(edges, "a long, b long, w double")
    one, many = ({r["node"]: r["level"] for r in hydrology.spill_levels(df, checkpointed, local=n).collect()} for n in (1 << 18, 0))
    assert one == many and len(one) == 40


def test_accumulation_over_long_ways(spark):
    z = np.arange(300.0)[::-1].reshape(1, 300)
    got = dense(hydrology.d8_accumulation(grid(spark, z), checkpoint=checkpointed, tile=16), "cells", z.shape)
    assert got.tolist() == [list(range(1, 301))]
    ring = spark.createDataFrame([(0, 0, 0, 9), (0, 9, 0, 0)], "row int, col int, to_row int, to_col int")
    with pytest.raises(ValueError):
        hydrology.accumulate(ring, checkpointed, tile=4).collect()


def test_bilinear_and_blocks(spark):
    z = np.random.default_rng(2).normal(size=(5, 6))
    z[2, 3] = np.nan
    target = grid(spark, np.zeros((10, 12)), "x")
    got = dense(resample.bilinear(grid(spark, z), target, "elev", 2.0), "elev", (10, 12))
    for r, c in ((0, 0), (3, 4), (5, 7), (9, 11)):
        y, x = (r + 0.5) / 2 - 0.5, (c + 0.5) / 2 - 0.5
        parts = [((1 - abs(y - i)) * (1 - abs(x - j)), z[i, j]) for i in range(5) for j in range(6) if abs(y - i) < 1 and abs(x - j) < 1 and not np.isnan(z[i, j])]
        assert math.isclose(got[r, c], sum(w * v for w, v in parts) / sum(w for w, _ in parts))
    q = np.kron(np.array([[1, 2], [3, 4]]), np.ones((2, 2)))
    q[0, 1] = np.nan
    assert np.allclose(dense(resample.coarsen(grid(spark, q), 2, ["elev"]), "elev", (2, 2)), [[1, 2], [3, 4]])
    hole = np.array([[1, np.nan], [3, 3.0]])
    assert math.isclose(dense(resample.coarsen(grid(spark, hole), 2, ["elev"]), "elev", (1, 1))[0, 0], 7 / 3)


def test_tiles_cover_and_do_not_leak(spark):
    t = [(r["r0"], r["c0"]) for r in tiles.tile_index(spark, 500, 600).collect()]
    seen = np.zeros((500, 600), int)
    for r, c in t:
        seen[r : r + 256, c : c + 256] += 1
    assert seen.min() >= 1 and sorted({c for _, c in t}) == [0, 224, 344]
    assert tiles.tile_index(spark, 100, 100).count() == 1
    with pytest.raises(ValueError):
        tiles.tile_index(spark, 500, 500, 32, 32)
    blocks = tiles.tile_blocks(tiles.tile_index(spark, 2000, 2000), 5, 10)
    made = tiles.assign_split(blocks).select("block_id", "split").distinct().collect()
    assert len(made) == len({r["block_id"] for r in made}) and {r["split"] for r in made} == {"train", "val", "test"}
    four = spark.range(4).select(F.col("id").alias("block_id"))
    splits = lambda d: sorted((r["block_id"], r["split"]) for r in tiles.assign_split(d).collect())
    assert splits(four) == splits(four.orderBy(F.desc("block_id"))) and [s for _, s in splits(four)].count("train") == 3
    assert [r["split"] for r in tiles.assign_split(four, rounded=False).collect()].count("train") == 2
    with pytest.raises(ValueError):
        tiles.assign_split(four, ratios=(0.5, 0.4, 0.2))
    a = grid(spark, np.arange(6.0).reshape(2, 3))
    assert (dense(tiles.augment(a, "rot90", 2, 3), "elev", (3, 2)) == np.rot90(np.arange(6.0).reshape(2, 3))).all()
    with pytest.raises(ValueError):
        tiles.augment(a, "shear", 2, 3)
    assert tiles.group_folds({1: 5, 2: 3, 3: 3, 4: 1}, 2) == {1: 0, 2: 1, 3: 1, 4: 0}


def test_exact_quantiles(spark):
    rng = np.random.default_rng(11)
    for n, accuracy in ((0, 5000), (2, 5000), (977, 5000), (5000, 1000)):
        x = np.round(rng.normal(size=n) * 20, 1 if n % 2 else 6)
        df = spark.createDataFrame([(float(v), int(i % 3)) for i, v in enumerate(x)] + [(None, 0)], "x double, g int")
        probs = [0.0, 0.02, 0.25, 0.5, 0.9, 1.0]
        got = stats.exact_quantiles(df, "x", probs, accuracy=accuracy).first()["q"]
        assert got == [None] * 6 if not n else np.allclose(got, np.quantile(x, probs), rtol=0, atol=1e-12)
        for r in stats.exact_quantiles(df, "x", probs, ["g"], accuracy=accuracy).collect():
            assert np.allclose(r["q"], np.quantile(x[np.arange(n) % 3 == r["g"]], probs), rtol=0, atol=1e-12)


def test_subsample(spark):
    df = spark.range(5000)
    for most in (0, 1, 700, 4999, 5000, 9000):
        got = [r["id"] for r in tiles.subsample(df, most, "id").collect()]
        want = [r["id"] for r in df.orderBy(F.xxhash64("id")).limit(most).collect()]
        assert sorted(got) == sorted(want)


def test_transforms(spark):
    """A plane on one grid, seen from another with other cells, an offset and other coordinates."""
    a, b = resample.Transform(500000.0, 4100000.0, 30.0, 30.0, 40, 50), resample.Transform(500210.0, 4099700.0, 20.0, 10.0, 12, 9)
    plane = grid(spark, np.zeros((40, 50))).select("row", "col")
    plane = resample.centres(plane, a).withColumn("v", F.col("x") * 0.01 + F.col("y") * 0.02)
    cells = grid(spark, np.zeros((12, 9))).select("row", "col")
    got = resample.centres(resample.align(plane, a, cells, b, "v"), b).collect()
    assert len(got) == 108 and all(math.isclose(r["v"], r["x"] * 0.01 + r["y"] * 0.02, rel_tol=1e-12) for r in got)
    # a grid of degrees over the same place
    lon, lat = spark.range(1).select(*S.lonlat(F.lit(500400.0), F.lit(4099400.0), 36)).first()
    c = resample.Transform(lon, lat, 1e-4, 1e-4, 5, 5)
    around = resample.align(plane, a, cells.where("row < 5 AND col < 5"), c, "v", lambda x, y: S.utm(x, y, 36))
    at = resample.centres(around, c, "lon", "lat")
    east, north = S.utm("lon", "lat", 36)
    for r in at.select("v", (east * 0.01 + north * 0.02).alias("want")).collect():
        assert math.isclose(r["v"], r["want"], rel_tol=1e-9)
    points = spark.createDataFrame([(500000.0, 4100000.0), (500029.9, 4099970.1), (501500.0, 4099000.0), (499999.0, 4100000.0)], "x double, y double")
    assert [(r["row"], r["col"]) for r in resample.cells_of(points, "x", "y", a).collect()] == [(0, 0), (0, 0), (None, None), (None, None)]


def test_rank_statistics(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame([(float(v), float(2 * v + 1), int(i % 3), float(v + (15 if i % 3 == 0 else 0))) for i, v in enumerate(x)], "x double, y double, g int, z double")
    r = stats.spearman(df, "x", "y").first()
    assert math.isclose(r["rho"], 1.0) and r["p"] == 0
    k = stats.kruskal_wallis(df, "z", "g").first()
    assert k["p"] < 1e-3 and stats.kruskal_wallis(df, "x", "g").first()["p"] > 1e-3
    ranks = [(v["x"], v["r"]) for v in stats.average_ranks(df, "x", "r").collect()]
    order = np.sort(x)
    assert all(rank == (np.searchsorted(order, v, "left") + 1 + np.searchsorted(order, v, "right")) / 2 for v, rank in ranks)
    strata = {r["stratum"] for r in stats.quantile_strata(df, "x", 4).collect()}
    assert strata == {0, 1, 2, 3}


def test_metrics(spark):
    one = spark.createDataFrame([(1.0, 2.0)], "obs double, pred double")
    assert tuple(stats.regression_metrics(one).first()) == (1, None, None, None, None)
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (3.0, float("nan")), (None, 4.0), (5.0, 5.0)], "obs double, pred double")
    assert tuple(stats.regression_metrics(df).first()) == (3, 1.0, 0.0, 0.0, 0.0)
    maps = spark.createDataFrame([(0, 0), (0, 0), (1, 0), (1, 1), (1, None)], "pred int, target int")
    assert math.isclose(stats.mean_iou(maps, 2).first()[0], (2 / 3 + 1 / 2) / 2)
    assert math.isclose(stats.mean_iou(maps, 3).first()[0], (2 / 3 + 1 / 2) / 2)


def test_spi(spark):
    rng = np.random.default_rng(4)
    rain = rng.gamma(2, 20, 360)
    rain[::5] = 0
    rows = [(0, f"{1990 + i // 12}-{i % 12 + 1:02d}-01", float(v)) for i, v in enumerate(rain)] + [(1, f"{1990 + i // 12}-{i % 12 + 1:02d}-01", 3.0) for i in range(360)]
    df = spark.createDataFrame(rows, "pixel int, month string, precip double").withColumn("month", F.col("month").cast("date"))
    out = climate.spi(df)
    z = [r["spi"] for r in out.where("pixel = 0").orderBy("month").collect()]
    assert z[:2] == [None, None] and abs(np.mean(z[2:])) < 0.1 and abs(np.std(z[2:]) - 1) < 0.1
    assert out.where("pixel = 1 AND spi IS NOT NULL").count() == 0
    acc = [r["acc"] for r in climate.rolling_sum(spark.createDataFrame([(0, i, float(i)) for i in range(1, 6)], "pixel int, month int, precip double")).orderBy("month").collect()]
    assert acc == [None, None, 6.0, 9.0, 12.0]


def test_models(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = 3 * x[:, 0] - 2 * x[:, 1] + 0.1 * rng.normal(size=600)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i]), i % 12) for i in range(600)], "id long, a double, b double, c double, y double, grp long")
    assert ml.spatial_cv(df, ["a", "b", "c"], "y", "grp", 3, rounds=30, rate=0.2).agg(F.min("r2")).first()[0] > 0.7
    q = ml.quantile_forest(df.where("id < 400"), df.where("id >= 400"), ["a", "b", "c"], "y", "id", trees=10)
    assert 0.5 < stats.interval_calibration(q, "y", "q0", "q2", "q1").first()["coverage"] <= 1
    gone = df.withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    made = ml.fit_predict(df, gone, ["a", "b", "c"], "y", ml.forest(5, 5), ["id"])
    assert made.count() == 600 and made.where("prediction IS NULL").select("id").collect() == [(7,)]
    with pytest.raises(KeyError):
        ml.transfer(df, df, ["a"], ["b"], "y", "id")


def grown(x, y, weight, row, depth):
    """The prediction for a row by a tree grown node by node, split at every distinct value."""
    rows = np.flatnonzero(weight)
    for _ in range(depth):
        sse = lambda r: (weight[r] * (y[r] - np.average(y[r], weights=weight[r])) ** 2).sum()
        cuts = [(sse(rows) - sse(rows[x[f, rows] <= c]) - sse(rows[x[f, rows] > c]), f, c) for f in range(len(x)) for c in sorted(set(x[f, rows]))[:-1]]
        if not cuts or max(cuts)[0] <= 1e-9:
            break
        _, f, c = max(cuts)
        rows = rows[(x[f, rows] <= c) == (row[f] <= c)]
    return np.average(y[rows], weights=weight[rows])


@pytest.mark.parametrize("depth", [1, 3, 4])
def test_tree(depth):
    rng = np.random.default_rng(depth)
    x, y = rng.integers(0, 32, (2, 150)).astype(np.uint8), rng.normal(size=150)
    known = trees.tree(x, y, np.ones(150), x, 40)  # whole trees know their rows, those of the same bins by their mean
    assert np.allclose(known, [y[(x == x[:, [i]]).all(axis=0)].mean() for i in range(150)])
    weight = rng.poisson(1.0, 150)
    given = x[:, :40]
    want = [grown(x, y, weight, given[:, i], depth) for i in range(40)]
    assert np.allclose(trees.tree(x, y, weight, given, depth), want)


def test_edges():
    assert trees.edges(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5] and trees.edges(np.zeros(9)).tolist() == []
    x = np.random.default_rng(1).normal(size=10_000)
    assert len(trees.edges(x)) == 31 and np.bincount(np.searchsorted(trees.edges(x), x)).max() < 320
    x[:9000] = 0
    assert 0 < len(trees.edges(x)) <= 31


def test_forest_cv(spark, monkeypatch):
    """Rows that tasks can hold are no work of MLlib's; more of them are, and either way gives about the same metrics."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] + 0.1 * rng.normal(size=900)
    df = spark.createDataFrame([(i, *map(float, x[i]), float(y[i])) for i in range(900)], "id long, a double, b double, y double")
    run = lambda df, **more: sorted(map(tuple, ml.forest_cv(df, ["a", "b"], "y", "id", 3, trees=20, depth=6, **more).select("fold", "n", "r2", "rmse").collect()))
    theirs = run(df, held=0)
    monkeypatch.setattr(ml, "forest", lambda **_: pytest.fail("fitted by MLlib"))
    ours = run(df)
    assert [r[:2] for r in ours] == [r[:2] for r in theirs] and sum(r[1] for r in ours) == 900
    assert all(abs(a[2] - b[2]) < 0.03 and a[2] > 0.9 for a, b in zip(ours, theirs))
    assert np.allclose(run(df.repartition(7)), ours)
    with pytest.raises(ValueError):
        run(df.withColumn("y", F.when(F.col("id") != 7, F.col("y"))))


def test_rasters_points_and_grids(spark, tmp_path):
    a, b = np.random.default_rng(6).normal(size=(2, 7, 9)).astype(np.float32)
    a[0, 0] = -9999
    files.write_tiff(f"{tmp_path}/x.tif", [a, b])
    (tmp_path / "bad.tif").write_bytes(b"<html>")
    got = dense(files.read_rasters(spark, str(tmp_path)), "v", a.shape)
    assert np.isnan(got[0, 0]) and np.allclose(got.ravel()[1:], a.ravel()[1:])
    spark.dataSource.register(files.RasterSource)
    second = spark.read.format("georaster").options(path=f"{tmp_path}/x.tif", band="2").load()
    assert np.allclose(dense(second, "v", b.shape), b)
    (tmp_path / "p.csv").write_text("lon,lat,clay_pct_topsoil,sand_pct_topsoil,soc_topsoil,country,source\r\n32.1,37.2,12.5,1,2,x,y\r\n32.2,37.3,,1,2,x,y\r\n32.2,37.3,  ,1,2,x,y\r\n")
    assert [tuple(r) for r in files.read_points(spark, f"{tmp_path}/p.csv", "clay_pct_topsoil").collect()] == [(32.1, 37.2, 12.5)]
    with pytest.raises(KeyError):
        files.read_points(spark, f"{tmp_path}/p.csv", "ph")
    g = grid(spark, np.arange(100.0).reshape(10, 10))
    files.write_grid(g, f"{tmp_path}/g", 4)
    part = files.read_grid(spark, f"{tmp_path}/g", 2, 3, 5, 6, 4)
    assert part.count() == 16 and "brow" not in part.columns


def test_urls_and_configs(tmp_path, monkeypatch):
    assert "COVERAGEID=clay_0-5cm_mean" in files.coverage_url("clay", "0-5cm", 1, 2, 3, 4)
    for bad in (("gold", "0-5cm"), ("clay", "1-2cm")):
        with pytest.raises(ValueError):
            files.coverage_url(*bad, 1, 2, 3, 4)
    monkeypatch.setenv("CELL", "30")
    (tmp_path / "c.json").write_text('{"name": "a", "bbox": {"west": 1}, "crs": "EPSG:32636", "cell": "${CELL}", "other": ["${UNSET_NAME}"]}')
    area = files.load_area(str(tmp_path / "c.json"))
    assert area.name == "a" and area.options == {"cell": "30", "other": ["${UNSET_NAME}"]}


def test_utm_of_the_south_and_back(spark):
    rows = [(lon, lat) for lon in (31.0, 33.0, 35.5) for lat in (-60.0, -12.5, 0.0, 37.25, 70.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    for south in (False, True):
        e, n = S.utm("lon", "lat", 36, south)
        x, y = S.lonlat("e", "n", 36, south)
        for r in df.withColumns({"e": e, "n": n}).select("*", x.alias("x"), y.alias("y")).collect():
            assert math.isclose(r["x"], r["lon"], abs_tol=1e-8) and math.isclose(r["y"], r["lat"], abs_tol=1e-8)
            assert not south or r["lat"] > 0 or 0 < r["n"] <= 1e7


def test_utm(spark):
    e, n = S.utm(F.lit(33.0), F.lit(0.0), 36)
    got = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert math.isclose(got["e"], 500000) and abs(got["n"]) < 1e-6


def test_streams(spark, tmp_path):
    rows = [(f"2023-01-{d:02d}", 0, 0, float(d)) for d in (1, 5, 13, 14, 30)]
    df = spark.createDataFrame(rows, "acq_date string, row int, col int, vv double").withColumn("acq_date", F.col("acq_date").cast("date"))
    df.write.parquet(f"{tmp_path}/in")
    schema = "acq_date date, row int, col int, vv double"
    q = window_means(arriving(spark, f"{tmp_path}/in", schema)).writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(r["n"] for r in spark.table("w").collect()) == 5
    make = lambda b: b.groupBy("row", "col").agg(F.avg("vv").alias("vv"))
    for _ in range(2):
        append_new(arriving(spark, f"{tmp_path}/in", schema), make, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
