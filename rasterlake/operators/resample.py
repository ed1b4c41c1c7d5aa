"""Grid alignment: bilinear resampling, aggregation to coarser grids, point sampling, cubes and training matrices."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import block_id

PIXEL = ["row", "col"]


@dataclass(frozen=True)
class Transform:
    """A north-up grid: its upper left corner, cell sizes, rows and columns."""

    west: float
    north: float
    width: float
    height: float
    rows: int
    cols: int


def cells_of(points: DataFrame, x: str, y: str, grid: Transform) -> DataFrame:
    """points with the row and col of the cell that they stand in; NULL off the grid. A point on a border belongs to the cell to its right or below."""
    row = F.floor((F.lit(grid.north) - F.col(y)) / F.lit(grid.height)).cast("int")
    col = F.floor((F.col(x) - F.lit(grid.west)) / F.lit(grid.width)).cast("int")
    on = row.between(0, grid.rows - 1) & col.between(0, grid.cols - 1)
    return points.withColumns({"row": F.when(on, row), "col": F.when(on, col)})


def centres(cells: DataFrame, grid: Transform, x: str = "x", y: str = "y") -> DataFrame:
    """cells with their centres' coordinates."""
    return cells.withColumns({x: F.lit(grid.west) + (F.col("col") + 0.5) * grid.width, y: F.lit(grid.north) - (F.col("row") + 0.5) * grid.height})


def align(source: DataFrame, source_grid: Transform, target: DataFrame, target_grid: Transform, value: str, project=None, out: str | None = None) -> DataFrame:
    """value of a grid on the cells of another, bilinear, by their transforms; offsets and cell sizes may differ. project maps the
    target's x and y columns to the source's coordinates, where the systems differ (`utm`, `lonlat`)."""
    at = centres(target.select(*PIXEL), target_grid, "_px", "_py")
    x, y = project(F.col("_px"), F.col("_py")) if project else (F.col("_px"), F.col("_py"))
    at = at.withColumns({"_y": (F.lit(source_grid.north) - y) / source_grid.height - 0.5, "_x": (x - F.lit(source_grid.west)) / source_grid.width - 0.5})
    return _four_corners(source, at.select(*PIXEL, "_y", "_x"), value, out or value)


def finer_grid(df: DataFrame, scale: float) -> DataFrame:
    """row, col of a grid over df's extent whose cells are 1 / scale of its size; its rows are dealt out before they get columns."""
    size = df.agg(F.floor((F.max("row") + 1) * scale).cast("int").alias("h"), F.floor((F.max("col") + 1) * scale).cast("int").alias("w"))  # one row
    rows = size.where("h > 0 AND w > 0").select(F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("row"), "w").repartition("row")
    return rows.select("row", F.explode(F.sequence(F.lit(0), F.col("w") - 1)).alias("col"))


def bilinear(source: DataFrame, target: DataFrame, value: str, scale: float, out: str | None = None) -> DataFrame:
    """value of a grid whose cells are `scale` times the target's, at the target's cell centres.

    Each target cell reads its four neighbours with bilinear weights; missing ones give their weight to the rest.
    """
    y, x = (F.col("row") + 0.5) / scale - 0.5, (F.col("col") + 0.5) / scale - 0.5
    return _four_corners(source, target.select(*PIXEL).withColumns({"_y": y, "_x": x}), value, out or value)


def _four_corners(source: DataFrame, at: DataFrame, value: str, out: str) -> DataFrame:
    """Bilinear values at fractional rows _y and columns _x of a source."""
    t = at.withColumns({"_r": F.floor("_y").cast("int"), "_c": F.floor("_x").cast("int")})
    fy, fx = F.col("_y") - F.col("_r"), F.col("_x") - F.col("_c")
    corner = lambda dr, dc, w: F.named_struct(F.lit("sr"), F.col("_r") + dr, F.lit("sc"), F.col("_c") + dc, F.lit("w"), w)
    four = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    wanted = t.select(*PIXEL, F.inline(four))
    got = wanted.join(source.select(F.col("row").alias("sr"), F.col("col").alias("sc"), F.col(value).alias("_v")), ["sr", "sc"], "left")
    used = F.when(F.col("_v").isNotNull(), F.col("w"))
    total = F.sum(used)
    return got.groupBy(*PIXEL).agg(F.when(total > 1e-12, F.sum(used * F.col("_v")) / total).alias(out))


def coarsen(df: DataFrame, factor: int, values: list[str], height: Column | None = None, width: Column | None = None) -> DataFrame:
    """Mean of each block of factor x factor cells that are there; a block without any is NULL. With height and width, partial blocks at the end are left out."""
    if height is not None:
        df = df.where((F.col("row") < height - height % factor) & (F.col("col") < width - width % factor))
    cell = lambda a: F.floor(F.col(a) / factor).cast("int").alias(a)
    return df.groupBy(cell("row"), cell("col")).agg(*[F.avg(v).alias(v) for v in values])


def overviews(df: DataFrame, value: str, factors=(2, 4, 8, 16)) -> DataFrame:
    """The pyramid of averaged grids: factor, row, col, value. Each level is made from the one below with its counts, so the grid is read once."""
    level = df.groupBy(*PIXEL).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    parts, done = [], 1
    for f in factors:
        step = f // done
        level = level.groupBy(F.floor(F.col("row") / step).cast("int").alias("row"), F.floor(F.col("col") / step).cast("int").alias("col")).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        parts.append(level.select(F.lit(f).alias("factor"), "row", "col", F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).alias(value)))
        done = f
    return reduce(DataFrame.unionByName, parts)


def decimate_nearest(df: DataFrame, factor: int, value: str) -> DataFrame:
    """The cell at the upper left of each block's centre."""
    half = factor // 2
    near = df.where((F.col("row") % factor == half) & (F.col("col") % factor == half))
    return near.select(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), value)


def feature_cube(reference: DataFrame, features: dict[str, DataFrame]) -> DataFrame:
    """All features, in order of name, on the pixels of the reference grid."""
    parts = [features[n].select(*PIXEL, F.col("v").alias(n)) for n in sorted(features)]
    return reduce(lambda a, b: a.join(b, PIXEL, "left"), parts, reference.select(*PIXEL))


def training_matrix(cube: DataFrame, labels: DataFrame, block: int, width: int, subset: list[str] | None = None) -> DataFrame:
    """Pixels with all features and a label, with their spatial block."""
    joined = cube.join(labels, PIXEL)
    return joined.na.drop("any", subset=subset or [c for c in joined.columns if c not in PIXEL]).withColumn("block_id", block_id("row", "col", block, width))


def sample_points(points: DataFrame, raster: DataFrame, value: str) -> DataFrame:
    """The raster's value at each point's cell, NULL off the grid."""
    return points.join(raster.select(*PIXEL, value), PIXEL, "left")


def split_bbox(spark, west: float, south: float, east: float, north: float, nx: int, ny: int) -> DataFrame:
    """nx by ny tiles of a box: tx, ty, west, south, east, north."""
    dx, dy = (east - west) / nx, (north - south) / ny
    t = spark.range(nx * ny).select((F.col("id") % nx).cast("int").alias("tx"), F.floor(F.col("id") / nx).cast("int").alias("ty"))
    return t.select("tx", "ty", (F.lit(west) + F.col("tx") * dx).alias("west"), (F.lit(south) + F.col("ty") * dy).alias("south"), (F.lit(west) + (F.col("tx") + 1) * dx).alias("east"), (F.lit(south) + (F.col("ty") + 1) * dy).alias("north"))
