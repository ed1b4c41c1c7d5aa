"""Tiles, blocks, splits, folds, channel normalisation and geometric augmentation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _offsets(extent: int, tile: int, overlap: int) -> list[int]:
    if extent <= tile:
        return [0]
    return sorted({*range(0, extent - tile + 1, tile - overlap), extent - tile})


def tile_index(spark: SparkSession, height: int, width: int, tile: int = 256, overlap: int = 32) -> DataFrame:
    """r0, c0, h, w of tiles that cover a grid; the last ones end at its edge."""
    if overlap >= tile:
        raise ValueError("tiles must be larger than their overlap")
    rows, cols = (F.array(*[F.lit(o) for o in _offsets(n, tile, overlap)]) for n in (height, width))
    t = spark.range(1).select(F.explode(rows).alias("r0")).select("r0", F.explode(cols).alias("c0"))
    return t.select("r0", "c0", F.lit(min(tile, height)).alias("h"), F.lit(min(tile, width)).alias("w"))


def tile_blocks(tiles: DataFrame, block_km: float, pixel_m: float) -> DataFrame:
    """Each tile's spatial block, by its upper left corner."""
    px = max(1, round(block_km * 1000 / pixel_m))
    b = tiles.withColumns({"br": F.floor(F.col("r0") / px), "bc": F.floor(F.col("c0") / px)})
    most = b.agg((F.max("bc") + 2).alias("m"))  # one row
    return b.join(F.broadcast(most)).select("r0", "c0", "h", "w", (F.col("br") * F.col("m") + F.col("bc")).cast("long").alias("block_id"))


def assign_split(df: DataFrame, unit: str | list[str] = "block_id", ratios=(0.7, 0.15, 0.15), seed: int = 42, rounded: bool = True) -> DataFrame:
    """df with a split: whole units (blocks, chips) in the order of a seeded hash, cut at the ratios' counts. Counts are rounded for
    blocks, and cut off for chips (rounded=False); what remains is test. Units are ranked in parts, whose counts place them."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("ratios must sum to 1")
    keys = [unit] if isinstance(unit, str) else list(unit)
    units = df.select(*keys).distinct().withColumn("_h", F.xxhash64(*keys, F.lit(seed))).withColumn("_part", F.shiftright("_h", 56))
    counts = units.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # 256 rows
    total = counts.agg(F.sum("_n").alias("_all"))  # one row
    whole = F.round if rounded else F.floor
    first, second = whole(F.col("_all") * F.lit(ratios[0])), whole(F.col("_all") * F.lit(ratios[1]))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy("_h", *keys)) - 1
    placed = units.join(F.broadcast(before), "_part").withColumn("_place", place).join(F.broadcast(total))
    split = F.when(F.col("_place") < first, "train").when(F.col("_place") < first + second, "val").otherwise("test")
    return df.join(placed.select(*keys, split.alias("split")), keys)


def paired(names: DataFrame, left: str, right: str, name: str = "name") -> DataFrame:
    """key, left, right: the files of two kinds that have the same name but for the kinds' endings."""
    kind = lambda end, out: names.where(F.col(name).endswith(end)).select(F.expr(f"substring({name}, 1, length({name}) - {len(end)})").alias("key"), F.col(name).alias(out))
    return kind(left, "left").join(kind(right, "right"), "key")


def pad_tile(df: DataFrame, r0: int, c0: int, size: int, fills: dict[str, float | None]) -> DataFrame:
    """A size x size tile; where the grid ends, and where a value is missing, values are the fills."""
    spark = df.sparkSession
    grid = spark.range(size * size).select((F.floor(F.col("id") / size) + r0).cast("int").alias("row"), (F.col("id") % size + c0).cast("int").alias("col"))
    inside = df.where(F.col("row").between(r0, r0 + size - 1) & F.col("col").between(c0, c0 + size - 1))
    joined = grid.join(inside, ["row", "col"], "left")
    return joined.select((F.col("row") - r0).alias("row"), (F.col("col") - c0).alias("col"), *[F.coalesce(F.col(v), F.lit(x).cast("double")).alias(v) for v, x in fills.items()])


def augment(df: DataFrame, op: str, height: int | Column, width: int | Column) -> DataFrame:
    """hflip, vflip or rot90 (counter-clockwise) of coordinates; all values, features and labels alike, move with them."""
    r, c = F.col("row"), F.col("col")
    moved = {"hflip": (r, width - 1 - c), "vflip": (height - 1 - r, c), "rot90": (width - 1 - c, r)}
    if op not in moved:
        raise ValueError(f"no such augmentation: {op}")
    return df.withColumns({"row": moved[op][0].cast("int"), "col": moved[op][1].cast("int")})


def cut(df: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """The pixels of every tile, by the tile's own row and col, with its r0, c0, h, w: an equi-join on coarse cells with the rest as a filter."""
    cells = lambda a, n: F.sequence(F.floor(F.col(a) / size), F.floor((F.col(a) + F.col(n) - 1) / size))
    t = tiles.withColumn("_br", F.explode(cells("r0", "h"))).withColumn("_bc", F.explode(cells("c0", "w")))
    x = df.withColumns({"_br": F.floor(F.col("row") / size), "_bc": F.floor(F.col("col") / size)})
    both = x.join(t, ["_br", "_bc"]).where("row >= r0 AND row < r0 + h AND col >= c0 AND col < c0 + w").drop("_br", "_bc")
    return both.withColumns({"row": F.col("row") - F.col("r0"), "col": F.col("col") - F.col("c0")})


def channel_stats(df: DataFrame, channel: str = "c", value: str = "v", weight: Column | None = None) -> DataFrame:
    """mean and std (population, floored) of each channel's values that are there, each as often as its weight says."""
    w = F.when(F.col(value).isNotNull(), F.lit(1.0) if weight is None else weight)
    n, s, ss = F.sum(w), F.sum(w * F.col(value)), F.sum(w * F.col(value) * F.col(value))
    return df.groupBy(channel).agg((s / n).alias("mean"), F.sqrt(F.greatest(ss / n - (s / n) * (s / n), F.lit(1e-12))).alias("std"))


def tile_multiplicity(df: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """df with `tiles`, the number of tiles that hold each pixel."""
    x = cut(df, tiles, size).withColumns({"row": F.col("row") + F.col("r0"), "col": F.col("col") + F.col("c0")})
    return x.groupBy(*df.columns).agg(F.count("*").alias("tiles"))


def normalize(df: DataFrame, stats: DataFrame, channel: str = "c", value: str = "v", out: str = "z", fill: float | None = 0.0) -> DataFrame:
    """z-scores by channel; missing values become fill after that."""
    z = (F.col(value) - F.col("mean")) / F.col("std")
    return df.join(stats, channel).withColumn(out, z if fill is None else F.coalesce(z, F.lit(fill))).drop("mean", "std")


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """A fold for each row by a hash of its key: folds of about equal size without a sort of all rows."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def group_folds(sizes: dict[int, int], k: int = 5) -> dict[int, int]:
    """Groups, largest first, each to the fold that is smallest so far."""
    k = min(k, len(sizes))
    load, out = [0] * k, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[g] = load.index(min(load))
        load[out[g]] += sizes[g]
    return out


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """A fold for each row such that groups stay whole. Spatial blocks are few: their sizes are gathered on the driver."""
    sizes = {r[0]: r[1] for r in df.groupBy(group).count().collect()}
    kind = dict(df.dtypes)[group]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(list(group_folds(sizes, k).items()), f"{group} {kind}, fold int")), group)


def subsample(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most `most` rows, those with the smallest hash of their keys. Counts of the hash's upper bits tell up to where all
    rows stay and which few are left to be sorted."""
    rows = df.withColumn("_h", F.xxhash64(*keys)).withColumn("_top", F.shiftright("_h", 48))
    counts = rows.groupBy("_top").agg(F.count("*").alias("_n"))  # 65536 rows at most
    upto = F.sum("_n").over(Window.orderBy("_top"))
    edge = counts.select("_top", upto.alias("_upto"), (upto - F.col("_n")).alias("_before")).where((F.col("_upto") > most) & (F.col("_before") <= most))
    edge = edge.agg(F.min("_top").alias("_edge"), F.min("_before").alias("_kept"))  # one row, of nulls if all rows stay
    met = rows.join(F.broadcast(edge))
    sure = met.where(F.col("_edge").isNull() | (F.col("_top") < F.col("_edge")))
    place = F.row_number().over(Window.partitionBy("_top").orderBy("_h", *keys))
    rest = met.where(F.col("_top") == F.col("_edge")).withColumn("_place", place).where(F.col("_place") <= most - F.col("_kept")).drop("_place")
    return sure.unionByName(rest).select(*df.columns)


def first_k(df: DataFrame, order: Column | str, k: int) -> DataFrame:
    return df.orderBy(order).limit(k)


def rank_within(df: DataFrame, by: list[str], order: Column, out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(order)))
