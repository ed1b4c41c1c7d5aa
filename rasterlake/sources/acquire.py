"""What has to be fetched, as relations: names, addresses and targets of files, and what is still missing. Fetching itself is a
function that the caller gives; it runs on executors, a file at a time, and a file that fails does not stop the others."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import PROPERTIES, coverage_url

#: Public archives.
RAIN = "https://data.chc.ucsb.edu/products/CHIRPS-2.0/global_monthly/tifs"
FLOODS = "https://storage.googleapis.com/sen1floods11"
FLOOD_FOLDER = "v1.1/data/flood_events/HandLabeled"

FILES = "name string, url string, target string"


def monthly_rain(spark: SparkSession, first_year: int, last_year: int, folder: str) -> DataFrame:
    """FILES of monthly precipitation rasters."""
    months = spark.range(first_year * 12, (last_year + 1) * 12).select(F.floor(F.col("id") / 12).alias("y"), (F.col("id") % 12 + 1).alias("m"))
    name = F.format_string("chirps-v2.0.%d.%02d.tif.gz", "y", "m")
    return months.select(name.alias("name"), F.concat(F.lit(RAIN + "/"), name).alias("url"), F.concat(F.lit(folder + "/"), name).alias("target"))


def soil_layers(spark: SparkSession, box: dict, folder: str, properties: list[str] | None = None, depth: str = "0-5cm") -> DataFrame:
    """FILES of soil properties in a box; unknown names are ValueErrors."""
    asked = properties or [p for p in PROPERTIES if p in ("clay", "sand", "soc")]
    rows = [(f"sg_{p}_{depth.replace('-', '_')}_mean.tif", coverage_url(p, depth, box["west"], box["south"], box["east"], box["north"])) for p in asked]
    return spark.createDataFrame([(n, u, f"{folder}/{n}") for n, u in rows], FILES)


def flood_chips(pages: DataFrame, folder: str, limit: int | None = None) -> DataFrame:
    """FILES of flood chips and labels from pages (page, names array<string>) of an object listing, in the order of the listing;
    with a limit, the first of each kind."""
    kind = F.element_at(F.split("object", "/"), -2)
    objects = pages.select("page", F.posexplode("names").alias("place", "object")).where(F.col("object").endswith(".tif")).withColumn("kind", kind)
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("kind").orderBy("page", "place"))
        objects = objects.withColumn("rank", rank).where(F.col("rank") <= limit)
    name = F.element_at(F.split("object", "/"), -1)
    return objects.select(name.alias("name"), F.concat(F.lit(FLOODS + "/"), "object").alias("url"), F.concat(F.lit(folder + "/"), "kind", F.lit("/"), name).alias("target"))


def monthly_climate_request(box: dict, variables: list[str], first_year: int, last_year: int) -> dict:
    """What the climate store is asked for; its boxes go north, west, south, east."""
    return {
        "product_type": "monthly_averaged_reanalysis", "variable": list(variables), "year": [str(y) for y in range(first_year, last_year + 1)], "month": [f"{m:02d}" for m in range(1, 13)],
        "time": "00:00", "area": [box[k] for k in ("north", "west", "south", "east")], "format": "netcdf",
    }


def north_up(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """row, col and the other columns of a table of coordinates, whatever its axes are called: rows from the north, columns from the west."""
    x = df
    for found, wanted in names.items():
        if found in x.columns:
            x = x.withColumnRenamed(found, wanted)
    axis = lambda c, order, out: x.select(c).distinct().withColumn(out, F.row_number().over(Window.orderBy(order)) - 1)  # noqa: E731  as long as an axis
    return x.join(F.broadcast(axis("lat", F.desc("lat"), "row")), "lat").join(F.broadcast(axis("lon", F.asc("lon"), "col")), "lon").drop("lat", "lon")


@dataclass(frozen=True)
class ImageService:
    """Where and how images are asked for; credentials come from the environment and are never written."""

    base: str
    token: str
    client: str = ""
    secret: str = ""

    @classmethod
    def from_env(cls, base: str, token: str, prefix: str = "SH") -> "ImageService":
        client, secret = os.environ.get(f"{prefix}_CLIENT_ID", ""), os.environ.get(f"{prefix}_CLIENT_SECRET", "")
        if not client or not secret:
            raise ValueError(f"set {prefix}_CLIENT_ID and {prefix}_CLIENT_SECRET")
        return cls(base, token, client, secret)

    def options(self, collection: str, box: dict, start: str, end: str, resolution: float, crs: str = "EPSG:4326") -> dict[str, str]:
        """Options of a data source that asks the service."""
        return {"url": self.base, "token_url": self.token, "collection": collection, "bbox": ",".join(str(box[k]) for k in ("west", "south", "east", "north")), "crs": crs, "time": f"{start}/{end}", "resolution": str(resolution)}


def pending(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Those of files whose target is not there yet."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder) if exists(spark, folder) else None
    if there is None:
        return files
    present = there.select(F.element_at(F.split("path", "/"), -1).alias("name")).distinct()
    return files.join(present, "name", "left_anti").select(*files.columns)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def fetched(files: DataFrame, fetch: Callable[[str], bytes], tiff: bool = True) -> DataFrame:
    """name, target, content, error of each file: content is null where fetching failed or, of a raster, gave no TIFF."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = []
            for name, url, target in zip(pdf["name"], pdf["url"], pdf["target"]):
                try:
                    content = fetch(url)
                    if tiff and content[:4] not in (b"II*\0", b"MM\0*"):
                        raise ValueError(f"no TIFF: {content[:40]!r}")
                    rows.append((name, target, content, None))
                except Exception as e:  # a failed file is a row of its own
                    rows.append((name, target, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["name", "target", "content", "error"])

    return files.mapInPandas(run, "name string, target string, content binary, error string")
