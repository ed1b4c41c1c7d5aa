"""Sources and sinks: point tables, GeoTIFF rasters, block-partitioned Parquet, catalogs, metrics, configs, request URLs."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.scalar import NODATA, from_nodata

POINT_SCHEMA = "lon DOUBLE, lat DOUBLE, clay_pct_topsoil STRING, sand_pct_topsoil STRING, soc_topsoil STRING, country STRING, source STRING"


def read_points(spark: SparkSession, path: str, value: str, schema: str = POINT_SCHEMA) -> DataFrame:
    """lon, lat, value of a CSV's points; blank values are dropped, an unknown column is a KeyError."""
    df = spark.read.csv(path, header=True, schema=schema)
    if value not in df.columns:
        raise KeyError(value)
    text = F.trim(F.regexp_replace(F.col(value), "\r", ""))
    return df.where(F.col(value).isNotNull() & (text != "")).select("lon", "lat", text.cast("double").alias("value"))


# GeoTIFF: classic little- or big-endian files, strips or tiles, uncompressed or deflated, with horizontal or floating predictors

_SIZES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}


class Tiff:
    def __init__(self, data: bytes):
        self.data, self.order = data, "<" if data[:2] == b"II" else ">"
        if data[:2] not in (b"II", b"MM") or struct.unpack(self.order + "H", data[2:4])[0] != 42:
            raise ValueError("not a TIFF file")
        at = struct.unpack(self.order + "I", data[4:8])[0]
        self.tags: dict[int, tuple] = {}
        for i in range(struct.unpack(self.order + "H", data[at : at + 2])[0]):
            e = at + 2 + 12 * i
            tag, kind, n = struct.unpack(self.order + "HHI", data[e : e + 8])
            if kind in _SIZES:
                code, size = _SIZES[kind]
                where = e + 8 if n * size <= 4 else struct.unpack(self.order + "I", data[e + 8 : e + 12])[0]
                raw = data[where : where + n * size]
                self.tags[tag] = (raw,) if kind == 2 else struct.unpack(self.order + code * n, raw)
        self.width, self.height = self.tags[256][0], self.tags[257][0]
        self.bands = self.tags.get(277, (1,))[0]
        self.nodata = float(self.tags[42113][0].rstrip(b"\0 ")) if 42113 in self.tags else None

    def band(self, band: int = 1):
        import numpy as np

        bits, form, how = self.tags.get(258, (8,))[0], self.tags.get(339, (1,))[0], self.tags.get(259, (1,))[0]
        kind = np.dtype(f"{self.order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}")
        planar, predictor = self.tags.get(284, (1,))[0], self.tags.get(317, (1,))[0]
        per = 1 if planar == 2 else self.bands
        tiled = 322 in self.tags
        w, h = (self.tags[322][0], self.tags[323][0]) if tiled else (self.width, self.tags.get(278, (self.height,))[0])
        starts, sizes = (self.tags[324], self.tags[325]) if tiled else (self.tags[273], self.tags[279])
        across, down = -(-self.width // w), -(-self.height // h)
        out = np.empty((down * h, across * w), kind.newbyteorder("="))
        first = (band - 1) * across * down if planar == 2 else 0
        for k in range(across * down):
            raw = self.data[starts[first + k] : starts[first + k] + sizes[first + k]]
            if how in (8, 32946):
                raw = zlib.decompress(raw)
            elif how != 1:
                raise ValueError(f"compression {how} is not supported")
            r, c = divmod(k, across)
            rows = h if tiled else min(h, self.height - r * h)
            if predictor == 3:
                b = np.frombuffer(raw, np.uint8).reshape(rows, w * per * kind.itemsize)
                b = np.cumsum(b.reshape(rows, -1, per), axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, w * per)
                x = np.ascontiguousarray(b.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(rows, w, per)
            else:
                x = np.frombuffer(raw, kind).reshape(rows, w, per)
                if predictor == 2:
                    x = np.cumsum(x, axis=1, dtype=kind.newbyteorder("="))
            out[r * h : r * h + rows, c * w : (c + 1) * w] = x[:, :, 0 if planar == 2 else band - 1]
        return out[: self.height, : self.width]


def write_tiff(path: str, bands: list, nodata: float = NODATA) -> None:
    """float32 bands as a strip-organised, deflated file: for fixtures and small products."""
    import numpy as np

    h, w = bands[0].shape
    data = [zlib.compress(np.ascontiguousarray(b, "<f4").tobytes()) for b in bands]
    n, mark = len(bands), f"{nodata}\0".encode()
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, n, [32] * n), (259, 3, 1, 8), (262, 3, 1, 1), (273, 4, n, None), (277, 3, 1, n), (278, 4, 1, h), (279, 4, n, [len(d) for d in data]), (284, 3, 1, 2), (339, 3, n, [3] * n), (42113, 2, len(mark), mark)]
    at = 8 + 2 + 12 * len(tags) + 4
    extra, entries = b"", b""
    body = at + sum(n * 4 if t in (273, 279) and n > 1 else n * 2 if t in (258, 339) and n > 2 else len(mark) if t == 42113 and len(mark) > 4 else 0 for t, *_ in tags)
    offsets = [body + sum(map(len, data[:i])) for i in range(n)]
    for tag, kind, count, value in tags:
        value = offsets if tag == 273 else value
        raw = value if kind == 2 else struct.pack("<" + {3: "H", 4: "I"}[kind] * count, *(value if isinstance(value, list) else [value]))
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, count, at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, count) + raw.ljust(4, b"\0")
    Path(path).write_bytes(b"II*\0" + struct.pack("<IH", 8, len(tags)) + entries + struct.pack("<I", 0) + extra + b"".join(data))


def pixels_of(content: bytes, band: int = 1):
    """row, col, v arrays of a file's band, missing data as NaN."""
    import numpy as np

    t = Tiff(content)
    x = t.band(band).astype(np.float64)
    x[x == (NODATA if t.nodata is None else t.nodata)] = np.nan
    r, c = np.indices(x.shape)
    return r.ravel().astype(np.int32), c.ravel().astype(np.int32), x.ravel()


def read_rasters(spark: SparkSession, path: str, band: int = 1) -> DataFrame:
    """path, row, col, v of GeoTIFF files, whose bytes Spark's own source reads from any store."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                r, c, v = pixels_of(bytes(content), band)
                for at in range(0, len(r), 1 << 18):
                    s = slice(at, at + (1 << 18))
                    yield pd.DataFrame({"path": p, "row": r[s], "col": c[s], "v": v[s]})

    files = spark.read.format("binaryFile").load(path).where(F.substring("content", 1, 2).isin(bytearray(b"II"), bytearray(b"MM")))
    return files.select("path", "content").mapInPandas(run, "path string, row int, col int, v double").withColumn("v", from_nodata("v"))


class RasterSource(DataSource):
    """spark.read.format("georaster").option("path", ...).option("band", 1): one partition a file, on paths that executors can open."""

    @classmethod
    def name(cls) -> str:
        return "georaster"

    def schema(self) -> str:
        return "path string, row int, col int, v double"

    def reader(self, schema) -> "RasterReader":
        return RasterReader(self.options)


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.band = options["path"], int(options.get("band", 1))

    def partitions(self):
        p = Path(self.path)
        return [InputPartition(str(f)) for f in (sorted(p.glob("*.tif")) if p.is_dir() else [p])]

    def read(self, partition):
        import math

        r, c, v = pixels_of(Path(partition.value).read_bytes(), self.band)
        for row in zip(r.tolist(), c.tolist(), v.tolist()):
            yield (partition.value, row[0], row[1], None if math.isnan(row[2]) else row[2])


def write_grid(df: DataFrame, path: str, block: int = 512, mode: str = "errorifexists") -> None:
    """A grid as Parquet by blocks of pixels, so that scans of a window read its blocks only."""
    blocks = df.withColumns({"brow": F.floor(F.col("row") / block).cast("int"), "bcol": F.floor(F.col("col") / block).cast("int")})
    blocks.repartition("brow", "bcol").sortWithinPartitions("row", "col").write.mode(mode).partitionBy("brow", "bcol").parquet(path)


def read_grid(spark: SparkSession, path: str, r0: int, c0: int, r1: int, c1: int, block: int = 512) -> DataFrame:
    """Pixels of rows r0..r1 and columns c0..c1: whole blocks are pruned."""
    g = spark.read.parquet(path)
    near = F.col("brow").between(r0 // block, r1 // block) & F.col("bcol").between(c0 // block, c1 // block)
    return g.where(near & F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).drop("brow", "bcol")


def catalog(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """name, path, type of products, in order of name."""
    return spark.createDataFrame([(e["name"], e["path"], e["type"]) for e in entries], "name string, path string, type string").orderBy("name")


def save_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Metrics, catalogs and scalers: small results as JSON lines."""
    df.coalesce(1).write.mode(mode).json(path)


def load_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What `save_json` wrote: scalers and metrics."""
    return spark.read.schema(schema).json(path)


def write_cube(df: DataFrame, features: list[str], path: str, block: int = 512, mode: str = "errorifexists") -> None:
    """A cube by blocks of pixels, beside its features' names in their order."""
    write_grid(df.select("row", "col", *features), f"{path}/cells", block, mode)
    df.sparkSession.createDataFrame([(i, f) for i, f in enumerate(features)], "place int, name string").coalesce(1).write.mode(mode).json(f"{path}/features")


def read_cube(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    names = [r["name"] for r in load_json(spark, f"{path}/features", "place int, name string").orderBy("place").collect()]  # a row a feature
    return spark.read.parquet(f"{path}/cells").select("row", "col", *names), names


# configuration

_VARIABLE = re.compile(r"\$\{(\w+)\}")


def resolve_env(x):
    """${NAME} in strings, lists and dictionaries; unknown names stay as they are."""
    if isinstance(x, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[0]), x)
    if isinstance(x, dict):
        return {k: resolve_env(v) for k, v in x.items()}
    return [resolve_env(v) for v in x] if isinstance(x, list) else x


@dataclass
class Area:
    """An area of interest."""

    name: str
    bbox: dict
    crs: str
    resolution: float = 10.0
    options: dict = field(default_factory=dict)


def load_config(path: str) -> dict:
    """A YAML or JSON file with its variables put in."""
    text = Path(path).read_text()
    if path.endswith(".json"):
        return resolve_env(json.loads(text))
    import yaml

    return resolve_env(yaml.safe_load(text) or {})


def load_area(path: str) -> Area:
    x = load_config(path)
    known = {k: x.pop(k) for k in ("name", "bbox", "crs", "resolution") if k in x}
    return Area(**known, options=x)


#: Soil properties with their units, and depths, that the coverage service is asked for.
PROPERTIES = {"clay": "g/kg", "sand": "g/kg", "silt": "g/kg", "soc": "dg/kg", "bdod": "cg/cm³"}
DEPTHS = ("0-5cm", "5-15cm", "15-30cm")
#: Names of the wetness classes, from the driest.
CLASS_NAMES = ("dry", "moderately_dry", "transitional", "seasonally_wet", "persistently_wet")


def coverage_url(prop: str, depth: str, west: float, south: float, east: float, north: float, base: str = "https://maps.isric.org/mapserv") -> str:
    """Request of a mean soil property in a box; unknown names are ValueErrors."""
    if prop not in PROPERTIES:
        raise ValueError(f"unknown property: {prop}")
    if depth not in DEPTHS:
        raise ValueError(f"unknown depth: {depth}")
    asked = {"SERVICE": "WCS", "VERSION": "2.0.1", "REQUEST": "GetCoverage", "COVERAGEID": f"{prop}_{depth}_mean", "FORMAT": "image/tiff", "SUBSETTINGCRS": "http://www.opengis.net/def/crs/EPSG/0/4326"}
    box = [f"SUBSET=X({west},{east})", f"SUBSET=Y({south},{north})"]
    return "&".join([f"{base}?map=/map/{prop}.map", *(f"{k}={v}" for k, v in asked.items()), *box])


def checked_schema(df: DataFrame, expected: list[str]) -> DataFrame:
    """df's columns in the trained order: a missing one is a KeyError, others are left out."""
    missing = [c for c in expected if c not in df.columns]
    if missing:
        raise KeyError(", ".join(missing))
    return df.select(*expected)


def discover(spark: SparkSession, folder: str, wanted: dict[str, str]) -> dict[str, DataFrame]:
    """Those of the wanted features (name to subfolder) that exist."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    return {n: spark.read.parquet(f"{folder}/{p}") for n, p in wanted.items() if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{p}"))}
