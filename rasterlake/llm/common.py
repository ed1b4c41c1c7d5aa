"""Vectorised text primitives and the shared folder, used by the operators of this subpackage.

Texts are handled as UTF-8 bytes, many documents at a time: an Arrow batch is cut into chunks of a few
megabytes, and every step below is a numpy pass over a chunk, so that no Python code runs per byte or word.
"""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
NULL_ID = (1 << 63) - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
MIX1, MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x *= MIX1
    x ^= x >> np.uint64(33)
    x *= MIX2
    x ^= x >> np.uint64(33)
    return x


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, seed: int):
        self.base = np.random.default_rng(seed).integers(1 << 62, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.up = self.down = np.empty(0, np.uint64)

    def reach(self, n: int) -> "Powers":
        if len(self.up) < n:
            n = max(1 << 16, 1 << (n - 1).bit_length())
            for name, b in (("up", self.base), ("down", self.inverse)):
                table = np.full(n, b, np.uint64)
                table[0] = 1
                setattr(self, name, np.cumprod(table, dtype=np.uint64))
        return self


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of a polynomial hash; `span_hash` reads any span from them."""
    n = len(values)
    powers.reach(n + 1)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers.up[:n], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    h = sums[end]
    h -= sums[start]
    h *= powers.down[start]
    return mix(h + (end - start).astype(np.uint64))


def byte_table(seed: int, lower: bool = False) -> np.ndarray:
    """A random 64-bit value for each byte; A-Z share those of a-z if lower."""
    table = np.random.default_rng(seed).integers(1 << 62, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        table[65:91] = table[97:123]
    return table


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, nulls as empty, and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `limit` bytes; a longer text is a run of its own."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
    trim()


def trim() -> None:
    """Gives freed memory back to the system: a worker process lives on, and others need it."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def alphabet(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of the words [^\x20\x09-\x0D]+ and of the words of letters, digits and what is not ASCII.
SPACED = ~alphabet((0x20, 0x20), (0x09, 0x0D))
PLAIN = alphabet((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and each document's first word; words never cross documents."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = member[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0] = after[-1] = False
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < n]] = False
    after[edges[edges > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, powers: Powers) -> np.ndarray:
    return span_hash(prefix(table[data], powers), starts, ends, powers)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after the other."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    out = np.arange(total)
    out += np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver reach; only local sessions that have none get one of their own."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="rasterlake-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir()
    return at.rstrip("/")


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession, most: int = 16 << 20) -> SparkSession:
    """The session, with Arrow batches of `most` bytes at most: texts differ in length, and a worker holds a batch several times over.
    The setting is read when a plan runs, after the operator has returned it, so it stays; a smaller one is left as it is."""
    now = spark.conf.get(BATCH).removesuffix("b")
    if not (now.isdigit() and 0 < int(now) <= most):
        spark.conf.set(BATCH, str(most))
    return spark


#: Tables that `written` made and nothing has removed: results that were not read yet may need them.
HELD: list[DataFrame] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it does not run df's plan again, whatever executors are lost.

    Its shuffle files go once it is written; nothing runs its plan again. `release` removes the tables of all results
    that have been read.
    """
    spark = bounded(df.sparkSession)
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    HELD.append(spark.read.schema(df.schema).parquet(path))
    return HELD[-1]


def discard(df: DataFrame) -> None:
    """Removes a table that `written` made and nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    HELD[:] = [x for x in HELD if x is not df]


def release(spark: SparkSession) -> int:
    """Removes all tables of this session's operators that are still there, and says how many. Results that are wanted later
    must have been written before."""
    mine = [x for x in HELD if x.sparkSession is spark]
    for x in mine:
        discard(x)
    return len(mine)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def order_id(column: str | Column = "doc_id") -> Column:
    """doc_id as an ordering key that is never null: null comes after every id."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(NULL_ID)).cast("long")
