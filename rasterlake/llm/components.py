"""Connected components of a table of links, in one task's memory if they are few, else by alternating large and small stars.

Each round replaces links by stars around smaller ids; the minimum of a node's neighbours is a partial aggregation,
written, and joined back: both sides of the join are plain tables, so the links of a node with very many of them are dealt
to several tasks. Rounds are written to the shared folder, and the tables of the round before removed; their number
is about the logarithm of the longest path. A round is four tables and a dozen stages however few its links are, so up to
`HELD_LINKS` of them are left to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Links that one task joins: 16 bytes each, and some ten times that while they are sorted.
HELD_LINKS = 1 << 20


def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of nodes 0 to n - 1: the smallest one that links between a and b reach."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _in_memory(links: DataFrame) -> DataFrame:
    """node, root of all links' nodes, by one task that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]) for batch in batches]
        if pairs:
            ids, at = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
            root = ids[joined(*at.reshape(2, -1), len(ids))]
            for k in range(0, len(ids), 1 << 16):
                yield pa.record_batch({"node": pa.array(ids[k : k + (1 << 16)]), "root": pa.array(root[k : k + (1 << 16)])})

    return written(links.coalesce(1).mapInArrow(run, "node long, root long"), "roots")


def _fingerprint(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _least(links: DataFrame) -> DataFrame:
    """a, m: the smallest of a and its neighbours."""
    return written(links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")


def components(links: DataFrame, rounds: int = 60, held: int = HELD_LINKS) -> DataFrame:
    """node, root: root is the smallest id of the node's component. links: a, b long; nodes without a link have no row.
    Up to `held` links are joined by one task. More that do not settle in `rounds` rounds are an error."""
    stars = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")  # a > b
    before = None
    for _ in range(rounds):
        now = _fingerprint(stars)
        if now[0] <= held:
            made = _in_memory(stars)
            discard(stars)
            return made
        if now == before:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select(F.col("b"), F.col("b"))).distinct()
        before = now
        both = stars.union(stars.select(F.col("b"), F.col("a")))
        least = _least(both)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.union(least.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        small = _least(large)
        made = large.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b")
        made = written(made.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        for old in (stars, least, large, small):
            discard(old)
        stars = made
    raise RuntimeError(f"components did not settle in {rounds} rounds")
