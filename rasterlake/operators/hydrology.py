"""Depression filling, D8 flow directions and accumulation, wetness and stream power.

Rasters are worked on in square tiles, of which each fits a task; what crosses tiles is a graph of their borders, a small
part of the raster, that is solved by rounds of joins whose number is a logarithm. A heavy pass over the tiles comes
before that and one after it. `checkpoint` cuts a plan: it writes a DataFrame to the shared folder.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import stream_power, twi
from .checkpoints import plain
from .stats import exact_quantiles
from .stencil import neighbours

#: Row and column steps to the neighbours a to i, the centre left out, with distances in cells.
STEPS = {"a": (-1, -1), "b": (-1, 0), "c": (-1, 1), "d": (0, -1), "f": (0, 1), "g": (1, -1), "h": (1, 0), "i": (1, 1)}
TILE = 256
#: Graph edges up to which a graph is solved in one task's memory.
LOCAL = 1 << 18
#: Labels are numbers of tiles times this and numbers of border cells; 0 is the outside.
LABELS = 1 << 20

Checkpoint = Callable[[DataFrame], DataFrame]


def _eager(df: DataFrame) -> DataFrame:
    return plain(df.checkpoint())


def _tile(size: int, across: int = 1 << 21) -> Column:
    return F.floor(F.col("row") / size).cast("long") * across + F.floor(F.col("col") / size).cast("long")


def _around(df: DataFrame, size: int) -> DataFrame:
    """df's rows for each neighbour of their cell that is in another tile, at the neighbour's row and col."""
    steps = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in STEPS.values()])
    moved = df.withColumn("_s", F.explode(steps)).withColumns({"row": F.col("row") + F.col("_s.dr"), "col": F.col("col") + F.col("_s.dc")})
    return moved.where(_tile(size) != F.col("tile")).drop("_s", "tile")


def _square(pdf: pd.DataFrame, *values: str) -> tuple[int, int, np.ndarray, np.ndarray, list[np.ndarray]]:
    """First row and column, the cells' places, and arrays of values with a frame of missing cells around them."""
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    r, c = pdf["row"].to_numpy(np.int64) - r0 + 1, pdf["col"].to_numpy(np.int64) - c0 + 1
    out = []
    for v in values:
        x = np.full((int(r.max()) + 2, int(c.max()) + 2), np.nan)
        x[r, c] = pdf[v].to_numpy(np.float64)
        out.append(x)
    return r0, c0, r, c, out


def _shift(x: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The neighbours of a framed array's inner cells."""
    return x[1 + dr : x.shape[0] - 1 + dr, 1 + dc : x.shape[1] - 1 + dc]


def _flood(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a framed tile: heights filled up to its border, and the number of the border cell that each cell spills over.

    A border cell is one with a missing neighbour, or at the tile's edge. Cells are reached from the lowest border first.
    """
    h, w = z.shape
    missing = np.isnan(z)
    near = np.zeros(z.shape, bool)
    for dr, dc in STEPS.values():
        near[1:-1, 1:-1] |= _shift(missing, dr, dc)
    seeds = np.flatnonzero(near & ~missing)
    heights, filled, label = z.ravel().tolist(), z.ravel().tolist(), [-1] * (h * w)
    heap = [(heights[at], at) for at in seeds.tolist()]
    for k, (_, at) in enumerate(heap):
        label[at] = k
    for at in np.flatnonzero(missing).tolist():
        label[at] = -2
    heapq.heapify(heap)
    around, pop, push = [dr * w + dc for dr, dc in STEPS.values()], heapq.heappop, heapq.heappush
    while heap:
        level, at = pop(heap)
        own = label[at]
        for step in around:
            to = at + step
            if label[to] == -1:
                label[to] = own
                up = heights[to]
                if up < level:
                    up = level
                filled[to] = up
                push(heap, (up, to))
    return np.array(filled).reshape(h, w), np.array(label).reshape(h, w)


_FLOODED = "tile long, r0 int, c0 int, width int, filled binary, label binary, edges array<struct<a:long,b:long,w:double>>, border array<struct<row:int,col:int,label:long,z:double,open:boolean>>"


def _flood_tile(size: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tile, pdf = int(key[0]), pdf[pdf["z"].notna()]
        names = [x.split()[0] for x in _FLOODED.split(", ")]
        if pdf.empty:
            return pd.DataFrame([], columns=names)
        r0, c0, _, _, (z,) = _square(pdf, "z")
        filled, label = _flood(z)
        here = label >= 0
        # where two labels meet: the higher of both cells, the lowest such place of each pair
        parts = []
        for dr, dc in ((0, 1), (1, -1), (1, 0), (1, 1)):
            a, b = label[1:-1, 1:-1], _shift(label, dr, dc)
            meet = (a >= 0) & (b >= 0) & (a != b)
            parts.append((np.minimum(a, b)[meet], np.maximum(a, b)[meet], np.maximum(filled[1:-1, 1:-1], _shift(filled, dr, dc))[meet]))
        a, b, w = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((w, b, a))
        a, b, w = a[order], b[order], w[order]
        first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        base = tile * LABELS + 1
        edges = [{"a": base + int(x), "b": base + int(y), "w": float(v)} for x, y, v in zip(a[first], b[first], w[first])]
        # the tile's cells that a neighbour in another tile or a missing one may touch
        near = np.zeros(z.shape, bool)
        for dr, dc in STEPS.values():
            near[1:-1, 1:-1] |= _shift(~here, dr, dc)
        r, c = np.nonzero(near & here)
        open_ = np.zeros(len(r), bool)
        for dr, dc in STEPS.values():
            i, j = r + dr, c + dc
            open_ |= ~here[i, j] & ((i - 1 + r0) // size == (r0 // size)) & ((j - 1 + c0) // size == (c0 // size))
        border = [{"row": r0 + i - 1, "col": c0 + j - 1, "label": base + int(label[i, j]), "z": float(z[i, j]), "open": o} for i, j, o in zip(r.tolist(), c.tolist(), open_.tolist())]
        inner = slice(1, -1), slice(1, -1)
        row = (tile, r0, c0, z.shape[1] - 2, filled[inner].astype("<f8").tobytes(), label[inner].astype("<i4").tobytes(), edges, border)
        return pd.DataFrame([row], columns=names)

    return run


def _spill_local(edges: list[tuple[int, int, float]]) -> dict[int, float]:
    """The lowest level at which each node reaches node 0: edges from the lowest up, joining sets."""
    parent: dict[int, int] = {}
    waiting: dict[int, list[int]] = {}
    level: dict[int, float] = {}

    def root(x: int) -> int:
        if x not in parent:
            parent[x], waiting[x] = x, [x] if x else []
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b, w in sorted(edges, key=lambda e: e[2]):
        x, y, out = root(a), root(b), root(0)
        if x == y:
            continue
        if y == out or (x != out and len(waiting[x]) < len(waiting[y])):
            x, y = y, x
        parent[y] = x
        if x == out:
            for n in waiting.pop(y):
                level[n] = w
        else:
            waiting[x] += waiting.pop(y)
    return level


def _spilled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    level = _spill_local([e for batch in batches for e in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "w")))])
    yield pa.record_batch({"node": pa.array(list(level), pa.int64()), "level": pa.array(list(level.values()), pa.float64())})


def spill_levels(edges: DataFrame, checkpoint: Checkpoint = _eager, local: int = LOCAL) -> DataFrame:
    """node, level: the smallest possible highest edge of a way from each node to node 0. edges: a, b, w.

    Every set of nodes without an outside picks its lowest edge: no way out is lower, and all nodes of the set wait for it.
    Sets are joined along the picked edges, and again, until all have the outside: each round halves their number at
    least. Up to `local` edges are solved in memory.
    """
    spark = edges.sparkSession
    edges = checkpoint(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))
    if edges.count() <= local:
        return edges.coalesce(1).mapInArrow(_spilled, "node long, level double")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).where("node <> 0").distinct()
    sets = checkpoint(nodes.select("node", F.col("node").alias("root"), F.lit(float("-inf")).alias("level")))
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).where("a <> 0")
        pick = both.groupBy("a").agg(F.min(F.struct("w", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("e"))
        pick = checkpoint(pick.select("a", F.when(F.col("e.x") == F.col("a"), F.col("e.y")).otherwise(F.col("e.x")).alias("to"), F.col("e.w").alias("w")))
        if pick.isEmpty():
            return sets.select("node", "level")
        # of two that picked the same edge, the smaller is a root
        other = pick.select(F.col("a").alias("to"), F.col("to").alias("back"))
        up = checkpoint(pick.join(other, "to", "left").select("a", F.when((F.col("back") == F.col("a")) & (F.col("a") < F.col("to")), F.col("a")).otherwise(F.col("to")).alias("to")))
        while True:
            # ways double, up to a root or the outside
            rest = up.where("to <> 0 AND to <> a")
            beyond = up.select(F.col("a").alias("to"), F.col("to").alias("far")).where("far <> to")
            longer = rest.join(beyond, "to").select("a", F.col("far").alias("to"))
            if longer.isEmpty():
                break
            up = checkpoint(up.join(longer.withColumnRenamed("to", "far"), "a", "left").select("a", F.coalesce("far", "to").alias("to")))
        step = pick.select(F.col("a").alias("root"), "w").join(up.select(F.col("a").alias("root"), F.col("to").alias("next")), "root")
        sets = checkpoint(sets.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"), F.when(F.col("w").isNotNull(), F.greatest("level", "w")).otherwise(F.col("level")).alias("level")))
        ends = lambda e, c: e.join(up.select(F.col("a").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        moved = ends(ends(edges, "a"), "b").where("a <> b")
        edges = checkpoint(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w").groupBy("a", "b").agg(F.min("w").alias("w")))


def fill_depressions(df: DataFrame, value: str = "elev", checkpoint: Checkpoint = _eager, tile: int = TILE, local: int = LOCAL) -> DataFrame:
    """row, col, filled: each cell's lowest level from which water finds a way out, over cells at that level at most.

    The way out is the raster's border or a missing cell; a missing cell stays so. Each tile is flooded from its own
    border; where floods meet, and where tiles do, water may pass: the graph of these passes tells the level at which each
    border cell spills to the outside, and a second pass raises the cells behind it to that level.
    """
    cells = df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col(value).cast("double").alias("z"))
    flooded = checkpoint(cells.withColumn("tile", _tile(tile)).groupBy("tile").applyInPandas(_flood_tile(tile), _FLOODED))
    border = flooded.select("tile", F.inline("border"))
    near = _around(border.select("tile", F.col("label").alias("a"), F.col("z").alias("az"), "row", "col"), tile)
    # a cell beside another tile is in that tile's border, or missing
    met = near.join(border.select("row", "col", F.col("label").alias("b"), F.col("z").alias("bz")), ["row", "col"], "left")
    across = met.select("a", F.coalesce("b", F.lit(0)).alias("b"), F.greatest("az", "bz").alias("w"))
    out = border.where("open").select(F.col("label").alias("a"), F.lit(0).cast("long").alias("b"), F.col("z").alias("w"))
    edges = flooded.select(F.inline("edges")).union(across).union(out)
    levels = spill_levels(edges, checkpoint, local)
    of_tile = levels.withColumn("tile", F.shiftright(F.col("node") - 1, 20)).groupBy("tile").agg(F.collect_list(F.struct("node", "level")).alias("levels"))

    def raised(batches):
        for pdf in batches:
            for x in pdf.itertuples():
                filled, label = np.frombuffer(x.filled, "<f8"), np.frombuffer(x.label, "<i4")
                known = np.full(int(label.max(initial=0)) + 1, -np.inf)
                for n in x.levels if x.levels is not None else ():
                    known[n["node"] - x.tile * LABELS - 1] = n["level"]
                there = label >= 0
                r, c = np.divmod(np.flatnonzero(there), x.width)
                yield pd.DataFrame({"row": r + x.r0, "col": c + x.c0, "filled": np.maximum(filled[there], known[label[there]])})

    made = flooded.drop("edges", "border").join(of_tile, "tile", "left").mapInPandas(raised, "row int, col int, filled double")
    return df.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col")).join(made, ["row", "col"], "left")


def _steepest(x: DataFrame) -> DataFrame:
    """x with to_row, to_col: the neighbour of steepest descent, ties in the order a to i; NULL where none is lower."""
    ways = []
    for k, (n, (dr, dc)) in enumerate(STEPS.items()):
        drop = (F.col("e") - F.col(n)) / F.lit((dr * dr + dc * dc) ** 0.5)
        ways.append(F.struct(F.coalesce(drop, F.lit(0.0)).alias("drop"), F.lit(-k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")))
    x = x.withColumn("_s", F.greatest(*ways))
    falls = F.col("_s.drop") > 0
    return x.withColumns({"to_row": F.when(falls, F.col("row") + F.col("_s.dr")), "to_col": F.when(falls, F.col("col") + F.col("_s.dc"))}).drop("_s")


def d8_pointer(df: DataFrame, value: str = "elev") -> DataFrame:
    """row, col, to_row, to_col: the neighbour of steepest descent, ties in the order a to i; NULL in a pit."""
    return _steepest(neighbours(df, value)).select("row", "col", "to_row", "to_col")


def flat_distances(filled: DataFrame, checkpoint: Checkpoint = _eager, tile: int = TILE) -> DataFrame:
    """row, col, filled, to_row, to_col, dist of a dense filled surface: the steepest descent where there is one (dist 0), NULL and
    dist 0 at the raster's border or beside a missing cell, and else the number of steps over cells of the same height
    to the next cell of these kinds. Tiles tell each other the distances at their borders until none gets shorter."""
    x = neighbours(filled, "filled")
    inside = F.lit(True)
    for n in STEPS:
        inside = inside & F.col(n).isNotNull()
    x = _steepest(x).select("row", "col", "filled", "to_row", "to_col", inside.alias("inside"))
    drained = F.col("filled").isNotNull() & (F.col("to_row").isNotNull() | ~F.col("inside"))
    cells = checkpoint(x.withColumn("dist", F.when(drained, F.lit(0.0))).withColumn("tile", _tile(tile)).drop("inside"))

    def told(x: DataFrame) -> DataFrame:
        """The distances that cells hear of from neighbours of the same height in other tiles."""
        edge = x.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1) | F.pmod("col", F.lit(tile)).isin(0, tile - 1)) & F.col("dist").isNotNull())
        return _around(edge.select("tile", "row", "col", "filled", (F.col("dist") + 1).alias("told")), tile).groupBy("row", "col", "filled").agg(F.min("told").alias("told"))

    # tiles with flats
    there = cells.where("filled IS NOT NULL")
    work = there.join(there.where("dist IS NULL").select("tile").distinct(), "tile", "left_semi").select("tile", "row", "col", "filled", "dist")
    own = work.join(told(cells), ["row", "col", "filled"], "left").select("tile", "row", "col", "filled", F.coalesce("dist", "told").alias("dist"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        """The tile's distances, from its own and its neighbours' cells."""
        r0, c0, r, c, (z, d) = _square(pdf, "filled", "dist")
        d[np.isnan(d)] = np.inf
        step = 0
        while True:
            front = d == step
            if not front.any():
                ahead = d[(d > step) & np.isfinite(d)]
                if not len(ahead):
                    break
                step = int(ahead.min())
                continue
            reached = np.zeros(z.shape, bool)
            for dr, dc in STEPS.values():
                reached[1:-1, 1:-1] |= _shift(front, dr, dc) & (_shift(z, dr, dc) == z[1:-1, 1:-1])
            d[reached & (d > step + 1)] = step + 1
            step += 1
        found = d[r, c]
        return pd.DataFrame({"tile": pdf["tile"], "row": pdf["row"], "col": pdf["col"], "filled": pdf["filled"], "dist": np.where(np.isfinite(found), found, np.nan)})

    while True:
        own = checkpoint(own.groupBy("tile").applyInPandas(solve, "tile long, row int, col int, filled double, dist double"))
        nearer = checkpoint(own.join(told(own), ["row", "col", "filled"]).where("dist IS NULL OR told < dist").select("row", "col", "told"))
        if nearer.isEmpty():
            break
        own = own.join(nearer, ["row", "col"], "left").select("tile", "row", "col", "filled", F.coalesce("told", "dist").alias("dist"))
    done = own.select("row", "col", F.col("dist").alias("found"))
    return cells.join(done, ["row", "col"], "left").select("row", "col", "filled", "to_row", "to_col", F.coalesce("dist", "found").alias("dist"))


def filled_pointer(filled: DataFrame, checkpoint: Checkpoint = _eager, tile: int = TILE) -> DataFrame:
    """row, col, to_row, to_col on a filled surface: the steepest descent, and over flats the first neighbour, in the order a to
    i, of the same height that is a step nearer to the flat's way out; NULL where water leaves the raster."""
    x = flat_distances(filled, checkpoint, tile)
    x = neighbours(x.withColumn("s", F.struct("filled", "dist")), "s")
    to_row, to_col = F.col("to_row"), F.col("to_col")
    for n, (dr, dc) in reversed(STEPS.items()):
        nearer = (F.col("to_row").isNull()) & (F.col("dist") > 0) & (F.col(f"{n}.filled") == F.col("filled")) & (F.col(f"{n}.dist") == F.col("dist") - 1)
        to_row, to_col = F.when(nearer, F.col("row") + dr).otherwise(to_row), F.when(nearer, F.col("col") + dc).otherwise(to_col)
    return x.where("filled IS NOT NULL").select("row", "col", to_row.alias("to_row"), to_col.alias("to_col"))


def _down(own: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of own over all that flows to each cell, and the end of each cell's way: sums and ways double. to: -1 where a way ends."""
    total, to, end = own.copy(), to.copy(), np.arange(len(to))
    for _ in range(len(to).bit_length() + 1):
        flows = to >= 0
        if not flows.any():
            return total, end
        total = total + np.bincount(to[flows], weights=total[flows], minlength=len(total)).astype(np.int64)
        end = np.where(flows, end[np.where(flows, to, 0)], end)
        to = np.where(flows, to[np.where(flows, to, 0)], -1)
    raise ValueError("pointers run in a circle")


def accumulate(point: DataFrame, checkpoint: Checkpoint = _eager, tile: int = TILE) -> DataFrame:
    """row, col, cells: how many cells drain through each, itself included, along pointers (row, col, to_row, to_col).

    Each tile sums up its own cells. Water that crosses a border enters the next tile at a cell, whose way through that tile
    ends at the next border: the forest of these entries is summed up by rounds in which sums and ways double, and a second
    pass over the tiles lets the entries' water flow. Pointers must not run in a circle: one that does is an error.
    """
    cells = checkpoint(point.select(*[F.col(c).cast("long").alias(c) for c in ("row", "col", "to_row", "to_col")]).withColumn("tile", _tile(tile)))
    crossing = cells.where("to_row IS NOT NULL").withColumn("other", F.floor(F.col("to_row") / tile) * (1 << 21) + F.floor(F.col("to_col") / tile)).where("other <> tile")
    entries = crossing.select(F.col("to_row").alias("row"), F.col("to_col").alias("col")).distinct().withColumn("entry", F.lit(1).cast("long"))

    def summed(with_entries: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
            r0, c0, w = r.min(), c.min(), int(c.max() - c.min()) + 1
            place = np.full((int(r.max() - r0) + 1) * w, -1)
            place[(r - r0) * w + c - c0] = np.arange(len(r))
            known = pdf["to_row"].notna().to_numpy()
            tr, tc = pdf["to_row"].fillna(-1).to_numpy(np.int64), pdf["to_col"].fillna(-1).to_numpy(np.int64)
            inside = known & (tr >= r0) & (tr <= r.max()) & (tc >= c0) & (tc <= c.max())
            to = np.full(len(r), -1)
            to[inside] = place[(tr[inside] - r0) * w + tc[inside] - c0]
            if with_entries:
                return pd.DataFrame({"row": r, "col": c, "cells": _down(1 + pdf["inflow"].fillna(0).to_numpy(np.int64), to)[0]})
            total, end = _down(np.ones(len(r), np.int64), to)
            out, enter = known & ~inside, pdf["entry"].notna().to_numpy()
            exits, entered = np.flatnonzero(out), np.flatnonzero(enter)
            leaves = known[end[entered]] & ~inside[end[entered]]
            # kind 0: water of the tile's own that leaves to a cell; kind 1: an entry and the cell that its water goes on to
            return pd.DataFrame({
                "kind": np.concatenate([np.zeros(len(exits), np.int64), np.ones(len(entered), np.int64)]),
                "row": np.concatenate([tr[exits], r[entered]]), "col": np.concatenate([tc[exits], c[entered]]),
                "to_row": pd.array(np.concatenate([np.zeros(len(exits), np.int64), tr[end[entered]]]), dtype="Int64"), "to_col": pd.array(np.concatenate([np.zeros(len(exits), np.int64), tc[end[entered]]]), dtype="Int64"),
                "on": np.concatenate([np.zeros(len(exits), bool), leaves]), "n": np.concatenate([total[exits], np.zeros(len(entered), np.int64)]),
            })

        return run

    flows = cells.join(entries, ["row", "col"], "left").groupBy("tile").applyInPandas(summed(False), "kind long, row long, col long, to_row long, to_col long, on boolean, n long")
    flows = checkpoint(flows)
    inflow = flows.where("kind = 0").groupBy("row", "col").agg(F.sum("n").alias("n"))
    ways = flows.where("kind = 1").select("row", "col", F.when(F.col("on"), F.struct(F.col("to_row").alias("row"), F.col("to_col").alias("col"))).alias("to"))
    water = checkpoint(ways.join(inflow, ["row", "col"], "left").select(F.struct("row", "col").alias("at"), "to", F.coalesce("n", F.lit(0)).alias("n")))
    count = water.count()
    for _ in range(count.bit_length() + 1):
        if water.where("to IS NOT NULL").isEmpty():
            break
        more = water.where("to IS NOT NULL").groupBy(F.col("to").alias("at")).agg(F.sum("n").alias("more"))
        far = water.select(F.col("at").alias("to"), F.col("to").alias("far"))
        water = checkpoint(water.join(more, "at", "left").join(far, "to", "left").select("at", F.col("far").alias("to"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
    else:
        raise ValueError("pointers run in a circle")
    entered = water.select("at.row", "at.col", F.col("n").alias("inflow"))
    final = cells.join(entered, ["row", "col"], "left").groupBy("tile").applyInPandas(summed(True), "row long, col long, cells long")
    return final.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "cells")


def d8_accumulation(df: DataFrame, value: str = "elev", checkpoint: Checkpoint = _eager, tile: int = TILE) -> DataFrame:
    """row, col, cells over the surface as it is: water stays in pits."""
    return accumulate(d8_pointer(df, value), checkpoint, tile)


def accumulate_filled(df: DataFrame, value: str = "elev", checkpoint: Checkpoint = _eager, tile: int = TILE, local: int = LOCAL) -> DataFrame:
    """row, col, cells over the surface with its depressions filled; missing cells have no row."""
    filled = checkpoint(fill_depressions(df, value, checkpoint, tile, local))
    return accumulate(filled_pointer(filled, checkpoint, tile), checkpoint, tile)


def wetness(area: DataFrame, slope: DataFrame, cell: float = 30.0) -> DataFrame:
    """row, col, twi, stream_power from accumulated cells and slope."""
    x = area.join(slope.select("row", "col", "slope"), ["row", "col"]).withColumn("a", F.col("cells") * cell)
    return x.select("row", "col", F.when(F.col("slope").isNotNull(), twi("a", "slope")).alias("twi"), F.when(F.col("slope").isNotNull(), stream_power("a", "slope")).alias("stream_power"))


def construction_risk(df: DataFrame, moisture: str, flow: str, slope: str, weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """row, col, risk: weighted wetness, flow and flatness, scaled by the largest values where all three are there."""
    rows = df.where(F.col(moisture).isNotNull() & F.col(flow).isNotNull() & F.col(slope).isNotNull())
    most = rows.agg(F.max(F.log1p(flow)).alias("_f"), F.max(slope).alias("_s"))  # one row
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    risk = clip(F.col(moisture)) * weights[0] + F.log1p(flow) / (F.col("_f") + 1e-9) * weights[1] + clip(1 - F.col(slope) / (F.col("_s") + 1e-9)) * weights[2]
    return rows.join(F.broadcast(most)).select("row", "col", risk.alias("risk"))


def percentile_scaled(df: DataFrame, value: str, out: str, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """value from its 2nd to its 98th percentile as 0 to 1."""
    edge = exact_quantiles(df, value, [low, high]).select(F.col("q").alias("_p"))  # one row
    x = (F.col(value) - F.col("_p")[0]) / (F.col("_p")[1] - F.col("_p")[0] + 1e-9)
    return df.join(F.broadcast(edge)).withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))).drop("_p")
