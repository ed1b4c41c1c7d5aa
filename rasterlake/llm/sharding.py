"""Hierarchical weighted hash tree: region, rack and shard levels, with DataFrame functions only.

Every node has a name and a weight of its own. A row descends from the root: at each level every child draws an
exponential time -ln(u) / weight, u being a hash of the row's key and the child's path, and the row goes to the child with
the smallest draw. Draws of other nodes do not depend on a node's weight, so a change moves rows at its own level only:
a new or heavier child takes rows into itself, a lighter one gives rows away to its siblings, and below a node whose
weight stays nothing that happens elsewhere is felt. Shards that come later stand in a region of their own, so that they
take rows only into themselves and every shard keeps an equal share.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import order_id


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; a shard has no children, and its name is the shard's number."""

    name: int
    weight: float
    children: tuple["Node", ...] = ()

    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards()] if self.children else [self.name]


def branch(name: int, children: list[Node]) -> Node:
    """A node with the weight of its children."""
    return Node(name, sum(c.weight for c in children), tuple(children))


def founded(regions: int, racks: int, shards: int) -> Node:
    """A tree of equal shards, numbered rack by rack."""
    number = lambda g, r, s: (g * racks + r) * shards + s
    return branch(0, [branch(g, [branch(r, [Node(number(g, r, s), 1.0) for s in range(shards)]) for r in range(racks)]) for g in range(regions)])


def grown(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, of a rack in a region of its own."""
    shard = Node(max(tree.shards(), default=-1) + 1, weight)
    region = branch(max((g.name for g in tree.children), default=-1) + 1, [branch(0, [shard])])
    return branch(tree.name, [*tree.children, region])


def reweighted(tree: Node, path: tuple[int, ...], weight: float) -> Node:
    """The tree with another weight of the node at a path of names; its ancestors' weights stay."""
    if not path:
        return Node(tree.name, weight, tree.children)
    return Node(tree.name, tree.weight, tuple(reweighted(c, path[1:], weight) if c.name == path[0] else c for c in tree.children))


def draw(key: Column, path: str, weight: float) -> Column:
    # xxhash64's upper 53 bits as a number in (0, 1)
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(weight))


def descend(key: Column, node: Node, path: str = "") -> Column:
    """The shard of a key; only the draws on the row's own way down are made."""
    if not node.children:
        return F.lit(node.name)
    live = [c for c in node.children if c.weight > 0]
    if not live:
        raise ValueError("a tree needs children of positive weight")
    ways = [descend(key, c, f"{path}/{c.name}") for c in live]
    if len(live) == 1:
        return ways[0]
    draws = [F.struct(draw(key, f"{path}/{c.name}", c.weight).alias("draw"), F.lit(i).alias("child")) for i, c in enumerate(live)]
    return F.element_at(F.transform(F.array(F.least(*draws)["child"]), lambda i: _case(i, ways)), 1)


def _case(i: Column, ways: list[Column]) -> Column:
    """ways[i], of which no other is worked out."""
    out = F.when(i == 0, ways[0])
    for k, way in enumerate(ways[1:], 1):
        out = out.when(i == k, way)
    return out


def place(docs: DataFrame, tree: Node, next_tree: Node, parts: int = 256) -> DataFrame:
    """Shard and slot of every row, and its shard in the next tree.

    The key law: doc_id and the tree decide. Slots are gapless from 0 in each shard, by a fixed hash part of the row, then
    doc_id, crc32 and size. Rows equal in these are counted before they are dealt; a window adds up the counts of one of
    `parts` parts of a shard, and the parts' sums (parts x shards rows) place the parts, so no task holds a shard or a
    group of equal rows. A null text has no bytes; rows without doc_id share a shard, but not its parts; rows that repeat a
    doc_id share a shard too, and all have slots of their own. An empty table gives an empty result.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", order_id().alias("_key"), (F.octet_length(data) + F.lit(16)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "_key", "size", "text_crc32").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("_key", "text_crc32", "size"), F.lit(parts)).cast("int")
    rows = rows.withColumns({"shard": descend(F.col("_key"), tree), "grown_shard": descend(F.col("_key"), next_tree), "_part": part})
    counts = rows.groupBy("shard", "_part").agg(F.sum("_n").alias("_all"))
    before = counts.select("shard", "_part", (F.sum("_all").over(Window.partitionBy("shard").orderBy("_part")) - F.col("_all")).alias("_before"))
    upto = F.sum("_n").over(Window.partitionBy("shard", "_part").orderBy("_key", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, 0))
    joined = rows.withColumn("_first", upto - F.col("_n")).join(before, ["shard", "_part"])
    first = F.col("_before") + F.col("_first")
    slot = F.explode(F.sequence(first, first + F.col("_n") - 1))
    return joined.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
