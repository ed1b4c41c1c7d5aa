"""Exact dedup with owners in Patricia tries.

Every input task inserts the whole normalised texts into a compressed radix trie whose terminal nodes hold the
group's owner so far and its count. A trie that outgrows its memory spills its largest subtrees: their terminals
go to the shuffle as partial groups, and the subtree is dropped. Length and content hash deal the partial groups
out, sorted by both, to a second trie, which spills a key's subtree once the input has passed that key. So a
group of any size reaches the shuffle as a few rows of each input task, and no task holds more than its limit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, order_id, utf8

#: The characters that do not count when texts are compared: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


class Node:
    __slots__ = ("children", "label", "owner", "size")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.size = label, None, None, 0


def shared_prefix(a: bytes, at: int, label: bytes) -> int:
    """How many bytes of label stand in a from `at`; by halving, with comparisons of slices."""
    low, high = 0, min(len(a) - at, len(label))
    while low < high:
        middle = (low + high + 1) // 2
        if a[at + low : at + middle] == label[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class PatriciaTrie:
    """Byte strings with an owner each. An owner is (-code points, id, count); the smallest wins and counts add up."""

    def __init__(self):
        self.root = Node(b"")

    @property
    def size(self) -> int:
        return self.root.size

    def insert(self, key: bytes, owner: tuple[int, int, int]) -> None:
        node, at, path = self.root, 0, [self.root]
        while at < len(key):
            children = node.children
            child = children.get(key[at]) if children else None
            if child is None:
                child = Node(key[at:])
                if node.children is None:
                    node.children = {}
                node.children[key[at]] = child
                at = len(key)
            elif key.startswith(child.label, at):
                at += len(child.label)
            else:
                n = shared_prefix(key, at, child.label)
                upper = Node(child.label[:n])
                upper.children, upper.size = {child.label[n]: child}, child.size
                child.label = child.label[n:]
                node.children[key[at]] = child = upper
                at += n
            node = child
            path.append(node)
        old = node.owner
        if old is None:
            node.owner = owner
            for x in path:
                x.size += len(key) + 200
        else:
            best = min(old[:2], owner[:2])
            node.owner = (*best, old[2] + owner[2])

    def spill(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple[int, int, int]]]:
        stack = [(node, prefix + node.label)]
        while stack:
            x, text = stack.pop()
            if x.owner is not None:
                yield text, x.owner
            for child in (x.children or {}).values():
                stack.append((child, text + child.label))

    def spill_to(self, limit: int) -> Iterator[tuple[bytes, tuple[int, int, int]]]:
        """Drops the largest subtrees of the root, or the root's own terminal at last, until at most `limit` bytes are held."""
        while self.root.size > limit:
            if not self.root.children:
                yield from self.drain()
                return
            byte, child = max(self.root.children.items(), key=lambda x: x[1].size)
            yield from self.spill(child, b"")
            self.root.size -= child.size
            del self.root.children[byte]

    def drain(self) -> Iterator[tuple[bytes, tuple[int, int, int]]]:
        yield from self.spill(self.root, b"")
        self.root = Node(b"")


PARTIAL = "n_bytes long, key long, text binary, chars long, owner long, n long"


def _partial(rows: list) -> pa.RecordBatch:
    keys = [hashlib.blake2b(t, digest_size=8).digest() for t, _ in rows]
    return pa.record_batch({
        "n_bytes": pa.array([len(t) for t, _ in rows], pa.int64()), "key": pa.array([int.from_bytes(k, "little", signed=True) for k in keys], pa.int64()), "text": pa.array([t for t, _ in rows], pa.binary()),
        "chars": pa.array([-o[0] for _, o in rows], pa.int64()), "owner": pa.array([o[1] for _, o in rows], pa.int64()), "n": pa.array([o[2] for _, o in rows], pa.int64()),
    })


def _batched(found: Iterator, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for x in found:
        rows.append(x)
        size += len(x[0]) + 64
        if size > limit:
            yield _partial(rows)
            rows, size = [], 0
    if rows:
        yield _partial(rows)


def _local(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, blanks = PatriciaTrie(), BLANKS.encode()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole = data.tobytes()
            for a, b, chars, owner in zip(offsets[:-1].tolist(), offsets[1:].tolist(), batch.column("chars").to_pylist(), batch.column("owner").to_pylist()):
                trie.insert(whole[a:b].translate(None, blanks), (-chars, owner, 1))
                if trie.size > memory:
                    yield from _batched(trie.spill_to(memory // 2))
        yield from _batched(trie.drain())

    return run


def _merged(memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(), None

        def groups(found) -> Iterator[pa.RecordBatch]:
            found = list(found)
            if found:
                yield pa.record_batch({"text_sha256": pa.array([hashlib.sha256(t).hexdigest() for t, _ in found], pa.string()), "keep_id": pa.array([o[1] for _, o in found], pa.int64()), "group_size": pa.array([o[2] for _, o in found], pa.int64())})

        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            whole = data.tobytes()
            rows = zip(offsets[:-1].tolist(), offsets[1:].tolist(), *(batch.column(c).to_pylist() for c in ("n_bytes", "key", "chars", "owner", "n")))
            for a, b, n_bytes, key, chars, owner, n in rows:
                if (n_bytes, key) != last and trie.size > memory:
                    yield from groups(trie.drain())  # every key in it has passed
                last = (n_bytes, key)
                trie.insert(whole[a:b], (-chars, owner, n))
        yield from groups(trie.drain())

    return run


def owners(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """One row per distinct text: text_sha256, keep_id, group_size."""
    rows = docs.select("text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"), order_id().alias("owner"))
    partial = rows.mapInArrow(_local(memory), PARTIAL)
    dealt = partial.repartition("n_bytes", "key").sortWithinPartitions("n_bytes", "key")
    return dealt.mapInArrow(_merged(memory), "text_sha256 string, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """Which row of each group of equal texts stays.

    Texts are equal when they are so without the characters of BLANKS. The row with the most code points, then the
    smallest doc_id, stays. A null text is an empty one, and texts of blanks only are equal to it; a null doc_id
    comes after all others and, where it stays, keep_id is null. Rows that repeat a doc_id with an equal text are
    all marked kept. An empty table gives an empty result; other columns are ignored.
    """
    hashed = docs.select("doc_id", F.sha2(F.translate(F.coalesce("text", F.lit("")), BLANKS, "").cast("binary"), 256).alias("text_sha256"))
    joined = hashed.join(owners(docs, memory), "text_sha256", "left")
    keep = F.when(F.col("keep_id") != NULL_ID, F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), "group_size", F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")
