"""Substring dedup on words with prefix-partitioned suffix trees.

Suffixes are the places where a window of `width` words starts. They are split into groups by variable-length
prefixes: by their first word, and groups that are larger than the memory limit by one word more, until they fit; small
ones are packed together. Each group's suffix tree is made from its sorted suffixes and the common prefixes of
neighbours: a deep internal node, of at least `width` words, is an interval of neighbours with that many words in
common. Its leaves are the places of a repeat, of which those in the smallest doc_id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACED, Powers, byte_table, ranges, word_hashes, words
from .repeats import Repeats, covered, sha256


def prefix_groups(suffixes: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, int]]:
    """Rows of suffixes (a row of word numbers each) in groups of at most `limit`, unless all of a row's words are equal, and the depth of the prefix that a group's rows share."""
    stack = [(np.arange(len(suffixes)), 0)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= limit or depth == suffixes.shape[1]:
            yield rows, depth
            continue
        word = suffixes[rows, depth]
        order = np.argsort(word, kind="stable")
        rows, word = rows[order], word[order]
        heads = np.concatenate([np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])), [len(rows)]])
        begin = 0
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
            if b - a > limit:
                if begin < a:
                    yield rows[begin:a], depth
                stack.append((rows[a:b], depth + 1))
                begin = b
            elif b - begin > limit:
                yield rows[begin:a], depth
                begin = a
        if begin < len(rows):
            yield rows[begin:], depth


def deep_nodes(suffixes: np.ndarray, rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """A group's rows in suffix order, and where the tree's nodes of full depth begin: neighbours there differ in a word."""
    own = suffixes[rows, depth:]
    if not own.shape[1]:
        return rows, np.array([0])
    order = np.lexsort(own.T[::-1])
    own = own[order]
    common = np.logical_and.accumulate(own[1:] == own[:-1], axis=1).sum(axis=1)  # words in common with the one before
    return rows[order], np.concatenate([[0], np.flatnonzero(common < own.shape[1]) + 1])


class WordRepeats(Repeats):
    """limit: suffixes of a group's tree. memory: suffixes that are gathered before they are split, between two deals."""

    def __init__(self, width: int = 13, gram: int = 4, limit: int = 1 << 16, memory: int = 1 << 18, crowd: int = 512):
        super().__init__(width, gram, other_document=True, crowd=crowd)
        self.limit, self.memory = limit, memory
        self.powers, self.table = Powers(31), byte_table(32)

    def symbols(self, data, offsets):
        starts, ends, first = words(data, offsets, SPACED)
        return (word_hashes(data, starts, ends, self.table, self.powers) if len(starts) else np.empty(0, np.uint64)), first

    def passages(self, text, spans):
        split = text.split()
        return [b" ".join(split[a:b]) for a, b in spans]

    def index(self, batches):
        held, size, last = [], 0, None
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("deal", "gram", "ctx", "n", "least", "windows", "passage", "members")))
            for row in rows:
                if size > self.memory and row[0] != last:
                    yield from self.trees(held)
                    held, size = [], 0
                held.append(row)
                size += row[5]
                last = row[0]
        if held:
            yield from self.trees(held)

    def trees(self, contexts: list[tuple]) -> Iterator[pa.RecordBatch]:
        gram, ctx, n, least, windows = (np.array([c[i] for c in contexts], np.int64) for i in range(1, 6))
        numbers: dict[bytes, int] = {}
        texts = [[numbers.setdefault(w, len(numbers)) for w in c[6].split()] for c in contexts]
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        flat = np.array([w for t in texts for w in t], np.int32)
        at, owner = ranges(begin, windows), np.repeat(np.arange(len(contexts)), windows)
        suffixes = flat[at[:, None] + np.arange(self.width)]
        smallest, places = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        for rows, depth in prefix_groups(suffixes, self.limit):
            rows, nodes = deep_nodes(suffixes, rows, depth)
            leaves = np.diff(np.concatenate([nodes, [len(rows)]]))
            smallest[rows] = np.repeat(np.minimum.reduceat(least[owner[rows]], nodes), leaves)
            places[rows] = np.repeat(np.add.reduceat(n[owner[rows]], nodes), leaves)
        keep = places > 1
        owner, window, smallest = owner[keep], (at - begin[owner])[keep], smallest[keep]
        if not len(owner):
            return
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (window[1:] != window[:-1] + 1) | (smallest[1:] != smallest[:-1])
        heads = np.flatnonzero(new)
        end = np.concatenate([heads[1:], [len(owner)]]) - 1
        own = owner[heads]
        yield self.found(gram[own], ctx[own], window[heads], window[end], smallest[heads], [contexts[i][7] for i in own.tolist()])


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _cut(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                split = (text or b"").split()
                gone = covered(spans, len(split)) if spans else None
                kept = b" ".join(split if gone is None else [split[i] for i in np.flatnonzero(~gone).tolist()])
                rows.append((len(split), 0 if gone is None else int(gone.sum()), sha256(kept), kept.decode("utf-8", "replace") if with_kept else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def substring_dedup(docs: DataFrame, width: int = 13, gram: int | None = None, with_kept: bool = False, **index) -> DataFrame:
    """Every document without the words of windows of `width` words that also start in a document with a smaller doc_id.

    Words are runs of other characters than [\\x20\\x09-\\x0D], unchanged. Windows never cross documents, are judged on
    the input, and overlapping ones count. A null text has no words; a text shorter than a window loses nothing;
    repeated rows share their doc_id, so neither is before the other; a null doc_id comes after all others. kept holds
    the remaining words, joined by a space, if with_kept, else null.
    """
    engine = WordRepeats(width, gram or max(1, width // 3), **index)
    keyed, spans = engine.spans(docs)
    rows = keyed.join(spans, ["doc", "chk"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(with_kept), RESULT)
