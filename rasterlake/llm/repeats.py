"""Where could a long passage stand twice? The part that both substring dedups share.

Windows of `width` symbols (bytes or words) are what is compared. Of the runs of `gram` symbols in a window, the one
with the smallest hash is the window's anchor; consecutive windows mostly share it, and equal windows have it at the
same place. So an anchor with the text that its windows cover, its context, stands for all of them. A window can only
stand twice if its anchor's gram does: single grams, the great majority, go no further than one shuffle of fixed-size
rows. Equal contexts are one row with their number, and one text of each distinct context goes to an index, dealt by gram,
which finds the windows that stand twice (the operator's own method). Its answers are joined back to all places.

Rows of the input tasks are grouped by gram before the shuffle, so a gram that very many documents share comes as one
row of each task, and its places are dealt by place. A gram that stands in very many different contexts, a crowd, is not
dealt by gram: its contexts are taken apart into windows, equal windows of a task become one row, and the rows are
dealt by window.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, chunks, discard, mix, order_id, prefix, ranges, sliding_min, span_hash, utf8, written

LOW = np.uint64(0xFFFFFFFF)


class Anchors:
    """Anchors of the windows of a chunk of documents, whose symbols are 64-bit values."""

    def __init__(self, width: int, gram: int):
        if not 0 < width - gram < 255:
            raise ValueError("a window has 1 to 254 more symbols than a gram")
        self.width, self.gram = width, gram
        self.first, self.second = Powers(11), Powers(12)

    def find(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """document, place, first window, last window, gram hash, context hash of each anchor; bounds: documents' first symbols."""
        counts = np.maximum(0, np.diff(bounds) - self.width + 1)
        at = ranges(bounds[:-1], counts)
        if not len(at):
            none = np.empty(0, np.int64)
            return (none,) * 6
        sums, starts = prefix(symbols, self.first), np.arange(len(symbols) - self.gram + 1)
        grams = span_hash(sums, starts, starts + self.gram, self.first)
        best = sliding_min((grams & ~LOW) | starts.astype(np.uint64), self.width - self.gram + 1)[at]
        place = (best & LOW).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        low, place = at[new], place[new]
        high = at[np.concatenate([np.flatnonzero(new)[1:], [len(at)]]) - 1]
        other = prefix(symbols, self.second)
        shape = ((place - low) * 256 + (place - high)).astype(np.uint64)
        context = mix(span_hash(other, low, high + self.width, self.second) + shape)
        doc = np.searchsorted(bounds, low, "right") - 1
        return doc, place - bounds[doc], low - bounds[doc], high - bounds[doc], grams[place], context


class Repeats(ABC):
    """A substring dedup: how a text becomes symbols, and the index that finds repeated windows."""

    #: What an index reads: contexts, or windows of a crowd with all contexts of a task that hold them (gram, ctx, window).
    PASSAGES = "deal long, gram long, ctx long, n long, least long, windows int, passage binary, members binary"
    #: What an index returns: windows first..last of a context stand twice, the first time in row `least`.
    FOUND = "gram long, ctx long, first int, last int, least long"

    def __init__(self, width: int, gram: int, other_document: bool, crowd: int = 512):
        """crowd: distinct contexts of a gram from which it is dealt by window (more in a corpus of over 2**16 times as many)."""
        self.width, self.gram, self.other_document, self.crowd = width, gram, other_document, crowd

    @abstractmethod
    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit values of all symbols and each document's first."""

    @abstractmethod
    def passages(self, text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
        """The texts of spans of symbols."""

    @abstractmethod
    def index(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From PASSAGES, sorted by deal, to FOUND. Equal windows have equal deals."""

    # anchors, grouped by gram in each task, then over all

    def _anchors(self, batches: Iterator[pa.RecordBatch], held: int = 1 << 20) -> Iterator[pa.RecordBatch]:
        finder, got, size = Anchors(self.width, self.gram), [], 0

        def flush() -> pa.RecordBatch:
            gram, ctx, doc, chk, pos = (np.concatenate([g[i] for g in got]) for i in range(5))
            got.clear()
            order = np.argsort(gram)
            gram, ctx, doc, chk, pos = gram[order], ctx[order], doc[order], chk[order], pos[order]
            heads = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(gram)]]))
            twice = sizes > 1
            if self.other_document:
                twice &= np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads)
            # 0: alone so far; 2: known to stand twice, dealt by place; 1: tells the others of its gram so
            kind = np.repeat(np.where(twice, 2, 0), sizes)
            key = np.where(kind == 2, mix(gram ^ doc.view(np.uint64) ^ chk.view(np.uint64) ^ pos.view(np.uint64)), gram)
            tell = heads[twice]
            pick = lambda x: np.concatenate([x, x[tell]]).view(np.int64)
            key = np.concatenate([key, gram[tell]]).view(np.int64)
            kind = np.concatenate([kind, np.ones(len(tell), np.int64)]).astype(np.int8)
            return pa.record_batch({"key": key, "gram": pick(gram), "ctx": pick(ctx), "doc": pick(doc), "chk": pick(chk), "pos": pick(pos), "kind": kind})

        for batch in batches:
            ids, checks = batch.column("doc").to_numpy(), batch.column("chk").to_numpy()
            for a, b, data, offsets in chunks(batch.column("text")):
                symbols, bounds = self.symbols(data, offsets)
                doc, place, low, high, gram, ctx = finder.find(symbols, bounds)
                if not len(doc):
                    continue
                pos = place << 32 | (place - low) << 24 | (place - high) << 16
                got.append((gram, ctx, ids[a:b][doc].astype(np.int64), checks[a:b][doc].astype(np.int64), pos.astype(np.int64)))
                size += len(doc)
                if size > held:
                    yield flush()
                    size = 0
        if got:
            yield flush()

    def _twice(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key: the places whose gram stands twice."""
        names = ("key", "gram", "ctx", "doc", "chk", "pos", "kind")
        rest = [np.empty(0, np.int64)] * 7

        def made(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key, gram, ctx, doc, chk, pos, kind = rows
            if not len(key):
                return
            heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(key)]]))
            twice = np.maximum.reduceat(kind, heads) > 0
            twice |= np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads) if self.other_document else sizes > 1
            keep = (np.repeat(twice, sizes) & (kind != 1)) | (kind == 2)
            if keep.any():
                yield pa.record_batch({"gram": gram[keep], "ctx": ctx[keep], "doc": doc[keep], "chk": chk[keep], "pos": pos[keep]})

        for batch in batches:
            rows = [np.concatenate([r, batch.column(c).to_numpy().astype(np.int64)]) for r, c in zip(rest, names)]
            cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
            yield from made([x[:cut] for x in rows])
            rest = [x[cut:] for x in rows]
        yield from made(rest)

    def _contexts(self, crowds: np.ndarray):
        """The passages of the contexts that each text stands for."""
        known = frozenset(crowds.tolist())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, size, apart, held = [], 0, {}, 0
            for batch in batches:
                data, offsets = utf8(batch.column("text"))
                whole = data.tobytes()
                for i, places in enumerate(batch.column("places").to_pylist()):
                    spans = []
                    for p in places:
                        place, low, high = p["pos"] >> 32, p["pos"] >> 24 & 255, p["pos"] >> 16 & 255
                        spans.append((place - low, place - high + self.width))
                    many = [k for k, p in enumerate(places) if p["gram"] in known]
                    text, least = whole[offsets[i] : offsets[i + 1]], batch.column("doc")[i].as_py()
                    for k, passage in enumerate(self.passages(text, spans)):
                        p, (a, b) = places[k], spans[k]
                        if p["gram"] not in known:
                            out.append((p["gram"], p["gram"], p["ctx"], p["n"], least, b - a - self.width + 1, passage, None))
                            size += len(passage)
                    single = [(a + w, a + w + self.width) for k in many for a, b in [spans[k]] for w in range(b - a - self.width + 1)]
                    owner = [(places[k], w) for k in many for w in range(spans[k][1] - spans[k][0] - self.width + 1)]
                    for (p, w), passage in zip(owner, self.passages(text, single) if single else ()):
                        at = apart.get((p["gram"], passage))
                        if at is None:
                            apart[p["gram"], passage] = [p["ctx"], p["n"], least, [(p["gram"], p["ctx"], w)]]
                            held += len(passage)
                        else:
                            at[1], at[2] = at[1] + p["n"], min(at[2], least)
                            at[3].append((p["gram"], p["ctx"], w))
                        held += 64
                    if size > 4 << 20:
                        yield self._passages(out)
                        out, size = [], 0
                    if held > 32 << 20:
                        yield from self._apart(apart)
                        apart, held = {}, 0
            yield from self._apart(apart)
            if out:
                yield self._passages(out)

        return run

    def _apart(self, windows: dict[tuple[int, bytes], list], lot: int = 1 << 14) -> Iterator[pa.RecordBatch]:
        rows = []
        for (gram, passage), (ctx, n, least, members) in windows.items():
            deal = hashlib.blake2b(passage, digest_size=8, key=gram.to_bytes(8, "little", signed=True)).digest()
            rows.append((int.from_bytes(deal, "little", signed=True), gram, ctx, n, least, 1, passage, np.array(members, "<i8").tobytes()))
            if len(rows) >= lot:
                yield self._passages(rows)
                rows = []
        if rows:
            yield self._passages(rows)

    @classmethod
    def _passages(cls, rows: list) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 5, pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in cls.PASSAGES.split(", ")])

    @staticmethod
    def found(gram: np.ndarray, ctx: np.ndarray, first: np.ndarray, last: np.ndarray, least: np.ndarray, members: list[bytes | None]) -> pa.RecordBatch:
        """FOUND of runs of windows of contexts; those of a crowd's window are its members."""
        apart = np.array([m is not None for m in members], bool)
        parts = [(gram[~apart], ctx[~apart], first[~apart], last[~apart], least[~apart])]
        for k in np.flatnonzero(apart).tolist():
            m = np.frombuffer(members[k], "<i8").reshape(-1, 3)
            parts.append((m[:, 0], m[:, 1], m[:, 2], m[:, 2], np.full(len(m), least[k])))
        gram, ctx, first, last, least = (np.concatenate(x) for x in zip(*parts))
        return pa.record_batch({"gram": gram, "ctx": ctx, "first": first.astype(np.int32), "last": last.astype(np.int32), "least": least})

    def spans(self, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The documents (doc, chk, and docs' columns) and their spans of symbols to remove: doc, chk, spans (first, end).

        chk is a 64-bit hash of the text: it tells rows without an id, or of one id, apart.
        """
        keyed = docs.select(order_id().alias("doc"), F.xxhash64("text").alias("chk"), "doc_id", "text")
        anchors = keyed.select("doc", "chk", "text").mapInArrow(self._anchors, "key long, gram long, ctx long, doc long, chk long, pos long, kind byte")
        places = written(anchors.repartition("key").sortWithinPartitions("key").mapInArrow(self._twice, "gram long, ctx long, doc long, chk long, pos long"), "places")
        contexts = places.groupBy("gram", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("doc", "chk", "pos")).alias("at"))
        contexts = written(contexts.select("gram", "ctx", "n", "at.doc", "at.chk", "at.pos"), "contexts")
        # a list of 2**16 grams at most
        most = max(self.crowd, contexts.count() >> 16)
        crowds = contexts.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > most).select("gram").collect()
        # a document's list is no longer than the document
        wanted = contexts.groupBy("doc", "chk").agg(F.collect_list(F.struct("gram", "ctx", "n", "pos")).alias("places"))
        texts = keyed.select("doc", "chk", "text").join(wanted, ["doc", "chk"]).select("doc", "text", "places")
        passages = texts.mapInArrow(self._contexts(np.array([r["gram"] for r in crowds], np.int64)), self.PASSAGES)
        found = passages.repartition("deal").sortWithinPartitions("deal").mapInArrow(self.index, self.FOUND)
        # a context's windows as one row, neighbours of the same least row as one run: a place then meets one row, not one for each
        # of its windows. No list is longer than a context has windows
        runs = found.groupBy("gram", "ctx").agg(F.sort_array(F.collect_list(F.struct("first", "last", "least"))).alias("runs"))
        run = lambda first, last, least: F.struct(first.alias("first"), last.alias("last"), least.alias("least"))
        meets = lambda x, r: (F.size(x) > 0) & (F.get(x, F.size(x) - 1)["least"] == r["least"]) & (r["first"] <= F.get(x, F.size(x) - 1)["last"] + 1)
        longer = lambda x, r: F.concat(F.slice(x, 1, F.size(x) - 1), F.array(run(F.get(x, F.size(x) - 1)["first"], F.greatest(F.get(x, F.size(x) - 1)["last"], r["last"]), r["least"])))
        empty = F.array().cast("array<struct<first:int,last:int,least:bigint>>")
        merged = F.aggregate("runs", empty, lambda x, r: F.when(meets(x, r), longer(x, r)).otherwise(F.concat(x, F.array(run(r["first"], r["last"], r["least"])))))
        found = written(runs.select("gram", "ctx", merged.alias("runs")), "found")
        discard(contexts)
        start = F.shiftright("pos", 32) - F.shiftright("pos", 24).bitwiseAND(F.lit(255))
        span = lambda r: F.struct((start + r["first"]).alias("first"), (start + r["last"] + self.width).alias("end"))
        own = F.transform(F.filter("runs", lambda r: F.col("doc") > r["least"]), span)
        spans = places.join(found, ["gram", "ctx"]).select("doc", "chk", own.alias("spans")).where(F.size("spans") > 0)
        return keyed, spans.groupBy("doc", "chk").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def covered(spans: list[dict] | None, n: int) -> np.ndarray:
    """Which of n symbols some span covers."""
    if not spans:
        return np.zeros(n, bool)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["first"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge[:-1]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
