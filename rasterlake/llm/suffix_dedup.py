"""Substring dedup on bytes with a logarithmic family of suffix arrays.

Suffixes are the positions where a window of `width` bytes starts; only that many bytes of a suffix count. A new batch of
texts gets a suffix array: its suffixes in byte order, equal ones as one run with the number of its places. The batch is
merge-scanned against each level, the suffix array of earlier batches: neighbours in the merged order that agree in
`width` bytes are a long match. What no level has becomes a new level, and levels of like size are merged, so that there
are about log n levels and a suffix is moved log n times. A window is reported when its run, over all levels, gets a second
place: then, once, for every place that it has, and for each later one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_table, ranges, utf8
from .repeats import Repeats, covered, sha256


def heads(suffixes: np.ndarray) -> np.ndarray:
    """Where the runs of equal ones begin in sorted suffixes."""
    if not len(suffixes):
        return np.empty(0, np.int64)
    raw = suffixes.view(np.uint8).reshape(len(suffixes), -1)
    return np.flatnonzero(np.concatenate([[True], (raw[1:] != raw[:-1]).any(axis=1)]))


class Level:
    """A suffix array of distinct windows, with their bytes: one place (context << 8 | window) and the number of places of each."""

    def __init__(self, suffixes: np.ndarray, place: np.ndarray, total: np.ndarray):
        self.suffixes, self.place, self.total = suffixes, place, total

    def __len__(self) -> int:
        return len(self.place)

    def order(self, other: "Level") -> tuple[np.ndarray, np.ndarray]:
        """The merged order of both arrays, and the merged suffixes: a stable sort of two runs is one pass."""
        both = np.concatenate([self.suffixes, other.suffixes])
        order = np.argsort(both, kind="stable")
        return order, both[order]

    def merged(self, other: "Level") -> "Level":
        order, suffixes = self.order(other)
        return Level(suffixes, np.concatenate([self.place, other.place])[order], np.concatenate([self.total, other.total])[order])

    def matches(self, other: "Level") -> tuple[np.ndarray, np.ndarray]:
        """Which windows of this level and of the other are the same, from a scan of the merged order."""
        order, suffixes = self.order(other)
        again = np.ones(len(order), bool)
        again[heads(suffixes)] = False
        at = np.flatnonzero(again)
        return order[at - 1], order[at] - len(self)


class Family:
    def __init__(self, width: int):
        self.width, self.levels = width, []
        self.reported: list[np.ndarray] = []

    @property
    def size(self) -> int:
        return sum(map(len, self.levels))

    def suffix_array(self, data: np.ndarray, first: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted suffixes of a batch's contexts, and their places."""
        at = ranges(first, windows)
        number = np.repeat(np.arange(len(first)), windows)
        every = np.ndarray((len(data) - self.width + 1,), f"V{self.width}", buffer=data, strides=(1,))
        suffixes = every[at]
        order = np.argsort(suffixes, kind="stable")
        return suffixes[order], (number << 8 | (at - first[number]))[order]

    def add(self, data: np.ndarray, first: np.ndarray, windows: np.ndarray, n: np.ndarray, base: int) -> None:
        """A batch of contexts, numbered from base, that stand at n places each."""
        if not len(first):
            return
        suffixes, place = self.suffix_array(data, first, windows)
        run = heads(suffixes)
        sizes = np.diff(np.concatenate([run, [len(place)]]))
        new = Level(suffixes[run], place[run] + (base << 8), np.add.reduceat(n[place >> 8], run))
        known = np.zeros(len(new), bool)
        for level in self.levels:
            theirs, ours = level.matches(new)
            known[ours] = True
            once = theirs[level.total[theirs] == 1]
            self.reported.append(level.place[once])
            level.total[theirs] += new.total[ours]
        self.reported.append((place + (base << 8))[np.repeat(known | (new.total > 1), sizes)])
        if not known.all():
            self.levels.append(Level(new.suffixes[~known], new.place[~known], new.total[~known]))
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                b, a = self.levels.pop(), self.levels.pop()
                self.levels.append(a.merged(b))

    def answers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Context, first and last window of the runs of reported windows."""
        place = np.unique(np.concatenate(self.reported)) if self.reported else np.empty(0, np.int64)
        if not len(place):
            return (np.empty(0, np.int64),) * 3
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (place[1:] >> 8 != place[:-1] >> 8)
        begins = np.flatnonzero(new)
        last = place[np.concatenate([begins[1:], [len(place)]]) - 1]
        return place[begins] >> 8, place[begins] & 255, last & 255


class SuffixRepeats(Repeats):
    """batch: windows of a batch, about. memory: suffixes in a family from which on it is closed, between two deals."""

    def __init__(self, width: int = 200, gram: int = 64, batch: int = 1 << 15, memory: int = 1 << 17, crowd: int = 512):
        super().__init__(width, gram, other_document=False, crowd=crowd)
        self.batch, self.memory, self.table = batch, memory, byte_table(13)

    def symbols(self, data, offsets):
        return self.table[data], offsets

    def passages(self, text, spans):
        return [text[a:b] for a, b in spans]

    def index(self, batches):
        family, held = Family(self.width), []

        def close() -> Iterator[pa.RecordBatch]:
            number, first, last = family.answers()
            if len(number):
                gram, ctx = (np.concatenate([p.column(c).to_numpy() for p in held])[number] for c in ("gram", "ctx"))
                members = pa.chunked_array([p.column("members") for p in held]).take(pa.array(number)).to_pylist()
                yield self.found(gram, ctx, first, last, np.full(len(number), -(1 << 63), np.int64), members)

        last_deal = None
        for batch in batches:
            deal, windows = batch.column("deal").to_numpy(), batch.column("windows").to_numpy().astype(np.int64)
            upto, at = np.cumsum(windows), 0
            while at < len(deal):
                if family.size > self.memory and deal[at] != last_deal:
                    yield from close()  # no window of this deal or a later one stands in the family
                    family, held = Family(self.width), []
                to = max(at + 1, int(np.searchsorted(upto, upto[at] - windows[at] + self.batch, "right")))
                part = batch.slice(at, to - at)
                data, offsets = utf8(part.column("passage"))
                family.add(data, offsets[:-1], windows[at:to], part.column("n").to_numpy(), sum(p.num_rows for p in held))
                held.append(part.select(["gram", "ctx", "members"]))
                last_deal, at = deal[to - 1], to
        yield from close()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = []
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                gone = covered(spans, len(text))
                n = int(gone.sum())
                kept = (text[~gone] if n else text).tobytes()
                rows.append((len(text), n, int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), sha256(kept), kept if with_kept else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def suffix_dedup(docs: DataFrame, width: int = 200, gram: int | None = None, with_kept: bool = False, **index) -> DataFrame:
    """Every document without the bytes of windows of `width` bytes that also start anywhere else.

    Windows never cross documents, are judged on the input, and overlapping ones count. A null text is an empty one;
    a text shorter than a window loses nothing; repeated rows are other places, so both lose their windows. kept holds
    the remaining bytes if with_kept, else null. Rows may share a doc_id; a null one comes after all others.
    """
    engine = SuffixRepeats(width, gram or max(1, width * 8 // 25), **index)
    keyed, spans = engine.spans(docs)
    rows = keyed.join(spans, ["doc", "chk"], "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(_cut(with_kept), RESULT)
