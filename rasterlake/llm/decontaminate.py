"""Benchmark decontamination by template canonicalisation.

Words become templates: numbers, names (capitalised words but function words, wherever they stand) and units after a
number are replaced by typed placeholders, runs of names and the groups of a number by one. Windows of canonical words
of the benchmark are hash-joined with those of all documents, and so are windows of its words as they are but for case.
Where a document has some of an item's windows, the words are aligned and the slots are compared: equal fillers are an
exact leak, fillers that differ but map one to one a re-parameterised one, anything else is not the item.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PLAIN, Powers, alphabet, byte_table, chunks, mix, order_id, ranges, utf8, word_hashes, words, written

#: Unit names that are placeholders after a number.
UNITS = "mm cm m km g kg t ml l s ms min h hours minutes seconds days weeks years mph kmh hz khz mhz ghz kb mb gb tb w kw v a c f k usd eur dollars euros cents percent miles feet inches pounds metres meters litres liters grams".split()

#: Words that are no names when they open a sentence.
FUNCTION = """a about after all although an and another any are as assume at because before between both but by calculate can compute consider could
 did do does during each either every few find for from given had has have he her here his how i if in into is it its let many may more most my no not
 of on once one or our over she should show since so solve some such suppose than that the their them then there these they this those to two under
 until was we were what when where which while who whom whose why will with would yes you your""".split()

#: Words that are numbers.
NUMERALS = """two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty
 forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()

DIGITS, UPPER = alphabet((0x30, 0x39)), alphabet((0x41, 0x5A))
#: Between the groups of a number: in digits, and in words.
GROUPS, HYPHENS = alphabet((0x2C, 0x2C), (0x2E, 0x2E)), alphabet((0x20, 0x20), (0x2D, 0x2D))
NUMBER, NAME, UNIT = (np.uint64(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in (1, 3, 5))


class Words(NamedTuple):
    """A chunk's words, or its folded ones: canonical and literal hash, each document's first, and each one's first word."""

    canonical: np.ndarray
    literal: np.ndarray
    first: np.ndarray
    word: np.ndarray


class Canonical:
    """Words of a chunk of documents as canonical and literal hashes."""

    def __init__(self):
        self.powers, self.table = Powers(61), byte_table(62, lower=True)
        self.units, self.function, self.numerals = self.known(UNITS), self.known(FUNCTION), self.known(NUMERALS)

    def known(self, some: list[str]) -> np.ndarray:
        joined = np.frombuffer(" ".join(some).encode(), np.uint8)
        s, e, _ = words(joined, np.array([0, len(joined)]), PLAIN)
        return np.sort(word_hashes(joined, s, e, self.table, self.powers))

    @staticmethod
    def among(literal: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, literal)
        at[at == len(known)] = 0
        return known[at] == literal

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, Words]:
        """The words as they are, and with runs of names and the groups of a number folded into one."""
        starts, ends, first = words(data, offsets, PLAIN)
        if not len(starts):
            none = Words(np.empty(0, np.uint64), np.empty(0, np.uint64), first, np.empty(0, np.int64))
            return none, none
        literal = word_hashes(data, starts, ends, self.table, self.powers)
        digits = np.concatenate([[0], np.cumsum(DIGITS[data])])
        number = (digits[ends] - digits[starts] == ends - starts) | self.among(literal, self.numerals)
        begins = np.zeros(len(starts) + 1, bool)
        begins[first] = True
        begins = begins[:-1]
        after = np.concatenate([[False], number[:-1]]) & ~begins
        unit = after & self.among(literal, self.units)
        # a capital, or a two-byte capital of the Latin-1 letters
        lead, second = data[starts], data[np.minimum(starts + 1, len(data) - 1)]
        capital = UPPER[lead] | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))
        name = capital & ~unit & ~self.among(literal, self.function)
        canonical = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, literal)))
        between = data[ends[:-1]] if len(starts) > 1 else np.empty(0, np.uint8)
        run = (starts[1:] == ends[:-1] + 1) & ~begins[1:]
        digit = DIGITS[lead]
        run &= (name[1:] & name[:-1] & (between == 0x20)) | (number[1:] & number[:-1] & np.where(digit[1:] & digit[:-1], GROUPS[between], HYPHENS[between]))
        heads = np.flatnonzero(np.concatenate([[True], ~run]))
        sizes = np.diff(np.concatenate([heads, [len(starts)]]))
        place = (np.arange(len(starts)) - np.repeat(heads, sizes)).astype(np.uint64)
        whole = np.add.reduceat(mix(literal + place * np.uint64(0x9E3779B97F4A7C15)), heads)
        folded = Words(canonical[heads], np.where(sizes > 1, whole, literal[heads]), np.searchsorted(heads, first), heads)
        return Words(canonical, literal, first, np.arange(len(starts))), folded


def windows(canonical: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(canonical) - n + 1)
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + canonical[k : k + m])
    return h


class Table:
    """Windows of items' words, canonical or literal, sorted; equal lengths together."""

    def __init__(self, literal: bool):
        self.literal, self.items, self.tables = literal, [], {}
        self.found: dict[int, list[tuple[np.ndarray, int]]] = defaultdict(list)

    def compared(self, x: Words) -> np.ndarray:
        return x.literal if self.literal else x.canonical

    def add(self, number: int, own: Words, window: int) -> None:
        n = min(window, len(own.literal))
        if n:
            self.found[n].append((windows(self.compared(own), n), len(self.items)))
            self.items.append((number, own, n))

    def close(self) -> None:
        for n, rows in self.found.items():
            h = np.concatenate([x for x, _ in rows])
            item, place = np.concatenate([np.full(len(x), i) for x, i in rows]), np.concatenate([np.arange(len(x)) for x, _ in rows])
            order = np.argsort(h, kind="stable")
            self.tables[n] = (h[order], item[order], place[order])
        self.found.clear()

    def leaks(self, text: Words, cover: float) -> Iterator[tuple]:
        """(document, item's number, windows, coverage, slots, changed slots, kind, first word, end word) of a chunk's leaks."""
        first = text.first
        for n, (table, item, place) in self.tables.items():
            h = windows(self.compared(text), n)
            low = np.searchsorted(table, h)
            low[low == len(table)] = 0
            at = np.flatnonzero(table[low] == h)
            doc = np.searchsorted(first, at, "right") - 1
            inside = at + n <= first[doc + 1]
            at, doc, low = at[inside], doc[inside], low[at[inside]]
            if not len(at):
                continue
            many = np.searchsorted(table, h[at], "right") - low
            entry, at, doc = ranges(low, many), np.repeat(at, many), np.repeat(doc, many)
            which, where = item[entry], place[entry]
            order = np.lexsort((at, which, doc))
            at, doc, which, where = at[order], doc[order], which[order], where[order]
            heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (which[1:] != which[:-1])]))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(doc)]):
                d, i = int(doc[a]), int(which[a])
                got = self.aligned(i, at[a:b], where[a:b], text, int(first[d]), int(first[d + 1]), cover)
                if got:
                    yield d, self.items[i][0], *got

    def aligned(self, i: int, at: np.ndarray, where: np.ndarray, text: Words, begin: int, end: int, cover: float) -> tuple | None:
        _, own, n = self.items[i]
        theirs, ours = self.compared(text), self.compared(own)
        size = len(ours)
        total = size - n + 1
        # places of the item: hits whose offset from the item's beginning stays within half of the item
        offset = at - where
        order = np.argsort(offset, kind="stable")
        at, where, offset = at[order], where[order], offset[order]
        slack, best = max(2, size // 4), None
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(offset) > slack) + 1, [len(offset)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            seen = len(set(where[a:b].tolist()))
            pairs = {(j + k, w + k) for j, w in zip(at[a:b].tolist(), where[a:b].tolist()) for k in range(n)}
            # the words that no window holds go by the offset of the nearest that one holds
            held = {w: j for j, w in sorted(pairs, reverse=True)}
            near, gone = sorted(held), []
            for w in range(size):
                if w not in held:
                    k = bisect_left(near, w)
                    to = min(near[max(0, k - 1) : k + 1], key=lambda x: abs(x - w))
                    j = w + held[to] - to
                    if begin <= j < end and theirs[j] == ours[w]:
                        pairs.add((j, w))
                    else:
                        gone.append((j if begin <= j < end else None, w))
            if seen < cover * total and size - len(gone) < (1 + cover) / 2 * size:
                continue
            # another filler is for the canonical words to judge
            if self.literal and any(own.canonical[w] != own.literal[w] and j is not None and text.canonical[j] == own.canonical[w] for j, w in gone):
                continue
            kind = (0, 0, "exact") if self.literal else self.slots(sorted(pairs), text.canonical, text.literal, own.canonical, own.literal)
            share = max(seen / total, 1 - len(gone) / size)
            if kind and (best is None or (kind[2] != "exact", -share) < best[0]):
                low, high = min(pairs)[0], max(pairs)[0]
                base = int(text.word[begin])
                last = int(text.word[high + 1]) if high + 1 < len(text.word) else int(text.word[high]) + 1
                best = ((kind[2] != "exact", -share), (seen, share, *kind, int(text.word[low]) - base, last - base))
        return best and best[1]

    @staticmethod
    def slots(pairs, canonical, literal, own_canonical, own_literal) -> tuple[int, int, str] | None:
        """Slots, changed slots, and `exact` or `reparameterised`; None if fillers contradict each other or few plain words are equal."""
        is_slot = lambda w: own_canonical[w] != own_literal[w]
        slots = [(int(own_canonical[w]), int(own_literal[w]), int(literal[j])) for j, w in pairs if is_slot(w)]
        plain = len(pairs) - len(slots)
        changed = sum(x != y for _, x, y in slots)
        if not changed:
            return len(slots), 0, "exact"
        if plain < 0.5 * len(pairs):
            return None
        there, back = defaultdict(Counter), defaultdict(Counter)
        for kind, x, y in slots:
            there[kind, x][y] += 1
            back[kind, y][x] += 1
        agree = sum(c.most_common(1)[0][1] for c in there.values()) + sum(c.most_common(1)[0][1] for c in back.values())
        return (len(slots), changed, "reparameterised") if agree >= 1.6 * len(slots) else None


class Block:
    """Some benchmark items: windows of their words as they are, and of their folded canonical words."""

    def __init__(self, canon: Canonical, items: list[tuple[int, bytes]], window: int):
        self.canon, self.ids = canon, [i for i, _ in items]
        self.plain, self.folded = Table(literal=True), Table(literal=False)
        for number, (_, text) in enumerate(items):
            raw = np.frombuffer(text, np.uint8)
            for table, own in zip((self.plain, self.folded), canon.words(raw, np.array([0, len(raw)]))):
                table.add(number, own, window)
        self.plain.close()
        self.folded.close()

    def leaks(self, data: np.ndarray, offsets: np.ndarray, cover: float) -> Iterator[tuple]:
        """(document, item id, windows, coverage, slots, changed slots, kind, first word, end word): a chunk's leaks, a pair of document and item once."""
        plain, folded = self.canon.words(data, offsets)
        found = {}
        for row in (*self.folded.leaks(folded, cover), *self.plain.leaks(plain, cover)):
            if row[:2] not in found or (found[row[:2]][6], row[6]) == ("reparameterised", "exact"):
                found[row[:2]] = row
        for (d, number), row in found.items():
            yield d, self.ids[number], *row[2:]


class Bloom:
    """Which 64-bit hashes may be among those given: four bits of each are set. False ones are rare up to a 64th of the bits."""

    def __init__(self, words: np.ndarray):
        self.words, self.mask = words, np.uint64(64 * len(words) - 1)

    @staticmethod
    def place(h: np.ndarray, k: int, mask: np.uint64) -> np.ndarray:
        """The k-th bit of mixed hashes."""
        return (h + np.uint64(k) * (mix(h) | np.uint64(1))) & mask if k else h & mask

    @classmethod
    def of(cls, windows: DataFrame, most_bits: int) -> "Bloom":
        """Of a column h: its set words are gathered, so the driver holds most_bits at most."""
        count = windows.agg(F.approx_count_distinct("h")).first()[0]
        bits = 1 << 12
        while bits < min(64 * count, most_bits):
            bits *= 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at = np.empty(0, np.uint64)
            for batch in batches:
                h = mix(batch.column("h").to_numpy().view(np.uint64))
                at = np.unique(np.concatenate([at, *(cls.place(h, k, np.uint64(bits - 1)) for k in range(4))]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            if len(word):
                value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first)
                yield pa.record_batch({"word": word.view(np.int64), "value": value.view(np.int64)})

        got = windows.select("h").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
        words = np.zeros(bits // 64, np.uint64)
        words[got["word"].to_numpy()] = got["value"].to_numpy().view(np.uint64)
        return cls(words)

    def passed(self, h: np.ndarray) -> np.ndarray:
        """Places of those that may be among them."""
        h, at = mix(h), None
        for k in range(4):
            bit = self.place(h, k, self.mask)
            some = np.flatnonzero(self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1))
            h, at = h[some], some if at is None else at[some]
        return at


def keyed(h: np.ndarray, n: int, literal: bool) -> np.ndarray:
    """Window hashes that tell lengths, and words as they are from canonical ones, apart."""
    return mix(h ^ np.uint64(2 * n + literal))


WINDOWS = "item long, h long, place int, need int, n int, literal boolean"


def benchmark_windows(items: DataFrame, window: int, cover: float) -> DataFrame:
    """Windows of all items, and how many different ones a document must have for `Table.aligned` to accept the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonical()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            item, rows = batch.column("item").to_numpy(), []
            for own, literal in zip(canon.words(data, offsets), (True, False)):
                compared = own.literal if literal else own.canonical
                for i, (a, b) in enumerate(zip(own.first[:-1].tolist(), own.first[1:].tolist())):
                    n, size = min(window, b - a), b - a
                    if n:
                        total = size - n + 1
                        # a word that differs costs n windows at most, and a place where others come between n - 1, but has one on both sides
                        differ = int((1 - cover) / 2 * size + 1e-9)
                        need = max(1, min(int(np.ceil(cover * total - 1e-9)), -(-(total - n * differ + n - 1) // n)))
                        rows.append((np.full(total, item[i]), keyed(windows(compared[a:b], n), n, literal).view(np.int64), np.arange(total, dtype=np.int32), np.full(total, need, np.int32), np.full(total, n, np.int32), np.full(total, literal)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*rows)], names=[x.split()[0] for x in WINDOWS.split(", ")])

    return items.mapInArrow(run, WINDOWS)


SUSPECTS = "doc_id long, id long, chk long, uid long, text binary, hits array<long>"
LEAKS = "doc_id long, item_id long, n_windows long, coverage double, n_slots long, n_changed long, kind string, first_word long, end_word long"


def _suspects(bloom: Bloom, lengths: list[tuple[int, bool]]):
    """Documents with windows that pass the filter, and those windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonical()
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column("text")):
                both = dict(zip((True, False), canon.words(data, offsets)))
                doc, hit = [], []
                for n, literal in lengths:
                    own = both[literal]
                    h = keyed(windows(own.literal if literal else own.canonical, n), n, literal)
                    at = bloom.passed(h)
                    d = np.searchsorted(own.first, at, "right") - 1
                    inside = at + n <= own.first[d + 1]
                    doc.append(d[inside])
                    hit.append(h[at[inside]])
                doc, hit = np.concatenate(doc), np.concatenate(hit)
                if not len(doc):
                    continue
                # each document's different hits
                order = np.lexsort((hit, doc))
                doc, hit = doc[order], hit[order]
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (hit[1:] != hit[:-1])])
                doc, hit = doc[new], hit[new]
                rows, begin = np.unique(doc, return_index=True)
                some = pa.array(a + rows)
                text = pa.array([data[offsets[d] : offsets[d + 1]].tobytes() for d in rows.tolist()], pa.binary())
                hits = pa.ListArray.from_arrays(pa.array(np.append(begin, len(hit)).astype(np.int32)), pa.array(hit.view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("doc_id", "id", "chk", "uid")), text, hits], names=[x.split()[0] for x in SUSPECTS.split(", ")])

    return run


def _checked(window: int, cover: float):
    """Pairs of a document and an item, as rows of documents with lists of items, that hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canonical()
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            rows = []
            for d, items in enumerate(batch.column("items").to_pylist()):
                block = Block(canon, [(x["item"], x["words"]) for x in items], window)
                text = data[offsets[d] : offsets[d + 1]]
                rows += [(d, *x[1:]) for x in block.leaks(text, np.array([0, len(text)]), cover)]
            if rows:
                some = pa.array([r[0] for r in rows], pa.int64())
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                names = ["doc_id", "id", "chk", "item", *[x.split()[0] for x in LEAKS.split(", ")[2:]]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in ("doc_id", "id", "chk")), *(pa.array([r[i + 1] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return run


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int, cover: float, most_bits: int, salts: int = 8) -> DataFrame | None:
    """doc_id, id, chk (an order id and a hash of the text) and LEAKS' columns; None if the benchmark has no words."""
    every = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item"), "text")
    items = every.select("item", F.col("text").cast("binary").alias("words")).dropDuplicates(["item"])
    table = written(benchmark_windows(items.withColumnRenamed("words", "text"), window, cover), "windows")
    lengths = [(r["n"], r["literal"]) for r in table.select("n", "literal").distinct().collect()]  # window x 2 at most
    if not lengths:
        return None
    bloom = Bloom.of(table, most_bits)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), order_id().alias("id"), F.xxhash64("text").alias("chk"), F.monotonically_increasing_id().alias("uid"), "text")
    suspects = written(given.mapInArrow(_suspects(bloom, lengths), SUSPECTS), "suspects")
    # windows that very many documents share are dealt by salt, too
    salt = F.pmod("uid", F.lit(salts))
    hits = suspects.select("uid", F.explode("hits").alias("h")).withColumn("salt", salt)
    ours = table.select("h", "item", "place", "need", "n", "literal").withColumn("salt", F.explode(F.array(*[F.lit(k).cast("long") for k in range(salts)])))
    shared = hits.join(ours, ["h", "salt"]).groupBy("uid", "item", "literal", "n").agg(F.count("*").alias("places"), F.max("need").alias("need"))
    pairs = shared.where("places >= need").select("uid", "item").distinct()
    lists = pairs.join(items, "item").groupBy("uid").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    rows = suspects.select("doc_id", "id", "chk", "uid", "text").join(lists, "uid").select("doc_id", "id", "chk", "text", "items")
    found = rows.mapInArrow(_checked(window, cover), "doc_id long, id long, chk long, item long, " + LEAKS.split(", ", 2)[2])
    return found.join(every.select("item", "item_id").distinct(), "item")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 5, cover: float = 0.8, most_bits: int = 1 << 27) -> DataFrame:
    """Documents that hold a benchmark item: a row for each of their pairs.

    An item counts as held if near one place of the document at least `cover` of its windows of `window` words stand, or
    a window does and half of what `cover` leaves at most of the words aligned with it differ; in either case as words
    or as canonical words with consistent slots. Items of fewer words have one window of all their words, be it one word.
    Null or empty texts on either side match nothing; items with equal ids and texts count once, other items with equal
    texts are looked for once and have rows of their own; repeated rows of documents have rows of their own; an empty
    benchmark gives an empty result. Neither side is gathered: the benchmark's windows are joined, and the filter of
    them that goes to all tasks has most_bits bits at most (beyond that it passes more, and the join tells).
    """
    found = _leaks(docs, benchmark, window, cover, most_bits)
    names = [x.split()[0] for x in LEAKS.split(", ")]
    return docs.sparkSession.createDataFrame([], LEAKS) if found is None else found.select(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 5, cover: float = 0.8, most_bits: int = 1 << 27) -> DataFrame:
    """The rows of docs that hold no benchmark item (see find_leaks), all columns as they were. Rows are told apart by id and text: equal ones stay or go together."""
    found = _leaks(docs, benchmark, window, cover, most_bits)
    if found is None:
        return docs
    gone = written(found.select("id", "chk").distinct(), "leaks")
    rows = docs.select(order_id().alias("id"), F.xxhash64("text").alias("chk"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.join(gone, ["id", "chk"], "left_anti").select("row.*")
