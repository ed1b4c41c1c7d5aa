"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

The vocabulary's ids are ranked by how often they occur in the whole corpus, so that the frequent half of a text takes
one byte an id. Each block of documents has a control stream, two bits an id for the length of its rank in bytes
(four ids a byte), and a data stream of the ranks' bytes. Decoding looks up the 256 control bytes in a table of
four lengths and gathers all ranks of a block at once with numpy.

A file is a Parquet file whose rows are blocks, so that Spark's own committer writes it to any store and a lost
executor leaves no half-written file. Files hold consecutive ranges of doc_id.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, Powers, alphabet, byte_table, chunks, discard, order_id, ranges, word_hashes, words, written

#: Bytes of control streams to the byte lengths of their four ranks.
LENGTHS = np.array([[(c >> s & 3) + 1 for s in (0, 2, 4, 6)] for c in range(256)], np.int64)
#: Texts are cut at these two, and between an ASCII letter and one of these marks.
PIECES = ~alphabet((0x20, 0x20), (0x0A, 0x0A))
ASCII_LETTERS = alphabet((0x41, 0x5A), (0x61, 0x7A))
MARKS = alphabet((0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F))
#: How a tokenizer must see texts for pieces to be encoded apart, and whatever their case: no token spans a cut.
CUT_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
CUT_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def may_be_cut(path: str) -> bool:
    """Whether pieces give the ids of whole texts. Special tokens must not be cut, and must be told by `<|`, as case matters in them."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = [t["content"] for t in told["added_tokens"]]
    whole = all(t.startswith("<|") and len(pieces(*_bytes(t))[0]) == 1 for t in special) and not any(t["lstrip"] or t["rstrip"] for t in told["added_tokens"])
    return whole and told["normalizer"] == CUT_NORMALIZER and told["pre_tokenizer"] == CUT_PRE_TOKENIZER and told["model"]["type"] == "BPE" and not told["truncation"] and not told["padding"]


def word_ends(path: str) -> np.ndarray | None:
    """By id: whether it ends a word; None if the vocabulary has no sign for that."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if not (sign := model.get("end_of_word_suffix")):
        return None
    ends = np.zeros(max(model["vocab"].values(), default=-1) + 1, bool)
    ends[[i for x, i in model["vocab"].items() if x.endswith(sign)]] = True
    return ends


def _bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all pieces, and each document's first."""
    starts, ends, _ = words(data, offsets, PIECES)
    letter, mark = ASCII_LETTERS[data], MARKS[data]
    cut = np.flatnonzero((letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])) + 1
    inner = np.searchsorted(starts, cut, "right") - 1
    cut = cut[(inner >= 0) & (cut > starts[inner]) & (cut < ends[inner])] if len(starts) else cut[:0]
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)

BLOCK = "shard int, block int, doc_ids binary, counts binary, control binary, data binary, n_tokens long"


class Encoder:
    """Encodes whole texts. Where the tokenizer allows it, a piece is encoded once, whatever the case of A-Z, and found again by its 64-bit hash."""

    def __init__(self, path: str, most: int = 1 << 19):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.cut = Tokenizer.from_file(path), most, may_be_cut(path)
        self.powers, self.folded, self.exact = Powers(71), byte_table(72, lower=True), byte_table(73)
        self.ends = word_ends(path) if self.cut else None
        self.slots = 1 << max(4, (2 * most - 1).bit_length())
        self.forget()

    def forget(self) -> None:
        #: A table of hashes and their numbers; a hash stands at its slot, or at the next free one.
        self.keys, self.numbers, self.known = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32), 0
        self.starts, self.counts, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)
        self.hashes, self.again = np.empty(0, np.uint64), np.empty(0, bool)  # again: found in a later chunk

    def thin(self) -> None:
        """Forgets the pieces that no later chunk had; all of them, if the others take half of the room."""
        kept = np.flatnonzero(self.again)
        kept = kept[: len(kept) if 2 * len(kept) <= self.most else 0]
        hashes, ids, counts = self.hashes[kept], self.pool[ranges(self.starts[kept], self.counts[kept])], self.counts[kept]
        self.forget()
        self.add(hashes, ids, counts)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of hashes, -1 for new ones."""
        out, mask = np.full(len(hashes), -1, np.int64), np.uint64(self.slots - 1)
        open_, at = np.arange(len(hashes)), hashes & mask
        while len(open_):
            key = self.keys[at]
            same = key == hashes[open_]
            out[open_[same]] = self.numbers[at[same]]
            rest = ~same & (key != 0)
            open_, at = open_[rest], at[rest] + np.uint64(1) & mask
        return out

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        kind = np.array([x.isalpha() + (x.isalpha() and x.isascii()) for x in pieces], np.int8)
        for k, ids_of in enumerate((self.ids_of, self.ids_of_words, self.ids_of_plain_words)):
            of_kind = np.flatnonzero(kind == k)
            if len(of_kind):
                self.add(hashes[of_kind], *ids_of([pieces[i] for i in of_kind.tolist()]))

    def ids_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some texts, and the number of ids of each."""
        got = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def ids_of_plain_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids_of for texts of ASCII letters: what a tokenizer that may be cut does before its model is to lower them."""
        model = self.tokenizer.model
        got = [[x.id for x in model.tokenize(text.lower())] for text in texts]
        return np.array([i for x in got for i in x], np.uint32), np.array([len(x) for x in got], np.int64)

    def ids_of_words(self, texts: list[str], together: int = 1024) -> tuple[np.ndarray, np.ndarray]:
        """ids_of for texts of letters: many at a time, as a text of words. Each of them ends a word at least, so if there are as
        many ends as texts, each is one word; else they are encoded one by one."""
        if self.ends is None:
            return self.ids_of(texts)
        made = []
        for k in range(0, len(texts), together):
            part = texts[k : k + together]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.ends[ids])
            whole = len(ends) == len(part) and ends[-1] == len(ids) - 1
            made.append((ids, np.diff(ends, prepend=-1)) if whole else self.ids_of(part))
        ids, counts = zip(*made)
        return np.concatenate(ids), np.concatenate(counts)

    def add(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        starts, number = len(self.pool) + np.cumsum(counts) - counts, len(self.counts) + np.arange(len(counts))
        self.pool = np.concatenate([self.pool, ids])
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.hashes, self.again = np.concatenate([self.hashes, hashes]), np.concatenate([self.again, np.zeros(len(hashes), bool)])
        self.known += len(counts)
        mask, at = np.uint64(self.slots - 1), hashes & np.uint64(self.slots - 1)
        while len(hashes):
            free = self.keys[at] == 0
            self.keys[at[free]] = hashes[free]  # of several for one slot, one stays
            mine = free & (self.keys[at] == hashes)
            self.numbers[at[mine]] = number[mine]
            hashes, number, at = hashes[~mine], number[~mine], at[~mine] + np.uint64(1) & mask

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk of documents, and the number of ids of each document."""
        if not self.cut:
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return self.ids_of(texts)
        starts, ends, first = pieces(data, offsets)
        if not len(starts):
            return np.empty(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        whole = data.tobytes()
        # case matters in the names of special tokens only
        hashes = word_hashes(data, starts, ends, self.exact if b"<|" in whole else self.folded, self.powers)
        hashes[hashes == 0] = 1
        number = self.find(hashes)
        self.again[number[number >= 0]] = True
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, one = np.unique(hashes[new], return_index=True)
            if self.known + len(distinct) > self.most:
                self.thin()
                number = self.find(hashes)
                new = np.flatnonzero(number < 0)
                distinct, one = np.unique(hashes[new], return_index=True)
            if 2 * (self.known + len(distinct)) > self.slots:
                self.forget()
                distinct, one = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
                self.slots = max(self.slots, 1 << (2 * len(distinct)).bit_length())
                self.keys, self.numbers = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.int32)
            self.learn(distinct, [whole[starts[j] : ends[j]].decode("utf-8", "replace") for j in new[one].tolist()])
            number[new] = self.find(hashes[new])
        counts = self.counts[number]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.pool[ranges(self.starts[number], counts)], np.diff(total[first])


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    return np.insert(ids, np.cumsum(counts), end_id).astype(np.uint32), counts + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data stream of ranks below 2**32."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    quads = codes.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    used = np.arange(4, dtype=np.uint8)[None, :] < size[:, None]
    return control.astype(np.uint8).tobytes(), ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths) - lengths
    stream = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = stream[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = lengths > k
        if not longer.any():
            break
        out[longer] |= stream[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def frequencies(blocks: DataFrame) -> DataFrame:
    """How often each id occurs in all blocks: id, n. As long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                got = np.bincount(unpack(row["control"], row["data"], row["n_tokens"]), minlength=len(seen))
                got[: len(seen)] += seen
                seen = got
        at = np.flatnonzero(seen)
        yield pa.record_batch({"id": pa.array(at, pa.int64()), "n": pa.array(seen[at], pa.int64())})

    return blocks.select("control", "data", "n_tokens").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


#: Encoders of this process, by tokenizer file: a worker keeps its own over its tasks.
ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    if path not in ENCODERS:
        ENCODERS[path] = Encoder(path)
    return ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int = 1 << 18, range_bytes: int = 64 << 20, order: str | None = None) -> tuple[DataFrame, np.ndarray]:
    """Writes the files in ascending doc_id order, or that of the column `order`; returns their blocks and the id of each rank.

    tokenizer is the path of a tokenizer file that is on every machine: any of the tokenizers library. Texts are encoded
    once, into files whose ranks are the ids themselves; their counts, ties by id, give the ranks of the files that stay.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard, block = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch.column("text"), 4 * block_ids):
                ids, counts = with_end(*enc.encode(data, offsets), end_id)
                control, payload = pack(ids)
                yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([doc_ids[a:b].astype("<i8").tobytes()], pa.binary()), "counts": pa.array([counts.astype("<u8").tobytes()], pa.binary()), "control": pa.array([control], pa.binary()), "data": pa.array([payload], pa.binary()), "n_tokens": pa.array([len(ids)], pa.int64())})
                block += 1

    rows = docs.select((F.col(f"`{order}`") if order else order_id()).alias("at"), order_id().alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    # rows of one id, or of none, are dealt by how their texts begin
    ordered = rows.repartitionByRange(n, "at", "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("at", "doc_id", "text").select("doc_id", "text")
    plain = written(ordered.mapInArrow(encode, BLOCK), "ids")
    counted = {r["id"]: r["n"] for r in frequencies(plain).collect()}  # a row for each id of the vocabulary
    ranked = np.array(sorted(counted, key=lambda i: (-counted[i], i)), np.uint32)
    rank_of = np.zeros(int(ranked.max(initial=0)) + 1, np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pack(rank_of[unpack(*row)]) for row in zip(*(batch.column(c).to_pylist() for c in ("control", "data", "n_tokens")))]
            new = {"control": pa.array([c for c, _ in made], pa.binary()), "data": pa.array([d for _, d in made], pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    final = written(plain.mapInArrow(rerank, BLOCK), "tokens")
    discard(plain)
    return final, ranked


def read_token_files(blocks: DataFrame, ranked: np.ndarray) -> DataFrame:
    """Decodes every block: doc_id, start, n_tokens, ids_crc32. start needs the files' sums only, one row a block's file."""
    sums = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()}  # one row a file
    before, total = {}, 0
    for shard in sorted(sums):
        before[shard] = total
        total += sums[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, counts = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<u8").astype(np.int64)
                ids = ranked[unpack(row["control"], row["data"], row["n_tokens"])].astype("<u4")
                ends = np.cumsum(counts)
                whole, starts = ids.tobytes(), ends - counts
                crc = [zlib.crc32(whole[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(starts + row["before"] + before[row["shard"]], pa.int64()), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    # a file's blocks: their number is bounded by the size of the file
    places = blocks.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("before"))
    return blocks.join(places, ["shard", "block"]).select("shard", "doc_ids", "counts", "control", "data", "n_tokens", "before").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, order: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what reading them back gives, one row a document.

    A null or empty text has the end id only. Rows without a doc_id come last and have a null one; rows that repeat
    a doc_id stand next to each other, ordered by text. With the name of a column as `order`, that comes before doc_id.
    A very long text is a block of its own; other columns don't matter. An empty table gives an empty result.
    """
    blocks, ranked = write_token_files(docs, tokenizer, end_id, order=order)
    return read_token_files(blocks, ranked).withColumn("doc_id", F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
