"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of its own text. A text is compressed in blocks with every
language's dictionary, and the language with the smallest total wins; where the two smallest totals are closer than a
margin, the text is rejected. Blocks keep a long text from becoming its own dictionary.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, utf8

UNDETERMINED = "und"


def train(labelled: DataFrame, docs_per_language: int = 64, excerpt: int = 256) -> dict[str, bytes]:
    """A dictionary for every label of labelled (text, lang).

    The sample is bounded in rows: at most docs_per_language texts a label, those with the smallest hashes. Copies of a
    text count once, and a text with several labels counts for each. The sample's whole texts are read: each gives the
    dictionary the passage of `excerpt` characters whose runs of letters stand in the most texts of the sample. Rows
    without a label, and null, empty or letterless texts teach nothing, so a label that has no others is not learned; no
    label is left out for being rare, and no dictionary is cut to another's length. An empty table gives no dictionary.
    """
    texts = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    counts = texts.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # a row a label
    if not counts:
        return {}
    # about twice the texts that are wanted, or all; of these, exactly the smallest hashes
    chance = [(r["lang"], min(1.0, 2.0 * docs_per_language / max(1, r["n"]))) for r in counts]
    chance = labelled.sparkSession.createDataFrame(chance, "lang string, chance double")
    draw = F.pmod("h", F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    chosen = texts.join(F.broadcast(chance), "lang").where(draw < F.col("chance")).select("lang", "h", "text").dropDuplicates(["lang", "h"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 52)), "h"))
    sample = chosen.withColumn("place", place).where(F.col("place") <= docs_per_language)

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        made = dictionary([letters(t.encode()).decode("utf-8", "replace") for t in pdf.sort_values("place")["text"]], excerpt)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "content": [made.encode()]})

    learned = sample.groupBy("lang").applyInPandas(learn, "lang string, content binary").collect()  # a row a label, of bounded size
    return {r["lang"]: bytes(r["content"]) for r in sorted(learned, key=lambda r: r["lang"]) if r["content"]}


def dictionary(texts: list[str], excerpt: int, run: int = 6, bits: int = 18) -> str:
    """A passage of each text, the best one last: that whose runs of `run` characters stand in the most texts, runs of
    passages chosen before not counting. Runs are told apart by `bits` bits of a hash."""
    runs, seen = [], np.zeros(1 << bits, np.int64)
    for text in texts:
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        h = np.zeros(max(0, len(points) - run + 1), np.uint64)
        for k in range(run):
            h = h * np.uint64(1_000_003) + points[k : k + len(h)]
        runs.append((mix(h) >> np.uint64(64 - bits)).astype(np.int64))
        seen[np.unique(runs[-1])] += 1
    made = []
    for text, h in zip(texts, runs):
        width = max(1, excerpt - run + 1)
        at, best = 0, 0
        if len(h) > width:
            total = np.concatenate([[0], np.cumsum(np.maximum(0, seen[h] - 1))])
            score = total[width:] - total[:-width]
            at = int(np.argmax(score))
            best = int(score[at])
        seen[h[at : at + width]] = 0
        made.append((best, text[at : at + excerpt]))
    return " ".join(passage for _, passage in sorted(made, key=lambda x: x[0]))


#: A-Z become a-z; other ASCII that is no letter becomes a space.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


#: What stands before a text of fewer bytes: zstandard stores a block as it is unless that saves a few bytes, and a short text alone never does.
PAD, SHORT = bytes(64), 512
#: One of still fewer counts eight times, before runs of letters that make its block worth compressing: whole bytes of one total tell too little.
TINY, RUNS = 128, [bytes([c]) for c in b"abcdefgh"]


def letters(text: bytes) -> bytes:
    return b" ".join(text.translate(LETTERS).split())


class Classifier:
    """Short matches and a lazy parser: languages differ in syllables, which the usual levels pass over.

    A larger dictionary would win by its size. So the total of a language whose dictionary has fewer characters than the
    others' is scaled by what the missing text is worth on this very text to a language that it is not in: the full
    total of the second best of the complete dictionaries over its total when cut to the short one's length. One too
    short to tell anything (zstandard ignores less than 8 bytes) thus equals the second best, and never wins.

    More than `held` languages go in blocks of that many, one after the other over some texts: a compressor takes
    over a megabyte.
    """

    def __init__(self, dictionaries: dict[str, bytes], block: int = 8192, held: int = 64):
        import zstandard

        self.block, self.held, self.made = block, held, {}
        self.how = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=16, search_log=5, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        chars = {lang: len(d.decode("utf-8", "replace")) for lang, d in dictionaries.items()}
        longest = max(chars.values())
        # lengths in steps of a half octave, upwards: few totals are needed
        short = {lang: math.ceil(2 ** (math.ceil(2 * math.log2(n)) / 2)) for lang, n in chars.items() if n < longest * 15 / 16}
        # complete ones come first, and so win ties
        self.languages, self.dictionaries = sorted(dictionaries, key=lambda x: (x in short, x)), dictionaries
        self.complete, self.chars = len(dictionaries) - len(short), short
        self.compressors = self.loaded(0) if len(self.languages) <= held else None

    def loaded(self, at: int) -> list:
        """The compressors of a block of languages."""
        return [self.compressor(self.dictionaries[lang]) for lang in self.languages[at : at + self.held]]

    def compressor(self, dictionary: bytes):
        import zstandard

        d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=self.how)
        return zstandard.ZstdCompressor(dict_data=d, compression_params=self.how)

    def cut(self, lang: str, chars: int):
        """A compressor with lang's first so many characters; some are held."""
        if (lang, chars) not in self.made:
            if len(self.made) >= self.held:
                self.made.pop(next(iter(self.made)))
            self.made[lang, chars] = self.compressor(self.dictionaries[lang].decode("utf-8", "replace")[:chars].encode())
        return self.made[lang, chars]

    def parts(self, text: bytes) -> list[bytes]:
        text = letters(text)
        if len(text) < TINY:
            return [PAD + text + b" " + 24 * c for c in RUNS]
        if len(text) < SHORT:
            text = PAD + text
        return [text[i : i + self.block] for i in range(0, len(text), self.block)]

    def sizes(self, texts: list[bytes]) -> list[list[float]]:
        """Each text's totals, language by language; a tiny text's is the mean of its eight."""
        parts = [self.parts(text) for text in texts]
        totals: list[list[float]] = [[] for _ in texts]
        for at in range(0, len(self.languages), self.held):
            compressors = self.compressors or self.loaded(at)
            for p, t in zip(parts, totals):
                t += [sum(len(c.compress(x)) for x in p) / self.times(p) for c in compressors]
        return [self.fair(p, t) for p, t in zip(parts, totals)]

    @staticmethod
    def times(parts: list[bytes]) -> int:
        """How often parts hold their text."""
        return len(RUNS) if len(parts) == len(RUNS) and parts[0].endswith(24 * RUNS[0]) else 1

    def fair(self, parts: list[bytes], sizes: list[int]) -> list[float]:
        """Totals as if all dictionaries were complete."""
        if len(sizes) == self.complete or self.complete < 2:
            return sizes
        second = sorted(range(self.complete), key=lambda i: sizes[i])[1]
        full = sizes[second] * self.times(parts)
        worth = {n: full / sum(len(self.cut(self.languages[second], n).compress(p)) for p in parts) for n in set(self.chars.values())}
        return sizes[: self.complete] + [s * min(1.0, worth[self.chars[lang]]) for lang, s in zip(self.languages[self.complete :], sizes[self.complete :])]

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, float]]:
        """Of each text: the best language, its probability 2**-bytes tempered by 4, and the relative margin to the second."""
        return [self.told(sizes) for sizes in self.sizes(texts)]

    def told(self, sizes: list[float]) -> tuple[str, float, float]:
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
        best = sizes[order[0]]
        score = 1.0 / sum(2.0 ** -min(1000.0, (s - best) / 4) for s in sizes)
        margin = (sizes[order[1]] - best) / sizes[order[1]] if len(order) > 1 else 1.0
        return self.languages[order[0]], score, margin


PREDICTED = "lang_pred string, score double, margin double, rejected boolean"


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], min_margin: float = 0.001) -> DataFrame:
    """docs' columns `keep`, and lang_pred, score, margin, rejected.

    The text alone decides, so repeated rows have equal results. A null or empty text, one without a letter, or any text
    where no language was learned is `und` with score 0 and rejected; so is, with its best language and score, a text
    whose margin between the smallest and the second total is not above min_margin. Of languages with equal totals the
    first by name wins, those with a complete dictionary before others. A long text is compressed whole, in blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter, model = regex.compile(r"\p{L}"), Classifier(dictionaries) if dictionaries else None
        for batch in batches:
            data, offsets = utf8(batch.column("_text"))
            whole, spans = data.tobytes(), list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
            rows = [(UNDETERMINED, 0.0, 0.0, True)] * len(spans)
            told = [i for i, (a, b) in enumerate(spans) if model and letter.search(whole[a:b].decode("utf-8", "replace"))]
            # blocks of languages are loaded anew for each lot of texts
            step = 1 if model and model.compressors else 1024
            for at in range(0, len(told), step):
                some = told[at : at + step]
                for i, (lang, score, margin) in zip(some, model.predict([whole[slice(*spans[i])] for i in some])):
                    rows[i] = (lang, score, margin, margin <= min_margin)
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            n = len(keep)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(n)] + made, names=[*keep, "lang_pred", "score", "margin", "rejected"])

    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("_text"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[: len(keep)])
    return given.mapInArrow(run, head + PREDICTED)
