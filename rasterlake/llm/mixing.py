"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of equal-token slots. Slot i belongs to the source whose interval of cumulative target weights
holds the golden-ratio point frac(i * phi), so that every prefix of the mix is close to the targets. The slots of a
source are ranked. A source's documents, shuffled by hash, form a stream of words that begins again where it ends, and
is cut into blocks of a slot's length: block r is joined to the source's slot of rank r. A document stands in the blocks
that its words touch, once for each time the stream passes it, and the mix takes those of its words whose block has a
slot.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import order_id, written

#: The fractional part of the golden ratio.
PHI = 0.6180339887498949
#: Sources in order of name have these weights in turn.
WEIGHTS = (5.0, 2.0, 1.0)
#: Rows of a part of a shuffled stream, and slots of a part of the schedule: what a task sorts.
PART = 1 << 13


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0) -> dict[str | None, float]:
    """Words of each source: shares of all words by weight, at most `most` times the source's words; what is above is shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in fixed]
        left, by = total - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: left * weight[s] / by for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {s: fixed[s] if s in fixed else share[s] for s in names}
        fixed |= {s: most * sizes[s] for s in over}


def schedule(spark, target: dict[str | None, float], slots: int) -> DataFrame:
    """slot, number (the source's place in target), rank: whose slot it is, by golden-ratio points, and how many slots the
    source has before it. Ranks are counted in runs of slots, and the runs' counts place the runs."""
    total, upto, bounds = sum(target.values()), 0.0, []
    for s in target:
        upto += target[s]
        bounds.append(upto / total if total else 0.0)
    point = F.col("id") * F.lit(PHI) - F.floor(F.col("id") * F.lit(PHI))
    # the number of bounds at or below the point, of which the last never counts
    number = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[:-1]]).cast("array<double>"), lambda b: b <= point))
    dealt = spark.range(slots).select(F.col("id").alias("slot"), number.alias("number"), F.floor(F.col("id") / PART).alias("run"))
    counts = dealt.groupBy("number", "run").agg(F.count("*").alias("n"))  # a row for each run and source
    before = counts.select("number", "run", (F.sum("n").over(Window.partitionBy("number").orderBy("run")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("number", "run").orderBy("slot")) - 1
    return dealt.withColumn("within", within).join(before, ["number", "run"]).select("slot", "number", (F.col("before") + F.col("within")).alias("rank"))


def streams(keyed: DataFrame, counts: dict[int, int]) -> DataFrame:
    """keyed (uid, number, size, hash, id, check) and start: the words of its source before it, in the order of the shuffle.
    A source's stream is cut by hash into parts of about PART rows; the parts' sums place the parts."""
    parts = [max(1, -(-n // PART)) for _, n in sorted(counts.items())]
    # a hash's upper 32 bits as a fraction of a source's parts
    many = F.array(*[F.lit(p) for p in parts])[F.col("number")].cast("long")
    part = F.shiftright(F.shiftrightunsigned("hash", 32) * many, 32)
    rows = keyed.withColumn("part", part)
    sums = rows.groupBy("number", "part").agg(F.sum("size").alias("words"))
    before = sums.select("number", "part", (F.sum("words").over(Window.partitionBy("number").orderBy("part")) - F.col("words")).alias("before"))
    unsigned = F.shiftrightunsigned("hash", 1)
    within = F.sum("size").over(Window.partitionBy("number", "part").orderBy(unsigned, "hash", "id", "check").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return rows.withColumn("within", within).join(before, ["number", "part"]).withColumn("start", F.col("before") + F.col("within")).drop("within", "before", "part")


def mixed(docs: DataFrame, carry: list[str], weights: tuple[float, ...] = WEIGHTS, most: float = 3.0, max_slots: int = 1 << 20, seed: str = "mix") -> DataFrame:
    """What the mix takes of each document: row (a struct of docs' columns `carry`), size, source_size, target, taken (words),
    first_slot (the first slot with words of it, null if there is none), passes (slot and words of each pass of the
    stream that takes some of it, in order; null if there is none).

    A slot is ceil(all words / max_slots) words long. A source's slots take its stream from the beginning, and again
    where it ends, but never more than `most` times; so no document is above `most` times its size. Rows without a
    source are a source of their own, the last; a null text has no words, and nothing is taken of it; ties of the shuffle
    go by doc_id and text, so reruns agree; repeated rows have places of their own. An empty table gives an empty
    result. Rows are written once, with their sizes; the number of sources is that of a table's labels: their sums are
    gathered on the driver.
    """
    spark = docs.sparkSession
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")
    label = F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))
    row, check = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.xxhash64("text")
    rows = docs.select(row, size.alias("size"), label.alias("src"), order_id().alias("id"), check.alias("check"), F.monotonically_increasing_id().alias("uid"))
    rows = written(rows, "sizes")
    got = rows.groupBy("src").agg(F.sum("size").alias("words"), F.count("*").alias("n")).collect()  # a row a source
    names = {r["src"][1:] if r["src"] != "0" else None: r for r in got}
    target = targets({s: int(r["words"]) for s, r in names.items()}, weights, most) if names else {}
    total = int(sum(r["words"] for r in got))
    length = max(1, math.ceil(total / max_slots))
    plan = [("0" if s is None else "1" + s, i, int(names[s]["words"]), target[s], math.floor(most * names[s]["words"])) for i, s in enumerate(target)]
    sources = spark.createDataFrame(plan, "src string, number int, source_size long, target double, most long")
    keyed = rows.select("uid", "src", "size", "id", "check", F.xxhash64("id", "check", F.lit(seed)).alias("hash")).join(F.broadcast(sources), "src")  # a row a source
    stream = streams(keyed, {i: int(names[s]["n"]) for i, s in enumerate(target)}) if plan else keyed.withColumn("start", F.lit(0).cast("long"))
    # each pass over a document: its words in the repeated stream, and the blocks that they touch
    at = F.col("start") + F.col("pass") * F.col("source_size")
    passes = stream.where("size > 0").select("uid", "number", "size", "most", "start", "source_size", F.explode(F.sequence(F.lit(0), F.lit(math.ceil(most) - 1))).alias("pass"))
    passes = passes.select("uid", "pass", "number", at.alias("low"), F.least(at + F.col("size"), F.col("most")).alias("high")).where("low < high")
    cut = F.lit(length)
    touched = passes.select("uid", "pass", "number", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / cut), F.floor((F.col("high") - 1) / cut))).alias("rank"))
    words = F.least("high", (F.col("rank") + 1) * cut) - F.greatest("low", F.col("rank") * cut)
    blocks = touched.select("uid", "pass", "number", "rank", words.alias("words"))
    slots = schedule(spark, target, math.ceil(total / length))
    got = blocks.join(slots, ["number", "rank"]).groupBy("uid", "pass").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    # `most` passes at most
    taken = got.groupBy("uid").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.sort_array(F.collect_list(F.struct("slot", "words"))).alias("passes"))
    out = rows.join(F.broadcast(sources), "src").join(taken, "uid", "left")
    return out.select("row", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", "passes")


def mix(docs: DataFrame, carry: list[str] | None = None, **options) -> DataFrame:
    """docs' columns (or those in carry), but for any of these names, with size, source_size, target, taken and first_slot: see mixed."""
    made = ("size", "source_size", "target", "taken", "first_slot")
    names = [c for c in carry or docs.columns if c not in made]
    return mixed(docs, names, **options).select(*[F.col("row").getField(c).alias(c) for c in names], *made)
