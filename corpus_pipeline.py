"""A training corpus from raw documents: language ID, near copies, benchmark leaks, source mix, token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import bounded, order_id, read, shared_folder
from rasterlake.llm.decontaminate import decontaminate
from rasterlake.llm.jaccard_join import first_of_components
from rasterlake.llm.language_id import predict, train
from rasterlake.llm.mixing import mixed
from rasterlake.llm.queries import END_ID, VOCABULARY, held_out
from rasterlake.llm.token_files import token_files, vocabulary

#: Of an Arrow batch. Executors outlive the stages, and what their JVM and workers have taken for batches stays with them.
BATCH_BYTES = 4 << 20


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(stage)
    def made(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(bounded(spark, BATCH_BYTES), docs, sf_dir)

    return made


@small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without a letter or whose two best languages tie go. lang stays as it was."""
    dictionaries = train(docs.where(~held_out(docs) & F.col("doc_id").isNotNull()).select("text", "lang"))
    return predict(docs, dictionaries, docs.columns, min_margin=0.0).where(~F.col("rejected")).select(*docs.columns)


@small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by shingles of five words and a similarity of 0.8: the smallest doc_id, once.

    A null doc_id comes after all others; of rows that share an id, or have none, the one with the smallest text hash stays,
    and of repeated rows one. Null texts and texts without words have no copies: each stays, once for each id.
    """
    kept = first_of_components(docs, n=5, percent=80)
    rows = docs.select(order_id().alias("id"), F.xxhash64("text").alias("hash"), F.struct(*docs.columns).alias("row"))
    rows = rows.join(kept, ["id", "hash"])
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy("id", "hash").orderBy("id"))).where("n = 1")
    return once.select("row.*")


@small_batches
def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as words or with other numbers and names. Null and empty texts hold none and
    stay; rows with equal ids and texts stay or go together; an empty benchmark leaves all."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


@small_batches
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A copy of each document for each pass of its source's stream that takes half of it or more, in the order of the slots.

    Documents without words (null and empty texts) have no part in a mix by words and go. Rows without a source are the
    last source. Repeated rows have places of their own; ties of the shuffle go by doc_id and text.
    """
    half = F.filter("passes", lambda p: p["words"] * 2 >= F.col("size"))
    taken = mixed(docs, docs.columns).where("taken > 0").select("row", F.explode(half).alias("pass"))
    return taken.repartitionByRange("pass.slot").sortWithinPartitions("pass.slot").select("row.*")


@small_batches
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows, as read back, in a shuffled order that keeps the mix: by a hash of doc_id, text and copy, so that
    every stretch of the files has the sources' shares and a document's copies stand apart.

    Null and empty texts have the end id only; null ids are hashed as the largest; the order of repeated rows is that of
    their copy numbers.
    """
    copy = F.row_number().over(Window.partitionBy("id", "hash").orderBy("id")).cast("long")
    rows = docs.select("doc_id", order_id().alias("id"), F.xxhash64("text").alias("hash"), "text").withColumn("copy", copy)
    return token_files(rows.withColumn("at", F.xxhash64("id", "hash", "copy")), vocabulary(VOCABULARY), END_ID, order="at")


STAGES = [("language_id", language_id), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("source_mix", source_mix), ("tokens", tokens)]

#: Compression sizes, component search and tokens have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
