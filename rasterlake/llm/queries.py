"""The operators as registered queries: each reads its whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .decontaminate import find_leaks
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language_id import predict, train
from .license_scan import license_scan
from .mixing import mix
from .sharding import founded, grown, place
from .substring_dedup import substring_dedup
from .suffix_dedup import suffix_dedup
from .token_files import token_files, vocabulary

REGIONS, RACKS, SHARDS = 2, 4, 5
VOCABULARY, END_ID = "word_bpe_49k.json", 2


def held_out(docs: DataFrame):
    """Documents whose crc32(doc_id as text) mod 4 is 2: none of them is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents")).drop("kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    docs = docs.withColumn("held_out", held_out(docs))
    dictionaries = train(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()).select("text", "lang"))
    return predict(docs, dictionaries, ["doc_id", "held_out"])


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"), n=3, percent=90)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(read(spark, sf_dir, "documents"), vocabulary(VOCABULARY), END_ID)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = founded(REGIONS, RACKS, SHARDS)
    return place(read(spark, sf_dir, "documents"), tree, grown(tree))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"), ["doc_id", "source"]).select("doc_id", "size", "source_size", "target", "taken", "source")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_exact_dedup, op2_suffix_dedup, op3_language_id, op4_jaccard_join, op5_license_scan, op6_decontaminate, op7_token_files, op8_sharding, op9_mixing, op10_substring_dedup)
}

#: Where DuckDB can express the result on whole tables.
ORACLES = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
        k AS (SELECT text_sha256, count(*)::BIGINT AS group_size, (array_agg(doc_id ORDER BY chars DESC, doc_id))[1] AS keep_id FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN k USING (text_sha256)""",
}
