"""One query for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmere.llm import (
    license_scans,
    line_dedup,
    merkle_manifest,
    mixing,
    nearest_neighbours,
    quality_rules,
    sentencepiece_nbest,
    sharding,
    simhash_near_dedup,
    toxicity,
    url_filters,
    vector_codes,
    word_bpe,
)
from logmere.llm.url_filters import ALLOW, BLOCK, Rule

REGISTRY: dict = {}

#: Parts of the mixture; sources that aren't named share one part.
TARGET_WEIGHTS = {
    **{"src0": 12, "src1": 6, "src2": 6, "src3": 4, "src4": 4},
    **{f"src{k}": 2 for k in range(5, 20)},
}

URL_RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def query(make):
    """Register under the function's name."""
    REGISTRY[make.__name__] = make
    return make


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "quality",
    )


@query
def op8_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash_near_dedup.near_duplicates(table(spark, folder, "documents"), wide=True)
    return found.select(
        "doc_id", simhash_near_dedup.hex_of(F.col("fp")).alias("fingerprint"), "component_id"
    )


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, folder, "documents"), least_equal=1)
    return kept.select(
        "doc_id",
        "lines_gone",
        F.length("text").cast("long").alias("chars_left"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), TARGET_WEIGHTS)
    return mixed.select("doc_id", "source", "position")


@query
def op1_sentencepiece_nbest(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_rows(table(spark, folder, "documents"))


def sentencepiece_rows(docs: DataFrame, positions: bool = False) -> DataFrame:
    """Digests of the best ids, the scores of the best paths, and the checksum of the decoded text.

    With ``positions`` also the column ``position`` of ``docs`` and the ids themselves.
    """
    decoded = sentencepiece_nbest.encode(
        docs, decoded=True, keep=["position"] if positions else []
    )
    return decoded.select(
        F.col("id").alias("doc_id"),
        *(["position"] if positions else []),
        F.size("ids").cast("long").alias("n_pieces"),
        *(["ids"] if positions else []),
        F.xxhash64("ids").alias("ids_hash"),
        "score",
        F.transform("others", lambda x: x["score"]).alias("next_scores"),
        F.crc32(F.col("text").cast("binary")).alias("decoded_crc32"),
    )


@query
def op9_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return license_scans.summary(license_scans.scan(table(spark, folder, "documents")))


@query
def op7_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return url_filters.judge(table(spark, folder, "pages"), URL_RULES)


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours.nearest(table(spark, folder, "embeddings"))


@query
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.summary(table(spark, folder, "embeddings"))


@query
def op12_word_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the ids and of the text that they decode to."""
    both = word_bpe.encoded_and_decoded(table(spark, folder, "documents"))
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.audited(table(spark, folder, "documents"))
