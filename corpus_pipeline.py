"""The corpus pipeline: documents pass five stages, each written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmere.llm import line_dedup, mixing, queries, simhash_near_dedup, toxicity
from logmere.llm.common import NOT_SPACE
from logmere.session import work_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    return toxicity.accepted(docs, queries.table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that come earlier go; so does a document that had words and has none left.

    ``n_chars`` is counted anew where the text has changed.
    """
    left = line_dedup.dedup_lines(docs, least_equal=1)
    emptied = (F.col("lines_gone") > 0) & ~F.col("text").rlike(NOT_SPACE)
    return left.filter(~emptied).select(
        *(
            F.when(F.col("lines_gone") > 0, F.length("text").cast(docs.schema[c].dataType))
            .otherwise(F.col(c))
            .alias(c)
            if c == "n_chars"
            else c
            for c in docs.columns
        )
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the row with the smallest id stays; rows without an id come last."""
    return simhash_near_dedup.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture: files in the order of their names, rows as read."""
    return mixing.in_order(mixing.mix(docs, queries.TARGET_WEIGHTS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document, their digests, and its place in the mixture."""
    return queries.sentencepiece_rows(mixing.in_place(docs), positions=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece_nbest", encode_pieces),
]

#: Fitted trees, hashes of shingles and lattices can't be had in SQL; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
