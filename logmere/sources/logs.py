"""Parquet log files of the current, the older and the nanosecond layout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmere.schema import LOG_COLUMNS, LOG_SCHEMA


def read_logs(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    tolerate_corrupt: bool = False,
    with_file: bool = False,
) -> DataFrame:
    """Log rows of Parquet files or folders.

    Files written before the call site was recorded read with an empty
    ``caller``. With ``tolerate_corrupt`` unreadable files are passed over;
    ``unreadable_files`` tells which. ``with_file`` adds the path, size and row
    position each row came from.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        empty = spark.createDataFrame([], LOG_SCHEMA)
        if not with_file:
            return empty
        return empty.select(
            "*",
            F.lit("").alias("file_path"),
            F.lit(0).cast("bigint").alias("file_size"),
            F.lit(0).cast("bigint").alias("row_index"),
        )
    reader = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true")
    if tolerate_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true").option(
            "ignoreMissingFiles", "true"
        )
    rows = reader.parquet(*paths)
    columns = [F.col(name) for name in LOG_COLUMNS[:4]] + [
        F.coalesce(F.col(name), F.lit("")).alias(name) for name in LOG_COLUMNS[4:]
    ]
    if with_file:
        columns += [
            F.col("_metadata.file_path").alias("file_path"),
            F.col("_metadata.file_size").alias("file_size"),
            F.col("_metadata.row_index").alias("row_index"),
        ]
    return rows.select(*columns)


def import_nanos(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Log rows of files that hold the timestamp as nanoseconds.

    Asking for the column as a number keeps the nanosecond type readable without
    touching session settings; digits below the microsecond are cut off.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    schema = ", ".join(
        ["timestamp BIGINT"] + [f"{name} STRING" for name in LOG_COLUMNS[1:]]
    )
    nanos = F.col("timestamp")
    micros = F.call_function("div", nanos - F.pmod(nanos, F.lit(1000)), F.lit(1000))
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*paths)
    return rows.select(
        F.timestamp_micros(micros).alias("timestamp"),
        *LOG_COLUMNS[1:4],
        *[F.coalesce(F.col(n), F.lit("")).alias(n) for n in LOG_COLUMNS[4:]],
    )


def list_data_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, size_bytes, modified)`` of every Parquet file below a folder or several, unopened.

    Files of zero bytes hold nothing and are not listed.
    """
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    return listed.select(
        "path",
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )
