"""The topic: raw records in, encoded records out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmere.functions.clock import wall_of
from logmere.schema import LOG_COLUMNS

# Fixed value: wire form of the timestamp.
WIRE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"

# The key of a record is its project, so one topic partition may hold most of the
# records; a task reads at most this many of them.
RECORDS_PER_TASK = 500_000


def read_wire(
    spark: SparkSession,
    source: str,
    *,
    stream: bool = True,
    topic: str | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Raw records as ``WIRE_SCHEMA``, from the earliest one on.

    With ``topic``, ``source`` is a list of Kafka brokers; otherwise it is a
    folder of text files holding one record per line. ``received_at`` is the
    arrival time recorded by the source, so it survives a replay.
    """
    reader = spark.readStream if stream else spark.read
    if topic is not None:
        records = (
            reader.format("kafka")
            .option("kafka.bootstrap.servers", source)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
            .option("maxRecordsPerPartition", str(RECORDS_PER_TASK))
            .options(**(options or {}))
            .load()
        )
        return records.select(
            F.col("topic").alias("source"),
            "partition",
            "offset",
            F.col("timestamp").alias("received_at"),
            F.col("value").cast("string").alias("value"),
        )
    lines = reader.format("text").option("lineSep", "\n").options(**(options or {}))
    return lines.load(source).select(
        F.col("_metadata.file_path").alias("source"),
        F.lit(None).cast("int").alias("partition"),
        F.lit(None).cast("bigint").alias("offset"),
        F.col("_metadata.file_modification_time").alias("received_at"),
        "value",
    )


def encode(logs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Log rows to ``key`` (the project) and ``value`` (JSON of all six fields).

    ``keep`` names further columns to carry along.
    """
    fields = [wall_of(logs).alias("timestamp")] + [
        F.coalesce(F.col(name), F.lit("")).alias(name) for name in LOG_COLUMNS[1:]
    ]
    value = F.to_json(F.struct(*fields), {"timestampNTZFormat": WIRE_TIME})
    return logs.select(*keep, F.col("project").alias("key"), value.alias("value"))


def write_wire(records: DataFrame, target: str, *, topic: str | None = None) -> None:
    """Send encoded records to Kafka, or to text files, one record per line."""
    if topic is not None:
        (
            records.write.format("kafka")
            .option("kafka.bootstrap.servers", target)
            .option("topic", topic)
            .save()
        )
        return
    records.select("value").write.mode("append").text(target)
