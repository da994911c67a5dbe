"""The shared event stream of the test tables, seen as log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmere.functions.clock import instant_from_wall
from logmere.schema import LOG_COLUMNS


def events_as_logs(
    spark: SparkSession, folder: str, *, instants: bool = False, keep_id: bool = False
) -> DataFrame:
    """Log rows made from ``events``, the time zone-less unless ``instants``.

    The zone-less form renames the stored column, so time filters still reach
    the scan. ``keep_id`` keeps ``event_id``, the arrival order.
    """
    events = spark.read.parquet(f"{folder}/events.parquet")
    user, kind, number = F.col("user_id"), F.col("event_type"), F.col("event_id")
    project = (
        F.when(user % 3 == 0, "freight-service")
        .when(user % 3 == 1, "gate-service")
        .otherwise("exports-service")
    )
    level = (
        F.when((kind == "error") & (number % 10 == 0), "FATAL")
        .when(kind == "error", "ERROR")
        .when(kind == "purchase", "WARN")
        .when(kind == "view", "DEBUG")
        .otherwise("INFO")
    )
    caller = F.when(number % 10 == 7, "").otherwise(
        F.concat(F.lit("handler.go:"), (user + 1).cast("string"))
    )
    moment = instant_from_wall(F.col("ts")) if instants else F.col("ts")
    logs = events.select(
        "event_id",
        moment.alias("timestamp"),
        project.alias("project"),
        F.concat(F.lit("run-"), F.lpad(user.cast("string"), 4, "0")).alias("logid"),
        level.alias("level"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("message"),
        caller.alias("caller"),
    )
    return logs if keep_id else logs.select(*LOG_COLUMNS)
