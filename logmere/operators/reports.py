"""Reports over log rows: volume, reconciliation, age, and derived columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from logmere.functions.callers import split_caller
from logmere.functions.clock import epoch_micros, micros_of, wall_of
from logmere.functions.levels import level_ordinal
from logmere.functions.logids import logid_minute
from logmere.functions.sizes import row_bytes

_SECOND_US = 1_000_000
# Age units with their length in seconds, longest first.
AGE_UNITS = [("d", 86_400), ("h", 3_600), ("m", 60)]


def volume(logs: DataFrame) -> DataFrame:
    """Rows and estimated bytes per project, UTC day and level."""
    return logs.groupBy(
        "project", F.to_date(wall_of(logs)).alias("day"), "level"
    ).agg(F.count(F.lit(1)).alias("rows"), F.sum(row_bytes()).alias("bytes"))


def tally(logs: DataFrame) -> DataFrame:
    """``(kind, name, got)``: rows per project, per logid, and in total."""
    counts = logs.groupBy("project", "logid").agg(F.count(F.lit(1)).alias("n"))
    named = F.explode(
        F.array(
            F.struct(F.lit("project").alias("kind"), F.col("project").alias("name")),
            F.struct(F.lit("logid").alias("kind"), F.col("logid").alias("name")),
            F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")),
        )
    )
    return (
        counts.select("n", named.alias("key"))
        .groupBy(F.col("key.kind").alias("kind"), F.col("key.name").alias("name"))
        .agg(F.sum("n").alias("got"))
    )


def reconcile(logs: DataFrame, expected: DataFrame) -> DataFrame:
    """Compare counts with ``expected (kind, name, want)``.

    Kinds are project, logid and total (with an empty name). A row is ``short``
    when fewer arrived than wanted; names that nobody expected want 0.
    """
    joined = tally(logs).join(expected, ["kind", "name"], "full_outer")
    got, want = (F.coalesce(n, F.lit(0)).cast("bigint") for n in ("got", "want"))
    return joined.select(
        "kind", "name", want.alias("want"), got.alias("got"), (got < want).alias("short")
    )


def even_shares(projects: list[str], logids: list[str], sent: int) -> list[tuple]:
    """Expected minimum counts for events spread evenly over projects and logids."""
    share = sent // len(projects)
    rows = [("project", name, share) for name in projects]
    rows += [("logid", name, sent // len(logids)) for name in logids]
    return rows + [("total", "", share * len(projects))]


def age_histogram(logs: DataFrame, now: datetime) -> DataFrame:
    """Rows per project and age, as ``age`` whole units of s, m, h or d.

    Times after ``now`` count as 0 s.
    """
    micros = F.greatest(F.lit(epoch_micros(now)) - micros_of(logs), F.lit(0))
    seconds = F.call_function("div", micros, F.lit(_SECOND_US))

    def whole(length: int):
        return F.call_function("div", seconds, F.lit(length).cast("bigint"))

    unit = F.when(seconds >= AGE_UNITS[0][1], AGE_UNITS[0][0])
    age = F.when(seconds >= AGE_UNITS[0][1], whole(AGE_UNITS[0][1]))
    for name, length in AGE_UNITS[1:]:
        unit = unit.when(seconds >= length, name)
        age = age.when(seconds >= length, whole(length))
    return logs.groupBy(
        "project", unit.otherwise("s").alias("unit"), age.otherwise(seconds).alias("age")
    ).agg(F.count(F.lit(1)).alias("rows"))


def enrich(logs: DataFrame) -> DataFrame:
    """Add the severity ordinal, the minute in the logid, and the call site parts."""
    site = split_caller(F.col("caller"))
    return logs.select(
        "*",
        level_ordinal(F.col("level")).alias("level_no"),
        logid_minute(F.col("logid")).alias("logid_minute"),
        site["file"].alias("caller_file"),
        site["line"].alias("caller_line"),
    )
