"""Putting row sets together and removing copies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from logmere.schema import COPY_KEY, LOG_COLUMNS


def union_sources(*sources: DataFrame) -> DataFrame:
    """Bag union of sealed and recent rows; copies stay, a missing caller is ""."""
    rows = reduce(
        lambda left, right: left.unionByName(right, allowMissingColumns=True), sources
    )
    columns = [
        F.coalesce(F.col(n), F.lit("")).alias(n) if n in ("message", "caller") else n
        for n in rows.columns
    ]
    return rows.select(*columns)


def merge_unique(logs: DataFrame, arrival: list[str]) -> DataFrame:
    """One row per time, project, logid and message: the one that arrived first.

    ``arrival`` names the columns that give the order of arrival. Level and
    caller come from the row kept. Copies are combined before the shuffle, so a
    group with very many of them is one row per task by then.
    """
    others = [name for name in LOG_COLUMNS if name not in COPY_KEY]
    first = F.min(F.struct(*arrival, *others)).alias("_first")
    return (
        logs.groupBy(*COPY_KEY)
        .agg(first)
        .select(*COPY_KEY, *[F.col("_first")[name].alias(name) for name in others])
        .select(*LOG_COLUMNS)
    )


def merge_unique_stream(logs: DataFrame, forget_after: str = "1 hour") -> DataFrame:
    """The rows of a stream without later copies, in append mode.

    Keys are kept as state and forgotten ``forget_after`` they were last needed by the clock of the
    batches, not by the times of the rows: however late or shuffled these are, a row that is nobody's
    copy is never dropped. A copy that comes after its key was forgotten passes. Of copies in one batch
    the first of a source partition stays.
    """
    seen = logs.withColumn("_batch_time", F.current_timestamp())
    return (
        seen.withWatermark("_batch_time", forget_after)
        .dropDuplicatesWithinWatermark(COPY_KEY)
        .drop("_batch_time")
    )
