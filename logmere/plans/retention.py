"""Which files have outlived their keep time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from logmere.functions.clock import ZERO_TIME, is_wall, moment_literal
from logmere.operators.manifest import without

# Fixed value: keep time when none is given.
DEFAULT_TTL = timedelta(days=14)


def plan_retention(
    manifest: DataFrame,
    now: datetime,
    ttl: timedelta = DEFAULT_TTL,
    active: Sequence[str] = (),
) -> DataFrame:
    """Manifest rows of the files to delete.

    A file goes when its newest row is as old as the keep time or older. Files
    being written, and files whose end is not known, stay. A keep time of zero
    or less turns retention off.
    """
    if ttl <= timedelta(0):
        return manifest.filter(F.lit(False))
    wall = is_wall(manifest, "ended")
    ended = F.col("ended")
    return without(manifest, active).filter(
        (ended <= moment_literal(now - ttl, wall))
        & (ended != moment_literal(ZERO_TIME, wall))
    )


def retention_summary(manifest: DataFrame, plan: DataFrame) -> DataFrame:
    """``(scanned, deleted, skipped, bytes_freed)``.

    Entries whose end could not be read (null) are skipped. A zero end keeps the
    file too, but is not counted as skipped.
    """
    names = ["scanned", "deleted", "skipped", "bytes_freed"]

    def facts(**given):
        return [given.get(n, F.lit(0)).cast("bigint").alias(n) for n in names]

    one = F.lit(1)
    seen = manifest.select(*facts(scanned=one, skipped=F.col("ended").isNull().cast("int")))
    gone = plan.select(*facts(deleted=one, bytes_freed=F.col("size_bytes")))
    return seen.unionByName(gone).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]
    )
