"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from logmere.session import work_folder

SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]"
BUCKET_DIGITS = 3
BROADCAST_ROWS = 500_000


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python tasks import this package: Spark serves an archive of it from the driver."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def checked(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written side of a join, of few numbers a row: broadcast only if it is small."""
    return F.broadcast(rows) if rows.count() <= most else rows


def text_hashes(text: Column) -> list[Column]:
    """``h1, h2``: 128 bits of a text; a null one has its own."""
    return [F.xxhash64(F.lit(salt), text).alias(name) for name, salt in (("h1", 0), ("h2", 1))]


def words(text: Column) -> Column:
    """Runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def spread(*values: Column) -> Column:
    """One of 4,096 buckets, by digest; null has a bucket too."""
    told = F.concat_ws(" ", *(F.coalesce(v.cast("string"), F.lit("")) for v in values))
    return F.substring(F.md5(told.cast("binary")), 1, BUCKET_DIGITS)


def unused(columns: list[str]) -> str:
    """A beginning of names that none of ``columns`` has."""
    mark = "_"
    while any(c.lower().startswith(mark) for c in columns):
        mark += "_"
    return mark


def numbered(rows: DataFrame, group: str, by: list[str], name: str) -> DataFrame:
    """``rows`` with their number in ``group``, from 0 without gaps, as the column ``name``.

    Order: bucket of ``by``, then ``by``. A group is never in one task: rows are numbered inside
    buckets, and the counts of the buckets (4,096 for each group at most) say where each starts. Rows
    that are equal in all of ``by`` get different numbers, in no particular order, and share a bucket:
    so ``by`` names, beside an id that many rows may share or lack, a digest of the row.
    """
    mark = unused(rows.columns)
    placed = rows.withColumn(f"{mark}bucket", spread(*map(F.col, by)))
    before = Window.partitionBy(group).orderBy(f"{mark}bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        placed.groupBy(group, f"{mark}bucket")
        .agg(F.count(F.lit(1)).alias(f"{mark}rows"))
        .select(
            F.col(group).alias(f"{mark}group"),
            F.col(f"{mark}bucket").alias(f"{mark}in"),
            F.coalesce(F.sum(f"{mark}rows").over(before), F.lit(0)).alias(f"{mark}start"),
        )
    )
    inside = Window.partitionBy(group, f"{mark}bucket").orderBy(*by)
    same = F.col(group).eqNullSafe(F.col(f"{mark}group")) & (F.col(f"{mark}bucket") == F.col(f"{mark}in"))
    return (
        placed.withColumn(f"{mark}rank", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(starts), same)
        .withColumn(name, F.col(f"{mark}start") + F.col(f"{mark}rank"))
        .drop(f"{mark}bucket", f"{mark}rank", f"{mark}group", f"{mark}in", f"{mark}start")
    )
