"""The manifest: one row of facts per log file, and what can be answered from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from logmere.functions.clock import is_wall, micros_of, moment_literal
from logmere.plans.query import LogQuery
from logmere.schema import MANIFEST_COLUMNS

# Parts into which the time ranges of files are dealt when a page is looked for among them.
BUCKETS = 4096


def distinct_projects(project: Column) -> Column:
    """Aggregate: sorted distinct project names without empty ones."""
    return F.sort_array(F.collect_set(F.nullif(project, F.lit(""))))


def build_manifest(
    rows: DataFrame,
    file: Column,
    size_bytes: Column,
    together: Callable[[str], Column] = F.max,
) -> DataFrame:
    """Facts per file: time range, rows, projects, bytes, rows of each project.

    ``size_bytes`` is an aggregate over the rows of a file, such as the maximum of the file size
    found on each; ``together`` makes one of those of a file's projects. Of the log columns only time
    and project are read.
    """
    named = F.col("project").isNotNull() & (F.col("project") != "")
    counted = F.when(named, F.struct("project", "row_count"))
    return (
        rows.groupBy(file.alias("file"), "project")
        .agg(
            F.min("timestamp").alias("started"),
            F.max("timestamp").alias("ended"),
            F.count(F.lit(1)).alias("row_count"),
            size_bytes.alias("size_bytes"),
        )
        .groupBy("file")
        .agg(
            F.min("started").alias("started"),
            F.max("ended").alias("ended"),
            distinct_projects(F.col("project")).alias("projects"),
            together("size_bytes").alias("size_bytes"),
            F.map_from_entries(F.sort_array(F.collect_list(counted))).alias("project_rows"),
            F.sum("row_count").alias("row_count"),
        )
        .select(*MANIFEST_COLUMNS)
    )


def prune_files(manifest: DataFrame, query: LogQuery) -> DataFrame:
    """Files that may hold matches: by project and time; logid and level do not prune."""
    wall = is_wall(manifest, "started")
    if query.project:
        manifest = manifest.filter(F.array_contains("projects", query.project))
    start, end = query.window
    if start is not None:
        manifest = manifest.filter(F.col("ended") >= moment_literal(start, wall))
    if end is not None:
        manifest = manifest.filter(F.col("started") <= moment_literal(end, wall))
    return manifest


def _certain(query: LogQuery, wall: bool) -> Column:
    """The matching rows of a file whose number is known without reading it, else null.

    It is known if the file lies wholly in the time window and nothing but project and time is asked.
    """
    if query.logid or query.level:
        return F.lit(None).cast("bigint")
    rows = F.col("row_count")
    if query.project:
        held = F.coalesce(F.try_element_at("project_rows", F.lit(query.project)), F.lit(0))
        rows = F.when(F.col("project_rows").isNotNull(), held)
    start, end = query.window
    if start is not None:
        rows = F.when(F.col("started") >= moment_literal(start, wall), rows)
    if end is not None:
        rows = F.when(F.col("ended") <= moment_literal(end, wall), rows)
    return rows


def counted_files(manifest: DataFrame, query: LogQuery) -> DataFrame:
    """The files that may hold matches, with ``certain``: how many, where the manifest tells."""
    files = prune_files(manifest, query)
    return files.withColumn("certain", _certain(query, is_wall(manifest, "started")))


def near_page(files: DataFrame, query: LogQuery, offset: int, limit: int) -> tuple[DataFrame, int]:
    """Those of the ``counted_files`` in which the rows ``offset`` to ``offset + limit`` are, with
    files that must be read to count what comes before; and how many rows the others before have.

    The files' time ranges are dealt into ``BUCKETS`` of equal width. Files that end before a bucket
    does are sure to have their rows before its end; rows before its start are only in files that
    start before it. That bounds the page on both sides.
    """
    if query.newest_first:
        ends = {"low": -micros_of(files, "ended"), "high": -micros_of(files, "started")}
    else:
        ends = {"low": micros_of(files, "started"), "high": micros_of(files, "ended")}
    ranged = files.withColumns(ends)
    span = ranged.agg(F.min("low"), F.max("high")).head()
    if span[0] is None:
        return files, 0
    width = (span[1] - span[0]) // BUCKETS + 1
    bucket = lambda c: F.floor((F.col(c) - span[0]) / width)
    most = F.col("row_count")
    dealt = ranged.select(
        F.explode(
            F.array(
                F.struct(F.lit("high").alias("edge"), bucket("high").alias("at"), F.coalesce("certain", F.lit(0)).alias("rows")),
                F.struct(F.lit("low").alias("edge"), bucket("low").alias("at"), F.coalesce("certain", most).alias("rows")),
            )
        ).alias("x")
    ).select("x.*")
    sums = dealt.groupBy("edge", "at").agg(F.sum("rows").alias("rows")).collect()
    sums = {(r["edge"], r["at"]): r["rows"] for r in sums}
    # The page ends in this bucket at the latest: so many rows are sure to be up to its end.
    upto, last = 0, BUCKETS
    for at in range(BUCKETS + 1):
        upto += sums.get(("high", at), 0)
        if upto >= offset + limit:
            last = at
            break
    # And begins in this one at the earliest: no more rows than the offset can be before it.
    before, first = 0, 0
    for at in range(1, BUCKETS + 1):
        before += sums.get(("low", at - 1), 0)
        if before > offset:
            break
        first = at
    passed = F.coalesce((bucket("high") < first) & F.col("certain").isNotNull(), F.lit(False))
    skipped = sum(n for (edge, at), n in sums.items() if edge == "high" and at is not None and at < first)
    near = ranged.filter(~passed & F.coalesce(bucket("low") <= last, F.lit(True)))
    return near.select(*files.columns), skipped


def audit_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``(file, finding)``: entries without a file and files without an entry."""
    listed, present = manifest.select("file"), files.select("file")
    lost = listed.join(present, "file", "left_anti")
    unknown = present.join(listed, "file", "left_anti")
    return lost.select("file", F.lit("orphan_manifest").alias("finding")).unionByName(
        unknown.select("file", F.lit("unindexed_file").alias("finding"))
    )


def unreadable_files(manifest: DataFrame, rows_read: DataFrame) -> DataFrame:
    """Files that gave fewer rows than listed when read with corrupt files skipped.

    ``rows_read`` is ``(file, row_count)``.
    """
    seen = rows_read.select("file", F.col("row_count").alias("rows_read"))
    return (
        manifest.select("file", "row_count")
        .join(seen, "file", "left")
        .select("file", "row_count", F.coalesce("rows_read", F.lit(0)).alias("rows_read"))
        .filter(F.col("rows_read") != F.col("row_count"))
    )


def list_files(manifest: DataFrame) -> DataFrame:
    """The whole manifest, most recently started file first."""
    return manifest.select(*MANIFEST_COLUMNS).orderBy(F.col("started").desc(), "file")


def list_projects(manifest: DataFrame) -> DataFrame:
    """Sorted distinct project names, read from the manifest, not from the rows."""
    return (
        manifest.select(F.explode("projects").alias("project"))
        .filter(F.col("project") != "")
        .distinct()
        .orderBy("project")
    )


def suggest_projects(manifest: DataFrame, text: str) -> DataFrame:
    """Project names that contain the text, without regard to case."""
    return list_projects(manifest).filter(
        F.contains(F.lower("project"), F.lower(F.lit(text)))
    )


def without(manifest: DataFrame, active: Sequence[str]) -> DataFrame:
    """Entries other than the files still being written."""
    return manifest.filter(~F.col("file").isin(list(active))) if active else manifest
