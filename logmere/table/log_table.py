"""The log table: Parquet files, their manifest, and the jobs that maintain them.

``data/<unit>/`` holds the files of one write, ``errors/<unit>/`` refused records,
``manifest/`` and ``_log/`` the committed versions. A unit is written completely
before the version that lists it is published, so readers never see part of one.
Files that a version no longer lists stay until ``vacuum``, for readers that
resolved an earlier one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from logmere.functions.clock import moment_literal
from logmere.functions.sizes import row_bytes
from logmere.operators import manifest as listing
from logmere.operators import paging, seek
from logmere.plans.compaction import (
    COMPACT_PREFIX,
    MAX_FILE_BYTES,
    TARGET_BYTES,
    compaction_batches,
    compaction_candidates,
    compaction_summary,
)
from logmere.plans.query import LogQuery
from logmere.plans.retention import DEFAULT_TTL, plan_retention, retention_summary
from logmere.schema import DEAD_LETTER_SCHEMA, LOG_COLUMNS, LOG_SCHEMA, TIE_COLUMNS
from logmere.session import work_folder
from logmere.sources.logs import list_data_files, read_logs
from logmere.table.snapshot import CommitConflict, Snapshot, SnapshotLog

# Surviving files are named to the scan, so many in each; the scans of more are put
# together. A scan's own index of its files is larger than the names.
FILES_PER_SCAN = 10_000
# Units whose files are listed at once.
UNITS_PER_LISTING = 500
# A list of file names beside a scan is broadcast up to this many (some 100 bytes
# each), shuffled after that.
BROADCAST_FILES = 1_000_000
# Batches merged by one job; more of them are merged in several jobs, each
# committed by itself, so the shuffle stays small however long the backlog.
WAVE_BATCHES = 2_000
# Rows that one task sorts when files are merged, and batches of more rows that are
# put together side by side.
MERGE_ROWS = 1_000_000
MERGE_THREADS = 8
# Rows that one task numbers when the bytes of a file are bounded.
SIZED_ROWS = 100_000
# How long unlisted files are kept: for readers of earlier versions, and for
# writes that have not been committed yet.
GRACE = timedelta(days=1)
# Pages that one task writes, each to a file, when a walk is written whole.
PAGES_PER_TASK = 50
# Stands between a unit and the attempt to write it.
ATTEMPT = "~"
DELETE_THREADS = 32
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class FileLayout:
    """How log files are written.

    A stream batch is written to no more files than gives each at least
    ``stream_rows_per_file`` rows (the last ones aside), however many tasks it was
    read by; ``max_rows_per_file`` splits files, 0 leaves them whole. With ``max_file_bytes`` no file
    has more bytes of rows (by ``row_bytes``), unless one row alone has. Row groups hold up to 65,536 rows of a couple of hundred bytes; bloom filters
    on the correlation id let a look-up skip row groups of high-cardinality ids.
    """

    max_rows_per_file: int = 0
    max_file_bytes: int = 0
    stream_rows_per_file: int = 65_536
    row_group_bytes: int = 16 * 1024 * 1024
    compression: str = "snappy"

    def options(self) -> dict[str, str]:
        return {
            "compression": self.compression,
            "maxRecordsPerFile": str(self.max_rows_per_file),
            "parquet.block.size": str(self.row_group_bytes),
            "parquet.bloom.filter.enabled#logid": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
        }


def _relative(path: Column) -> Column:
    """Name of a data file as the manifest holds it."""
    return F.substring_index(path, "/data/", -1)


def sized_files(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with the name ``file`` of the one they go to, so that none has more than ``most`` bytes.

    Running sums over the rows of a task, in the order of time, are cut at multiples of half the bound;
    a row of more than half of it has a file of its own. So a file has half the bound and one
    row of at most the other half. The sums are made inside ranges of ``SIZED_ROWS`` rows, however many
    a task had, and go on from the sizes of the ranges before. The rows of a file end up in one task.
    """
    spark, half = rows.sparkSession, max(1, most // 2)
    order = ["timestamp", *TIE_COLUMNS, "number"]
    parts = max(1, -(-rows.count() // SIZED_ROWS))
    numbered = rows.withColumns(
        {"task": F.spark_partition_id(), "number": F.monotonically_increasing_id(), "bytes": row_bytes()}
    )
    dealt = numbered.repartitionByRange(parts, "task", *order).withColumn("part", F.spark_partition_id())
    # Written, so that the ranges and the numbers stay the same for their sizes and their rows.
    path = work_folder(spark, "sized-rows")
    dealt.write.parquet(path)
    dealt = spark.read.schema(dealt.schema).parquet(path).repartition(parts, "task", "part")
    # A row for each range of a task.
    earlier = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("task", "part").agg(F.sum("bytes").alias("held"))
    starts = sizes.select("task", "part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("start"))
    ordered = Window.partitionBy("task", "part").orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("upto", F.sum("bytes").over(upto)).join(F.broadcast(starts), ["task", "part"])
    end = F.col("start") + F.col("upto")
    name = F.when(F.col("bytes") > half, F.concat(F.lit("row-"), F.col("number").cast("string"))).otherwise(
        F.concat_ws("-", "task", F.floor(end / half).cast("string"))
    )
    return placed.withColumn("file", name).select(*rows.columns, "file").repartition(parts, "file")


class Walk(Iterator[DataFrame]):
    """The pages of one version of a table, in order, from ``LogTable.walk``."""

    def __init__(self, table: LogTable, query: LogQuery, page_size: int):
        self.table, self.query, self.page_size = table, query, page_size
        self.snapshot = table.snapshot()
        self._pages = table._walk(query, page_size, self.snapshot)

    def __next__(self) -> DataFrame:
        return next(self._pages)

    def write(self, path: str) -> DataFrame:
        """All pages of the walk, to the end, each as a file of its own in order below ``path/page=<number>``.

        However many pages there are, it takes the same few jobs: all rows are numbered at once, and
        then dealt by ranges of pages, so one task writes the whole of a page.
        """
        spark, newest_first = self.table.spark, self.query.newest_first
        rows = self.table.read(self.query, snapshot=self.snapshot)
        paged = paging.walk_into(rows, self.query, work_folder(spark, "walked-rows"), self.page_size)
        last = paged.agg(F.coalesce(F.max("page"), F.lit(0))).head()[0]
        order = ["page", *paging.order_columns(newest_first)]
        dealt = paged.repartitionByRange(last // PAGES_PER_TASK + 1, "page").sortWithinPartitions(*order)
        dealt.write.partitionBy("page").parquet(path)
        kinds = T.StructType([*LOG_SCHEMA.fields, T.StructField("page", T.IntegerType())])
        return spark.read.schema(kinds).parquet(path)


class LogTable:
    def __init__(self, spark: SparkSession, root: str, layout: FileLayout | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.layout = layout or FileLayout()
        self.files_per_scan = FILES_PER_SCAN
        self.units_per_listing = UNITS_PER_LISTING
        self.log = SnapshotLog(spark, self.root)

    # -- reading ---------------------------------------------------------

    def snapshot(self) -> Snapshot:
        return self.log.latest()

    def manifest(self, snapshot: Snapshot | None = None) -> DataFrame:
        return self.log.manifest(snapshot or self.snapshot())

    def read(
        self,
        query: LogQuery | None = None,
        *,
        tolerate_corrupt: bool = False,
        with_file: bool = False,
        snapshot: Snapshot | None = None,
    ) -> DataFrame:
        """Rows of one version, from the files that may match ``query``.

        The query prunes files only; apply ``query.matching`` for its rows.
        """
        manifest = self.manifest(snapshot)
        if query is not None:
            manifest = listing.prune_files(manifest, query)
        return self._read_files(
            manifest, tolerate_corrupt=tolerate_corrupt, with_file=with_file
        )

    def _read_files(
        self, manifest: DataFrame, *, tolerate_corrupt: bool, with_file: bool
    ) -> DataFrame:
        """Rows of exactly the listed files; one that is missing is an error unless tolerated."""

        def read(names: list[str]) -> DataFrame:
            rows = read_logs(
                self.spark,
                [f"{self.root}/data/{name}" for name in names],
                tolerate_corrupt=tolerate_corrupt,
                with_file=with_file,
            )
            if not with_file:
                return rows.select(*LOG_COLUMNS)
            return rows.withColumn("file", _relative(F.col("file_path"))).drop("file_path")

        def scans(files: DataFrame) -> DataFrame:
            names = [r["file"] for r in files.select("file").toLocalIterator()]
            size = self.files_per_scan
            groups = range(0, max(1, len(names)), size)
            return reduce(DataFrame.unionByName, (read(names[k : k + size]) for k in groups))

        try:
            return scans(manifest)
        except AnalysisException as err:
            if not tolerate_corrupt or err.getCondition() != "PATH_NOT_FOUND":
                raise
        return scans(manifest.join(self.files_on_disk(), "file", "left_semi"))

    def lookup(self, query: LogQuery, *, tolerate_corrupt: bool = False) -> DataFrame:
        """One row ``(count, results)`` over the committed files.

        A damaged or missing file is an error. With ``tolerate_corrupt`` it is passed over, and
        ``skipped_files`` tells how many of the files that may match were.
        """
        snapshot = self.snapshot()
        if not tolerate_corrupt:
            files = listing.counted_files(self.manifest(snapshot), query).cache()
            total = self._total(query, files).head()["count"]
            places = self._places(query, files, query.page_offset, query.page_limit, 1)
            files.unpersist()
            rows = self._page(query, snapshot, places[0] if places else None)
            return paging.envelope(total, rows, query.newest_first)
        manifest = listing.prune_files(self.manifest(snapshot), query)
        skipped = listing.unreadable_files(manifest, self._rows_per_file(manifest)).count()
        rows = self.read(query, tolerate_corrupt=True, snapshot=snapshot)
        return paging.lookup(rows, query).withColumn("skipped_files", F.lit(skipped))

    def total(self, query: LogQuery, snapshot: Snapshot | None = None) -> DataFrame:
        """One row ``count``: how many rows match.

        By project and time the manifest knows, for files wholly inside the window; only those at its
        edges are read. A logid or level takes a scan.
        """
        return self._total(query, listing.counted_files(self.manifest(snapshot), query))

    def _total(self, query: LogQuery, files: DataFrame) -> DataFrame:
        known = files.agg(F.coalesce(F.sum("certain"), F.lit(0)).alias("count"))
        edges = self._read_files(
            files.filter(F.col("certain").isNull()), tolerate_corrupt=False, with_file=False
        )
        counted = query.matching(edges).agg(F.count(F.lit(1)).alias("count"))
        return known.unionByName(counted).agg(F.sum("count").alias("count"))

    def walk(self, query: LogQuery, page_size: int = paging.PAGE_SIZE) -> Walk:
        """The pages of one version, one after another, each a data frame in order.

        The manifest says which files hold the next fifty pages, their times where each of these
        lies; a page then reads all columns of the rows between its edges only, from the files that
        have such rows. To have every page, ``write`` takes them all at once.
        """
        return Walk(self, query, page_size)

    def _walk(self, query: LogQuery, page_size: int, snapshot: Snapshot) -> Iterator[DataFrame]:
        offset = query.page_offset
        files = listing.counted_files(self.manifest(snapshot), query)
        while places := self._places(query, files, offset, page_size, paging.PAGES_AT_ONCE):
            for place in places:
                yield self._page(query, snapshot, place)
            offset += page_size * paging.PAGES_AT_ONCE

    def _places(
        self, query: LogQuery, files: DataFrame, offset: int, page_size: int, pages: int
    ) -> list[seek.Place]:
        near, skipped = listing.near_page(files, query, offset, page_size * pages)
        rows = query.matching(self._read_files(near, tolerate_corrupt=False, with_file=False))
        return seek.pages_at(rows, offset - skipped, page_size, pages, query.newest_first)[1]

    def _page(self, query: LogQuery, snapshot: Snapshot, place: seek.Place | None) -> DataFrame:
        if place is None:
            return self.spark.createDataFrame([], LOG_SCHEMA)
        newest_first = query.newest_first
        window = seek.moments(place, newest_first)
        if window is not None:
            start, end = (EPOCH + timedelta(microseconds=m) for m in window)
            query = replace(query, start=start, end=end)
        rows = query.matching(self.read(query, snapshot=snapshot))
        span = seek.spanned(rows, place.first, place.last, newest_first)
        return paging.read_page(span, place, newest_first)

    def dead_letters(self) -> DataFrame:
        """Refused records of the batches that the newest version has taken in."""
        streams = self.snapshot().streams
        if not streams or not self.log.exists("errors"):
            return self.spark.createDataFrame([], DEAD_LETTER_SCHEMA)
        letters = (
            self.spark.read.schema(DEAD_LETTER_SCHEMA)
            .option("recursiveFileLookup", "true")
            .parquet(f"{self.root}/errors")
        )
        unit = F.regexp_extract("_metadata.file_path", "/errors/([^/]*)/[^/]*$", 1)
        stream = F.regexp_extract(unit, "^logs-(.*)-[0-9]+$", 1)
        batch = F.regexp_extract(unit, "([0-9]+)$", 1).cast("bigint")
        last = F.create_map(*[F.lit(x) for pair in streams.items() for x in pair])
        return letters.filter(batch <= F.try_element_at(last, stream)).select(
            *DEAD_LETTER_SCHEMA.fieldNames()
        )

    def files_on_disk(self) -> DataFrame:
        """``file, size_bytes, modified`` of the data files there are, unopened.

        So many units are listed at a time and written down, so the driver never has the names of
        more files than a group of units holds.
        """
        units = [f"{self.root}/data/{name}" for name in self.log.names("data")]
        path = work_folder(self.spark, "files-on-disk")
        for start in range(0, len(units), self.units_per_listing):
            found = list_data_files(self.spark, units[start : start + self.units_per_listing])
            found.select(
                _relative(F.col("path")).alias("file"), "size_bytes", "modified"
            ).write.mode("append").parquet(path)
        kinds = "file string, size_bytes bigint, modified timestamp"
        if not units:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(path)

    def audit(self) -> DataFrame:
        """Manifest entries without a file, and files no version lists."""
        return listing.audit_manifest(self.manifest(), self.files_on_disk())

    def unreadable(self) -> DataFrame:
        """Listed files that cannot be read in full. Reads file footers only."""
        manifest = self.manifest()
        return listing.unreadable_files(manifest, self._rows_per_file(manifest))

    def _rows_per_file(self, manifest: DataFrame) -> DataFrame:
        rows = self._read_files(manifest, tolerate_corrupt=True, with_file=True)
        return rows.groupBy("file").agg(F.count(F.lit(1)).alias("row_count"))

    # -- writing ---------------------------------------------------------

    def write_unit(self, logs: DataFrame, unit: str) -> DataFrame:
        """Write log files below ``data/<unit>`` and return their manifest rows.

        Nothing is shuffled, unless the layout bounds the bytes of a file: tasks order their own rows
        by time, which keeps the time range of each row group narrow. Each attempt has a folder of its own, so
        one that is repeated never touches files that are committed.
        """
        unit = f"{unit}{ATTEMPT}{uuid.uuid4().hex}"
        rows = logs.select(*LOG_COLUMNS)
        if self.layout.max_file_bytes:
            sized = sized_files(rows, self.layout.max_file_bytes)
            writer = sized.sortWithinPartitions("file", "timestamp").write.partitionBy("file")
        else:
            writer = rows.sortWithinPartitions("timestamp").write
        writer.options(**self.layout.options()).parquet(f"{self.root}/data/{unit}")
        return self.describe_unit(unit)

    def describe_unit(self, unit: str) -> DataFrame:
        """Manifest rows of the files of a unit, read back from the files."""
        rows = read_logs(self.spark, f"{self.root}/data/{unit}", with_file=True)
        return listing.build_manifest(
            rows, _relative(F.col("file_path")), F.max("file_size")
        )

    def append(self, logs: DataFrame, unit: str | None = None) -> Snapshot:
        """Add rows as one write; a ``unit`` that is listed already is refused."""
        base = self.snapshot()
        if unit is not None:
            same = F.startswith(F.col("file"), F.lit(unit + ATTEMPT))
            if not self.manifest(base).filter(same).isEmpty():
                raise CommitConflict(f"unit {unit!r} is in {self.root} already")
        added = self.write_unit(logs, unit or "logs")
        return self.log.commit(base, added, summary={"operation": "append"})

    # -- maintenance -----------------------------------------------------

    def apply_retention(
        self,
        now: datetime,
        ttl: timedelta = DEFAULT_TTL,
        active: Sequence[str] = (),
        delete_now: bool = False,
    ) -> dict[str, int]:
        """Drop files past their keep time; returns the counts of the sweep.

        A version without them is published; ``vacuum`` deletes them later.
        ``delete_now`` deletes them at once, for tables nobody else is reading.
        """
        base = self.snapshot()
        manifest = self.manifest(base)
        plan = plan_retention(manifest, now, ttl, active)
        result = retention_summary(manifest, plan).head().asDict()
        if result["deleted"]:
            self.log.commit(
                base, removed=plan, summary={"operation": "retention", **result}
            )
            if delete_now:
                self._delete_files(plan)
        return result

    def compact(
        self,
        target_bytes: int = TARGET_BYTES,
        max_bytes: int = MAX_FILE_BYTES,
        active: Sequence[str] = (),
        by: Column | None = None,
        wave: int = WAVE_BATCHES,
        delete_now: bool = False,
    ) -> dict[str, int]:
        """Merge small files into time-ordered ones; returns the counts of the run.

        Batches are rewritten side by side, one task each, by a shuffle on the
        batch number. Files whose footer cannot be read are left out, and a batch
        whose result does not hold exactly the rows listed for its sources is not
        put in place, so no row is lost to a damaged file. ``by`` (for example
        the day of ``started``) keeps batches within one value. The sources stay
        on disk, unlisted, until ``vacuum``, unless ``delete_now`` is set.
        """
        manifest = self.manifest()
        candidates = compaction_candidates(manifest, max_bytes, active)
        if by is not None:
            candidates = candidates.withColumn("_by", by)
        damaged = listing.unreadable_files(candidates, self._rows_per_file(candidates))
        # Kept as a table: once the sources are gone it could not be worked out again.
        intact_path = work_folder(self.spark, "compaction-intact")
        candidates.join(damaged, "file", "left_anti").write.parquet(intact_path)
        intact = self.spark.read.parquet(intact_path)
        plan_path = work_folder(self.spark, "compaction-plan")
        compaction_batches(
            intact, target_bytes, by=None if by is None else "_by"
        ).write.parquet(plan_path)
        batches = self.spark.read.parquet(plan_path)
        last = batches.agg(F.max("batch")).head()[0]
        merged = []
        for start in range(0, 0 if last is None else last + 1, wave):
            some = batches.filter(F.col("batch").between(start, start + wave - 1))
            try:
                merged.append(self._merge(some, start, min(wave, last + 1 - start)))
            except CommitConflict:
                # What was committed stays, and is told; the rest waits for the next run.
                if not merged:
                    raise
                break
        done = batches.filter(F.lit(False))
        if merged:
            done = self.spark.read.schema(batches.schema).parquet(*merged)
            if delete_now:
                self._delete_files(done)
        return compaction_summary(manifest, intact, done).head().asDict()

    def _merge(self, batches: DataFrame, start: int, count: int) -> str:
        """Merge one wave of batches and commit it; returns where the sources
        that were replaced are listed."""
        base = self.snapshot()
        manifest = self.manifest(base)
        unit = f"{COMPACT_PREFIX}{uuid.uuid4().hex}"
        self._rewrite(manifest, batches, unit, start, count)
        batch_of = F.regexp_extract("file", r"/batch=(\d+)/", 1).cast("bigint")
        written_path = work_folder(self.spark, "compaction-written")
        self.describe_unit(unit).withColumn("batch", batch_of).write.parquet(written_path)
        written = self.spark.read.parquet(written_path)
        listed = (
            batches.join(manifest, "file")
            .groupBy("batch")
            .agg(F.sum("row_count").alias("listed"))
        )
        got = written.groupBy("batch").agg(F.sum("row_count").alias("got"))
        whole = listed.join(got, "batch").filter(F.col("listed") == F.col("got"))
        path = work_folder(self.spark, "compaction-merged")
        batches.join(whole.select("batch"), "batch", "left_semi").select(
            *batches.columns
        ).write.parquet(path)
        replaced = self.spark.read.schema(batches.schema).parquet(path)
        added = written.join(replaced.select("batch").distinct(), "batch", "left_semi")
        self.log.commit(
            base, added, replaced.select("file"), summary={"operation": "compaction"}
        )
        return path

    def _rewrite(
        self, manifest: DataFrame, batches: DataFrame, unit: str, start: int, count: int
    ) -> None:
        """One file for each batch, its rows in order of time.

        The rows of a batch are sorted by one task up to ``MERGE_ROWS``. Those of a larger one are
        sorted by ranges of time first, and the ranges then written one after another.
        """
        sized = batches.join(manifest.select("file", "row_count"), "file").groupBy("batch")
        sized = sized.agg(F.sum("row_count").alias("n")).filter(F.col("n") > MERGE_ROWS)
        large = {r["batch"]: -(-r["n"] // MERGE_ROWS) for r in sized.collect()}
        path = f"{self.root}/data/{unit}"
        in_order = ["timestamp", "file", "row_index"]
        if len(large) < count:
            some = batches.filter(~F.col("batch").isin(list(large))) if large else batches
            (
                self._of_batches(manifest, some)
                .repartitionById(count, (F.col("batch") - start).cast("int"))
                .sortWithinPartitions("batch", *in_order)
                .select(*LOG_COLUMNS, "batch")
                .write.mode("overwrite")
                .options(**self.layout.options())
                .partitionBy("batch")
                .parquet(path)
            )
        if not large:
            return
        ranges = work_folder(self.spark, "compaction-ranges")
        (
            self._of_batches(manifest, batches.filter(F.col("batch").isin(list(large))))
            .repartitionByRange(sum(large.values()), "batch", *in_order)
            .withColumn("part", F.spark_partition_id())
            .sortWithinPartitions("batch", "part", *in_order)
            .select(*LOG_COLUMNS, "batch", "part")
            .write.partitionBy("batch", "part")
            .parquet(ranges)
        )
        parts: dict[int, list[int]] = {batch: [] for batch in large}
        for found in self.spark.read.parquet(ranges).select("batch", "part").distinct().collect():
            parts[found["batch"]].append(found["part"])

        def together(batch: int) -> None:
            sorted_rows = [
                self.spark.read.schema(LOG_SCHEMA).parquet(f"{ranges}/batch={batch}/part={part}")
                for part in sorted(parts[batch])
            ]
            # A single task reads the ranges in their order, as it writes; it holds none.
            one = reduce(DataFrame.unionByName, sorted_rows).coalesce(1)
            one.write.options(**self.layout.options()).parquet(f"{path}/batch={batch}")

        with ThreadPoolExecutor(MERGE_THREADS) as pool:
            for done in [pool.submit(together, batch) for batch in parts if parts[batch]]:
                done.result()

    def _of_batches(self, manifest: DataFrame, batches: DataFrame) -> DataFrame:
        """Rows of the sources of some batches, with ``batch``, ``file`` and ``row_index``."""
        sources = manifest.join(batches.select("file"), "file", "left_semi")
        rows = self._read_files(sources, tolerate_corrupt=True, with_file=True)
        batch_map = batches.select("file", "batch")
        if batches.count() <= BROADCAST_FILES:
            batch_map = F.broadcast(batch_map)
        return rows.join(batch_map, "file")

    def vacuum(self, now: datetime, grace: timedelta = GRACE) -> dict[str, object]:
        """Delete files that neither the current version nor any version of the
        last ``grace`` lists, and that were written before it began.

        Returns how many were deleted, and if none why. Versions are kept by age alone, so however
        many commits a day has, the one that was current when the grace began is there to compare.
        """
        cutoff = now - grace
        earlier = self.log.published_before(cutoff)
        if earlier is None:
            return {"deleted": 0, "reason": "no version is older than the grace"}
        listed = self.manifest(earlier).select("file").unionByName(self.manifest().select("file"))
        unlisted = (
            self.files_on_disk()
            .filter(F.col("modified") <= moment_literal(cutoff, wall=False))
            .join(listed, "file", "left_anti")
        )
        path = work_folder(self.spark, "vacuum")
        unlisted.select("file").write.parquet(path)
        gone = self.spark.read.schema("file string").parquet(path)
        deleted = gone.count()
        self._delete_files(gone)
        self.log.drop_versions_before(earlier)
        self.log.fold()
        self.log.drop_unused_parts(cutoff)
        return {"deleted": deleted, "reason": "" if deleted else "every old file is listed"}

    def _delete_files(self, files: DataFrame) -> None:
        """Delete listed files; the names stream through, they are not gathered."""
        with ThreadPoolExecutor(DELETE_THREADS) as pool:
            window = []
            for row in files.select("file").toLocalIterator():
                window.append(pool.submit(self.log.delete, f"data/{row['file']}"))
                if len(window) >= 10 * DELETE_THREADS:
                    for done in window:
                        done.result()
                    window = []
            for done in window:
                done.result()
