"""One query per operator, each over the whole of the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakechecks.events import events_as_logs
from lakechecks.fixtures import (
    NOW,
    file_name,
    in_utc,
    logs_of,
    manifest_of,
    named_as_parquet,
    nanosecond_files,
    new_table,
    stored,
    wire_corpus,
)
from logmere.functions import (
    default_logid,
    level_name,
    level_ordinal,
    logid_minute,
    make_logid,
    parse_level,
    severity_to_level,
    wall_from_instant,
)
from logmere.functions.clock import moment_literal, wall_of
from logmere.functions.logids import FILLERS
from logmere.operators import combine, decode as decoding, filters, manifest as listing
from logmere.operators import paging, reports
from logmere.plans.compaction import (
    compaction_batches,
    compaction_candidates,
    compaction_summary,
)
from logmere.functions.sizes import row_bytes
from logmere.plans.query import LogQuery
from logmere.plans.retention import plan_retention, retention_summary
from logmere.schema import LOG_SCHEMA
from logmere.session import work_folder
from logmere.sources import encode, import_nanos, read_logs, read_wire
from logmere.sources.wire import write_wire
from logmere.streaming.ingest import ingest
from logmere.streaming.tail import keep_tail, read_tail
from logmere.table.log_table import FileLayout

WINDOW = (datetime(2024, 1, 5), datetime(2024, 1, 6))
BILLING_WINDOW = {
    "project": "freight-service",
    "from": "2024-01-05T00:00:00Z",
    "to": "2024-01-20T00:00:00Z",
}

REGISTRY: dict = {}


def query(make):
    """Register under the function's name."""
    REGISTRY[make.__name__] = make
    return make


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Newest 100 rows of a project in a time window, with the exact total."""
    return paging.flat_page(
        paging.lookup(logs_of(spark, folder), LogQuery.parse(BILLING_WINDOW))
    )


# -- predicates ----------------------------------------------------------


@query
def project_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_project(logs_of(spark, folder), "freight-service")


@query
def logid_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_logid(logs_of(spark, folder), "run-0007")


@query
def level_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.by_level(logs_of(spark, folder), "ERROR")


@query
def min_level(spark: SparkSession, folder: str) -> DataFrame:
    return filters.min_level(logs_of(spark, folder), "WARN")


@query
def time_range(spark: SparkSession, folder: str) -> DataFrame:
    return filters.time_range(logs_of(spark, folder), *WINDOW)


@query
def time_range_exact_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Both ends are times of events, which must be in the result."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    start, end = (
        events.filter(F.col("event_id") == number).select("ts").head()["ts"]
        for number in (100, 300)
    )
    return filters.time_range(logs_of(spark, folder), start, end)


@query
def preset_counts(spark: SparkSession, folder: str) -> DataFrame:
    return filters.preset_counts(logs_of(spark, folder), NOW)


# -- order and pages -----------------------------------------------------


@query
def lookup_newest(spark: SparkSession, folder: str) -> DataFrame:
    return flagship(spark, folder)


@query
def lookup_oldest_first(spark: SparkSession, folder: str) -> DataFrame:
    request = LogQuery.parse({"project": "gate-service", "order": "asc", "limit": "5000"})
    return paging.flat_page(paging.lookup(logs_of(spark, folder), request))


@query
def lookup_logid_level(spark: SparkSession, folder: str) -> DataFrame:
    request = LogQuery.parse({"logid": "run-0011", "level": "INFO"})
    return paging.flat_page(paging.lookup(logs_of(spark, folder), request))


@query
def lookup_offset(spark: SparkSession, folder: str) -> DataFrame:
    request = LogQuery.parse({"project": "exports-service", "limit": "50", "offset": "120"})
    return paging.flat_page(paging.lookup(logs_of(spark, folder), request))


@query
def lookup_past_end(spark: SparkSession, folder: str) -> DataFrame:
    request = LogQuery.parse({"project": "freight-service", "offset": "100000000"})
    found = paging.lookup(logs_of(spark, folder), request)
    return found.select("count", F.size("results").alias("returned"))


@query
def lookup_no_match(spark: SparkSession, folder: str) -> DataFrame:
    found = paging.lookup(logs_of(spark, folder), LogQuery(logid="no-such-id"))
    return found.select("count", F.size("results").alias("returned"))


@query
def ordered_rows(spark: SparkSession, folder: str) -> DataFrame:
    return paging.sort_logs(logs_of(spark, folder))


@query
def deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A page found by its times rather than by sorting what comes before it."""
    request = LogQuery(project="freight-service", offset=2500, limit=40)
    return paging.page(logs_of(spark, folder), request)


@query
def walk_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages, to the end."""
    request = LogQuery(project="freight-service")
    return paging.walk_into(logs_of(spark, folder), request, work_folder(spark, "walked-pages"))


@query
def live_tail(spark: SparkSession, folder: str) -> DataFrame:
    return paging.live_tail(logs_of(spark, folder), 10)


@query
def live_tail_by_logid(spark: SparkSession, folder: str) -> DataFrame:
    return paging.live_tail(logs_of(spark, folder), 3, by="logid")


# -- sets ----------------------------------------------------------------


@query
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Sealed rows of the older layout and recent rows of the current one."""
    logs = logs_of(spark, folder)
    cut = moment_literal(datetime(2024, 1, 20), wall=True)
    sealed = logs.filter(F.col("timestamp") < cut).drop("caller")
    return combine.union_sources(sealed, logs.filter(F.col("timestamp") >= cut))


@query
def merge_unique(spark: SparkSession, folder: str) -> DataFrame:
    logs = events_as_logs(spark, folder, keep_id=True).withColumn("source", F.lit(0))
    again = (
        logs.filter(F.col("event_id") % 20 == 0)
        .withColumn("source", F.lit(1))
        .withColumn("level", F.lit("OTHER"))
    )
    doubled = logs.unionByName(logs.withColumn("source", F.lit(2))).unionByName(again)
    return combine.merge_unique(doubled, ["source", "event_id"])


@query
def stream_merge_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in no order of time, then copies of all and more of them, through a stream of many batches."""
    path, out = work_folder(spark, "copies"), work_folder(spark, "unique")
    logs = events_as_logs(spark, folder, instants=True, keep_id=True)
    shuffled = logs.orderBy(F.xxhash64("event_id")).drop("event_id").repartition(6)
    shuffled.write.parquet(path)
    again = logs.withColumn("level", F.lit("OTHER")).drop("event_id").repartition(5)
    again.unionByName(again.filter(F.col("project") == "gate-service")).write.mode("append").parquet(path)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 3).parquet(path)
    run = (
        combine.merge_unique_stream(stream)
        .writeStream.option("checkpointLocation", work_folder(spark, "unique-run"))
        .trigger(availableNow=True)
        .start(out)
    )
    run.awaitTermination()
    return in_utc(spark.read.parquet(out))


@query
def stream_live_tail(spark: SparkSession, folder: str) -> DataFrame:
    """The tail kept batch by batch, rows coming in no order of time."""
    path, tail = work_folder(spark, "tail-rows"), work_folder(spark, "tail")
    logs = events_as_logs(spark, folder, instants=True, keep_id=True)
    logs.orderBy(F.xxhash64("event_id")).drop("event_id").repartition(9).write.parquet(path)
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 3).parquet(path)
    keep_tail(stream, tail, work_folder(spark, "tail-run"), 10, available_now=True).awaitTermination()
    return in_utc(read_tail(spark, tail))


# -- reports -------------------------------------------------------------


@query
def reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Even shares are expected of every project and logid, and of one that is absent."""
    logs = logs_of(spark, folder)
    total = logs.count()

    def shares(kind: str) -> DataFrame:
        names = logs.select(F.col(kind).alias("name")).distinct()
        number = names.count()
        return names.select(
            F.lit(kind).alias("kind"), "name", F.lit(total // number).alias("want")
        )

    absent = spark.range(1).select(
        F.lit("project").alias("kind"),
        F.lit("absent-service").alias("name"),
        F.lit(1).alias("want"),
    )
    return reports.reconcile(
        logs, shares("project").unionByName(shares("logid")).unionByName(absent)
    )


@query
def volume(spark: SparkSession, folder: str) -> DataFrame:
    return reports.volume(logs_of(spark, folder)).withColumn(
        "day", F.col("day").cast("string")
    )


@query
def age_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Seen on the second to last day, so that some rows lie in the future."""
    return reports.age_histogram(logs_of(spark, folder), datetime(2024, 1, 30, 12))


@query
def distinct_projects(spark: SparkSession, folder: str) -> DataFrame:
    logs = logs_of(spark, folder)
    blanked = F.when(F.col("caller") == "", "").otherwise(F.col("project"))
    return logs.groupBy("level").agg(
        F.array_join(listing.distinct_projects(blanked), ",").alias("projects")
    )


@query
def enrich(spark: SparkSession, folder: str) -> DataFrame:
    enriched = reports.enrich(logs_of(spark, folder))
    return enriched.withColumn("caller_line", F.coalesce("caller_line", F.lit(-1)))


@query
def level_functions(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    number = F.col("user_id") % 70
    text = F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(
        F.col("event_type")
    )
    read = parse_level(text)
    return events.select(
        "event_id",
        level_ordinal(text).alias("ordinal"),
        level_name(number - 2).alias("name"),
        read["level"].alias("level"),
        read["ok"].alias("ok"),
        severity_to_level(number, "python").alias("from_python"),
        severity_to_level(number - 10, "slog").alias("from_slog"),
    )


@query
def default_logids(spark: SparkSession, folder: str) -> DataFrame:
    logs = events_as_logs(spark, folder, keep_id=True)
    given = F.when(F.col("event_id") % 3 == 0, "").when(
        F.col("event_id") % 3 == 1, F.col("logid")
    )
    return logs.select(
        "event_id",
        default_logid(given, FILLERS["go"]).alias("go_logid"),
        default_logid(given, FILLERS["python"]).alias("python_logid"),
    )


@query
def logid_minutes(spark: SparkSession, folder: str) -> DataFrame:
    """Made ids name their minute, whatever the random-looking tail is."""
    logs = events_as_logs(spark, folder, keep_id=True)
    made = make_logid(wall_of(logs), F.col("event_id"))
    logid = F.when(F.col("event_id") % 5 == 0, F.col("logid")).otherwise(made)
    return logs.select(
        "event_id",
        F.substring(logid, 1, 14).alias("head"),
        F.length(logid).alias("width"),
        logid_minute(logid).alias("minute"),
    )


# -- wire ----------------------------------------------------------------


@query
def wire_decode(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decoding.decode(wire_corpus(spark, folder))
    kept = decoded.filter(F.col("reason").isNull())
    return in_utc(decoding.backfill_timestamp(kept, NOW)).drop("value", "reason")


@query
def dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decoding.decode(wire_corpus(spark, folder))
    return decoded.filter(F.col("reason").isNotNull()).select("event_id", "value", "reason")


@query
def ingest_stats(spark: SparkSession, folder: str) -> DataFrame:
    return decoding.ingest_stats(decoding.decode(wire_corpus(spark, folder)))


@query
def backfill_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    logs = events_as_logs(spark, folder, keep_id=True)
    zero = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")
    slot = F.col("event_id") % 4
    unset = F.when(slot == 0, None).when(slot == 1, zero).otherwise(F.col("timestamp"))
    return decoding.backfill_timestamp(logs.withColumn("timestamp", unset), NOW)


@query
def wire_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decoding.decode(encode(logs_of(spark, folder)).select("value"))
    return in_utc(decoding.clean_rows(decoded, NOW))


@query
def wire_round_trip_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as messages: every script, quote and line break survives."""
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    logs = documents.select(
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("timestamp"),
        F.col("source").alias("project"),
        F.col("doc_id").cast("string").alias("logid"),
        F.lit("INFO").alias("level"),
        F.col("text").alias("message"),
        F.col("lang").alias("caller"),
    )
    decoded = decoding.decode(encode(logs).select("value"))
    return in_utc(decoding.clean_rows(decoded, NOW))


@query
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded events and junk lines through the stream, then read from the table."""
    return in_utc(_ingested(spark, folder).read())


@query
def stream_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    letters = _ingested(spark, folder).dead_letters()
    return letters.groupBy("value", "reason").agg(F.count(F.lit(1)).alias("records"))


def _ingested(spark: SparkSession, folder: str):
    wire, table = work_folder(spark, "wire"), new_table(spark, "ingested")
    logs = events_as_logs(spark, folder, keep_id=True).repartition(8)
    records = encode(logs, keep=["event_id"])
    junk = F.concat(F.lit("junk "), F.col("key"))
    lines = records.select(
        "key",
        F.explode(
            F.when(F.col("event_id") % 50 == 0, F.array("value", junk)).otherwise(
                F.array("value")
            )
        ).alias("value"),
    )
    write_wire(lines, wire)
    records = read_wire(spark, wire, options={"maxFilesPerTrigger": "4"})
    run = ingest(records, table, work_folder(spark, "stream"), available_now=True)
    run.awaitTermination()
    return table


# -- files and manifest --------------------------------------------------


@query
def read_old_layout(spark: SparkSession, folder: str) -> DataFrame:
    """Files without the call site beside files with it."""
    path = work_folder(spark, "layouts")
    logs = events_as_logs(spark, folder, instants=True)
    old = F.col("level") == "DEBUG"
    logs.filter(old).drop("caller").write.parquet(f"{path}/old")
    logs.filter(~old).write.parquet(f"{path}/new")
    return in_utc(read_logs(spark, [f"{path}/old", f"{path}/new"]))


@query
def read_beside_corrupt(spark: SparkSession, folder: str) -> DataFrame:
    """A folder that also holds text files named like Parquet files."""
    path = work_folder(spark, "corrupt")
    logs = events_as_logs(spark, folder, instants=True)
    logs.write.parquet(f"{path}/good")
    texts = logs.select("message").repartition(2)
    texts.write.option("compression", "none").text(f"{path}/texts")
    named_as_parquet(spark, f"{path}/texts")
    return in_utc(read_logs(spark, path, tolerate_corrupt=True))


@query
def read_nanoseconds(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose time is a Parquet timestamp in nanoseconds, written by the tasks."""
    path = work_folder(spark, "nanos")
    logs = events_as_logs(spark, folder, instants=True)
    nanos = logs.withColumn("timestamp", F.unix_micros("timestamp") * 1000 + 789)
    nanos.repartition(4).mapInArrow(nanosecond_files(path), "file string").collect()
    return in_utc(import_nanos(spark, path))


@query
def ingest_file_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of bounded bytes: the rows stay, none is above the bound, and few are far below."""
    bound = 20_000
    table = new_table(spark, "sized")
    table.layout = FileLayout(max_file_bytes=bound)
    table.append(events_as_logs(spark, folder, instants=True).repartition(3))
    rows = table.read(with_file=True)
    sizes = rows.groupBy("file").agg(F.sum(row_bytes()).alias("bytes"), F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("rows"),
        F.count_if(F.col("bytes") > bound).alias("above"),
        (F.count_if(F.col("bytes") < bound // 3) <= 3).alias("mostly_full"),
        F.lit(table.manifest().agg(F.sum("row_count")).head()[0]).cast("bigint").alias("listed"),
    )


@query
def build_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(manifest_of(spark, folder))


def _flat(manifest: DataFrame) -> DataFrame:
    named = F.transform(
        F.array_sort(F.map_entries("project_rows")),
        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
    )
    return manifest.withColumns(
        {"projects": F.array_join("projects", ","), "project_rows": F.array_join(named, ",")}
    )


@query
def list_files(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(listing.list_files(manifest_of(spark, folder)))


@query
def list_projects(spark: SparkSession, folder: str) -> DataFrame:
    return listing.list_projects(manifest_of(spark, folder))


@query
def suggest_projects(spark: SparkSession, folder: str) -> DataFrame:
    return listing.suggest_projects(manifest_of(spark, folder), "RTS-serv")


@query
def prune_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = manifest_of(spark, folder)
    request = LogQuery(project="freight-service", start=WINDOW[0], end=WINDOW[1])
    return listing.prune_files(manifest, request).select("file", "row_count")


@query
def audit_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Some files have lost their entry and some entries their file."""
    files = events_as_logs(spark, folder, keep_id=True).select(
        file_name(F.col("event_id")).alias("file"), "project"
    )
    listed = files.filter(F.col("project") != "gate-service").distinct()
    day = manifest_of(spark, folder).filter(F.dayofmonth("started") > 3)
    return listing.audit_manifest(day, listed.select("file").distinct().filter(
        ~F.col("file").endswith("7.parquet")
    ))


@query
def table_rows(spark: SparkSession, folder: str) -> DataFrame:
    return in_utc(stored(spark, folder, "rows").read())


@query
def table_manifest_totals(spark: SparkSession, folder: str) -> DataFrame:
    return _totals(stored(spark, folder, "totals").manifest())


def _totals(manifest: DataFrame) -> DataFrame:
    projects = F.array_sort(F.array_distinct(F.flatten(F.collect_set("projects"))))
    return manifest.agg(
        wall_from_instant(F.min("started")).alias("started"),
        wall_from_instant(F.max("ended")).alias("ended"),
        F.sum("row_count").alias("row_count"),
        F.array_join(projects, ",").alias("projects"),
    )


@query
def table_lookup(spark: SparkSession, folder: str) -> DataFrame:
    table = stored(spark, folder, "lookup")
    return in_utc(paging.flat_page(table.lookup(LogQuery.parse(BILLING_WINDOW))))


@query
def table_total(spark: SparkSession, folder: str) -> DataFrame:
    """Totals of a project, from the manifest and from the files at the edges of a window."""
    table = new_table(spark, "total")
    logs = events_as_logs(spark, folder, instants=True)
    table.append(logs.repartitionByRange(12, "timestamp"))
    window = LogQuery(project="freight-service", start=WINDOW[0], end=WINDOW[1])
    asked = {"window": window, "project": LogQuery(project="freight-service"),
             "logid": LogQuery(logid="run-0007"), "absent": LogQuery(project="absent-service")}
    found = [table.total(q).select(F.lit(name).alias("asked"), "count") for name, q in asked.items()]
    return reduce(DataFrame.unionByName, found)


@query
def table_walk(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of a project in a window, each written by itself, from files in the order of time."""
    table = new_table(spark, "walk")
    logs = events_as_logs(spark, folder, instants=True)
    table.append(logs.repartitionByRange(12, "timestamp"))
    pages = table.walk(LogQuery.parse(BILLING_WINDOW))
    return in_utc(pages.write(work_folder(spark, "table-walk")))


@query
def table_pruned_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a window, read from the files left after pruning."""
    table = new_table(spark, "pruned")
    logs = events_as_logs(spark, folder, instants=True)
    table.append(logs.repartitionByRange(12, "timestamp"))
    request = LogQuery(project="freight-service", start=WINDOW[0], end=WINDOW[1])
    return in_utc(request.matching(table.read(request)))


@query
def lookup_damaged(spark: SparkSession, folder: str) -> DataFrame:
    """A listed file is lost: the look-up says so beside its total."""
    table = new_table(spark, "damaged")
    logs = events_as_logs(spark, folder, instants=True)
    table.append(logs.filter(F.col("level") != "ERROR").repartition(4))
    table.append(logs.filter(F.col("level") == "ERROR").coalesce(1), unit="lost")
    name = table.manifest().filter(F.startswith("file", F.lit("lost"))).head()["file"]
    table.log.delete(f"data/{name}")
    found = table.lookup(LogQuery(project="freight-service"), tolerate_corrupt=True)
    return found.select("count", "skipped_files")


@query
def read_many_files(spark: SparkSession, folder: str) -> DataFrame:
    """More files than one scan names."""
    table = new_table(spark, "many")
    table.files_per_scan = 7
    table.append(events_as_logs(spark, folder, instants=True).repartition(40))
    return in_utc(table.read())


@query
def table_audit(spark: SparkSession, folder: str) -> DataFrame:
    """A write that was never committed shows up; rows stay those committed."""
    table = stored(spark, folder, "audit")
    table.units_per_listing = 1
    table.write_unit(
        events_as_logs(spark, folder, instants=True).repartition(4), "uncommitted"
    )
    return (
        table.audit()
        .groupBy("finding")
        .agg((F.count(F.lit(1)) > 0).alias("found"))
        .withColumn("rows", F.lit(table.read().count()))
    )


# -- upkeep --------------------------------------------------------------


@query
def retention_freed(spark: SparkSession, folder: str) -> DataFrame:
    """After very many commits a sweep and a vacuum leave only listed files."""
    table = new_table(spark, "freed")
    logs = events_as_logs(spark, folder, instants=True)
    limit = F.lit((NOW - timedelta(days=14)).replace(tzinfo=timezone.utc))
    table.append(logs.filter(F.col("timestamp") <= limit).repartition(3))
    table.append(logs.filter(F.col("timestamp") > limit).repartition(3))
    for batch in range(120):
        table.log.commit(table.snapshot(), streams={"s": batch})
    table.apply_retention(NOW)
    table.vacuum(datetime.now(timezone.utc) + timedelta(days=2))
    on_disk, listed = table.files_on_disk().count(), table.manifest().count()
    return table.read().agg(
        F.count(F.lit(1)).alias("rows_left"),
        F.lit(on_disk - listed).cast("int").alias("unlisted_files"),
    )


@query
def retention_plan(spark: SparkSession, folder: str) -> DataFrame:
    manifest = manifest_of(spark, folder)
    return plan_retention(manifest, NOW, timedelta(days=14), ["logs-000003.parquet"]).select(
        "file", "row_count", "ended"
    )


@query
def retention_totals(spark: SparkSession, folder: str) -> DataFrame:
    manifest = manifest_of(spark, folder)
    return retention_summary(manifest, plan_retention(manifest, NOW))


@query
def retention_applied(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left after the sweep; files hold either only old or only young rows."""
    table = new_table(spark, "retention")
    logs = events_as_logs(spark, folder, instants=True)
    cut = moment_literal(NOW - timedelta(days=14), wall=False)
    table.append(logs.filter(F.col("timestamp") <= cut))
    table.append(logs.filter(F.col("timestamp") > cut))
    table.apply_retention(NOW)
    return in_utc(table.read())


@query
def compaction_candidate_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = manifest_of(spark, folder)
    return compaction_candidates(manifest, 14_480, ["logs-000002.parquet"]).select(
        "file", "size_bytes"
    )


@query
def compaction_plan(spark: SparkSession, folder: str) -> DataFrame:
    return compaction_batches(compaction_candidates(manifest_of(spark, folder)), 60_000)


@query
def compaction_plan_in_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The same plan made by several tasks that each see a part of the files."""
    candidates = compaction_candidates(manifest_of(spark, folder))
    return compaction_batches(candidates, 60_000, block_files=16)


@query
def compaction_plan_by_day(spark: SparkSession, folder: str) -> DataFrame:
    candidates = compaction_candidates(manifest_of(spark, folder))
    days = candidates.withColumn("day", F.to_date("started"))
    return compaction_batches(days, 25_000, by="day")


@query
def compaction_totals(spark: SparkSession, folder: str) -> DataFrame:
    manifest = manifest_of(spark, folder)
    candidates = compaction_candidates(manifest, 14_480)
    return compaction_summary(manifest, candidates, compaction_batches(candidates, 60_000))


@query
def compacted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Merging twice keeps the bag of rows."""
    table = stored(spark, folder, "compacted")
    table.compact()
    table.compact()
    return in_utc(table.read())


@query
def compacted_manifest_totals(spark: SparkSession, folder: str) -> DataFrame:
    table = stored(spark, folder, "compacted-totals")
    table.compact()
    return _totals(table.manifest())
