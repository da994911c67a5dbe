"""The log table: manifest, pruning, damage, versions, retention, merging, ingest."""

import random
from datetime import datetime, timedelta, timezone
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from conftest import at, full_plan, plain
from logmere.operators import manifest as listing, paging
from logmere.operators.paging import lookup
from logmere.plans import compaction
from logmere.plans.compaction import compaction_batches, compaction_candidates
from logmere.plans.query import LogQuery
from logmere.plans.retention import plan_retention, retention_summary
from logmere.schema import LOG_SCHEMA, MANIFEST_SCHEMA
from logmere.sources import encode, import_nanos, read_logs, read_wire, write_wire
from logmere.streaming.ingest import ingest, ingest_batch
from logmere.table.log_table import FileLayout, LogTable
from logmere.table.snapshot import CommitConflict


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, str(tmp_path / "table"))


def some_logs(spark, seed=1, n=200, parts=4):
    rnd = random.Random(seed)
    rows = [
        (at("00:00:00") + timedelta(minutes=rnd.randrange(3000)), rnd.choice(["a", "b", "c"]),
         f"l{rnd.randrange(9)}", rnd.choice(["INFO", "ERROR"]), f"m{rnd.randrange(20)}", "")
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, LOG_SCHEMA).repartition(parts)


def data_files(table):
    return sorted(Path(table.root, "data").rglob("*.parquet"))


def test_manifest_of_a_file(table, make_logs):
    table.append(make_logs([
        ("12:00:00", "billing", "r", "INFO"), ("12:00:01", "billing", "r", "INFO"),
        ("12:00:02", "auth", "r", "INFO")]))
    row = table.manifest().head()
    assert (row["row_count"], row["projects"]) == (3, ["auth", "billing"])
    assert row["size_bytes"] == data_files(table)[0].stat().st_size
    assert row["ended"] - row["started"] == timedelta(seconds=2)
    assert table.manifest().schema.simpleString() == MANIFEST_SCHEMA.simpleString()


def test_nothing_written_for_no_rows(table, make_logs):
    table.append(make_logs([("12:00:00", "p", "l", "INFO")]).filter("false"))
    assert table.manifest().count() == 0 and table.read().count() == 0


def test_empty_table_answers(table):
    row = table.lookup(LogQuery(project="p")).head()
    assert (row["count"], row["results"]) == (0, [])


def test_pruning_never_changes_answers(spark, table):
    logs = some_logs(spark, n=400)
    table.append(logs.repartitionByRange(8, "timestamp"))
    table.append(logs.filter("project = 'a'").limit(50))
    everything = table.read()
    for start, end in [(None, None), (at("05:00:00"), at("09:00:00")),
                       (at("2027-01-01T00:00:00"), None), (None, at("2026-01-01T10:00:00"))]:
        for project in ("a", "zzz", ""):
            query = LogQuery(project=project, start=start, end=end)
            pruned = table.read(query)
            assert plain(query.matching(pruned)) == plain(query.matching(everything))
    near = listing.prune_files(table.manifest(), LogQuery(start=at("05:00:00"), end=at("06:00:00")))
    assert 0 < near.count() < table.manifest().count()


def test_pruning_by_time(table, make_logs):
    table.append(make_logs([("00:00:00", "p", "l", "INFO")]))
    def files(start, end):
        return listing.prune_files(table.manifest(), LogQuery(project="p", start=start, end=end)).count()
    later = at("00:00:00") + timedelta(days=30)
    assert files(later, later + timedelta(days=1)) == 0
    assert files(None, at("01:00:00")) == 1
    assert files(at("00:00:00"), at("00:00:00")) == 1


def test_many_files_are_read_in_groups(spark, table):
    logs = some_logs(spark)
    table.append(logs)
    table.write_unit(logs, "uncommitted")
    table.append(logs.filter("level = 'INFO'"))
    whole = plain(logs.unionByName(logs.filter("level = 'INFO'")))
    for group in (3, 1):
        table.files_per_scan = group
        assert plain(table.read()) == whole
        assert not any("uncommitted" in name for name in table.read().inputFiles())
    lost = table.manifest().select("file").head()[0]
    table.log.delete(f"data/{lost}")
    with pytest.raises(AnalysisException):
        table.read()


def test_a_unit_is_taken_once(spark, table):
    table.append(some_logs(spark, n=20), unit="u")
    with pytest.raises(CommitConflict):
        table.append(some_logs(spark, n=20), unit="u")
    assert table.read().count() == 20 and table.audit().count() == 0


def test_damaged_and_missing_files(spark, table):
    logs = some_logs(spark, parts=6)
    table.append(logs)
    files = data_files(table)
    whole = files[3].read_bytes()
    files[0].write_text("this is not parquet")
    files[1].write_bytes(b"")
    files[3].write_bytes(whole[: len(whole) // 2])
    files[2].unlink()
    damaged = {f.name for f in files[:4]}
    kept = table.manifest().filter(~F.substring_index("file", "/", -1).isin(list(damaged)))
    left = kept.agg(F.sum("row_count")).head()[0]
    assert table.read(tolerate_corrupt=True).count() == left
    found = table.lookup(LogQuery(project="a"), tolerate_corrupt=True).head()
    assert found["count"] > 0 and found["skipped_files"] == 4
    with pytest.raises(Exception):
        table.lookup(LogQuery(project="a")).head()
    assert {r["file"].split("/")[-1] for r in table.unreadable().collect()} == damaged
    with pytest.raises(Exception):
        table.read().collect()
    lost = {(r["finding"], r["file"].split("/")[-1]) for r in table.audit().collect()}
    assert lost == {("orphan_manifest", files[1].name), ("orphan_manifest", files[2].name)}


def test_old_layout_reads_with_empty_caller(spark, tmp_path, make_logs):
    make_logs([("12:00:00", "p", "l", "INFO")]).drop("caller").write.parquet(str(tmp_path / "old"))
    assert read_logs(spark, str(tmp_path / "old")).head()["caller"] == ""


def test_nanosecond_files(spark, tmp_path):
    nanos = pa.array([1_767_268_800_123_456_789, -1], pa.timestamp("ns", tz="UTC"))
    text = pa.array(["p", "q"])
    columns = {"timestamp": nanos, "project": text, "logid": text, "level": text, "message": text}
    pq.write_table(pa.table(columns), tmp_path / "n.parquet", version="2.6")
    got = [r[0] for r in plain(import_nanos(spark, str(tmp_path / "n.parquet")))]
    assert got == ["1969-12-31 23:59:59.999999", "2026-01-01 12:00:00.123456"]


def test_time_predicate_holds_over_many_pages(spark, tmp_path):
    """Row groups of many pages: a match beyond the first page is still found."""
    day = 86_400_000_000
    micros = np.arange(20_000, dtype="int64") * 1_000_000 + 20_454 * day
    text = pa.array(["p"] * len(micros))
    columns = {"timestamp": pa.array(micros, pa.timestamp("us", tz="UTC"))}
    columns |= {name: text for name in LOG_SCHEMA.fieldNames()[1:]}
    pq.write_table(pa.table(columns), tmp_path / "t.parquet", data_page_size=512)
    query = LogQuery(project="p", start=at("2026-01-01T05:00:00"), end=at("2026-01-01T05:00:09"))
    assert lookup(read_logs(spark, str(tmp_path / "t.parquet")), query).head()["count"] == 10


def test_versions(spark, table, make_logs):
    first = table.append(make_logs([("12:00:00", "p", "l", "INFO")]))
    second = table.append(make_logs([("12:01:00", "p", "l", "INFO")]))
    assert (first.version, second.version) == (1, 2)
    assert table.read(snapshot=first).count() == 1 and table.read().count() == 2
    # A commit made on an older version goes on top of the newest one.
    third = table.log.commit(first, table.write_unit(some_logs(spark, n=7), "third"))
    assert third.version == 3 and table.read().count() == 9
    # Unless what it removes is gone, or its batch is in.
    dropped = table.manifest(first).select("file")
    fourth = table.log.commit(third, removed=dropped, streams={"s": 4})
    with pytest.raises(CommitConflict):
        table.log.commit(second, removed=dropped)
    with pytest.raises(CommitConflict):
        table.log.commit(second, streams={"s": 4})
    assert table.snapshot() == fourth and table.read().count() == 8


def test_vacuum_waits_for_readers(spark, table):
    table.append(some_logs(spark, parts=3))
    before = table.snapshot()
    table.compact()
    now = datetime.now(timezone.utc)
    table.vacuum(now)
    assert table.read(snapshot=before).count() == 200 and len(data_files(table)) == 4
    # Within the grace period the files of a running write are not touched.
    table.write_unit(some_logs(spark, n=5, parts=1), "being-written")
    table.vacuum(now + timedelta(days=1))
    assert any("being-written" in str(f) for f in data_files(table))
    table.vacuum(now + timedelta(days=2))
    (kept,) = data_files(table)
    assert "compact-" in str(kept) and table.read().count() == 200
    assert table.manifest().count() == 1 and table.audit().count() == 0


def test_manifest_parts_are_folded(spark, table, make_logs, monkeypatch):
    from logmere.table import snapshot

    monkeypatch.setattr(snapshot, "MAX_PARTS", 2)
    for minute in range(4):
        table.append(make_logs([(f"12:0{minute}:00", "p", "l", "INFO")]))
    gone = table.manifest().filter(F.col("started") == F.lit(at("12:01:00"))).select("file")
    table.log.commit(table.snapshot(), removed=gone)
    assert len(table.snapshot().parts) == 5 and table.read().count() == 3
    table.log.fold()
    assert len(table.snapshot().parts) == 1 and table.read().count() == 3
    table.append(make_logs([("13:00:00", "p", "l", "INFO")]))
    assert len(table.snapshot().parts) == 2 and table.read().count() == 4


def test_vacuum_after_very_many_commits(spark, table):
    table.append(some_logs(spark, parts=3))
    table.compact()
    for batch in range(130):
        table.log.commit(table.snapshot(), streams={"s": batch})
    now = datetime.now(timezone.utc)
    assert table.vacuum(now)["deleted"] == 0 and table.vacuum(now)["reason"]
    assert table.vacuum(now + timedelta(days=2))["deleted"] == 3
    assert len(data_files(table)) == 1 and table.read().count() == 200


def manifest_row(spark, rows):
    return spark.createDataFrame([(*r, None) for r in rows], MANIFEST_SCHEMA)


def test_retention_plan(spark):
    now, day = at("2026-02-01T00:00:00"), timedelta(days=1)
    row = lambda name, ended: (name, ended, ended, 1, ["p"], 10)
    rows = [
        row("old", now - 30 * day), row("edge", now - 14 * day), row("mid", now - 10 * day),
        row("active", now - 40 * day), row("zero", at("0001-01-01T00:00:00")),
    ]
    listed = manifest_row(spark, rows[:4]).unionByName(
        manifest_row(spark, [("unread", None, None, 1, [], 10)]))
    zero = listed.filter("file = 'old'").select(
        F.lit("zero").alias("file"),
        *[F.timestamp_micros(F.lit(-62135596800000000)).alias(n) for n in ("started", "ended")],
        "row_count", "projects", "size_bytes", "project_rows")
    listed = listed.unionByName(zero)
    plan = plan_retention(listed, now, 14 * day, ["active"])
    assert {r["file"] for r in plan.select("file").collect()} == {"old", "edge"}
    assert tuple(retention_summary(listed, plan).head()) == (6, 2, 1, 20)
    assert plan_retention(listed, now, timedelta(0)).count() == 0
    assert tuple(retention_summary(listed, plan_retention(listed, now, -day)).head()) == (6, 0, 1, 0)


def test_retention_applied_twice(spark, table, make_logs):
    now = at("2026-02-01T00:00:00")
    for stamp in ("2026-01-02T00:00:00", "2026-01-22T00:00:00", "2026-01-31T23:00:00"):
        table.append(make_logs([(stamp, "p", "l", "INFO")]))
    before = table.snapshot()
    data_files(table)[0].stat()
    result = table.apply_retention(now, delete_now=True)
    assert (result["scanned"], result["deleted"]) == (3, 1)
    assert table.read().count() == 2 and len(data_files(table)) == 2
    assert table.snapshot().version == before.version + 1
    assert table.apply_retention(now)["deleted"] == 0
    assert table.audit().count() == 0


def greedy(rows, target):
    """Files one after another; the meaning the batches must have."""
    batches, held, number, count, last = {}, 0, 0, 0, None
    for key, name, size in sorted(rows):
        if key != last and count:
            number, held, count = number + 1, 0, 0
        last = key
        batches.setdefault(number, []).append(name)
        held, count = held + size, count + 1
        if held >= target:
            number, held, count = number + 1, 0, 0
    return {n: names for n, names in batches.items() if len(names) >= 2}


@pytest.mark.parametrize("seed", range(4))
def test_batches_equal_the_plain_fold(spark, seed):
    rnd = random.Random(seed)
    keys, target = rnd.choice([1, 3, 30]), rnd.choice([1, 20, 100, 1000])
    rows = [(f"k{rnd.randrange(keys)}", f"f{i:04d}", rnd.choice([0, 1, rnd.randint(0, 60)]))
            for i in range(rnd.randint(40, 160))]
    files = spark.createDataFrame(rows, "key string, file string, size_bytes long")
    want = greedy(rows, target)
    for block in (1000, 23):
        got = {}
        for r in compaction_batches(files, target, by="key", block_files=block).collect():
            got.setdefault(r["batch"], []).append(r["file"])
        assert {n: sorted(names) for n, names in got.items()} == {
            n: sorted(names) for n, names in want.items()}


def test_blocks_are_chained_by_few_jobs(spark, monkeypatch):
    """A hundred blocks take no more jobs than ten; a bound on what the driver takes at once changes nothing."""
    rnd = random.Random(5)
    rows = [("", f"f{i:04d}", rnd.randint(0, 60)) for i in range(400)]
    files = spark.createDataFrame(rows, "key string, file string, size_bytes long").coalesce(1)
    tracker, want, jobs = spark.sparkContext.statusTracker(), greedy(rows, 500), {}
    for block, taken in ((40, 50_000), (4, 50_000), (40, 1)):
        monkeypatch.setattr(compaction, "PASSAGES", taken)
        spark.sparkContext.setJobGroup(f"blocks-{block}-{taken}", "")
        got = {}
        for r in compaction_batches(files, 500, block_files=block).collect():
            got.setdefault(r["batch"], set()).add(r["file"])
        jobs[block, taken] = len(tracker.getJobIdsForGroup(f"blocks-{block}-{taken}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == {n: set(names) for n, names in want.items()}
    assert jobs[4, 50_000] <= jobs[40, 50_000] + 1 < jobs[40, 1]


def test_batch_target_must_be_positive(spark):
    with pytest.raises(ValueError):
        compaction_batches(spark.createDataFrame([("f", 1)], "file string, size_bytes long"), 0)


def test_candidates(spark):
    t = at("00:00:00")
    listed = manifest_row(spark, [
        (name, t, t, 1, ["p"], size) for name, size in
        [("a", 10), ("b", 11), ("compact-x/batch=1/c", 1), ("d", 5)]])
    def names(**kw):
        return sorted(r["file"] for r in compaction_candidates(listed, **kw).collect())
    assert names(max_bytes=10) == ["a", "d"]
    assert names(max_bytes=0) == ["a", "b", "d"]
    assert names(max_bytes=10, active=["d"]) == ["a"]


def test_compaction(spark, table):
    logs = some_logs(spark, n=300, parts=6)
    table.append(logs)
    sizes = [f.stat().st_size for f in data_files(table)]
    result = table.compact(target_bytes=2 * max(sizes) + 1, delete_now=True)
    assert result["merged"] == 2 and result["source_files"] == 6 and result["rows"] == 300
    assert result["bytes_freed"] == sum(sizes)
    assert plain(table.read()) == plain(logs)
    files = data_files(table)
    assert len(files) == 2 and table.audit().count() == 0
    for path in files:
        stamps = pq.read_table(path)["timestamp"].to_pylist()
        assert stamps == sorted(stamps)
    again = table.compact(target_bytes=2 * max(sizes) + 1)
    assert (again["merged"], again["scanned"]) == (0, 0)
    oversized = LogTable(spark, table.root + "-2")
    oversized.append(logs)
    result = oversized.compact(max_bytes=1)
    assert (result["merged"], result["skipped"]) == (0, 6)


def test_large_batches_are_sorted_by_ranges(spark, table, monkeypatch):
    """No task sorts a whole batch of very many rows; it is still one file in the order of time, ties by source."""
    logs = some_logs(spark, n=600, parts=6)
    table.append(logs)
    table.append(logs.withColumn("timestamp", F.lit(at("05:00:00"))).repartition(5), unit="ties")
    small = LogTable(spark, table.root + "-2")
    for name in ("a", "b"):
        small.append(some_logs(spark, n=20, parts=1), unit=name)
    other = LogTable(spark, table.root + "-3")
    for k, n in enumerate((5, 6, 40, 45)):
        other.append(some_logs(spark, n=n, parts=1), unit=f"u{k}")
    want = {t: plain(t.read()) for t in (table, small, other)}
    monkeypatch.setattr("logmere.table.log_table.MERGE_ROWS", 50)
    sorts, plain_sort = [], DataFrame.sortWithinPartitions

    def sort(frame, *columns):
        sorts.append([r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()])
        return plain_sort(frame, *columns)

    monkeypatch.setattr(DataFrame, "sortWithinPartitions", sort)
    assert table.compact(delete_now=True)["merged"] == 1
    assert max(max(s) for s in sorts) < 300 and sum(sorts[-1]) == 1200
    assert small.compact(delete_now=True)["merged"] == 1
    entries = {r["file"]: r["size_bytes"] for r in other.manifest().collect()}
    first = sum(n for f, n in entries.items() if f.startswith(("u0", "u1")))
    assert other.compact(target_bytes=first, delete_now=True)["merged"] == 2
    for t, files in ((table, 1), (small, 1), (other, 2)):
        assert plain(t.read()) == want[t] and t.audit().count() == 0 and len(data_files(t)) == files
        for file in data_files(t):
            stamps = pq.read_table(file)["timestamp"].to_pylist()
            assert stamps == sorted(stamps)


def test_compaction_leaves_damaged_files_alone(spark, table):
    logs = some_logs(spark, n=300, parts=6)
    table.append(logs)
    bad = data_files(table)[2]
    bad.write_bytes(bad.read_bytes()[:-30])
    expected = plain(table.read(tolerate_corrupt=True))
    result = table.compact(wave=1)
    assert (result["merged"], result["source_files"], result["skipped"]) == (1, 5, 1)
    assert bad.exists() and plain(table.read(tolerate_corrupt=True)) == expected


def test_compaction_in_waves_by_day(spark, table):
    logs = some_logs(spark, n=300, parts=1).repartitionByRange(12, "timestamp")
    table.append(logs)
    days = table.manifest().groupBy(F.to_date("started").alias("day")).count()
    shared = days.filter("count > 1").count()
    result = table.compact(by=F.to_date("started"), wave=1)
    assert result["merged"] == shared >= 2
    assert plain(table.read()) == plain(logs)


def test_stable_order_of_equal_times(spark, table, make_logs):
    for message in "cab":
        rows = [(hour, "p", "l", "INFO", message) for hour in ("12:00:00", "11:00:00")]
        table.append(make_logs(rows), unit=f"u-{len(data_files(table))}")
    table.compact(delete_now=True)
    (path,) = data_files(table)
    assert pq.read_table(path)["message"].to_pylist() == list("cabcab")


def wire_file(folder, name, lines):
    Path(folder).mkdir(exist_ok=True)
    Path(folder, name).write_text("".join(line + "\n" for line in lines))


def test_stream_ingest(spark, table, tmp_path):
    """Shuffled times, junk between, two runs over one checkpoint."""
    logs = some_logs(spark, n=120)
    wire, checkpoint = str(tmp_path / "wire"), str(tmp_path / "checkpoint")

    def run():
        records = read_wire(spark, wire, options={"maxFilesPerTrigger": "2"})
        ingest(records, table, checkpoint, available_now=True).awaitTermination()

    write_wire(encode(logs), wire)
    wire_file(wire, "junk.txt", ["junk", '{"project":"p"}'])
    run()
    assert plain(table.read()) == plain(logs)
    assert sorted(r["reason"] for r in table.dead_letters().collect()) == [
        "decode json", "decode: logid is required"]
    version = table.snapshot().version
    run()
    assert table.snapshot().version == version
    wire_file(wire, "late.txt", ['{"project":"p","logid":"l","level":"INFO"}'])
    run()
    assert table.read().count() == 121
    assert table.audit().count() == 0


def test_replayed_batch_changes_nothing(spark, table, tmp_path):
    wire_file(tmp_path / "wire", "a.txt", ['{"project":"p","logid":"l","level":"INFO"}', "junk"])
    records = read_wire(spark, str(tmp_path / "wire"), stream=False)
    # A first attempt that died after writing, before its commit.
    table.write_unit(some_logs(spark, n=5), "logs-s-000000000000")
    spark.createDataFrame([("junk",)], "value string").write.parquet(
        f"{table.root}/errors/logs-s-000000000001"
    )
    first = ingest_batch(table, records, "s", 0)
    rows = plain(table.read())
    assert len(rows) == 1
    assert {r["finding"] for r in table.audit().collect()} == {"unindexed_file"}
    assert ingest_batch(table, records, "s", 0) == first
    assert plain(table.read()) == rows and table.dead_letters().count() == 1
    assert ingest_batch(table, records.filter("false"), "s", 1) == first
    assert first.summary["records"] == {"decoded": 1, "decode json": 1}


def test_only_junk_writes_no_log_file(spark, table, tmp_path):
    wire_file(tmp_path / "wire", "a.txt", ["junk"])
    ingest_batch(table, read_wire(spark, str(tmp_path / "wire"), stream=False), "s", 0)
    assert not Path(table.root, "data").exists() and table.dead_letters().count() == 1


def test_stream_batch_is_written_to_few_files(spark, tmp_path):
    wire = str(tmp_path / "wire")
    write_wire(encode(some_logs(spark, n=200, parts=8)), wire)
    records = read_wire(spark, wire, stream=False)
    for rows, files in ((1000, 1), (100, 2)):
        layout = FileLayout(stream_rows_per_file=rows)
        table = LogTable(spark, str(tmp_path / f"t{rows}"), layout)
        ingest_batch(table, records, "s", 0)
        assert table.manifest().count() == files and table.read().count() == 200


def test_rows_per_file(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), FileLayout(max_rows_per_file=50))
    table.append(some_logs(spark, n=200, parts=1))
    assert [r["row_count"] for r in table.manifest().collect()] == [50] * 4


def test_catalogue(spark, table, make_logs):
    table.append(make_logs([("12:00:00", p, "l", "INFO") for p in ["b", "", "a", "b", "Cx"]]))
    table.append(make_logs([("13:00:00", "a", "l", "INFO")]))
    listed = table.manifest()
    assert [r[0] for r in listing.list_projects(listed).collect()] == ["Cx", "a", "b"]
    assert [r[0] for r in listing.suggest_projects(listed, "X").collect()] == ["Cx"]
    assert [r[0] for r in listing.suggest_projects(listed, "").collect()] == ["Cx", "a", "b"]
    assert listing.suggest_projects(listed, "%").count() == 0
    starts = [r["started"] for r in listing.list_files(listed).collect()]
    assert starts == sorted(starts, reverse=True)


def spread_out(spark, n=900):
    """Rows over some hours, from two projects."""
    moment = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 11)
    return spark.range(n).select(
        moment.alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "quay").otherwise("yard").alias("project"),
        F.concat(F.lit("crate-"), F.col("id").cast("string")).alias("logid"),
        F.lit("INFO").alias("level"),
        F.lit("moved").alias("message"),
        F.lit("").alias("caller"),
    )


def test_total_reads_files_at_the_edges_only(spark, table):
    logs = spread_out(spark)
    table.append(logs.repartitionByRange(9, "timestamp"))
    whole = table.total(LogQuery(project="quay"))
    assert whole.head()["count"] == 300
    assert not any("/data/" in path for path in whole.inputFiles())
    start = datetime.fromtimestamp(1_700_000_000 + 11 * 150, timezone.utc)
    end = datetime.fromtimestamp(1_700_000_000 + 11 * 720, timezone.utc)
    query = LogQuery(project="quay", start=start, end=end)
    part = table.total(query)
    assert part.head()["count"] == query.matching(logs).count()
    assert 1 <= sum("/data/" in path for path in part.inputFiles()) <= 2
    assert table.total(LogQuery(logid="crate-7")).head()["count"] == 1
    assert table.total(LogQuery(project="nobody")).head()["count"] == 0


def test_total_with_entries_of_the_older_kind(spark, table):
    logs = spread_out(spark, 60)
    unit = table.write_unit(logs.repartition(2), "old")
    unit = unit.withColumn("project_rows", F.lit(None).cast("map<string,bigint>"))
    table.log.commit(table.snapshot(), unit)
    assert table.manifest().filter("project_rows is null").count() == 2
    assert table.total(LogQuery(project="quay")).head()["count"] == 20
    assert table.lookup(LogQuery(project="quay", limit=5, offset=2)).head()["count"] == 20


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("sorted_files", [True, False])
def test_table_walk(spark, table, order, sorted_files, monkeypatch):
    monkeypatch.setattr(paging, "PAGES_AT_ONCE", 3)
    logs = spread_out(spark)
    table.append(logs.repartitionByRange(9, "timestamp") if sorted_files else logs.repartition(4))
    query = LogQuery(project="quay", order=order, offset=11)
    want = paging.sort_logs(query.matching(logs), order != "asc").collect()[11:]
    pages = list(table.walk(query, page_size=40))
    table.append(spread_out(spark, 50))
    got = [page.collect() for page in pages]
    assert [len(rows) for rows in got] == [40] * 7 + [9]
    assert [tuple(r) for rows in got for r in rows] == [tuple(r) for r in want]
    found = table.lookup(LogQuery(project="yard", offset=30, limit=7)).head()
    assert found["count"] == 600 + 33 and len(found["results"]) == 7


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_walk_written_at_once(spark, table, tmp_path, order, monkeypatch):
    """As many jobs for many pages as for few, each page a file of its own, in order."""
    monkeypatch.setattr("logmere.table.log_table.PAGES_PER_TASK", 4)
    logs = spread_out(spark)
    table.append(logs.repartition(4))
    query = LogQuery(project="quay", order=order, offset=11)
    want = [tuple(r) for r in paging.sort_logs(query.matching(logs), order != "asc").collect()[11:]]
    tracker = spark.sparkContext.statusTracker()

    def jobs(page_size):
        spark.sparkContext.setJobGroup(f"walk-{order}-{page_size}", "")
        pages = table.walk(query, page_size=page_size).write(str(tmp_path / f"pages-{page_size}"))
        found = len(tracker.getJobIdsForGroup(f"walk-{order}-{page_size}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return pages, found

    pages, many = jobs(7)
    files = sorted((tmp_path / "pages-7").rglob("*.parquet"), key=lambda f: int(f.parent.name[5:]))
    written = [pq.read_table(f, partitioning=None).to_pylist() for f in files]
    assert [len(rows) for rows in written] == [len(want[k : k + 7]) for k in range(0, len(want), 7)]
    assert [tuple(r.values()) for rows in written for r in rows] == want
    assert sorted((r["page"], tuple(r)[:-1]) for r in pages.collect()) == sorted((k // 7, r) for k, r in enumerate(want))
    assert many <= jobs(200)[1] + 4 < len(written)


def test_a_page_reads_messages_of_its_own_rows_only(spark, table):
    table.append(spread_out(spark).repartitionByRange(9, "timestamp"))
    page = next(table.walk(LogQuery(project="quay"), page_size=20))
    plan = full_plan(page)
    assert len(page.inputFiles()) == 1 and "message" in plan
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThanOrEqual(timestamp" in plan
    assert page.count() == 20



def test_files_are_listed_by_groups_of_units(spark, table):
    assert table.files_on_disk().count() == 0
    for _ in range(5):
        table.append(some_logs(spark, n=20, parts=2))
    whole = {tuple(r) for r in table.files_on_disk().collect()}
    table.units_per_listing = 2
    assert {tuple(r) for r in table.files_on_disk().collect()} == whole and len(whole) == 10
    assert table.audit().count() == 0
