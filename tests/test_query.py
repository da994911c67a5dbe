"""Parameter rules, predicates, look-ups, pages, live tail."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from conftest import at, full_plan, plain
from logmere.operators import combine, filters, paging, seek
from logmere.plans.query import LogQuery
from logmere.schema import LOG_COLUMNS, LOG_SCHEMA

# (time, project, logid, level); two projects share a logid, two rows a time.
SHIPMENTS = [
    ("08:30:00", "dock", "box-17", "WARN"),
    ("07:15:00", "crane", "box-17", "DEBUG"),
    ("08:30:00", "dock", "box-02", "FATAL"),
    ("09:45:00", "crane", "box-40", "INFO"),
    ("06:00:00", "dock", "box-40", "INFO"),
]


def found(frame):
    row = frame.head()
    return row["count"], [tuple(r) for r in row["results"]]


@pytest.mark.parametrize(
    "params, message",
    [
        ({}, "names a project or a logid"),
        ({"level": "INFO"}, "names a project or a logid"),
        ({"project": "p", "from": "yesterday"}, "parameter 'from'"),
        ({"project": "p", "to": "2026-01-01"}, "parameter 'to'"),
        ({"project": "p", "to": "2026-01-01T00:00:00+25:00"}, "parameter 'to'"),
        ({"project": "p", "limit": "0"}, "parameter 'limit'"),
        ({"project": "p", "limit": "ten"}, "parameter 'limit'"),
        ({"project": "p", "limit": "1.5"}, "parameter 'limit'"),
        ({"project": "p", "offset": "-1"}, "parameter 'offset'"),
        ({"project": "p", "order": "up"}, "order is asc or desc"),
    ],
)
def test_refused_parameters(params, message):
    with pytest.raises(ValueError, match=message):
        LogQuery.parse(params)


def test_accepted_parameters():
    query = LogQuery.parse(
        {"project": "p", "from": "2026-01-01T02:00:00+02:00", "limit": "5000", "offset": "7",
         "order": "asc", "to": "0001-01-01T00:00:00Z"}
    )
    assert query.start == datetime(2026, 1, 1, tzinfo=timezone.utc)
    assert query.end is None
    assert (query.page_limit, query.page_offset, query.newest_first) == (1000, 7, False)
    assert LogQuery.parse({"logid": "x"}).page_limit == 100
    assert LogQuery(project="p", limit=-5, offset=-3).page_limit == 100
    assert LogQuery(project="p", limit=-5, offset=-3).page_offset == 0


def test_lookup_totals_and_pages(make_logs):
    logs = make_logs(SHIPMENTS)

    def boxes(**request):
        count, rows = found(paging.lookup(logs, LogQuery(**request)))
        return count, [r[2] for r in rows]

    assert boxes(project="dock") == (3, ["box-02", "box-17", "box-40"])
    assert boxes(project="dock", order="asc") == (3, ["box-40", "box-02", "box-17"])
    for at_row in range(4):
        want = ["box-02", "box-17", "box-40"][at_row : at_row + 1]
        assert boxes(project="dock", limit=1, offset=at_row) == (3, want)
    assert boxes(logid="box-40", level="INFO")[0] == 2
    assert boxes(logid="box-17", project="crane") == (1, ["box-17"])
    assert boxes(project="nowhere") == (0, [])
    assert boxes()[0] == len(SHIPMENTS)


def test_level_is_exact_and_min_level_is_a_threshold(make_logs):
    levels = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL", "bogus"]
    logs = make_logs([("12:00:00", "p", "l", level) for level in levels])
    assert [r[3] for r in plain(filters.by_level(logs, "WARN"))] == ["WARN"]
    kept = {r[3] for r in plain(filters.min_level(logs, "WARN"))}
    assert kept == {"WARN", "ERROR", "FATAL"}
    assert {r[3] for r in plain(filters.min_level(logs, "INFO"))} == set(levels) - {"DEBUG"}
    assert filters.min_level(logs, "bogus").count() == 5


def test_time_range_includes_both_ends(make_logs):
    logs = make_logs(SHIPMENTS)
    times = lambda *ends: [r[0][11:16] for r in plain(filters.time_range(logs, *ends))]
    micro = timedelta(microseconds=1)
    assert times(at("07:15:00"), at("08:30:00")) == ["07:15", "08:30", "08:30"]
    assert times(at("07:15:00") + micro, at("08:30:00") - micro) == []
    assert times(None, at("07:15:00")) == ["06:00", "07:15"]
    assert len(times()) == 5


def test_presets(make_logs):
    now = at("09:45:00")
    assert filters.preset_window("6h", now) == (at("03:45:00"), now)
    assert filters.preset_window("custom", now) == (None, None)
    with pytest.raises(ValueError):
        filters.preset_window("2h", now)
    early = [("2025-12-30T10:00:00", "p", "l", "INFO"), ("2025-12-31T10:00:00", "p", "l", "INFO")]
    logs = make_logs(SHIPMENTS + early + [("09:45:01", "p", "l", "INFO")])
    assert dict(plain(filters.preset_counts(logs, now))) == {
        "15m": 1, "1h": 1, "6h": 5, "24h": 6, "72h": 7}


def many(spark, seed, n=240, copies=60):
    """Rows with shared times and, for a quarter of them, whole copies."""
    rnd = random.Random(seed)
    rows = [
        (at("00:00:00") + timedelta(seconds=rnd.randrange(40)), rnd.choice("pq"),
         f"l{rnd.randrange(3)}", rnd.choice(["INFO", "WARN"]), f"m{rnd.randrange(3)}", "")
        for _ in range(n)
    ]
    rows += [rows[0]] * copies
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, LOG_SCHEMA).repartition(5)


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("wall", [False, True])
def test_walk_gives_the_whole_order(spark, order, wall):
    logs = many(spark, 3)
    if wall:
        from logmere.functions import wall_from_instant

        logs = logs.withColumn("timestamp", wall_from_instant(F.col("timestamp")))
    query = LogQuery(project="p", order=order)
    want = [tuple(r) for r in paging.sort_logs(query.matching(logs), order != "asc").collect()]
    for size in (13, len(want)):
        pages = list(paging.walk(logs, query, page_size=size))
        assert [tuple(r) for page in pages for r in page] == want
        assert all(len(page) == size for page in pages[:-1])


def test_walk_through_copies_only(spark):
    row = (at("00:00:00"), "p", "l", "INFO", "m", "c")
    logs = spark.createDataFrame([row] * 10, LOG_SCHEMA)
    sizes = [len(page) for page in paging.walk(logs, LogQuery(project="p"), page_size=4)]
    assert sizes == [4, 4, 2]


@pytest.mark.parametrize("order", ["asc", "desc"])
@pytest.mark.parametrize("few", [0, 7, 20_000])
def test_page_is_that_of_the_whole_order(spark, order, few, monkeypatch):
    monkeypatch.setattr(seek, "SORTED_ROWS", few)
    logs = many(spark, 5)
    whole = [tuple(r) for r in paging.sort_logs(logs, order != "asc").collect()]
    for offset in (0, 130, 291, 299, 5000):
        query = LogQuery(logid="", project="", offset=offset, limit=9, order=order)
        assert [tuple(r) for r in paging.page(logs, query).collect()] == whole[offset : offset + 9]


@pytest.mark.parametrize("order", ["asc", "desc"])
def test_page_of_very_many_times(spark, order, monkeypatch):
    """Times that lie close together in some places and far apart in others, and one that is hot."""
    monkeypatch.setattr(seek, "SORTED_ROWS", 50)
    number = F.col("id")
    micros = F.when(number % 5 < 3, F.lit(777_000_000)).otherwise(F.pow(F.col("id") % 10007, F.lit(3)))
    logs = spark.range(40_000).select(
        F.timestamp_micros(micros.cast("bigint")).alias("timestamp"),
        F.lit("p").alias("project"),
        number.cast("string").alias("logid"),
        *(F.lit("").alias(c) for c in LOG_COLUMNS[3:]),
    )
    monkeypatch.setattr(paging, "PART_ROWS", 5_000)
    whole = paging.sort_logs(logs, order != "asc").select("logid").collect()
    jobs = spark.sparkContext.statusTracker()
    hot = next(k for k, r in enumerate(whole) if int(r[0]) % 5 < 3)
    for offset in (0, 9_000, hot - 3, hot + 23_990, 39_990):
        query = LogQuery(project="p", offset=offset, limit=20, order=order)
        spark.sparkContext.setJobGroup(f"page{offset}{order}", "")
        got = paging.page(logs, query).select("logid").collect()
        assert got == whole[offset : offset + 20]
        assert len(jobs.getJobIdsForGroup(f"page{offset}{order}")) < 40


def test_rows_without_a_time(spark):
    rows = [(None, "p", str(k), "", "", "") for k in range(5)]
    rows += [(at("00:00:00") + timedelta(seconds=k), "p", "t", "", "", "") for k in range(5)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    for order in ("asc", "desc"):
        whole = [tuple(r) for r in paging.sort_logs(logs, order != "asc").collect()]
        for offset in (0, 3, 6):
            query = LogQuery(project="p", offset=offset, limit=3, order=order)
            assert [tuple(r) for r in paging.page(logs, query).collect()] == whole[offset : offset + 3]


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_deep_page_among_rows_of_one_time(spark, monkeypatch):
    """Most rows share a time, and half of those are copies of one row."""
    monkeypatch.setattr(seek, "SORTED_ROWS", 40)
    monkeypatch.setattr(paging, "PART_ROWS", 25)
    rnd = random.Random(9)
    same = [(at("00:00:00"), "p", f"l{rnd.randrange(50)}", "INFO", "m", "") for _ in range(150)]
    same += [(at("00:00:00"), "p", "l7", "INFO", "m", "")] * 150
    other = [(at(f"00:00:{s:02d}"), "p", "l", "INFO", "m", "") for s in range(1, 40)]
    logs = spark.createDataFrame(same + other, LOG_SCHEMA).repartition(4)
    for order in ("asc", "desc"):
        whole = paging.sort_logs(logs, order != "asc").collect()
        for offset in (60, 290):
            query = LogQuery(offset=offset, limit=30, order=order)
            got = paging.page(logs, query).collect()
            assert [tuple(r) for r in got] == [tuple(r) for r in whole[offset : offset + 30]]


def test_live_tail(spark, monkeypatch):
    logs = many(spark, 7)
    want = []
    for project in "pq":
        rows = paging.sort_logs(filters.by_project(logs, project)).limit(5).collect()
        want += [(*r, i + 1) for i, r in enumerate(rows)]
    assert rows_of(paging.live_tail(logs, 5)) == sorted(want, key=repr)
    monkeypatch.setattr(paging, "GROUP_LIMIT_ROWS", 2)
    assert rows_of(paging.live_tail(logs, 5)) == sorted(want, key=repr)


def test_union_keeps_copies_and_fills_caller(make_logs):
    logs = make_logs(SHIPMENTS)
    both = combine.union_sources(logs.drop("caller"), logs)
    assert both.columns == LOG_COLUMNS and both.count() == 2 * len(SHIPMENTS)
    assert both.filter("caller is null").count() == 0


def test_merge_unique_keeps_the_first_arrival(spark):
    rows = [
        (at("12:00:00"), "p", "l", "INFO", "m", "a", 2),
        (at("12:00:00"), "p", "l", "WARN", "m", "b", 1),
        (at("12:00:00"), "p", "l", "WARN", "other", "c", 3),
        (at("12:00:00"), "p|l", "", "WARN", "m", "d", 4),
    ]
    ddl = ", ".join(["timestamp timestamp"] + [f"{n} string" for n in LOG_COLUMNS[1:]] + ["n int"])
    logs = spark.createDataFrame(rows, ddl).repartition(3)
    got = {r[5] for r in plain(combine.merge_unique(logs, ["n"]))}
    assert got == {"b", "c", "d"}


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, tmp_path, make_logs):
    make_logs(SHIPMENTS).write.parquet(str(tmp_path / "t"))
    from logmere.sources import read_logs

    logs = read_logs(spark, str(tmp_path / "t"))
    query = LogQuery(project="dock", start=at("06:00:00"), end=at("08:30:00"), offset=1, limit=1)
    plan = plan_of(paging.page(logs, query))
    assert "TakeOrderedAndProject(limit=2, offset=1" in plan or "TakeOrderedAndProject(limit=1" in plan
    assert "EqualTo(project,dock)" in plan and "GreaterThanOrEqual(t" in plan
    whole = full_plan(paging.page(logs, query))
    assert "GreaterThanOrEqual(timestamp" in whole and "LessThanOrEqual(timestamp" in whole
    total = plan_of(query.matching(logs).agg(F.count(F.lit(1))))
    assert "ReadSchema: struct<timestamp:timestamp,project:string>" in total
    assert "In(level, [ERROR,FATAL])" in plan_of(filters.min_level(logs, "ERROR"))
    tail = plan_of(paging.live_tail(logs, 3))
    assert "WindowGroupLimit" in tail and "SinglePartition" not in tail


def test_walk_pages_goes_to_the_end(spark):
    """More than five pages."""
    from lakechecks.compare import connect, normal
    from lakechecks.oracles import ORACLES
    from lakechecks.queries import walk_pages

    folder = "/root/testdata/sf0.01"
    want = connect(folder).execute(ORACLES["walk_pages"]).df()
    got = walk_pages(spark, folder).toPandas()
    assert want["page"].max() > 5 and sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_walk_into_passes_runs_of_copies(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "p", "a", "INFO", "m", "")] * 11
    rows += [("2024-01-01 00:00:01", "p", "b", "INFO", str(k), "") for k in range(3)]
    names = ["timestamp", "project", "logid", "level", "message", "caller"]
    logs = spark.createDataFrame(rows, names).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    got = paging.walk_into(logs, LogQuery(project="p"), str(tmp_path / "pages"), page_size=4).collect()
    sizes = [sum(r["page"] == k for r in got) for k in range(4)]
    assert sizes == [4, 4, 4, 2] and [r["logid"] for r in got].count("b") == 3


def test_near_page_keeps_the_page_and_counts_the_rest(spark):
    """Whatever files there are, the page's rows are in those kept, and those passed over come before."""
    from logmere.operators import manifest as listing

    rnd = random.Random(4)
    for order in ("asc", "desc"):
        rows = []
        for file in range(30):
            start = rnd.randrange(500)
            for _ in range(rnd.randrange(1, 12)):
                moment = at("00:00:00") + timedelta(seconds=start + rnd.randrange(rnd.choice([2, 300])))
                rows.append((moment, rnd.choice("pq"), "l", "INFO", "m", "", f"f{file}"))
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LOG_SCHEMA) + ", file string"
        logs = spark.createDataFrame(rows, kinds).repartition(3).cache()
        manifest = listing.build_manifest(logs, F.col("file"), F.count(F.lit(1)), F.sum).cache()
        for window in ((None, None), (at("00:01:00"), at("00:06:00"))):
            query = LogQuery(project="p", start=window[0], end=window[1], order=order)
            whole = query.matching(logs).orderBy(*paging.order_columns(order != "asc")).collect()
            assert paging.lookup(logs, query).head()["count"] == len(whole)
            for offset in (0, 17, 40):
                files = listing.counted_files(manifest, query)
                near, skipped = listing.near_page(files, query, offset, 9)
                kept = {r["file"] for r in near.collect()}
                page = whole[offset : offset + 9]
                assert {r["file"] for r in page} <= kept
                ahead = [r for r in whole if r["file"] not in kept and r["timestamp"] != page[0]["timestamp"]
                         and whole.index(r) < offset]
                assert skipped == len(ahead) <= offset
