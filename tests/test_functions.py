"""Expressions and reports."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import at
from logmere.functions import (
    default_logid,
    instant_from_wall,
    level_name,
    level_ordinal,
    logid_minute,
    make_logid,
    parse_level,
    severity_to_level,
    split_caller,
    wall_from_instant,
)
from logmere.operators import reports


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).head())


def values(spark, make, given, ddl):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(given)], f"i int, v {ddl}")
    return [r["r"] for r in frame.orderBy("i").select(make(F.col("v")).alias("r")).collect()]


def test_levels(spark):
    names = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
    assert values(spark, level_ordinal, names + ["bogus", None, "info"], "string") == [
        0, 1, 2, 3, 4, 1, 1, 1]
    assert values(spark, level_name, [0, 1, 2, 3, 4, 5, -1], "int") == names + ["INFO"] * 2
    got = values(spark, parse_level, names + ["bogus", "warn", "", None], "string")
    assert [tuple(r) for r in got] == [(n, True) for n in names] + [("INFO", False)] * 4


def test_severity_schemes(spark):
    got = values(spark, lambda c: severity_to_level(c, "python"), [10, 20, 30, 40, 50, 35, 0], "int")
    assert got == ["DEBUG", "INFO", "WARN", "ERROR", "FATAL", "INFO", "INFO"]
    got = values(spark, lambda c: severity_to_level(c, "slog"), [-4, -1, 0, 3, 4, 7, 8, 12], "int")
    assert got == ["DEBUG", "DEBUG", "INFO", "INFO", "WARN", "WARN", "ERROR", "ERROR"]
    with pytest.raises(ValueError):
        severity_to_level(F.lit(1), "syslog")


def test_logids(spark):
    assert values(spark, lambda c: default_logid(c, "-"), ["a", "", None], "string") == ["a", "-", "-"]
    wall = F.lit("2026-10-05 14:30:59.999999").cast("timestamp_ntz")
    made, again, other = one(
        spark,
        make_logid(wall, F.lit(1)).alias("a"),
        make_logid(wall, F.lit(1)).alias("b"),
        make_logid(wall, F.lit(2)).alias("c"),
    )
    assert made == again != other
    assert re.fullmatch(r"20261005-1430-[0-9a-z]{6}", made)
    got = values(
        spark, logid_minute,
        ["20261005-1430-k3f9qz", "20260230-1430-k3f9qz", "20261005-2460-k3f9qz",
         "20261005-1430-K3F9QZ", "20261005-1430-k3f9qz\n", "x20261005-1430-k3f9qz", "", None],
        "string",
    )
    assert got == [datetime(2026, 10, 5, 14, 30)] + [None] * 7


def test_split_caller(spark):
    given = ["a.py:7", "C:\\x:y.py:12", "a.py", ":5", "a.py:", "", None]
    got = values(spark, split_caller, given, "string")
    assert [tuple(r) for r in got] == [
        ("a.py", 7), ("C:\\x:y.py", 12), (None, None), ("", 5), (None, None), (None, None), (None, None)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kathmandu"])
def test_clock_ignores_the_session_zone(spark, zone):
    texts = ["2026-03-08 02:30:00", "2026-11-01 01:30:00.000001", "1969-12-31 23:59:59.999999",
             "0001-01-01 00:00:00", "9999-12-31 23:59:59.999999"]
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        frame = spark.createDataFrame([(t,) for t in texts], "t string")
        wall = F.col("t").cast("timestamp_ntz")
        back = wall_from_instant(instant_from_wall(wall))
        assert frame.filter(wall != back).count() == 0
        exact = F.concat(F.col("t"), F.lit("Z")).cast("timestamp")
        assert frame.filter(instant_from_wall(wall) != exact).count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_age_histogram(make_logs):
    now = at("2026-01-10T00:00:00")
    times = ["2026-01-10T00:00:01", "2026-01-10T00:00:00", "2026-01-09T23:59:00.500000",
             "2026-01-09T23:59:00", "2026-01-09T23:00:00.000001", "2026-01-09T23:00:00",
             "2026-01-09T00:00:00", "2026-01-07T00:00:01"]
    logs = make_logs([(t, "p", "l", "INFO") for t in times])
    got = {(r["unit"], r["age"]): r["rows"] for r in reports.age_histogram(logs, now).collect()}
    assert got == {("s", 0): 2, ("s", 59): 1, ("m", 1): 1, ("m", 59): 1, ("h", 1): 1,
                   ("d", 1): 1, ("d", 2): 1}


def test_volume_counts_bytes_not_characters(make_logs):
    logs = make_logs([("12:00:00", "pé", "l", "INFO", "漢", "not counted")])
    row = reports.volume(logs).head()
    assert (row["rows"], row["bytes"]) == (1, 16 + 3 + 1 + 4 + 3)


def test_reconcile_tells_who_is_short(spark, make_logs):
    boats, crates = ["ferry", "barge"], [f"crate-{i}" for i in range(3)]
    logs = make_logs([
        (f"05:00:00.{i:06d}", boats[i % 2], crates[i % 3], "INFO") for i in range(301)])
    shares = reports.even_shares(boats, crates, 301)
    expected = spark.createDataFrame(shares, "kind string, name string, want long")
    got = {(r["kind"], r["name"]): (r["want"], r["got"], r["short"])
           for r in reports.reconcile(logs, expected).collect()}
    assert got[("project", "ferry")] == (150, 151, False)
    assert got[("logid", "crate-2")] == (100, 100, False)
    fewer = {(r["kind"], r["name"]): r["short"]
             for r in reports.reconcile(logs.filter("logid <> 'crate-1'"), expected).collect()}
    assert fewer[("logid", "crate-1")] and not fewer[("logid", "crate-2")]


def test_enrich(make_logs):
    logs = make_logs([("12:00:00", "p", "20260101-1200-abcdef", "ERROR", "m", "a.py:3")])
    row = reports.enrich(logs).head()
    assert (row["level_no"], row["logid_minute"], row["caller_file"], row["caller_line"]) == (
        3, datetime(2026, 1, 1, 12, 0), "a.py", 3)


def test_distinct_projects_drop_empty(make_logs):
    from logmere.operators.manifest import distinct_projects

    logs = make_logs([("12:00:00", p, "l", "INFO") for p in ["c", "", "a", "b", "a"]])
    assert logs.agg(distinct_projects(F.col("project"))).head()[0] == ["a", "b", "c"]
