"""Strict decoding: one payload per rule, and the round trip."""

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import at, plain
from logmere.operators.decode import (
    backfill_timestamp,
    clean_rows,
    dead_letters,
    decode,
    ingest_stats,
)
from logmere.schema import LOG_COLUMNS, LOG_SCHEMA
from logmere.sources import encode

REST = '"logid":"l","level":"INFO"'
WHOLE = '{"project":"p",' + REST + "}"
NO_PROJECT = "decode: project is required"
NO_LOGID = "decode: logid is required"
NO_LEVEL = "decode: level is required"


def sent_at(text):
    return '{"project":"p",%s,"timestamp":%s}' % (REST, text)


# payload, then the reason it is refused or the fields expected of it
CASES = [
    (WHOLE, {"project": "p", "logid": "l", "level": "INFO", "message": "", "caller": ""}),
    ('{"project":"p",%s,"message":"hi","caller":"a.py:7"}' % REST,
     {"message": "hi", "caller": "a.py:7"}),
    (" \t\r\n" + WHOLE + " \n", {"project": "p"}),
    ('{"Project":"cs",%s}' % REST, {"project": "cs"}),
    ('{"PROJECT":"cs","LogID":"l","LEVEL":"WARN","meſſage":"long s"}',
     {"project": "cs", "level": "WARN", "message": "long s"}),
    ('{"project":"p","project":"q",%s}' % REST, {"project": "q"}),
    ('{"project":"p","Project":"q",%s}' % REST, {"project": "q"}),
    ('{"Project":"q","project":"p",%s}' % REST, {"project": "p"}),
    ('{"project":"p","PROJECT":null,%s}' % REST, {"project": "p"}),
    ('{"project":"p",%s,"message":null}' % REST, {"message": ""}),
    ('{"pro\\u006aect":"esc",%s}' % REST, {"project": "esc"}),
    ('{"pro\\u006aect":"a","project":"b",%s}' % REST, {"project": "b"}),
    ('{"project":"a","Pro\\u006aect":"b",%s}' % REST, {"project": "b"}),
    ('{"project":"a","pro\\u006aect":null,%s}' % REST, {"project": "a"}),
    ('{"project":"p","message":"caf\\u00e9 \\"x\\": 1",%s}' % REST, {"message": 'café "x": 1'}),
    ('{"project":"p","message":"] , \\" }",%s}' % REST, {"message": '] , " }'}),
    ('{"project":"p","message":"\\"project\\":5, \\"level\\": [",%s}' % REST,
     {"message": '"project":5, "level": [', "project": "p"}),
    ('{"project":"p","extra":{"project":5,"level":["x"]},%s}' % REST, {"project": "p"}),
    ('{"project":"p","extra":{"a":1,"a":2},%s}' % REST, {"project": "p"}),
    ('{"extra":{"a":1,"a":2},"project":null,%s}' % REST, NO_PROJECT),
    ('{"extra":{"a":1,"a":2},"project":7,%s}' % REST, "decode json"),
    ('{"project":"p","n":1e999,"m":[],"b":true,%s}' % REST, {"project": "p"}),
    ('{"project":"p","deep":%s,%s}' % ("[" * 1500 + "]" * 1500, REST), {"project": "p"}),
    ('{"project":"p","long":%s,%s}' % ("7" * 1500, REST), {"project": "p"}),
    ('{"project":"p","logid":"l","level":"VERBOSE"}', {"level": "VERBOSE"}),
    ('{"project":"5","logid":"2024-01-01","level":"true"}',
     {"project": "5", "logid": "2024-01-01", "level": "true"}),
    # not one JSON object
    ("not-json", "decode json"),
    ("", "decode json"),
    ("   ", "decode json"),
    (None, "decode json"),
    ("5", "decode json"),
    ("true", "decode json"),
    ('"x"', "decode json"),
    ("[1]", "decode json"),
    ("[]", "decode json"),
    ("[" + WHOLE + "]", "decode json"),
    (WHOLE[:-1], "decode json"),
    ("{'project':'p','logid':'l','level':'INFO'}", "decode json"),
    ('{"project":"p",%s,}' % REST, "decode json"),
    ('{"project":"p",%s,"x":NaN}' % REST, "decode json"),
    ('{"project":"p",%s,"x":012}' % REST, "decode json"),
    ('{"project":"tab\there",%s}' % REST, "decode json"),
    ('{"project":"p"/*c*/,%s}' % REST, "decode json"),
    (WHOLE + " x", "decode json"),
    (WHOLE + WHOLE, "decode json"),
    (WHOLE + "," + WHOLE, "decode json"),
    ("null," + WHOLE, "decode json"),
    (WHOLE + "]", "decode json"),
    (WHOLE + "}", "decode json"),
    (WHOLE + "],[" + WHOLE, "decode json"),
    (WHOLE + ',{"nonce":1}]', "decode json"),
    # fields of another type
    ('{"project":5,%s}' % REST, "decode json"),
    ('{"project":true,%s}' % REST, "decode json"),
    ('{"project":{"a":"b"},%s}' % REST, "decode json"),
    ('{"project":["p"],%s}' % REST, "decode json"),
    ('{"project":5,"project":"p",%s}' % REST, "decode json"),
    # missing fields, in the order they are checked
    ("null", NO_PROJECT),
    (" null ", NO_PROJECT),
    ("{}", NO_PROJECT),
    ("{%s}" % REST, NO_PROJECT),
    ('{"project":"",%s}' % REST, NO_PROJECT),
    ('{"project":"p","level":"INFO"}', NO_LOGID),
    ('{"project":"p","logid":"","level":""}', NO_LOGID),
    ('{"project":"p","logid":"l"}', NO_LEVEL),
    # times
    (sent_at("null"), {"timestamp": None}),
    (sent_at('"0001-01-01T00:00:00Z"'), {"timestamp": "0001-01-01 00:00:00"}),
    (sent_at('"2026-09-06T10:11:12Z"'), {"timestamp": "2026-09-06 10:11:12"}),
    (sent_at('"2026-09-06T10:11:12+00:00"'), {"timestamp": "2026-09-06 10:11:12"}),
    (sent_at('"2026-09-06T10:11:12+02:00"'), {"timestamp": "2026-09-06 08:11:12"}),
    (sent_at('"2026-09-06T10:11:12-23:30"'), {"timestamp": "2026-09-07 09:41:12"}),
    (sent_at('"2026-09-06T10:11:12.5Z"'), {"timestamp": "2026-09-06 10:11:12.5"}),
    (sent_at('"2026-09-06T10:11:12.123456+00:00"'), {"timestamp": "2026-09-06 10:11:12.123456"}),
    (sent_at('"2026-09-06T10:11:12.123456789Z"'), {"timestamp": "2026-09-06 10:11:12.123456"}),
    (sent_at('"2026-09-06T1:11:12Z"'), {"timestamp": "2026-09-06 01:11:12"}),
    (sent_at('"2026-09-06T10:11:12,25Z"'), {"timestamp": "2026-09-06 10:11:12.25"}),
    (sent_at('""'), "decode json"),
    (sent_at('"2026-09-06"'), "decode json"),
    (sent_at('"2026-09-06 10:11:12Z"'), "decode json"),
    (sent_at('"2026-09-06T10:11:12"'), "decode json"),
    (sent_at('"2026-02-30T10:11:12Z"'), "decode json"),
    (sent_at('"2026-09-06T24:00:00Z"'), "decode json"),
    (sent_at('"2026-09-06T10:11:12+25:00"'), "decode json"),
    (sent_at('"2026-09-06T10:11:12Z\\n"'), "decode json"),
    (sent_at("1756944000"), "decode json"),
]


@pytest.fixture(scope="module")
def decoded(spark):
    raw = spark.createDataFrame(
        [(i, case[0]) for i, case in enumerate(CASES)], "number int, value string"
    )
    rows = decode(raw).withColumn("timestamp", F.col("timestamp").cast("string"))
    spark_zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    try:
        return {r["number"]: r.asDict() for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", spark_zone)


@pytest.mark.parametrize("number", range(len(CASES)), ids=lambda n: repr(CASES[n][0])[:60])
def test_case(decoded, number):
    want, got = CASES[number][1], decoded[number]
    if isinstance(want, str):
        assert got["reason"] == want
    else:
        assert got["reason"] is None
        assert {name: got[name] for name in want} == want


def test_backfill_fills_missing_and_zero_only(spark):
    now = at("2026-02-01T00:00:00")
    raw = spark.createDataFrame(
        [(sent_at("null"),), (sent_at('"0001-01-01T02:00:00+02:00"'),),
         (sent_at('"2026-01-01T00:00:00Z"'),)], "value string"
    )
    got = [r[0] for r in plain(clean_rows(decode(raw), now))]
    assert got == ["2026-01-01 00:00:00"] + ["2026-02-01 00:00:00"] * 2


def test_backfill_takes_arrival_column(spark):
    raw = spark.createDataFrame(
        [(WHOLE, at("00:00:05"))], "value string, received_at timestamp"
    )
    logs = backfill_timestamp(decode(raw), F.col("received_at"))
    assert plain(logs.select("timestamp")) == [("2026-01-01 00:00:05",)]


def test_dead_letters_and_stats(spark):
    raw = spark.createDataFrame(
        [("t", 0, 1, at("00:00:00"), "junk"), ("t", 0, 2, at("00:00:00"), WHOLE),
         ("t", 1, 9, at("00:00:00"), "{}")],
        "source string, partition int, offset long, received_at timestamp, value string",
    )
    got = decode(raw)
    letters = {(r["partition"], r["offset"], r["value"], r["reason"])
               for r in dead_letters(got).collect()}
    assert letters == {(0, 1, "junk", "decode json"), (1, 9, "{}", NO_PROJECT)}
    assert plain(ingest_stats(got)) == [
        ("decode json", 1), (NO_PROJECT, 1), ("decoded", 1)]


def test_random_round_trip(spark):
    rnd = random.Random(11)
    alphabet = list('aZ09 "\\/{}[]:,\t\n\r\b\x00\x1fé漢🙂ſ ') + ['"project":"x"', "\\u0041"]
    def text(least=0):
        return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(least, 30)))
    rows = [
        (at("2026-01-01T00:00:00").replace(microsecond=rnd.randrange(10**6)),
         text(1), text(1), text(1), text(), text())
        for _ in range(300)
    ]
    logs = spark.createDataFrame(rows, LOG_SCHEMA)
    back = clean_rows(decode(encode(logs).select("value")), at("00:00:00"))
    assert plain(back) == plain(logs)


def test_encode_writes_all_six_fields(spark, make_logs):
    record = encode(make_logs([("12:00:00", "p", "l", "INFO", "m", "")])).head()
    assert record["key"] == "p"
    assert json.loads(record["value"]) == {
        "timestamp": "2026-01-01T12:00:00.000000Z", "project": "p", "logid": "l",
        "level": "INFO", "message": "m", "caller": ""}
    assert list(json.loads(record["value"])) == LOG_COLUMNS


def test_filter_is_not_pushed_into_the_parsing(spark):
    raw = spark.createDataFrame([(WHOLE,)], "value string")
    plan = decode(raw).filter("reason is null")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") < 20
