"""Inputs of the checks, all derived from the given tables by Spark."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lakechecks.events import events_as_logs
from logmere.functions.clock import wall_of
from logmere.functions.sizes import row_bytes
from logmere.operators.manifest import build_manifest
from logmere.session import work_folder
from logmere.sources import encode
from logmere.table.log_table import LogTable

NOW = datetime(2024, 1, 31)
ROWS_PER_FILE = 250
# Rows of a stored table that one task writes, beyond the first eight.
ROWS_PER_WRITER = 500_000


def logs_of(spark: SparkSession, folder: str) -> DataFrame:
    return events_as_logs(spark, folder)


def file_name(event_id: Column) -> Column:
    number = F.call_function("div", event_id, F.lit(ROWS_PER_FILE))
    return F.concat(F.lit("logs-"), F.lpad(number.cast("string"), 6, "0"), F.lit(".parquet"))


def manifest_of(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of the events cut into runs of equal length."""
    logs = events_as_logs(spark, folder, keep_id=True)
    return build_manifest(logs, file_name(F.col("event_id")), F.sum(row_bytes()), F.sum)


def new_table(spark: SparkSession, name: str) -> LogTable:
    return LogTable(spark, work_folder(spark, name))


def stored(spark: SparkSession, folder: str, name: str) -> LogTable:
    """A table holding the events."""
    table = new_table(spark, name)
    logs = events_as_logs(spark, folder, instants=True)
    table.append(logs.repartition(max(8, -(-logs.count() // ROWS_PER_WRITER))))
    return table


def in_utc(rows: DataFrame) -> DataFrame:
    """The time as zone-less UTC, the form the checks compare."""
    return rows.withColumn("timestamp", wall_of(rows))


def wire_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """``(event_id, value)``: encoded events, some of them replaced by odd payloads."""
    logs = events_as_logs(spark, folder, keep_id=True)
    good = encode(logs, keep=["event_id"])
    rest = '"logid":"l","level":"INFO"'
    whole = '{"project":"p",' + rest + "}"
    at = '{"project":"p",' + rest + ',"timestamp":'
    payloads = {
        0: whole,
        1: at + "null}",
        2: at + '"0001-01-01T00:00:00Z"}',
        3: at + '""}',
        4: at + '"2026-09-06"}',
        5: at + "1756944000}",
        6: at + '"2026-09-06T10:11:12+00:00"}',
        7: at + '"2026-09-06T10:11:12+02:00"}',
        8: at + '"2026-09-06T10:11:12.123Z"}',
        9: at + '"2026-09-06T10:11:12.123456+00:00"}',
        10: '{"Project":"cs",' + rest + "}",
        11: '{"project":"p","project":"q",' + rest + "}",
        12: '{"project":"p","PROJECT":null,' + rest + "}",
        13: '{"project":"p","extra":{"a":[1,{"b":null}]},' + rest + "}",
        14: "  \t" + whole + "  ",
        15: '{"project":"p","message":"] , \\" }",' + rest + "}",
        16: '{"project":"p","logid":"l","level":"VERBOSE"}',
        17: "not-json",
        18: "",
        19: None,
        20: "5",
        21: '"x"',
        22: "[1]",
        23: '{"project":"p",' + rest,
        24: "{'project':'p','logid':'l','level':'INFO'}",
        25: whole + " x",
        26: whole + "," + whole,
        27: whole + "]",
        28: whole + "}",
        29: whole + "],[" + whole,
        30: '{"project":5,' + rest + "}",
        31: "null",
        32: "{" + rest + "}",
        33: '{"project":"",' + rest + "}",
        34: '{"project":"p","level":"INFO"}',
        35: '{"project":"p","logid":"l"}',
        36: '{"project":"p","extra":{"a":1,"a":2},' + rest + "}",
        37: '{"pro\\u006aect":"esc","Project":null,' + rest + "}",
    }
    slot = F.col("event_id") % 97
    value = F.when(slot == 0, F.lit(payloads[0]))
    for number, payload in list(payloads.items())[1:]:
        value = value.when(slot == number, F.lit(payload))
    value = value.when(slot >= len(payloads), F.col("value"))
    return good.select("event_id", value.alias("value"))


def named_as_parquet(spark: SparkSession, folder: str) -> None:
    """Give the text files of a folder names of Parquet files."""
    paths = spark._jvm.org.apache.hadoop.fs
    at = paths.Path(folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in store.listStatus(at):
        name = status.getPath().getName()
        if name.endswith(".txt"):
            store.rename(status.getPath(), paths.Path(f"{folder}/{name[:-4]}.parquet"))


def nanosecond_files(folder: str):
    """A function for ``mapInArrow``: each task writes its rows with ``timestamp`` in nanoseconds."""

    def run(batches):
        import uuid

        import pyarrow as pa
        import pyarrow.fs
        import pyarrow.parquet as pq

        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path)
        for batch in batches:
            moments = batch.column("timestamp").cast(pa.timestamp("ns", "UTC"))
            columns = [moments, *batch.columns[1:]]
            name = f"{path}/{uuid.uuid4().hex}.parquet"
            pq.write_table(pa.table(columns, batch.schema.names), name, filesystem=store)
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return run
