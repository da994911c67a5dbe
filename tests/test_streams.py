"""Streams other than ingest: copies, the kept tail; and files of bounded bytes."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import at, plain
from logmere.functions.sizes import row_bytes
from logmere.operators import combine, paging
from logmere.schema import LOG_SCHEMA
from logmere.streaming import tail
from logmere.table.log_table import FileLayout, LogTable, sized_files


def batches_of(spark, path, batches):
    """A stream that gives each list of rows as a batch of its own."""
    for rows in batches:
        spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def log(seconds, message, level="INFO", project="p"):
    return (at("00:00:00") + timedelta(seconds=seconds), project, "l", level, message, "")


def run_unique(spark, tmp_path, batches, forget_after="1 hour"):
    stream = batches_of(spark, str(tmp_path / "in"), batches)
    unique = combine.merge_unique_stream(stream, forget_after)
    assert unique.columns == LOG_SCHEMA.fieldNames()
    writer = unique.writeStream.option("checkpointLocation", str(tmp_path / "run"))
    writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))


def test_copies_go_and_late_rows_stay(spark, tmp_path):
    day = 86_400
    first = [log(5 * day, "new"), log(5 * day, "new too")]
    late = [log(-400 * day, "very late"), log(5 * day, "new", "OTHER"), log(5 * day, "new", project="q")]
    again = [log(-400 * day, "very late", "OTHER"), log(-399 * day, "very late"), log(0, "")]
    got = run_unique(spark, tmp_path, [first, late, again]).collect()
    assert sorted((r["message"], r["level"], r["project"]) for r in got) == [
        ("", "INFO", "p"), ("new", "INFO", "p"), ("new", "INFO", "q"), ("new too", "INFO", "p"),
        ("very late", "INFO", "p"), ("very late", "INFO", "p"),
    ]


def test_forgotten_keys_let_copies_pass_but_drop_nothing(spark, tmp_path):
    rows = [[log(k, f"m{k}")] for k in range(4)] + [[log(9, "other")], [log(0, "m0")]]
    got = [r["message"] for r in run_unique(spark, tmp_path, rows, "0 seconds").collect()]
    assert set(got) == {"m0", "m1", "m2", "m3", "other"} and got.count("m0") in (1, 2)


@pytest.mark.parametrize("by", ["project", "logid"])
def test_kept_tail_is_the_live_tail(spark, tmp_path, by):
    rnd = random.Random(2)
    rows = [log(rnd.randrange(60), f"m{k}", project=rnd.choice("pqr")) for k in range(120)]
    rows += rows[:9]
    rnd.shuffle(rows)
    path = str(tmp_path / "tail")
    with pytest.raises(FileNotFoundError):
        tail.read_tail(spark, path)
    stream = batches_of(spark, str(tmp_path / "in"), [rows[:40], rows[40:50], rows[50:]])
    tail.keep_tail(stream, path, str(tmp_path / "run"), 4, by, available_now=True).awaitTermination()
    whole = spark.createDataFrame(rows, LOG_SCHEMA)
    assert plain(tail.read_tail(spark, path)) == plain(paging.live_tail(whole, 4, by))


def test_a_batch_taken_in_again_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "tail")
    some = [spark.createDataFrame([log(k, f"m{k}"), log(k, "x")], LOG_SCHEMA) for k in range(6)]
    for number, batch in enumerate(some):
        tail.update_tail(path, batch, number, 3)
        tail.update_tail(path, batch, number, 3)
    got = [(r["position"], r["message"]) for r in tail.read_tail(spark, path).orderBy("position").collect()]
    assert got == [(1, "m5"), (2, "x"), (3, "m4")]
    assert len(tail._tails(spark, path)) == tail.KEPT + 1


def test_no_file_is_above_its_bound(spark, tmp_path):
    rnd = random.Random(3)
    rows = [log(k, "x" * rnd.choice([1, 10, 300, 700])) for k in range(400)] + [log(7, "y" * 5000)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA).repartition(3)
    sizes = sized_files(logs, 1500).groupBy("file").agg(F.sum(row_bytes()).alias("b"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.collect()
    assert sum(r["n"] for r in sizes) == 401
    assert all(r["b"] <= 1500 or r["n"] == 1 for r in sizes)
    assert sum(r["b"] < 500 for r in sizes) < len(sizes) / 3
    table = LogTable(spark, str(tmp_path / "table"), FileLayout(max_file_bytes=1500))
    table.append(logs)
    assert plain(table.read()) == plain(logs)
    assert table.manifest().count() == len(sizes)
    assert table.audit().count() == 0


def test_files_of_bounded_bytes_by_ranges(spark, monkeypatch):
    """No task holds all rows of a writer, and the files are those that running sums over the whole of them give."""
    rnd = random.Random(4)
    rows = [log(rnd.randrange(50), "x" * rnd.choice([1, 10, 300, 900])) for _ in range(600)]
    logs = spark.createDataFrame(rows, LOG_SCHEMA).coalesce(1)
    want, end, number = {}, 0, 0
    for r in paging.sort_logs(logs, newest_first=False).withColumn("b", row_bytes()).collect():
        end += r["b"]
        big = r["b"] > 750
        want.setdefault(f"row {(number := number + 1)}" if big else end // 750, []).append(tuple(r)[:-1])
    monkeypatch.setattr("logmere.table.log_table.SIZED_ROWS", 60)
    sized = sized_files(logs, 1500)
    held = [r["n"] for r in sized.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert max(held) < 300 and sum(held) == 600
    got = {}
    for r in sized.collect():
        got.setdefault(r["file"], []).append(tuple(r)[:-1])
    assert sorted(sorted(map(repr, x)) for x in got.values()) == sorted(sorted(map(repr, x)) for x in want.values())
    tasks = sized.select("file", F.spark_partition_id().alias("task")).distinct()
    assert tasks.count() == len(got)
