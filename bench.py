"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from lakechecks.fixtures import manifest_of, new_table, wire_corpus  # noqa: E402
from logmere.operators import combine, paging, reports  # noqa: E402
from logmere.operators.decode import decode  # noqa: E402
from logmere.plans.query import LogQuery  # noqa: E402
from logmere.session import work_folder  # noqa: E402
from lakechecks.events import events_as_logs  # noqa: E402
from logmere.sources import encode, read_wire, write_wire  # noqa: E402
from logmere.streaming.ingest import ingest  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 5
DAY = {
    "project": "freight-service",
    "from": "2024-01-14T00:00:00Z",
    "to": "2024-01-15T00:00:00Z",
}


def run(rows: DataFrame) -> None:
    rows.write.format("noop").mode("overwrite").save()


def timed(action, repeats: int = REPEATS) -> float:
    """Median seconds after one warm-up."""
    action()
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        action()
        took.append(time.perf_counter() - began)
    return round(statistics.median(took), 4)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("logmere-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    logs = events_as_logs(spark, FOLDER)
    instants = events_as_logs(spark, FOLDER, instants=True)
    n = logs.count()
    queries: dict[str, float] = {}

    table = None

    def append() -> None:
        nonlocal table
        table = new_table(spark, "bench")
        table.append(instants.repartitionByRange(16, "timestamp"))

    queries["table_append"] = timed(append, repeats=2)

    day = LogQuery.parse(DAY)
    queries["lookup_day_unpruned"] = timed(lambda: run(paging.lookup(logs, day)))
    queries["lookup_day_pruned"] = timed(lambda: run(table.lookup(day)))
    logid = LogQuery.parse({"logid": "run-0007"})
    queries["lookup_logid"] = timed(lambda: run(table.lookup(logid)))

    stored = table.read()
    offset = min(50, n // 3 // paging.PAGE_SIZE // 2) * paging.PAGE_SIZE
    deep = LogQuery(project="freight-service", offset=offset, limit=paging.PAGE_SIZE)
    queries["page_50_offset"] = timed(lambda: run(paging.page(stored, deep)))
    before = paging.page(
        stored, LogQuery(project="freight-service", offset=offset - 1, limit=1)
    ).withColumn("us", F.unix_micros("timestamp")).head()
    cursor = paging.Cursor(before["us"], tuple(before[c] for c in paging.TIE_COLUMNS))
    first = LogQuery(project="freight-service", limit=paging.PAGE_SIZE)
    queries["page_50_keyset"] = timed(
        lambda: run(paging.page(paging.after(stored, cursor), first))
    )

    corpus = wire_corpus(spark, FOLDER).repartition(int(CPUS)).cache()
    corpus.count()
    queries["decode"] = timed(lambda: run(decode(corpus)))
    decode_rate = round(n / queries["decode"])

    wire = work_folder(spark, "bench-wire")
    write_wire(encode(logs.repartition(int(CPUS))), wire)

    def take_in() -> None:
        target = new_table(spark, "bench-ingest")
        stream = read_wire(spark, wire)
        ingest(
            stream, target, work_folder(spark, "bench-stream"), available_now=True
        ).awaitTermination()

    queries["ingest"] = timed(take_in, repeats=2)
    ingest_rate = round(n / queries["ingest"])

    queries["build_manifest"] = timed(lambda: run(manifest_of(spark, FOLDER)))

    merges = []
    for _ in range(2):
        small = new_table(spark, "bench-compact")
        small.append(instants.repartition(64))
        began = time.perf_counter()
        small.compact(target_bytes=400_000)
        merges.append(time.perf_counter() - began)
    queries["compact_64_files"] = round(merges[-1], 4)

    queries["live_tail"] = timed(lambda: run(paging.live_tail(logs, 10)))
    arrived = events_as_logs(spark, FOLDER, keep_id=True)
    doubled = arrived.withColumn("source", F.lit(0)).unionByName(
        arrived.withColumn("source", F.lit(1))
    )
    queries["merge_unique"] = timed(
        lambda: run(combine.merge_unique(doubled, ["source", "event_id"]))
    )
    queries["volume"] = timed(lambda: run(reports.volume(logs)))
    queries["age_histogram"] = timed(
        lambda: run(reports.age_histogram(logs, datetime(2024, 1, 31)))
    )

    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(queries.values()), 4),
                "unit": "sec",
                "queries": queries,
                "sf": FOLDER.rstrip("/").split("sf")[-1],
                "rows": n,
                "decode_rows_per_sec": decode_rate,
                "ingest_rows_per_sec": ingest_rate,
                "cpus": int(CPUS),
            }
        )
    )


if __name__ == "__main__":
    main()
