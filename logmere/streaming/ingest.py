"""Continuous ingest: wire records into the log table, refused ones beside it."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from logmere.operators.decode import (
    clean_rows,
    dead_letters,
    decode,
    ingest_stats,
)
from logmere.table.log_table import LogTable
from logmere.table.snapshot import Snapshot

# Fixed value: how soon accepted records become visible.
FLUSH_EVERY = "5 seconds"
_QUERY_ID = "sql.streaming.queryId"


def ingest_batch(
    table: LogTable, records: DataFrame, stream: str, batch_id: int
) -> Snapshot:
    """Take one batch of wire records into the table.

    The batch is written to a unit named after stream and number, each attempt to
    a folder of its own, and becomes visible with one commit that also records
    the number. A batch that was committed before is passed
    over, so a replay changes nothing. Records without a time get the time they
    arrived at the source, which a replay repeats.
    """
    base = table.snapshot()
    if base.streams.get(stream, -1) >= batch_id:
        return base
    decoded = decode(records).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        counts = {r["outcome"]: r["records"] for r in ingest_stats(decoded).collect()}
        unit = f"logs-{stream}-{batch_id:012d}"
        if not counts:
            return base
        added = None
        clean = counts.get("decoded", 0)
        if clean:
            # The rows are cached, so fewer writers do not mean fewer decoders.
            files = -(-clean // table.layout.stream_rows_per_file)
            logs = clean_rows(decoded, F.col("received_at")).coalesce(files)
            added = table.write_unit(logs, unit)
        if set(counts) - {"decoded"}:
            dead_letters(decoded).write.mode("overwrite").parquet(
                f"{table.root}/errors/{unit}"
            )
        return table.log.commit(
            base,
            added,
            streams={stream: batch_id},
            summary={"operation": "ingest", "batch": batch_id, "records": counts},
        )
    finally:
        decoded.unpersist()


def ingest(
    records: DataFrame,
    table: LogTable,
    checkpoint: str,
    *,
    available_now: bool = False,
    every: str = FLUSH_EVERY,
) -> StreamingQuery:
    """Start ingest of a stream from ``read_wire``.

    ``available_now`` takes in what is there and stops; otherwise a batch starts
    ``every`` so often. Bound a batch with the source option
    ``maxOffsetsPerTrigger`` or ``maxFilesPerTrigger``. Late records are always
    accepted; they only widen the time range of their file.
    """

    def take_in(batch: DataFrame, batch_id: int) -> None:
        # The identity Spark keeps in the checkpoint: a new checkpoint counts
        # its batches anew and must not be mistaken for the old one.
        stream = batch.sparkSession.sparkContext.getLocalProperty(_QUERY_ID)
        if not stream:
            raise RuntimeError("the identity of the stream is not known")
        ingest_batch(table, batch, stream, batch_id)

    writer = records.writeStream.foreachBatch(take_in).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=every).start()
