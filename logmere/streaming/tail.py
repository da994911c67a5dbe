"""The newest rows of every project, kept up to date as a stream brings rows.

Each batch is ranked together with the tail before it, which has ``n`` rows a project at most, so a
batch costs as much as its own rows, however many came earlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from logmere.operators.paging import live_tail
from logmere.schema import LOG_COLUMNS

# Tails that stay beside the newest, for readers that have begun.
KEPT = 2


def _tails(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the batches whose tail is complete."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(
        int(n.removeprefix("batch="))
        for n in names
        if n.startswith("batch=") and store.exists(done(f"{path}/{n}/_SUCCESS"))
    )


def update_tail(path: str, batch: DataFrame, batch_id: int, n: int, by: str = "project") -> None:
    """Take one batch into the tail at ``path``. Repeating a batch gives the same tail again."""
    spark = batch.sparkSession
    earlier = [k for k in _tails(spark, path) if k < batch_id]
    rows = batch.select(*LOG_COLUMNS)
    if earlier:
        rows = rows.unionByName(spark.read.parquet(f"{path}/batch={earlier[-1]}").select(*LOG_COLUMNS))
    live_tail(rows, n, by).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for old in earlier[:-KEPT]:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={old}"), True)


def keep_tail(
    logs: DataFrame, path: str, checkpoint: str, n: int, by: str = "project", available_now: bool = False
) -> StreamingQuery:
    """Start keeping the newest ``n`` rows of every project of a stream; see ``read_tail``."""
    writer = logs.writeStream.foreachBatch(
        lambda batch, batch_id: update_tail(path, batch, batch_id, n, by)
    ).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_tail(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete tail: log columns and ``position``, as ``live_tail`` gives them."""
    tails = _tails(spark, path)
    if not tails:
        raise FileNotFoundError(f"no tail at {path} yet")
    return spark.read.parquet(f"{path}/batch={tails[-1]}")
