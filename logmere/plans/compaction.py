"""Which small files to merge, and how they are grouped into batches.

Only manifest rows are handled here, never log rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from logmere.operators.manifest import without
from logmere.session import prepare_checkpoints

# Files above this are left alone; batches aim at this size; and
# the mark of a file that is itself the result of a merge.
MAX_FILE_BYTES = 64 * 1024 * 1024
TARGET_BYTES = 128 * 1024 * 1024
COMPACT_PREFIX = "compact-"

# Manifest rows that one task folds.
BLOCK_FILES = 200_000
# Rows about blocks that the driver takes at once to chain them; a block has at most one for each file
# up to where a first batch closes.
PASSAGES = 50_000


def compaction_candidates(
    manifest: DataFrame,
    max_bytes: int = MAX_FILE_BYTES,
    active: Sequence[str] = (),
) -> DataFrame:
    """Manifest rows of files worth merging; no size cap when ``max_bytes`` is 0."""
    kept = without(manifest, active).filter(~F.col("file").startswith(COMPACT_PREFIX))
    return kept.filter(F.col("size_bytes") <= max_bytes) if max_bytes > 0 else kept


def compaction_batches(
    candidates: DataFrame,
    target_bytes: int = TARGET_BYTES,
    by: str | None = None,
    block_files: int = BLOCK_FILES,
) -> DataFrame:
    """``(file, size_bytes, batch)``: files taken in name order into batches.

    A batch closes as soon as its bytes reach the target, so it may exceed it;
    what is left at the end is the last batch. Batches of one file are dropped.
    With ``by`` (a column such as the day) files of different values never share
    a batch and every value starts a new one.

    Where each batch starts depends on all files before it, yet no task reads
    them all. Files are range-partitioned by name into blocks, and each block
    first works out how an open batch of any size entering it would leave it;
    chaining those answers gives the size that does enter each block, and then
    all blocks assign their files at once.
    """
    if target_bytes <= 0:
        raise ValueError(f"target_bytes must be > 0, got {target_bytes}")
    spark = candidates.sparkSession
    key = F.lit("") if by is None else F.col(by).cast("string")
    files = candidates.select("file", "size_bytes", F.coalesce(key, F.lit("")).alias("key"))
    blocks = max(1, -(-files.count() // block_files))
    ordered = (
        files.repartitionByRange(blocks, "key", "file")
        .sortWithinPartitions("key", "file")
        .withColumn("block", F.spark_partition_id())
    )
    entering = {0: ("", 0, 0, 0)}
    if blocks > 1:
        prepare_checkpoints(spark)
        ordered = ordered.checkpoint()
        entering = _entering(ordered, blocks, target_bytes)
    assigned = ordered.mapInPandas(
        _assign(entering, target_bytes), "file string, size_bytes bigint, batch bigint"
    )
    members = F.count(F.lit(1)).over(Window.partitionBy("batch"))
    return assigned.withColumn("_n", members).filter(F.col("_n") >= 2).drop("_n")


def _entering(ordered: DataFrame, blocks: int, target: int) -> dict[int, tuple]:
    """Open batch on entry to each block: key, bytes, files in it, its number."""
    passages = ordered.mapInPandas(
        _passages(target),
        "block int, first_key string, below bigint, reach bigint,"
        " key string, bytes bigint, carry boolean, files bigint, closed bigint",
    ).checkpoint()
    sizes = passages.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()
    entering, state = {}, ("", 0, 0, 0)
    for some in _together({r["block"]: r["n"] for r in sizes}):
        ways = {}
        for way in passages.filter(F.col("block").between(some[0], some[-1])).collect():
            ways.setdefault(way["block"], []).append(way)
        for block in some:
            entering[block] = state
            key, size, count, number = state
            if key != ways[block][0]["first_key"]:
                number, size, count = number + (count > 0), 0, 0
            way = next(w for w in ways[block] if w["below"] <= size < w["reach"])
            closed = number + way["closed"]
            if way["carry"]:
                state = (way["key"], size + way["bytes"], count + way["files"], closed)
            else:
                state = (way["key"], way["bytes"], way["files"], closed)
    return entering


def _together(sizes: dict[int, int]) -> Iterator[list[int]]:
    """Blocks in their order, so many at a time as have up to ``PASSAGES`` rows together, or one that has more."""
    some, held = [], 0
    for block in sorted(sizes):
        if some and held + sizes[block] > PASSAGES:
            yield some
            some, held = [], 0
        some.append(block)
        held += sizes[block]
    if some:
        yield some


def _passages(target: int):
    """Per block: for every size an open batch may enter with, how it leaves.

    A row covers entry sizes ``below <= size < reach``. ``carry`` means the open
    batch never closes here, so what it holds is added to.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [part for part in parts if len(part)]
        if not frames:
            return
        rows = pd.concat(frames, ignore_index=True)
        n, keys = len(rows), rows["key"].to_numpy()
        total = np.concatenate([[0], np.cumsum(rows["size_bytes"].to_numpy())])
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        run_end = np.append(change, n)[np.searchsorted(change, np.arange(n), side="right")]
        full = np.searchsorted(total, total[:-1] + target)
        # Leaving state for a batch that starts empty at each file.
        leave: list[tuple] = [("", 0, 0, 0)] * (n + 1)
        leave[n] = (keys[-1], 0, 0, 0)
        for i in range(n - 1, -1, -1):
            if full[i] > run_end[i] and run_end[i] == n:
                leave[i] = (keys[i], int(total[n] - total[i]), n - i, 0)
            else:
                key, size, count, closed = leave[min(full[i], run_end[i])]
                leave[i] = (key, size, count, closed + 1)
        block, first, end = int(rows["block"].iloc[0]), keys[0], int(run_end[0])
        out = []
        reach = target
        for stop in range(1, end + 1):
            # An entering batch closes at this file when it is at least `below`.
            below = max(0, target - int(total[stop]))
            if below < reach:
                key, size, count, closed = leave[stop]
                out.append((block, first, below, reach, key, size, False, count, closed + 1))
                reach = below
            if reach == 0:
                break
        if reach > 0 and end == n:
            out.append((block, first, 0, reach, first, int(total[n]), True, n, 0))
        elif reach > 0:
            key, size, count, closed = leave[end]
            out.append((block, first, 0, reach, key, size, False, count, closed + 1))
        yield pd.DataFrame(
            out,
            columns=["block", "first_key", "below", "reach", "key", "bytes", "carry",
                     "files", "closed"],
        )

    return run


def _assign(entering: dict[int, tuple], target: int):
    """Give every file its batch number, starting from the state on entry."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None
        for part in parts:
            if not len(part):
                continue
            if state is None:
                state = entering.get(int(part["block"].iloc[0]), ("", 0, 0, 0))
            key, held, count, number = state
            numbers = np.empty(len(part), dtype=np.int64)
            for i, (name, size) in enumerate(zip(part["key"], part["size_bytes"])):
                if name != key and count:
                    number, held, count = number + 1, 0, 0
                key = name
                numbers[i] = number
                held, count = held + int(size), count + 1
                if held >= target:
                    number, held, count = number + 1, 0, 0
            state = (key, held, count, number)
            yield part[["file", "size_bytes"]].assign(batch=numbers)

    return run


def compaction_summary(
    manifest: DataFrame, candidates: DataFrame, batches: DataFrame
) -> DataFrame:
    """``(scanned, merged, source_files, bytes_freed, rows, skipped)`` of a plan.

    Results of earlier merges are not scanned. Skipped are the scanned files
    that did not qualify; files left over in a batch of one are neither.
    """
    def facts(**given):
        names = ["scanned", "merged", "source_files", "bytes_freed", "rows", "skipped"]
        return [given.get(n, F.lit(0)).cast("bigint").alias(n) for n in names]

    one = F.lit(1)
    scanned = manifest.filter(~F.col("file").startswith(COMPACT_PREFIX)).select(
        *facts(scanned=one, skipped=one)
    )
    qualified = candidates.select(*facts(skipped=-one))
    merged = (
        batches.join(manifest.select("file", "row_count"), "file")
        .groupBy("batch")
        .agg(
            F.count(one).alias("source_files"),
            F.sum("size_bytes").alias("bytes_freed"),
            F.sum("row_count").alias("rows"),
        )
        .select(
            *facts(
                merged=one,
                source_files=F.col("source_files"),
                bytes_freed=F.col("bytes_freed"),
                rows=F.col("rows"),
            )
        )
    )
    parts = scanned.unionByName(qualified).unionByName(merged)
    return parts.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in parts.columns]
    )
