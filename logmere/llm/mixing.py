"""Mixing sources to target weights by Pfair scheduling.

The documents of a source are cut into blocks. With weights ``w`` of the sources that still have
blocks, and ``W`` their sum, block ``i`` of a source is released at slot ``floor(i * W / w)`` and due
before slot ``ceil((i + 1) * W / w)``. Of the released blocks the one due earliest takes the slot, so
after every slot each source has had its share up to less than one block. The schedule repeats every
``W`` slots, so one period is worked out and any block's slot follows by arithmetic; when a source
runs out, a new schedule begins for those left. Nothing that grows with the documents is on the
driver: it holds one count for each named source and one period for each of these schedules.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import MapType

from logmere.llm.common import numbered, stored, unused

REST = ""
BLOCK_ROWS = 16
MOST_WEIGHT = 10_000


def period(weights: Mapping[str, int]) -> list[str]:
    """Which source takes each slot, earliest deadline first; equal deadlines: by name."""
    total = sum(weights.values())
    waiting = [(0, name, 0) for name in sorted(weights)]  # (release, source, block)
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # (deadline, source, block)
    taken = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, name, block = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(block + 1) * total // weights[name]), name, block))
        _, name, block = heapq.heappop(ready)
        taken.append(name)
        heapq.heappush(waiting, ((block + 1) * total // weights[name], name, block + 1))
    return taken


@dataclass(frozen=True)
class Phase:
    """A schedule from slot ``start`` on; ``done`` blocks of each source went before."""

    start: int
    done: dict[str, int]
    order: list[str]
    period: int


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[Phase]:
    """Schedules until every block has a slot; each ends where some source runs out."""
    left = {name: n for name, n in blocks.items() if n > 0}
    done, start, found = dict.fromkeys(left, 0), 0, []
    while left:
        own = {name: weights[name] for name in left}
        total = sum(own.values())
        order = period(own)
        place: dict[str, list[int]] = {name: [] for name in left}
        for slot, name in enumerate(order):
            place[name].append(slot)
        ends = {
            name: (n - 1) // own[name] * total + place[name][(n - 1) % own[name]] + 1
            for name, n in left.items()
        }
        end = min(ends.values())
        found.append(Phase(start, dict(done), order, total))
        whole, part = divmod(end, total)
        for name in left:
            done[name] += whole * own[name] + sum(s < part for s in place[name])
        start += end
        left = {name: blocks[name] - done[name] for name in left if blocks[name] > done[name]}
    return found


def mix(
    docs: DataFrame,
    weights: Mapping[str, int],
    rest_weight: int = 1,
    block_rows: int = BLOCK_ROWS,
    id_column: str = "doc_id",
    source_column: str = "source",
) -> DataFrame:
    """``docs`` with ``position``, the place in the mixture, from 0 without gaps.

    ``weights``: positive whole numbers by source. All sources without a weight, and rows without a
    source, together are one more source of weight ``rest_weight``. Nothing is dropped or repeated:
    when a source runs out, the others go on by their weights. Inside a source the order is by
    digest of id and row, then id; so rows that share an id, or have none, are spread. A column
    ``position`` is replaced. An empty table gives no rows. A weight below 1, or a sum above ``MOST_WEIGHT``, is refused.
    """
    weights = {**weights, REST: rest_weight}
    if min(weights.values()) < 1 or sum(weights.values()) > MOST_WEIGHT or block_rows < 1:
        raise ValueError("weights are whole numbers from 1, and few enough for one period")
    named = [name for name in weights if name != REST]
    mark = unused(docs.columns)
    name_of = lambda name: f"{mark}{name}"
    own = lambda name: F.col(name_of(name))
    kept = [c for c in docs.columns if c != "position"]
    group = F.when(F.col(source_column).isin(named), F.col(source_column)).otherwise(F.lit(REST))
    plain = [f.name for f in docs.schema if not isinstance(f.dataType, MapType)]
    keyed = docs.withColumns({name_of("group"): group, name_of("digest"): F.xxhash64(*plain)})
    placed = numbered(keyed, name_of("group"), [id_column, name_of("digest")], name_of("rank"))
    counted = docs.select(group.alias("g")).groupBy("g").count().collect()
    rows = {r["g"]: r["count"] for r in counted}
    blocks = {name: -(-n // block_rows) for name, n in rows.items()}
    plan = phases(blocks, weights)
    if not plan:
        return docs.select(*kept, F.lit(0).cast("long").alias("position"))

    spans, slots, last = [], [], {}
    for k, phase in enumerate(plan):
        after = plan[k + 1].done if k + 1 < len(plan) else blocks
        seen = dict.fromkeys(phase.done, 0)
        for slot, name in enumerate(phase.order):
            slots.append((name, k, seen[name], phase.start + slot))
            seen[name] += 1
        for name, share in seen.items():
            until = after.get(name, blocks[name])
            spans.append((name, k, phase.done[name], until, share, phase.period))
        for name, _, inner, slot in slots[len(slots) - len(phase.order) :]:
            turns = (after.get(name, blocks[name]) - 1 - phase.done[name] - inner) // seen[name]
            if turns >= 0:
                last[name] = max(last.get(name, 0), slot + turns * phase.period)
    spark = docs.sparkSession
    span = spark.createDataFrame(
        spans,
        "name string, phase int, done long, until long, share long, period long",
    )
    first = spark.createDataFrame(slots, "of string, in int, inner long, slot long")
    span, first = (t.select(*(F.col(c).alias(name_of(c)) for c in t.columns)) for t in (span, first))
    block = F.floor(own("rank") / block_rows)
    turn = block - own("done")
    at = own("slot") + F.floor(turn / own("share")) * own("period")
    # A source's last block may be short; what follows it moves up.
    short = F.lit(0).cast("long")
    for name, slot in last.items():
        lacking = blocks[name] * block_rows - rows[name]
        if lacking:
            short = short + F.when(at > slot, lacking).otherwise(0)
    in_span = (
        (own("group") == own("name")) & (block >= own("done")) & (block < own("until"))
    )
    in_turn = (
        (own("name") == own("of"))
        & (own("phase") == own("in"))
        & (F.pmod(turn, own("share")) == own("inner"))
    )
    position = at * block_rows + F.pmod(own("rank"), F.lit(block_rows)) - short
    # Both tables have at most sources * phases, and weights * phases, rows.
    return (
        placed.join(F.broadcast(span), in_span)
        .join(F.broadcast(first), in_turn)
        .select(*kept, position.cast("long").alias("position"))
    )


def in_order(mixed: DataFrame, rows_per_file: int = 10_000) -> DataFrame:
    """The documents in the order of their positions: files by range, rows in order inside."""
    files = max(1, -(-mixed.count() // rows_per_file))
    ordered = mixed.repartitionByRange(files, "position").sortWithinPartitions("position")
    return ordered.drop("position")


def in_place(docs: DataFrame) -> DataFrame:
    """``docs``, as read back from the files of ``in_order``, with ``position`` again, without gaps.

    The order is that of the files' numbers and of the rows in them. What isn't read from files is
    written first.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        docs = stored(docs, "mixture")
    rows = docs.select(
        *docs.columns,
        F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    number = F.regexp_extract("__of", "part-([0-9]+)", 1).cast("long")
    before = Window.orderBy(number, "__of").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each file.
    starts = (
        rows.groupBy(F.col("__file").alias("__of"))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__of", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    )
    return rows.join(F.broadcast(starts), F.col("__file") == F.col("__of")).select(
        *docs.columns, (F.col("__start") + F.col("__row")).alias("position")
    )
