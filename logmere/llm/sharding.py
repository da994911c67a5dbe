"""Sharding: minimax contiguous partition of groups of equal texts.

Groups stand in the order of their texts' digests, so any cut is a pair of digests and a document
finds its shard without a join. The smallest capacity for which a greedy filling needs no more
shards than allowed is found by binary search. Only sums of blocks of groups reach the driver, and
only blocks in which some cut may lie are looked at more closely, until the cuts are certain.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from logmere.llm.common import numbered, stored

DIGEST_DIGITS = 32
FIRST_DIGITS = 3
MOST_BLOCKS = 65_536


@dataclass(frozen=True)
class Block:
    """Groups whose digests begin with ``prefix``."""

    prefix: str
    size: int
    groups: int


class Greedy:
    """Greedy filling over blocks; a block of several groups hides where they end."""

    def __init__(self, blocks: list[Block], shards: int) -> None:
        self.blocks, self.shards = blocks, shards
        self.ends = [0, *accumulate(b.size for b in blocks)]
        self.total = self.ends[-1]

    def fill(self, capacity: int, hopeful: bool) -> list[tuple[int, int]]:
        """(target, end) of each shard; hidden ends count as reached only if ``hopeful``."""
        steps, at = [], 0
        for _ in range(self.shards):
            target = min(self.total, at + capacity)
            known = bisect_right(self.ends, target) - 1
            hidden = target < self.total and self.blocks[known].groups > 1
            at = max(at, target if hidden and hopeful else self.ends[known])
            steps.append((target, at))
        return steps

    def smallest(self, least: int, hopeful: bool) -> int:
        """The smallest capacity from ``least`` on that holds everything."""
        low, high = least, max(least, self.total)
        while low < high:
            middle = (low + high) // 2
            if self.fill(middle, hopeful)[-1][1] >= self.total:
                high = middle
            else:
                low = middle + 1
        return low

    def unsure(self, low: int, high: int) -> list[Block]:
        """Blocks of several groups in which a target may lie for a capacity in the range."""
        found: set[int] = set()
        for (first, _), (last, _) in zip(self.fill(low, False), self.fill(high, True), strict=True):
            for k in range(bisect_right(self.ends, first) - 1, bisect_right(self.ends, last)):
                if k < len(self.blocks) and self.blocks[k].groups > 1:
                    found.add(k)
        return [self.blocks[k] for k in sorted(found)]


def _blocks(groups: DataFrame, digits: int, inside: list[str] | None = None) -> list[Block]:
    if inside is not None:
        by_width: dict[int, list[str]] = {}
        for prefix in inside:
            by_width.setdefault(len(prefix), []).append(prefix)
        wanted = F.lit(False)
        for width, prefixes in by_width.items():
            wanted = wanted | F.substring("digest", 1, width).isin(prefixes)
        groups = groups.filter(wanted)
    summed = groups.groupBy(F.substring("digest", 1, digits).alias("prefix")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    return [Block(r["prefix"], r["size"], r["n"]) for r in summed.collect()]


def capacity_and_cuts(groups: DataFrame, shards: int) -> tuple[int, list[str]]:
    """The minimax capacity and, for each later shard that is used, the digest it starts at.

    ``groups``: one row for each group, with ``digest`` (32 hex digits) and ``size``.
    """
    blocks = sorted(_blocks(groups, FIRST_DIGITS), key=lambda b: b.prefix)
    if not blocks:
        return 0, []
    largest = groups.agg(F.max("size")).head()[0]
    while True:
        greedy = Greedy(blocks, shards)
        least = max(largest, -(-greedy.total // shards))
        low, high = greedy.smallest(least, True), greedy.smallest(least, False)
        unsure = greedy.unsure(low, high)
        if not unsure:
            break
        widths = {len(b.prefix) for b in unsure}
        more = 1
        while len(unsure) * 16 ** (more + 1) <= MOST_BLOCKS:
            more += 1
        digits = min(DIGEST_DIGITS, max(widths) + more)
        finer = _blocks(groups, digits, [b.prefix for b in unsure])
        gone = {b.prefix for b in unsure}
        blocks = sorted([b for b in blocks if b.prefix not in gone] + finer, key=lambda b: b.prefix)
    ends = [end for _, end in greedy.fill(high, False)]
    starts = [bisect_right(greedy.ends, end) - 1 for end in ends[:-1]]
    return high, [blocks[k].prefix for k in starts if k < len(blocks)]


def shard_documents(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each document: id, size, text_crc32, digest, shard, slot.

    Law ``bytes``: documents of equal text share a shard, and the largest shard is as small as any
    cutting of the groups in the order of their digests allows. Size: bytes of the text and 1.
    A null text counts as empty (size 1, checksum 0). Repeated rows are rows like others. An empty
    table gives no rows. With fewer groups than shards, the last shards stay empty. Other columns
    are not looked at. Slots number a shard's rows by bucket of the id, then id.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("digest"),
            # Parts even equal rows; written, so it stays.
            F.rand(11).alias("part"),
        ),
        "shard-rows",
    )
    groups = stored(rows.groupBy("digest").agg(F.sum("size").alias("size")), "shard-groups")
    _, cuts = capacity_and_cuts(groups, shards)
    shard: Column = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("digest") >= cut).cast("int")
    placed = numbered(rows.withColumn("shard", shard.cast("int")), "shard", ["id", "digest", "part"], "slot")
    return placed.select(
        F.col("id").alias(id_column), "size", "text_crc32", "digest", "shard", "slot"
    )
