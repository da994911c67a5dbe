"""Merkle manifest of a dataset: a tree of digests over the rows of each group, and one over the groups.

A row's digest is a leaf. Per level, lag and lead columns at the fixed offsets 1 to 7, masked by the
node's slot in its run and by the run's length, supply the siblings on either side; the first child
of a run hashes the whole run to its parent. A window is one run, so no group is ever in one task, and
a level is an eighth of the one below.

Proofs go down the other way: a node's path (its siblings, level by level) is its own siblings and its
parent's path. Only the last step meets the leaves, with one path for each run of eight.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from logmere.llm.common import checked, stored

RUN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left: string, right: string>>"


def framed(value: Column) -> Column:
    """``-`` if null, else the count of UTF-8 bytes, ``:``, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def without_capitals(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, their place in ``group`` from 0 without gaps, and ``n``, its rows.

    Rows are dealt by ranges of (group, order) and a salt, which parts even equal ones, and written:
    the parts' sizes say where each begins, and rows are counted inside parts only.
    """
    kinds = rows.columns
    dealt = rows.withColumn("_salt", F.rand(5)).repartitionByRange(group, *order, "_salt")
    dealt = stored(dealt.withColumn("_part", F.spark_partition_id()), "merkle-ranges")
    sizes = dealt.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    sizes = stored(sizes, "merkle-sizes")
    # One row for each part of a group: as many as there are parts and groups together.
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"),
        F.col("_part").alias("_of"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n"),
    )
    starts = checked(stored(starts, "merkle-starts"))
    inside = Window.partitionBy(group, "_part").orderBy(*order, "_salt")
    same = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_of"))
    return (
        dealt.withColumn("_rank", F.row_number().over(inside) - 1)
        .join(starts, same)
        .select(*kinds, (F.col("_start") + F.col("_rank")).alias("at"), "n")
    )


def with_siblings(nodes: DataFrame) -> DataFrame:
    """``nodes`` (group, at, digest) with ``run``, and the digests before and behind each in its run."""
    runs = nodes.withColumn("run", F.floor(F.col("at") / RUN).cast("long"))
    ordered = Window.partitionBy("group", "run").orderBy("at")
    slot = F.pmod(F.col("at"), F.lit(RUN))
    length = F.least(F.lit(RUN), F.col("n") - F.col("run") * RUN)
    offsets = range(1, RUN)
    before = [
        F.when(slot >= k, F.lag("digest", k).over(ordered)).otherwise("") for k in reversed(offsets)
    ]
    behind = [
        F.when(slot + k < length, F.lead("digest", k).over(ordered)).otherwise("") for k in offsets
    ]
    return runs.withColumns({"left": F.concat(*before), "right": F.concat(*behind)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes the run."""
    first = with_siblings(nodes).filter(F.pmod(F.col("at"), F.lit(RUN)) == 0)
    return first.select(
        "group",
        F.col("run").alias("at"),
        F.ceil(F.col("n") / RUN).cast("long").alias("n"),
        F.sha2(F.concat("digest", "right"), 256).alias("digest"),
    )


def levels_above(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` and the levels above, each with the groups that had several nodes below it."""
    levels = [nodes]
    most = nodes.agg(F.max("n")).head()[0] or 0
    while most > 1:
        below = levels[-1]
        levels.append(stored(parents(below.filter("n > 1")), "merkle-level"))
        most = -(-most // RUN)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """``(group, digest)``: the last node of each group, in whichever level it is."""
    last = [level.filter("n = 1").select("group", "digest") for level in levels]
    return stored(reduce(DataFrame.unionByName, last), "merkle-tops")


def with_paths(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level's nodes with ``top`` and ``steps``, their siblings from level to level.

    ``above``: ``group, top, steps`` of the groups' last nodes, where a group's own steps go on.
    """
    held = checked(above)
    keys = lambda rows: rows.select(
        F.col("group").alias("_group"), F.col("at").alias("_at"), "top", "steps"
    )
    found = None
    for k, level in reversed(list(enumerate(levels))):
        kinds = level.columns
        up = held.withColumnRenamed("group", "_group")
        alone = level.filter("n = 1").join(up, F.col("group").eqNullSafe(F.col("_group")))
        alone = alone.select(*kinds, "top", "steps")
        if found is not None:
            same = F.col("group").eqNullSafe(F.col("_group")) & (F.col("run") == F.col("_at"))
            step = F.array(F.struct("left", "right"))
            rest = with_siblings(level.filter("n > 1")).join(keys(found), same)
            rest = rest.select(*kinds, "top", F.concat(step, "steps").alias("steps"))
            alone = rest.unionByName(alone)
        found = stored(alone, "merkle-paths") if k else alone
    return found


@dataclass(frozen=True)
class Manifest:
    """``leaves`` has the given rows as the struct ``row``, with ``subroot`` and the ``steps`` to the root."""

    root: str | None
    leaves: DataFrame


def manifest(rows: DataFrame, group: str, order: list[str], digest: str) -> Manifest:
    """The tree over ``rows``, whose column ``digest`` has the leaves; other columns may have any name.

    Leaves of a group ascend by ``order``, nulls first; where it leaves a choice by digest, and rows
    equal in both are given their places in no particular order. Groups ascend bytewise, null first.
    A group of one leaf is its own subroot, a single group's subroot is the root. Without rows there
    is no root.
    """
    named = rows.select(
        F.struct(*rows.columns).alias("row"),
        F.col(group).cast("string").alias("group"),
        F.col(digest).alias("digest"),
        *(F.col(c).alias(f"by{k}") for k, c in enumerate(order)),
    )
    keys = [f"by{k}" for k in range(len(order))]
    leaves = stored(placed(named, "group", [*keys, "digest"]), "merkle-leaves")
    below = levels_above(leaves)
    subroots = tops(below)
    groups = subroots.select(F.lit(0).alias("group"), F.col("group").alias("of"), "digest")
    groups = stored(placed(groups, "group", ["of"]), "merkle-groups")
    upper = levels_above(groups)
    root = tops(upper).head()
    start = rows.sparkSession.range(1).select(
        F.lit(0).alias("group"), F.lit("").alias("top"), F.array().cast(STEPS).alias("steps")
    )
    over = with_paths(upper, start).select(
        F.col("of").alias("group"), F.col("digest").alias("top"), "steps"
    )
    held = with_paths(below, stored(over, "merkle-groups-paths"))
    held = held.select("row", F.col("top").alias("subroot"), "steps")
    return Manifest(root and root["digest"], held)


def proof_digest(steps: Column) -> Column:
    """The digest of all siblings, level by level, each from left to right."""
    parts = F.transform(steps, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.array_join(parts, ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(steps, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def tampered(key: Column) -> Column:
    """Whether 3 divides the checksum of a key; a null one isn't tampered with."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def audited(docs: DataFrame) -> DataFrame:
    """A manifest of documents by ``lang``, and each document's proof checked after tampering.

    ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.
    Nulls are part of a leaf as ``-``; null ids come first in their language and stay untampered. Of
    rows with equal ids the one with the smaller leaf comes first, equal rows get a place each. Texts
    are hashed whole; an empty table gives no rows. Further columns of any name have no effect.
    """
    values = [F.col(c) for c in COLUMNS]
    changed = [*values[:-1], without_capitals(F.col("text"))]
    leaves = docs.select(
        "doc_id",
        "lang",
        row_digest(values).alias("leaf"),
        F.when(tampered(F.col("doc_id")), row_digest(changed)).alias("changed"),
    )
    tree = manifest(leaves, "lang", ["doc_id"], "leaf")
    root = F.lit(tree.root).cast("string")
    now = folded(F.coalesce("row.changed", "row.leaf"), F.col("steps"))
    judged = tree.leaves.select(
        "row.doc_id",
        "row.leaf",
        "subroot",
        root.alias("root"),
        proof_digest(F.col("steps")).alias("proof_sha256"),
        now.alias("folded_root"),
    )
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))
