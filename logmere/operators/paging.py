"""Ordering, pages, look-ups with totals, walking pages, and the live tail.

Rows are ordered by time, newest first unless asked otherwise; rows of one time
follow project, logid, level, message, caller ascending, so every order here is
repeatable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from logmere.functions.clock import is_wall, micros_literal, micros_of
from logmere.operators import seek
from logmere.operators.seek import Place
from logmere.plans.query import LogQuery
from logmere.schema import LOG_COLUMNS, TIE_COLUMNS
from logmere.session import prepare_checkpoints

# Rows per part when a page is looked for among rows of one time.
PART_ROWS = 200_000
PAGE_SIZE = 200
# Pages that a walk locates at once.
PAGES_AT_ONCE = 50
# Shards of the live tail's first step, and the longest tail for which Spark puts
# a group limit before the shuffle (its default threshold).
TAIL_SHARDS = 64
GROUP_LIMIT_ROWS = 1000


def order_columns(newest_first: bool = True) -> list[Column]:
    moment = F.col("timestamp")
    first = moment.desc() if newest_first else moment.asc()
    return [first] + [F.col(name).asc() for name in TIE_COLUMNS]


def sort_logs(logs: DataFrame, newest_first: bool = True) -> DataFrame:
    return logs.orderBy(*order_columns(newest_first))


def read_page(span: DataFrame, place: Place, newest_first: bool) -> DataFrame:
    """The rows of a page, in order, from ``span``: the rows from its first time to its last.

    All columns are read of these only: the page's rows, and those that share the times of its edges.
    """
    rows = span.select(*LOG_COLUMNS)
    if place.span <= place.rows + seek.SORTED_ROWS:
        ordered = sort_logs(rows, newest_first)
        return (ordered.offset(place.skip) if place.skip else ordered).limit(place.rows)
    # Very many rows share the time of an edge.
    at = lambda key: seek.spanned(rows, key, key, newest_first)
    if place.first == place.last:
        return _within_tie(at(place.first), place.skip, place.rows, place.span)
    head = min(place.first_ties - place.skip, place.rows)
    tail = place.rows - head - (place.span - place.first_ties - place.last_ties)
    middle = seek.spanned(rows, place.first + 1, place.last - 1, newest_first)
    parts = [
        _within_tie(at(place.first), place.skip, head, place.first_ties),
        middle,
        _within_tie(at(place.last), 0, tail, place.last_ties),
    ]
    return sort_logs(reduce(DataFrame.unionByName, parts), newest_first).limit(place.rows)


def _within_tie(rows: DataFrame, offset: int, limit: int, number: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` among many of the same time.

    The rows are spread by range over the tie columns and a salt, which parts
    even rows that are equal throughout; the sizes of the parts tell which of
    them hold the page. Fixing the spread as a checkpoint keeps it the same for
    counting and reading.
    """
    prepare_checkpoints(rows.sparkSession)
    parts = -(-number // PART_ROWS)
    spread = (
        rows.withColumn("_salt", F.rand(1))
        .repartitionByRange(parts, *TIE_COLUMNS, "_salt")
        .withColumn("_part", F.spark_partition_id())
        .checkpoint()
    )
    first = last = None
    before = 0
    for part in spread.groupBy("_part").count().orderBy("_part").toLocalIterator():
        if first is None and offset < before + part["count"]:
            first, skip = part["_part"], offset - before
        before += part["count"]
        last = part["_part"]
        if before >= offset + limit:
            break
    chosen = spread.filter(F.col("_part").between(first, last)).select(*rows.columns)
    return sort_logs(chosen).offset(skip).limit(limit)


#: From the edges of a page to the rows that match between them.
Reader = Callable[[Place], DataFrame]


def reader_of(matched: DataFrame, newest_first: bool) -> Reader:
    return lambda place: seek.spanned(matched, place.first, place.last, newest_first)


def page(logs: DataFrame, query: LogQuery) -> DataFrame:
    """The ordered rows of one page; where it lies is found at once, by a few small jobs."""
    return located(query.matching(logs), query)[1]


def located(
    matched: DataFrame, query: LogQuery, read: Reader | None = None
) -> tuple[int, DataFrame]:
    """How many rows match, and the rows of the page.

    ``matched`` is read for its times only; ``read`` gives the rows of the page, from ``matched``
    unless told otherwise.
    """
    newest_first = query.newest_first
    total, places = seek.pages_at(matched, query.page_offset, query.page_limit, 1, newest_first)
    if not places:
        return total, matched.select(*LOG_COLUMNS).filter(F.lit(False))
    rows = (read or reader_of(matched, newest_first))(places[0])
    return total, read_page(rows, places[0], newest_first)


def lookup(logs: DataFrame, query: LogQuery) -> DataFrame:
    """One row ``(count, results)``: all matches counted, one page returned.

    Past the last page ``results`` is empty and ``count`` stays.
    """
    return envelope(*located(query.matching(logs), query), query.newest_first)


def envelope(total: int, rows: DataFrame, newest_first: bool) -> DataFrame:
    micros = micros_of(rows)
    packed = F.struct(
        (-micros if newest_first else micros).alias("rank"),
        *[F.col(name) for name in TIE_COLUMNS],
        F.col("timestamp"),
    )
    # A page holds at most MAX_LIMIT rows, so collecting it is bounded.
    held = rows.agg(F.array_sort(F.collect_list(packed)).alias("rows"))
    return held.select(
        F.lit(total).cast("bigint").alias("count"),
        F.transform(
            "rows",
            lambda r: F.struct(*[r[name].alias(name) for name in LOG_COLUMNS]),
        ).alias("results"),
    )


def flat_page(envelope: DataFrame) -> DataFrame:
    """A look-up result as rows: ``count``, ``position`` in the page, log columns."""
    return envelope.select(
        "count", F.posexplode("results").alias("position", "row")
    ).select("count", "position", "row.*")


class Cursor(NamedTuple):
    """A place in the order: the time and tie columns of the row before it."""

    micros: int
    ties: tuple[str, ...]


def after(
    logs: DataFrame,
    cursor: Cursor,
    newest_first: bool = True,
    inclusive: bool = False,
) -> DataFrame:
    """Rows behind a place in the order, with those at it if ``inclusive``."""
    moment = F.col("timestamp")
    edge = micros_literal(cursor.micros, is_wall(logs))
    ties = F.struct(*[F.col(name) for name in TIE_COLUMNS])
    held = F.struct(*[F.lit(v).alias(n) for n, v in zip(TIE_COLUMNS, cursor.ties)])
    bound = moment <= edge if newest_first else moment >= edge
    behind = ties >= held if inclusive else ties > held
    return logs.filter(bound & ((moment != edge) | behind))


def walk(
    logs: DataFrame,
    query: LogQuery,
    page_size: int = PAGE_SIZE,
    read: Reader | None = None,
) -> Iterator[list[Row]]:
    """Pages one after another, to the end of what matches.

    One search over the times locates fifty pages; for each of them only the rows between its edges
    are read. ``logs`` must not change meanwhile: a page is told by its rank, and of rows equal in all
    columns any will do.
    """
    matched, newest_first = query.matching(logs), query.newest_first
    read = read or reader_of(matched, newest_first)
    offset, total = query.page_offset, None
    while total is None or offset < total:
        total, places = seek.pages_at(matched, offset, page_size, PAGES_AT_ONCE, newest_first)
        for place in places:
            yield read_page(read(place), place, newest_first).collect()
        offset += page_size * PAGES_AT_ONCE


def walk_into(logs: DataFrame, query: LogQuery, path: str, page_size: int = PAGE_SIZE) -> DataFrame:
    """All pages, to the end, as rows with their number ``page``; the sorted rows stay at ``path``.

    Two passes, however many pages there are: the rows are dealt by ranges of the order (and a salt,
    which parts even equal ones), sorted and written with their number inside the range; the sizes of
    the ranges then tell each row's number in the whole, and so its page.
    """
    spark, newest_first = logs.sparkSession, query.newest_first
    rows = query.matching(logs).select(*LOG_COLUMNS).withColumn("_salt", F.rand(3))
    order = [*order_columns(newest_first), F.col("_salt")]
    (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        # The number of the range in the upper bits, that of the row in the lower 33.
        .withColumn("_number", F.monotonically_increasing_id())
        .drop("_salt")
        .write.parquet(path)
    )
    written = spark.read.parquet(path)
    part = F.shiftright("_number", 33)
    inside = F.col("_number").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = written.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    # One row for each range: as many as the write had tasks.
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    placed = written.withColumn("_part", part).join(F.broadcast(starts), "_part")
    number = F.col("_start") + inside - query.page_offset
    pages = F.floor(number / page_size).cast("int")
    return placed.filter(number >= 0).select(pages.alias("page"), *LOG_COLUMNS)


def has_more(loaded: int, total: int) -> bool:
    return loaded < total


def live_tail(logs: DataFrame, n: int, by: str = "project") -> DataFrame:
    """The newest ``n`` rows of every project, with their ``position``.

    Ranking happens first within shards of the input, so a project that holds
    most of the rows is spread over many tasks; only the winners of the shards
    meet in the second step. Up to ``GROUP_LIMIT_ROWS`` Spark also drops losers
    before each shuffle; for a longer tail, rows that are certainly too old are
    dropped by counts.
    """
    if n > GROUP_LIMIT_ROWS:
        logs = _recent(logs, n, by)
    order = order_columns(newest_first=True)
    sharded = logs.withColumn("_shard", F.spark_partition_id() % TAIL_SHARDS)
    in_shard = Window.partitionBy(by, "_shard").orderBy(*order)
    winners = (
        sharded.withColumn("_rank", F.row_number().over(in_shard))
        .filter(F.col("_rank") <= n)
        .drop("_rank", "_shard")
    )
    position = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return winners.withColumn("position", position).filter(F.col("position") <= n)


def _recent(logs: DataFrame, n: int, by: str) -> DataFrame:
    """Rows from the minute on that holds the ``n``-th newest row of their project."""
    micros = micros_of(logs)
    minute = micros - F.pmod(micros, F.lit(60_000_000))
    sizes = logs.groupBy(by, minute.alias("_minute")).agg(F.count(F.lit(1)).alias("_rows"))
    newer = Window.partitionBy(by).orderBy(F.col("_minute").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    edge = (
        sizes.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
        .filter(F.col("_newer") < n)
        .groupBy(by)
        .agg(F.min("_minute").alias("_edge"))
    )
    return logs.join(edge, by).filter(micros >= F.col("_edge")).select(*logs.columns)
