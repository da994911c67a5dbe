"""Where a page lies in the order, found from the times alone.

Only the columns that the filters need and the time are read. A quantile sketch of the times, taken in
one scan, says near which times a rank must be; the rows before a few of these are counted exactly, so
the rank is now either at one of them or between two neighbours, where at most about a hundredth of the
rows are. This goes on inside until few rows are left, which are counted by time. How deep a page lies
and how many rows there are changes only how often: each scan reads a hundredth of the one before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from logmere.functions.clock import is_wall, micros_literal, micros_of

# So few rows around an edge are counted by time, and sorted.
SORTED_ROWS = 20_000
# Quantiles of a sketch, and the inverse of its error as a share of the rows.
GRID = 200
ACCURACY = 2_000
LEAST, MOST = -(1 << 63), (1 << 63) - 1


class Place(NamedTuple):
    """A page: ``first`` and ``last`` are the keys of its edges (see ``key_of``), ``skip`` and ``rows``
    say which of the rows from ``first`` to ``last`` it has; ``span`` is how many these are, and
    ``first_ties`` and ``last_ties`` how many have the edges' own times."""

    first: int
    last: int
    skip: int
    rows: int
    span: int
    first_ties: int
    last_ties: int


@dataclass
class _Rank:
    """A row's number, and the keys between which it is: ``before`` rows have smaller ones than ``low``."""

    rank: int
    inside: int
    low: int = LEAST
    high: int = MOST
    before: int = 0

    @property
    def open(self) -> bool:
        return self.low < self.high and self.inside > SORTED_ROWS

    def within(self, key: Column) -> Column:
        return key.between(self.low, self.high)

    def near(self, grid: list[int]) -> set[int]:
        """Those of the sketch's keys around which the rank must be."""
        kinds = sorted(set(grid))
        at = grid[min(len(grid) - 1, (self.rank - self.before) * len(grid) // max(1, self.inside))]
        here = bisect_left(kinds, at)
        return set(kinds[max(0, here - 2) : here + 3])

    def narrow(self, below: dict[int, int], upto: dict[int, int]) -> None:
        """With the exact numbers of rows before and up to some keys."""
        low, high, before = self.low, self.high, self.before
        behind = self.before + self.inside
        for key in sorted(below):
            if upto[key] <= self.rank and key >= low:
                low, before = key + 1, upto[key]
            elif below[key] <= self.rank < upto[key]:
                low = high = key
                before, behind = below[key], upto[key]
                break
            elif below[key] > self.rank:
                high, behind = key - 1, below[key]
                break
        self.low, self.high, self.before, self.inside = low, high, before, behind - before


def key_of(rows: DataFrame, newest_first: bool) -> Column:
    """A whole number that ascends in the order of rows; rows without a time come where Spark sorts nulls."""
    micros = micros_of(rows)
    if newest_first:
        return F.coalesce(-micros, F.lit(MOST))
    return F.coalesce(micros, F.lit(LEAST))


def spanned(rows: DataFrame, first: int, last: int, newest_first: bool) -> DataFrame:
    """Rows with keys from ``first`` to ``last``, by conditions on the time that reach a Parquet scan."""
    moment, wall = F.col("timestamp"), is_wall(rows)
    absent = MOST if newest_first else LEAST
    low, high = (-last, -first) if newest_first else (first, last)
    if first == last == absent:
        return rows.filter(moment.isNull())
    bounds = [
        None if edge in (absent, -absent) else test(micros_literal(edge, wall))
        for edge, test in ((low, moment.__ge__), (high, moment.__le__))
    ]
    held = [b for b in bounds if b is not None]
    if not held:
        return rows
    between = held[0] if len(held) == 1 else held[0] & held[1]
    return rows.filter(between | moment.isNull() if absent in (first, last) else between)


def moments(place: Place, newest_first: bool) -> tuple[int, int] | None:
    """The microseconds from which to which a page goes; none if it has rows without a time."""
    if (MOST if newest_first else LEAST) in (place.first, place.last):
        return None
    return (-place.last, -place.first) if newest_first else (place.first, place.last)


def pages_at(
    rows: DataFrame, offset: int, page_size: int, pages: int, newest_first: bool
) -> tuple[int, list[Place]]:
    """How many ``rows`` there are, and where up to ``pages`` pages from ``offset`` on lie."""
    keys = rows.select(key_of(rows, newest_first).alias("key"))
    key = F.col("key")

    def sketch(ranks: list[_Rank] | None) -> list[list[int]]:
        quantiles = [F.lit((k + 0.5) / GRID) for k in range(GRID)]
        taken = [
            F.percentile_approx(key if r is None else F.when(r.within(key), key), F.array(*quantiles), ACCURACY)
            for r in ranks or [None]
        ]
        inside = keys if ranks is None else keys.filter(_any(r.within(key) for r in ranks))
        found = inside.agg(F.count(F.lit(1)), *taken).head()
        return list(found)

    total, grid = sketch(None)
    if offset >= total:
        return total, []
    end = min(offset + page_size * pages, total)
    ranks = [_Rank(offset, total), _Rank(end - 1, total)]
    grids = [grid, grid]
    while any(r.open for r in ranks):
        waiting = [(r, g) for r, g in zip(ranks, grids) if r.open]
        near = sorted(set().union(*(r.near(g) for r, g in waiting)))
        counts = keys.agg(
            *(F.count_if(key < x) for x in near), *(F.count_if(key <= x) for x in near)
        ).head()
        below, upto = dict(zip(near, counts)), dict(zip(near, counts[len(near) :]))
        for r, _ in waiting:
            r.narrow(below, upto)
        still = [r for r in ranks if r.open]
        found = iter(sketch(still)[1:]) if still else iter(())
        grids = [next(found) if r.open else [] for r in ranks]
    # Keys of the rows at and between the edges: the pages' own rows and few more.
    low, high = ranks[0].low, ranks[1].high
    sizes = keys.filter(key.between(low, high)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    held = sorted((r["key"], r["n"]) for r in sizes.toLocalIterator())
    ends, at = [], ranks[0].before
    for _, n in held:
        at += n
        ends.append(at)
    starts = [ranks[0].before, *ends[:-1]]
    places = []
    for begin in range(offset, end, page_size):
        stop = min(begin + page_size, end)
        i, j = bisect_right(ends, begin), bisect_left(ends, stop)
        places.append(
            Place(
                held[i][0], held[j][0], begin - starts[i], stop - begin,
                ends[j] - starts[i], held[i][1], held[j][1],
            )
        )
    return total, places


def _any(conditions) -> Column:
    out = F.lit(False)
    for condition in conditions:
        out = out | condition
    return out
