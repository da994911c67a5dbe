"""Predicates on log rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from logmere.functions.clock import as_utc, is_wall, moment_literal
from logmere.functions.levels import DEFAULT_LEVEL, LEVELS, ordinal_of

# Time presets in minutes; "custom" leaves the window open.
PRESETS = {"15m": 15, "1h": 60, "6h": 360, "24h": 1440, "72h": 4320}
CUSTOM = "custom"


def by_project(logs: DataFrame, project: str) -> DataFrame:
    return logs.filter(F.col("project") == project)


def by_logid(logs: DataFrame, logid: str) -> DataFrame:
    """Rows of one correlation id, whichever projects they come from."""
    return logs.filter(F.col("logid") == logid)


def by_level(logs: DataFrame, level: str) -> DataFrame:
    """Rows of exactly this level; ``min_level`` is the threshold form."""
    return logs.filter(F.col("level") == level)


def min_level(logs: DataFrame, level: str) -> DataFrame:
    """Rows at or above a level, unknown ones counting as INFO; the filter reaches a Parquet scan."""
    lowest, name = ordinal_of(level), F.col("level")
    if lowest > LEVELS.index(DEFAULT_LEVEL):
        return logs.filter(name.isin(LEVELS[lowest:]))
    below = LEVELS[:lowest]
    return logs.filter(~name.isin(below) | name.isNull()) if below else logs


def within(
    logs: DataFrame, start: datetime | None, end: datetime | None
) -> Column | None:
    """Condition ``start <= timestamp <= end``; an absent end is open."""
    wall = is_wall(logs)
    moment = F.col("timestamp")
    condition = None
    if start is not None:
        condition = moment >= moment_literal(start, wall)
    if end is not None:
        upper = moment <= moment_literal(end, wall)
        condition = upper if condition is None else condition & upper
    return condition


def time_range(
    logs: DataFrame, start: datetime | None = None, end: datetime | None = None
) -> DataFrame:
    """Rows in a window, both ends included and each optional."""
    condition = within(logs, start, end)
    return logs if condition is None else logs.filter(condition)


def preset_window(name: str, now: datetime) -> tuple[datetime | None, datetime | None]:
    """``(start, end)`` of a named preset ending now."""
    if name == CUSTOM:
        return None, None
    if name not in PRESETS:
        raise ValueError(f"unknown preset: {name!r}")
    now = as_utc(now)
    return now - timedelta(minutes=PRESETS[name]), now


def preset_counts(logs: DataFrame, now: datetime) -> DataFrame:
    """``(preset, matches)`` for every preset, in one pass over the widest window."""
    widest = max(PRESETS, key=lambda name: PRESETS[name])
    counts = time_range(logs, *preset_window(widest, now)).agg(
        *[
            F.count_if(within(logs, *preset_window(name, now))).alias(name)
            for name in PRESETS
        ]
    )
    return counts.unpivot([], list(PRESETS), "preset", "matches")
