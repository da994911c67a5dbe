"""Severity levels as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Level names, lowest first; the position is the ordinal.
LEVELS = ["DEBUG", "INFO", "WARN", "ERROR", "FATAL"]
DEFAULT_LEVEL = "INFO"

# Numeric severities of the two kinds of producers.
PYTHON_SEVERITIES = {10: "DEBUG", 20: "INFO", 30: "WARN", 40: "ERROR", 50: "FATAL"}
SLOG_THRESHOLDS = [(8, "ERROR"), (4, "WARN"), (0, "INFO")]
SLOG_BELOW = "DEBUG"


def ordinal_of(name: str) -> int:
    """Ordinal of a level name on the driver; unknown names count as INFO."""
    return LEVELS.index(name if name in LEVELS else DEFAULT_LEVEL)


def level_ordinal(name: Column) -> Column:
    """0 to 4; unknown names count as INFO."""
    branches = F.when(name == LEVELS[0], 0)
    for number, level in enumerate(LEVELS[1:], start=1):
        branches = branches.when(name == level, number)
    return branches.otherwise(LEVELS.index(DEFAULT_LEVEL))


def level_name(number: Column) -> Column:
    """Name of an ordinal; out of range is INFO."""
    branches = F.when(number == 0, LEVELS[0])
    for position, level in enumerate(LEVELS[1:], start=1):
        branches = branches.when(number == position, level)
    return branches.otherwise(DEFAULT_LEVEL)


def parse_level(text: Column) -> Column:
    """``struct(level, ok)``; case-sensitive, a miss gives (INFO, false)."""
    known = F.coalesce(text.isin(LEVELS), F.lit(False))
    return F.struct(
        F.when(known, text).otherwise(DEFAULT_LEVEL).alias("level"), known.alias("ok")
    )


def severity_to_level(number: Column, scheme: str) -> Column:
    """Level of a numeric severity.

    ``python`` maps the five standard numbers exactly and anything else to
    INFO; ``slog`` uses thresholds and never yields FATAL.
    """
    if scheme == "python":
        pairs = list(PYTHON_SEVERITIES.items())
        branches = F.when(number == pairs[0][0], pairs[0][1])
        for value, level in pairs[1:]:
            branches = branches.when(number == value, level)
        return branches.otherwise(DEFAULT_LEVEL)
    if scheme == "slog":
        branches = F.when(number >= SLOG_THRESHOLDS[0][0], SLOG_THRESHOLDS[0][1])
        for floor, level in SLOG_THRESHOLDS[1:]:
            branches = branches.when(number >= floor, level)
        return branches.otherwise(SLOG_BELOW)
    raise ValueError(f"unknown severity scheme: {scheme!r}")
