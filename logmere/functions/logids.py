"""Correlation ids as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: UTC date, UTC minute, six characters of 0-9a-z.
LOGID_SHAPE = r"^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})-[0-9a-z]{6}(?![\s\S])"
SUFFIX_LENGTH = 6

# What a missing correlation id becomes, per front end.
FILLERS = {"go": "-", "python": "unknown"}


def default_logid(logid: Column, filler: str) -> Column:
    return F.coalesce(F.nullif(logid, F.lit("")), F.lit(filler))


def make_logid(wall: Column, *seed: Column) -> Column:
    """An id ``yyyymmdd-hhmm-xxxxxx`` for a UTC wall clock.

    The tail is a hash of the seed, so a retried task yields the same id.
    """
    text = wall.cast("string")
    stamp = F.concat(
        F.substring(text, 1, 4), F.substring(text, 6, 2), F.substring(text, 9, 2),
        F.lit("-"), F.substring(text, 12, 2), F.substring(text, 15, 2),
    )
    number = F.pmod(F.xxhash64(*seed), F.lit(36**SUFFIX_LENGTH))
    tail = F.lower(F.conv(number.cast("string"), 10, 36))
    return F.concat(stamp, F.lit("-"), F.lpad(tail, SUFFIX_LENGTH, "0"))


def logid_minute(logid: Column) -> Column:
    """UTC minute (zone-less) read from an id, null for any other shape."""
    iso = F.regexp_replace(logid, LOGID_SHAPE, "$1-$2-$3 $4:$5:00")
    return F.when(logid.rlike(LOGID_SHAPE), iso.try_cast("timestamp_ntz"))
