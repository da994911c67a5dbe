"""Time helpers that never consult the session time zone.

Log times are instants. Some sources hold them as zone-less wall clocks that
mean UTC (``TIMESTAMP_NTZ``); the operators accept both, and the helpers here
convert between the two and build literals of the matching type so that a
comparison stays a plain column-versus-literal predicate and reaches Parquet.
"""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed value: the shape accepted for an RFC 3339 time. One-digit hours and a
# comma before the fraction are accepted because producers may send them.
RFC3339 = (
    r"^(\d{4}-\d{2}-\d{2})T(\d{1,2}):(\d{2}:\d{2})(?:[.,](\d+))?"
    r"(?:(Z)|([+-])(\d{2}):(\d{2}))(?![\s\S])"
)
# The subset of that shape which a plain cast reads with the same result.
PLAIN_RFC3339 = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?"
    r"(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)(?![\s\S])"
)
# Largest offset parts that still parse.
MAX_OFFSET_HOUR = 24
MAX_OFFSET_MINUTE = 60

ZERO_TIME = datetime(1, 1, 1, tzinfo=timezone.utc)

_UNIX_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_HOUR_US = 3_600_000_000
_MINUTE_US = 60_000_000
_DAY_US = 24 * _HOUR_US


def as_utc(moment: datetime) -> datetime:
    """An aware datetime in UTC; naive input is taken to be UTC already."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def epoch_micros(moment: datetime) -> int:
    return (as_utc(moment) - _UNIX_EPOCH) // timedelta(microseconds=1)


def parse_moment(text: str) -> datetime:
    """Parse an RFC 3339 time given as a look-up parameter."""
    found = re.match(RFC3339, text, flags=re.ASCII)
    if not found:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    day, hour, rest, fraction, _, sign, off_hour, off_minute = found.groups()
    micros = (fraction or "0")[:6].ljust(6, "0")
    moment = datetime.fromisoformat(f"{day}T{hour.zfill(2)}:{rest}.{micros}+00:00")
    if sign:
        hours, minutes = int(off_hour), int(off_minute)
        if hours > MAX_OFFSET_HOUR or minutes > MAX_OFFSET_MINUTE:
            raise ValueError(f"time zone offset out of range: {text!r}")
        shift = timedelta(hours=hours, minutes=minutes)
        try:
            moment = moment - shift if sign == "+" else moment + shift
        except OverflowError as err:
            raise ValueError(f"time out of range: {text!r}") from err
    return moment


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text to an instant, null when it does not parse.

    Digits below the microsecond are cut off.
    """

    def part(n: int) -> Column:
        return F.regexp_extract(text, RFC3339, n)

    micros = F.rpad(F.substring(part(4), 1, 6), 6, "0")
    wall = F.concat(
        part(1), F.lit("T"), F.lpad(part(2), 2, "0"), F.lit(":"), part(3),
        F.lit("."), micros, F.lit("Z"),
    ).try_cast("timestamp")
    hours = part(7).try_cast("bigint")
    minutes = part(8).try_cast("bigint")
    shift = F.when(part(6) == "", F.lit(0).cast("bigint")).when(
        (hours <= MAX_OFFSET_HOUR) & (minutes <= MAX_OFFSET_MINUTE),
        F.when(part(6) == "+", F.lit(1)).otherwise(F.lit(-1))
        * (hours * _HOUR_US + minutes * _MINUTE_US),
    )
    return F.when(text.rlike(PLAIN_RFC3339), text.try_cast("timestamp")).when(
        text.rlike(RFC3339), F.timestamp_micros(F.unix_micros(wall) - shift)
    )


def _wall_micros(wall: Column) -> Column:
    since = wall - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")

    def field(name: str) -> Column:
        return F.extract(F.lit(name), since).cast("bigint")

    seconds = F.extract(F.lit("SECOND"), since) * F.lit(1_000_000).cast("bigint")
    return (
        field("DAY") * _DAY_US
        + field("HOUR") * _HOUR_US
        + field("MINUTE") * _MINUTE_US
        + seconds.cast("bigint")
    )


def instant_from_wall(wall: Column) -> Column:
    """Zone-less wall clock meaning UTC, to an instant."""
    return F.timestamp_micros(_wall_micros(wall))


def wall_from_instant(moment: Column) -> Column:
    """Instant to the zone-less UTC wall clock."""
    seconds = F.unix_micros(moment).cast("decimal(20,0)") / 1_000_000
    zero = F.lit(0)
    return F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(
        zero, zero, zero, seconds
    )


def is_wall(frame: DataFrame, name: str = "timestamp") -> bool:
    return isinstance(frame.schema[name].dataType, T.TimestampNTZType)


def micros_of(frame: DataFrame, name: str = "timestamp") -> Column:
    """Microseconds since the epoch of a time column of either type."""
    column = F.col(name)
    return _wall_micros(column) if is_wall(frame, name) else F.unix_micros(column)


def wall_of(frame: DataFrame, name: str = "timestamp") -> Column:
    """UTC wall clock of a time column of either type."""
    column = F.col(name)
    return column if is_wall(frame, name) else wall_from_instant(column)


def micros_literal(micros: int, wall: bool) -> Column:
    """A literal comparable with the time column without casting the column."""
    moment = F.timestamp_micros(F.lit(micros))
    return wall_from_instant(moment) if wall else moment


def moment_literal(moment: datetime, wall: bool) -> Column:
    return micros_literal(epoch_micros(moment), wall)
