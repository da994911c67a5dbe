"""Column expressions; none of them leaves the JVM."""

from logmere.functions.callers import split_caller
from logmere.functions.clock import (
    instant_from_wall,
    parse_moment,
    parse_rfc3339,
    wall_from_instant,
)
from logmere.functions.levels import (
    LEVELS,
    level_name,
    level_ordinal,
    parse_level,
    severity_to_level,
)
from logmere.functions.logids import default_logid, logid_minute, make_logid
from logmere.functions.sizes import row_bytes

__all__ = [
    "LEVELS",
    "default_logid",
    "instant_from_wall",
    "level_name",
    "level_ordinal",
    "logid_minute",
    "make_logid",
    "parse_level",
    "parse_moment",
    "parse_rfc3339",
    "row_bytes",
    "severity_to_level",
    "split_caller",
    "wall_from_instant",
]
