"""A look-up request: its parameter rules and the predicate it stands for."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from logmere.functions.clock import ZERO_TIME, as_utc, parse_moment
from logmere.operators.filters import time_range

# Page size when none is given, and the largest page.
DEFAULT_LIMIT = 100
MAX_LIMIT = 1000


@dataclass(frozen=True)
class LogQuery:
    """What to look up. Empty strings and ``None`` leave a field open."""

    project: str = ""
    logid: str = ""
    level: str = ""
    start: datetime | None = None
    end: datetime | None = None
    limit: int = DEFAULT_LIMIT
    offset: int = 0
    order: str = "desc"

    @classmethod
    def parse(cls, params: Mapping[str, str]) -> LogQuery:
        """Build a request from text parameters, refusing malformed ones."""

        def moment(name: str) -> datetime | None:
            text = params.get(name, "")
            if not text:
                return None
            try:
                value = parse_moment(text)
            except ValueError as err:
                raise ValueError(f"parameter {name!r} is no time such as 2026-01-05T00:00:00Z: {err}") from err
            return None if value == ZERO_TIME else value

        def number(name: str, default: int, lowest: int) -> int:
            text = params.get(name, "")
            if not text:
                return default
            if not re.fullmatch(r"[+-]?[0-9]+", text) or int(text) < lowest:
                raise ValueError(f"parameter {name!r} is no whole number from {lowest} on: {text!r}")
            return int(text)

        named = {name: params.get(name, "") for name in ("project", "logid", "level")}
        return cls(
            **named,
            start=moment("from"),
            end=moment("to"),
            limit=number("limit", DEFAULT_LIMIT, 1),
            offset=number("offset", 0, 0),
            order=params.get("order", "") or "desc",
        ).validate()

    def validate(self) -> LogQuery:
        if not self.project and not self.logid:
            raise ValueError("a look-up names a project or a logid")
        if self.limit <= 0 or self.offset < 0:
            raise ValueError(f"no page of {self.limit} rows from {self.offset} on")
        if self.order not in ("asc", "desc"):
            raise ValueError(f"order is asc or desc, not {self.order!r}")
        return self

    @property
    def page_limit(self) -> int:
        """Rows of a page; out-of-range sizes are adjusted, not refused."""
        return DEFAULT_LIMIT if self.limit <= 0 else min(self.limit, MAX_LIMIT)

    @property
    def page_offset(self) -> int:
        return max(self.offset, 0)

    @property
    def newest_first(self) -> bool:
        return self.order != "asc"

    def matching(self, logs: DataFrame) -> DataFrame:
        """Rows of the request, all pages. The filters reach a Parquet scan."""
        for name in ("project", "logid", "level"):
            wanted = getattr(self, name)
            if wanted:
                logs = logs.filter(F.col(name) == wanted)
        return time_range(logs, *self.window)

    @property
    def window(self) -> tuple[datetime | None, datetime | None]:
        """Bounds of the time range; a zero time leaves its end open."""
        start, end = (
            None if moment is None or as_utc(moment) == ZERO_TIME else moment
            for moment in (self.start, self.end)
        )
        return start, end
