"""Call sites as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: file name, last colon, line number.
CALLER_SHAPE = r"^(.*):([0-9]+)(?![\s\S])"


def split_caller(caller: Column) -> Column:
    """``struct(file, line)``; both null when there is no ``file:line``."""
    matches = caller.rlike(CALLER_SHAPE)
    return F.struct(
        F.when(matches, F.regexp_extract(caller, CALLER_SHAPE, 1)).alias("file"),
        F.when(matches, F.regexp_extract(caller, CALLER_SHAPE, 2))
        .try_cast("int")
        .alias("line"),
    )
