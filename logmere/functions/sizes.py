"""Row size estimate used for volume accounting and file sizing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bytes counted per row beside the strings, and the strings counted.
ROW_OVERHEAD_BYTES = 16
SIZED_COLUMNS = ["project", "logid", "level", "message"]


def row_bytes() -> Column:
    """Estimated bytes of a log row; the call site is not counted."""
    total = F.lit(ROW_OVERHEAD_BYTES).cast("bigint")
    for name in SIZED_COLUMNS:
        total = total + F.coalesce(F.octet_length(F.col(name)), F.lit(0))
    return total
