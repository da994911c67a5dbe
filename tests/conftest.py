import sys
from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logmere.schema import LOG_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("logmere-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def at(text: str) -> datetime:
    """A time on 2026-01-01 given as HH:MM:SS, or a whole ISO time."""
    text = text if "T" in text else f"2026-01-01T{text}"
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


@pytest.fixture
def make_logs(spark):
    """Log rows from (time, project, logid, level, message, caller) tuples."""

    def make(rows, parts=1):
        full = [
            (at(r[0]), *r[1:], *["m", ""][len(r) - 4 :]) if len(r) < 6 else (at(r[0]), *r[1:])
            for r in rows
        ]
        return spark.createDataFrame(full, LOG_SCHEMA).coalesce(parts)

    return make


def full_plan(frame) -> str:
    """The physical plan with all that is pushed to its scans."""
    modes = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode
    return frame._jdf.queryExecution().explainString(modes.fromString("formatted"))


def plain(frame) -> list[tuple]:
    """Rows as sorted tuples, times as UTC text."""
    from pyspark.sql import functions as F

    from logmere.functions.clock import wall_of

    if "timestamp" in frame.columns:
        frame = frame.withColumn("timestamp", wall_of(frame).cast("string"))
    return sorted((tuple(r) for r in frame.collect()), key=repr)
