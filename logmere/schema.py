"""Row types of the log lake."""

from __future__ import annotations

from pyspark.sql import types as T

LOG_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("project", T.StringType()),
        T.StructField("logid", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("caller", T.StringType()),
    ]
)
LOG_COLUMNS = LOG_SCHEMA.fieldNames()

# Columns that settle the order of rows sharing a timestamp, all ascending.
TIE_COLUMNS = ["project", "logid", "level", "message", "caller"]

# Rows are copies of one another when these agree; level and caller may differ.
COPY_KEY = ["timestamp", "project", "logid", "message"]

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("started", T.TimestampType()),
        T.StructField("ended", T.TimestampType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("projects", T.ArrayType(T.StringType())),
        T.StructField("size_bytes", T.LongType()),
        # Rows of each project; null in entries written before this was recorded.
        T.StructField("project_rows", T.MapType(T.StringType(), T.LongType())),
    ]
)
MANIFEST_COLUMNS = MANIFEST_SCHEMA.fieldNames()

# One record of the topic, before decoding.
WIRE_SCHEMA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("value", T.StringType()),
    ]
)

DEAD_LETTER_SCHEMA = T.StructType(
    WIRE_SCHEMA.fields + [T.StructField("reason", T.StringType())]
)
