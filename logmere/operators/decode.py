"""Strict decoding of wire records into log rows, and the rows that fail.

``from_json`` alone is too lenient: it ignores text after the object, and turns
numbers into strings. The decoder therefore parses the payload as the first
element of a two-element array whose second element is a sentinel that no
producer can guess. Trailing text, a second value or an early closing bracket
all displace the sentinel.

Most records spell each key exactly, once, with a string value. Counting keys in
the text shows that, and such records need a single parse into strings. The
others are parsed again into variants, which keep the JSON type, inside a map,
which keeps repeated keys in order.

Everything is a column expression: decoding is a narrow, map-only step that
works the same on batch and streaming frames.
"""

from __future__ import annotations

import secrets
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from logmere.functions.clock import (
    ZERO_TIME,
    is_wall,
    moment_literal,
    parse_rfc3339,
)
from logmere.schema import DEAD_LETTER_SCHEMA, LOG_COLUMNS

# Reasons a record is refused, in the order they are checked.
BAD_JSON = "decode json"
REQUIRED = {
    "project": "decode: project is required",
    "logid": "decode: logid is required",
    "level": "decode: level is required",
}

_STRICT = {
    "allowComments": "false",
    "allowNonNumericNumbers": "false",
    "allowNumericLeadingZeros": "false",
    "allowSingleQuotes": "false",
    "allowUnquotedControlChars": "false",
    "allowUnquotedFieldNames": "false",
    # An object may be nested 10,000 deep, and the frame adds one; lengths have no limit of their own.
    "maxNestingDepth": "10001",
    "maxNumLen": "2147483647",
    "maxStringLen": "2147483647",
}
_NAMES = "|".join(LOG_COLUMNS)
# A quote inside a JSON string is escaped, so these match keys only.
_STRING_KEY = f'"(?:{_NAMES})"\\s*:\\s*"'
_OTHER_KEY = f'"(?i:{_NAMES})"(?<!"(?:{_NAMES})")\\s*:|"(?:{_NAMES})"\\s*:\\s*[^"\\s]'
_ESCAPED_KEY = r'\\u[0-9a-fA-F]{4}[^"\\]*"\s*:'
_QUOTED = ", ".join(f"'{name}'" for name in LOG_COLUMNS)
# Keys match without regard to case; U+017F folds to s.
_FOLDED = "lower(translate({0}, 'ſ', 's'))"


def _parsed(raw: DataFrame) -> DataFrame:
    """Add the parse results: ``_plain`` fields, or else the ``_map`` of the object.

    ``_empty`` marks a payload that is JSON null, which holds no fields.
    """
    sentinel = "s" + secrets.token_hex(16)

    def framed(element: str) -> Column:
        """The payload followed by the sentinel, parsed as one array."""
        return F.from_json(text, f"array<{element}>", _STRICT)

    def struct_of(kind: str) -> str:
        fields = [f"{name}:{kind}" for name in LOG_COLUMNS] + [f"{sentinel}:int"]
        return "struct<" + ",".join(fields) + ">"

    text = F.concat(F.lit("["), F.col("value"), F.lit(',{"' + sentinel + '":1}]'))
    present = " + ".join(f"int(_texts[0].{name} IS NOT NULL)" for name in LOG_COLUMNS)
    plain = (
        F.expr(f"size(_texts) = 2 AND _texts[1].{sentinel} IS NOT NULL")
        & (F.regexp_count("value", F.lit(_STRING_KEY)) == F.expr(present))
        & ~F.col("value").rlike(_OTHER_KEY)
        & ~F.col("value").contains("ſ")
        & ~(F.col("value").contains("\\u") & F.col("value").rlike(_ESCAPED_KEY))
    )
    frame = (
        raw.withColumn("_texts", framed(struct_of("string")))
        .withColumn("_plain", F.when(plain, F.expr("_texts[0]")))
        .withColumn(
            "_doc", F.when(F.col("_plain").isNull(), framed("map<string,variant>"))
        )
    )
    # An object under an unknown key may repeat a key. A variant cannot hold
    # that, though such a record is valid; read it by exact field names, which
    # skips unknown keys, provided the known keys are spelled exactly and once.
    unread = F.expr("_plain IS NULL AND _doc IS NULL") & F.col("value").rlike(r"^\s*\{")
    frame = frame.withColumn(
        "_pairs", F.when(unread, framed("map<string,string>"))
    ).withColumn(
        "_known", F.expr(f"filter(map_keys(_pairs[0]), k -> {_FOLDED.format('k')} IN ({_QUOTED}))")
    )
    spelled = F.expr(
        f"size(_pairs) = 2 AND map_contains_key(_pairs[1], '{sentinel}')"
        f" AND size(_known) = size(array_distinct(_known))"
        f" AND forall(_known, k -> k IN ({_QUOTED}))"
    )
    frame = frame.withColumn("_fields", F.when(spelled, framed(struct_of("variant"))))
    entries = ", ".join(f"'{name}', _fields[0].{name}" for name in LOG_COLUMNS)
    complete = f"size(_doc) = 2 AND map_contains_key(_doc[1], '{sentinel}')"
    return frame.select(
        *raw.columns,
        "_plain",
        F.expr(
            f"CASE WHEN {complete} THEN _doc[0]"
            f" WHEN _fields IS NOT NULL THEN map({entries}) END"
        ).alias("_map"),
        F.expr(f"{complete} AND _doc[0] IS NULL").alias("_empty"),
    )


def _fields(raw: DataFrame) -> DataFrame:
    """Add ``_read`` and one text column per field, null when absent."""
    given = F.expr(
        "filter(transform(map_entries(_map),"
        f" e -> struct({_FOLDED.format('e.key')} AS key, e.value AS value)),"
        f" e -> e.key IN ({_QUOTED}) AND e.value IS NOT NULL AND NOT is_variant_null(e.value))"
    )
    texts = F.expr(
        "CASE WHEN forall(_given, e -> schema_of_variant(e.value) = 'STRING')"
        " THEN transform(_given, e -> struct(e.key AS key, string(e.value) AS value)) END"
    )
    last = "try_element_at(filter(_entries, e -> e.key = '{0}'), -1).value"
    return (
        _parsed(raw)
        .withColumn("_given", given)
        .withColumn("_entries", texts)
        .select(
            *raw.columns,
            F.expr(
                "_plain IS NOT NULL OR _entries IS NOT NULL OR coalesce(_empty, false)"
            ).alias("_read"),
            *[
                F.expr(
                    f"CASE WHEN _plain IS NOT NULL THEN _plain.{name}"
                    f" ELSE {last.format(name)} END"
                ).alias(f"_{name}")
                for name in LOG_COLUMNS
            ],
        )
    )


def decode(raw: DataFrame) -> DataFrame:
    """Wire records to log columns plus ``reason``; null reason means clean.

    ``raw`` needs a ``value`` column; its other columns are carried along. Key
    case is ignored, later keys win, JSON nulls are skipped, unknown keys are
    ignored, and a field that is not a string refuses the record. The timestamp
    is null where none was sent; ``backfill_timestamp`` fills it.
    """
    sent = F.col("_timestamp")
    fields = _fields(raw).withColumn("timestamp", parse_rfc3339(sent))
    bad_json = ~F.col("_read") | (sent.isNotNull() & F.col("timestamp").isNull())
    reason = F.when(bad_json, BAD_JSON)
    for name, text in REQUIRED.items():
        reason = reason.when(F.coalesce(F.col(f"_{name}"), F.lit("")) == "", text)
    result = F.struct(
        F.col("timestamp"),
        *[
            F.coalesce(F.col(f"_{name}"), F.lit("")).alias(name)
            for name in LOG_COLUMNS[1:]
        ],
        reason.alias("reason"),
    )
    # A filter on these columns must not be pushed below and so repeat the whole
    # of the parsing in its condition; a generator of one row holds it up here.
    return fields.select(*raw.columns, F.explode(F.array(result)).alias("_row")).select(
        *raw.columns, "_row.*"
    )


def backfill_timestamp(logs: DataFrame, now: datetime | Column) -> DataFrame:
    """Fill a missing or zero timestamp.

    ``now`` is a fixed time, or a column such as the arrival time of the record
    so that a replay produces the same rows.
    """
    wall = is_wall(logs)
    filler = moment_literal(now, wall) if isinstance(now, datetime) else now
    moment = F.col("timestamp")
    unset = moment.isNull() | (moment == moment_literal(ZERO_TIME, wall))
    return logs.withColumn("timestamp", F.when(unset, filler).otherwise(moment))


def clean_rows(decoded: DataFrame, now: datetime | Column) -> DataFrame:
    """Log rows of the records that decoded."""
    clean = decoded.filter(F.col("reason").isNull())
    return backfill_timestamp(clean, now).select(*LOG_COLUMNS)


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Refused records with the raw value, where it came from, and why."""
    kept = [name for name in DEAD_LETTER_SCHEMA.fieldNames() if name in decoded.columns]
    return decoded.filter(F.col("reason").isNotNull()).select(*kept)


def ingest_stats(decoded: DataFrame) -> DataFrame:
    """``(outcome, records)``: decoded, and one row per reason for refusal."""
    outcome = F.coalesce(F.col("reason"), F.lit("decoded"))
    return decoded.groupBy(outcome.alias("outcome")).agg(
        F.count(F.lit(1)).alias("records")
    )
