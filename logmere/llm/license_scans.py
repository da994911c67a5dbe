"""License scans by ordered signature rules.

Keywords decide which rules look at a text at all; a text without any isn't looked at further. Where
detections overlap, one that lies inside another of the same or a higher order is suppressed.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from logmere.llm.license_rules import BASE, GATES, Rule, all_rules

#: Runs of ASCII characters that are neither letters nor digits.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OPEN, CLOSE = "\x01", "\x02"
ORDERS = 4


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(text: Column, pattern: Column) -> Column:
    """First and last word of each match; matches are whole words."""

    def marked(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(pieces) - 1)
        starts = F.filter(numbers, lambda k: F.startswith(F.get(pieces, k), F.lit(OPEN)))
        ends = F.filter(numbers, lambda k: F.endswith(F.get(pieces, k), F.lit(CLOSE)))
        return F.arrays_zip(starts.alias("start"), ends.alias("end"))

    signs = F.regexp_replace(text, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f"{OPEN}$1{CLOSE}"))
    return _let(F.split(F.trim(signs), " "), marked)


def _detections(text: Column, rules: list[Rule]) -> Column:
    """All matches of the rules whose keyword the text has; each set of keywords is looked for once."""
    by_keywords: dict[tuple[str, ...], list[Rule]] = {}
    for rule in rules:
        by_keywords.setdefault(rule.keywords, []).append(rule)
    table = F.array(
        *(
            F.struct(
                F.array(*map(F.lit, keywords)).alias("keywords"),
                F.array(
                    *(
                        F.struct(
                            F.lit(r.label).alias("label"),
                            F.lit(r.order).alias("order"),
                            F.lit(r.confidence).alias("confidence"),
                            F.lit(r.pattern).alias("pattern"),
                        )
                        for r in group
                    )
                ).alias("rules"),
            )
            for keywords, group in by_keywords.items()
        )
    )
    groups = F.filter(table, lambda g: F.exists(g["keywords"], lambda k: F.contains(text, k)))
    fitting = F.filter(
        F.flatten(F.transform(groups, lambda g: g["rules"])), lambda r: F.rlike(text, r["pattern"])
    )
    return F.flatten(
        F.transform(
            fitting,
            lambda r: F.transform(
                _places(text, r["pattern"]),
                lambda p: F.struct(
                    p["start"].cast("long").alias("start"),
                    (-p["end"]).cast("long").alias("minus_end"),
                    r["order"].alias("order"),
                    r["label"].alias("label"),
                    r["confidence"].alias("confidence"),
                ),
            ),
        )
    )


def _standing(found: Column) -> Column:
    """Detections that no other one of the same or a higher order covers."""
    kinds = "array<struct<start:bigint,minus_end:bigint,`order`:int,label:string,confidence:double>>"

    def step(state: Column, d: Column) -> Column:
        end = -d["minus_end"]
        reach = F.get(state["reach"], d["order"])
        return F.struct(
            F.transform(
                state["reach"],
                lambda r, k: F.when(k >= d["order"], F.greatest(r, end)).otherwise(r),
            ).alias("reach"),
            F.when(reach >= end, state["kept"])
            .otherwise(F.array_append(state["kept"], d))
            .alias("kept"),
        )

    start = F.struct(
        F.array(*[F.lit(-1).cast("long")] * ORDERS).alias("reach"),
        F.array().cast(kinds).alias("kept"),
    )
    return F.aggregate(F.array_sort(found), start, step, lambda s: s["kept"])


def scan(
    docs: DataFrame,
    rules: list[Rule] | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, n_words, base, detections`` for each row of ``docs``.

    Words are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower
    case. ``base``: for each of the base phrases the words it starts at. ``detections``: start and
    end word, order, label and confidence of what stands after suppression. Equal places: the higher
    order, then the smaller label wins. A null text counts as empty: no words, nothing found. Texts
    are taken whole; repeated rows are scanned alike; an empty table gives no rows.
    """
    least = [*GATES] if rules is None else sorted({k for r in rules for k in r.keywords})
    least += [f" {p} " for p, _ in BASE if not any(k in f" {p} " for k in least)]
    rules = all_rules() if rules is None else rules
    spaced = docs.select(
        F.col(id_column).alias("id"),
        F.concat(
            F.lit(" "),
            F.trim(F.regexp_replace(F.coalesce(F.col(text_column), F.lit("")), BETWEEN, " ")),
            F.lit(" "),
        ).alias("words"),
    ).select(
        "id",
        F.when(
            F.length("words") > 2,
            F.length("words") - F.length(F.replace(F.col("words"), F.lit(" "))) - 1,
        )
        .otherwise(0)
        .cast("long")
        .alias("n_words"),
        "words",
        F.lower("words").alias("low"),
    )
    # Lower case of all letters shows whatever that of A-Z does; the rules see the latter.
    gate = reduce(or_, (F.contains("low", F.lit(k)) for k in least))
    spaced = spaced.select(
        "id", "n_words", F.when(gate, F.translate("words", UPPER, LOWER)).alias("gated")
    )
    none = F.array().cast("array<bigint>")
    phrases = F.struct(
        *(
            F.when(
                F.contains("gated", F.lit(f" {phrase} ")),
                F.transform(
                    _places(F.col("gated"), F.lit(f"(?<= ){phrase}(?= )")),
                    lambda p: p["start"].cast("long"),
                ),
            )
            .otherwise(none)
            .alias(label.replace("-", "_"))
            for phrase, label in BASE
        )
    )
    found = F.when(
        F.col("gated").isNotNull(), _standing(_detections(F.col("gated"), rules))
    )
    detections = F.transform(
        F.coalesce(found, F.array()),
        lambda d: F.struct(
            d["start"].alias("start"),
            (-d["minus_end"]).alias("end"),
            d["order"].alias("order"),
            d["label"].alias("label"),
            d["confidence"].alias("confidence"),
        ),
    )
    return spaced.select(
        F.col("id").alias(id_column),
        "n_words",
        phrases.alias("base"),
        detections.alias("detections"),
    )


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score: one minus the chance that every standing detection is wrong."""
    names = [(label, F.col("base")[label.replace("-", "_")]) for _, label in BASE]
    places = F.concat(*(places for _, places in names))
    base = F.filter(
        F.array(*(F.when(F.size(places) > 0, F.lit(label)) for label, places in names)),
        lambda x: x.isNotNull(),
    )
    labels = F.array_union(base, F.transform("detections", lambda d: d["label"]))
    wrong = F.aggregate("detections", F.lit(1.0), lambda a, d: a * (1 - d["confidence"]))
    return scanned.select(
        *(c for c in scanned.columns if c not in ("base", "detections")),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        (1 - wrong).alias("score"),
    )
