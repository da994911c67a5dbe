"""Quality rules as weak supervision.

Each rule votes good or bad or abstains. Expectation-maximisation over the counts of vote patterns
estimates how accurate each rule is, as the chances of its votes on good and on bad documents, and
the posterior probability of good quality decides. There are 3 ** rules patterns at most, so what reaches the
driver is bounded; the posterior is a plain expression over the votes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from logmere.llm.common import NOT_SPACE, stored, words

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: The estimate goes on until no number of it moves by more.
SETTLED = 1e-7
GOOD, BAD, NONE = 1, 0, -1
VOTES = (GOOD, BAD, NONE)
#: At the start a rule is nearly always right about good documents, and finds few of the bad ones,
#: as each rule knows one kind of them.
START_SHARE, START_ON_GOOD, START_ON_BAD = 0.9, 0.999, 0.3
START_ROWS = 10.0
#: A rule is written so that it wrongs few good documents; without this, the two classes may drift.
LEAST_ON_GOOD = 0.99


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """How many words lie in windows whose hash comes more than once."""

    def positions(ordered: Column) -> Column:
        def repeated(k: Column) -> Column:
            here = F.get(ordered, k)["h"]
            same = lambda j: F.coalesce(F.get(ordered, j)["h"] == here, F.lit(False))
            return same(k - 1) | same(k + 1)

        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        return F.array_sort(
            F.transform(F.filter(places, repeated), lambda k: F.get(ordered, k)["at"])
        )

    ordered = F.array_sort(
        F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at")))
    )
    return F.aggregate(
        _let(ordered, positions),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"),
            (p + WINDOW).alias("end"),
        ),
        lambda a: a["n"],
    )


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of counts for each document; a null or empty text has zeros."""
    split = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")
    ).select("id", "text", words(F.col("text")).alias("words"), F.split("text", "\n").alias("lines"))
    with_lines = split.select(
        "id",
        "text",
        "words",
        F.size("words").alias("n"),
        F.filter("lines", lambda x: x.rlike(NOT_SPACE)).alias("lines"),
        F.when(
            F.size("words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(1), F.size("words") - WINDOW + 1),
                lambda k: F.xxhash64(F.slice("words", k, WINDOW)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("windows"),
    )
    return with_lines.select(
        "id",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"), _covered(F.col("windows"))
        )
        .otherwise(F.lit(0))
        .cast("long")
        .alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
        F.regexp_count("text", F.lit("\\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("!")).cast("long").alias("n_shouts"),
    )


@dataclass(frozen=True)
class Rule:
    """Bad where ``bad`` holds, else good where ``good`` holds, else no vote."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.expr(
            f"CASE WHEN {self.bad} THEN {BAD} WHEN {self.good} THEN {GOOD} ELSE {NONE} END"
        )


RULES = (
    Rule(
        "word_length",
        "word_chars BETWEEN 2.5 * n_words AND 10 * n_words",
        "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    ),
    Rule("symbols", "20 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("lines", "20 * n_dup_lines <= n_lines", "2 * n_dup_lines > n_lines"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "4 * n_repeat_words > n_words"),
    Rule("capitals", "20 * n_capitals <= 3 * word_chars", "10 * n_capitals > 3 * word_chars"),
    Rule("shouts", "20 * n_shouts <= n_words", "10 * n_shouts > n_words"),
    Rule("variety", "4 * n_distinct >= n_words", "10 * n_distinct < n_words"),
)


@dataclass(frozen=True)
class Model:
    """Share of good documents and, by rule, how often it is right about good and about bad ones."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[dict[int, float]]:
        """By rule and vote, what it adds to the log odds of good; no vote adds nothing."""
        return [
            {GOOD: math.log(g / (1 - b)), BAD: math.log((1 - g) / b), NONE: 0.0}
            for g, b in zip(self.on_good, self.on_bad, strict=True)
        ]

    def prior(self) -> float:
        return math.log(self.good / (1 - self.good))

    def accuracy(self, rule: int) -> float:
        return self.good * self.on_good[rule] + (1 - self.good) * self.on_bad[rule]

    def expression(self, names: list[str]) -> Column:
        """The posterior as a column over vote columns."""
        total = F.lit(self.prior())
        for name, weight in zip(names, self.weights(), strict=True):
            total = total + (
                F.when(F.col(name) == GOOD, F.lit(weight[GOOD]))
                .when(F.col(name) == BAD, F.lit(weight[BAD]))
                .otherwise(F.lit(weight[NONE]))
            )
        return 1 / (1 + F.exp(-total))


def estimate(patterns: dict[tuple[int, ...], int], rules: int) -> Model:
    """Expectation-maximisation over counted vote patterns; no patterns give the starting values."""
    model = Model(START_SHARE, (START_ON_GOOD,) * rules, (START_ON_BAD,) * rules)
    counted = sorted(patterns.items())
    every = sum(n for _, n in counted)
    moved = 1.0 if counted else 0.0
    while moved > SETTLED:
        weights, prior = model.weights(), model.prior()
        good = 0.0
        right_good, all_good = [0.0] * rules, [0.0] * rules
        right_bad, all_bad = [0.0] * rules, [0.0] * rules
        for votes, n in counted:
            total = prior + sum(w[v] for w, v in zip(weights, votes, strict=True))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, total))))
            good += n * p
            for rule, vote in enumerate(votes):
                if vote != NONE:
                    all_good[rule] += n * p
                    all_bad[rule] += n * (1 - p)
                    right_good[rule] += n * p * (vote == GOOD)
                    right_bad[rule] += n * (1 - p) * (vote == BAD)
        share = lambda some, of, start: (some + START_ROWS * start) / (of + START_ROWS)
        before = model
        model = Model(
            share(good, every, START_SHARE),
            tuple(
                max(LEAST_ON_GOOD, share(x, y, START_ON_GOOD))
                for x, y in zip(right_good, all_good, strict=True)
            ),
            tuple(share(x, y, START_ON_BAD) for x, y in zip(right_bad, all_bad, strict=True)),
        )
        was, now = ((m.good, *m.on_good, *m.on_bad) for m in (before, model))
        moved = max(abs(x - y) for x, y in zip(was, now, strict=True))
    return model


def judge(
    docs: DataFrame,
    threshold: float = 0.5,
    rules: tuple[Rule, ...] = RULES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Counts, votes, ``quality`` (posterior) and ``kept`` for each row of ``docs``.

    ``base_failed``: under 20 words, or over 30 % of them in windows of eight words that come twice
    or more in the text. ``kept``: not failed, and posterior at least ``threshold``. Null and empty
    texts have no words and fail. Repeated rows are judged alike and each counts in the estimate,
    which is made over the documents that haven't failed.
    An empty table gives no rows. Words of any length and texts of any length are taken whole.
    """
    names = [f"vote_{r.name}" for r in rules]
    voted = stored(
        measured(docs, id_column, text_column).select(
            "*", *(r.vote().alias(name) for r, name in zip(rules, names, strict=True))
        ),
        "quality-votes",
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )
    counted = voted.filter(~failed).groupBy(*names).count().collect()
    model = estimate({tuple(r[n] for n in names): r["count"] for r in counted}, len(rules))
    return (
        voted.withColumn("quality", model.expression(names))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= threshold))
        .withColumnRenamed("id", id_column)
    )
