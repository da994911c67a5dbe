"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled documents is split by digest into three parts. Two of them train the
trees, each with features from the lexicon (words and word beginnings) that the other one teaches;
the third calibrates the trees' output, with the lexicon of both. All documents then get features
from that lexicon in one pass, and scores from the fitted models.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from logmere.llm.common import checked, ship_package, stored, text_hashes

#: Labelled documents that are used at most, the first ones by digest of the id.
MOST_LABELLED = 24_000
MOST_TERMS = 2_000
LEAST_EVIDENCE = 18.0
LEAST_ODDS = 2.0
LEAST_DOCUMENTS = 4
BEGINNINGS = (4, 5, 6)
TREES, DEPTH, STEP = 20, 3, 0.2
THRESHOLD = 0.7
#: This share of the score is the trees' own, so that equally calibrated documents keep an order.
OWN_SHARE = 0.01
NEAR_WORDS = 6
#: Parts of the sample, out of 100: the two that teach and train end here, the rest calibrates.
FIRST_END, SECOND_END = 42, 84
FILES = 4

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
NATIVE_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
CAPITALS = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
MIXED = re.compile(
    r"(?<![a-z0-9@$])(?=[a-z]*[0-9@$])(?=[0-9@$]*[a-z])[a-z0-9@$]{3,24}(?![a-z0-9@$])"
)
STRETCHED = re.compile(r"([a-zà-ÿ])\1\1+")
PLAIN = str.maketrans("013457@$", "oieastas")

#: Insults and pronouns of the second person.
INSULTS = frozenset(
    "idiot idiots stupid moron morons dumb fool trash garbage scum loser losers pathetic worthless"
    " disgusting clown ugly jerk filth vermin imbecile cretin dumm dummkopf abschaum widerlich"
    " versager erbärmlich wertlos trottel stupide imbécile crétin minable ordure dégoûtant nul"
    " estúpido idiota imbécil basura asqueroso inútil patético escoria payaso".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine euch ihr tu te toi ton ta tes vous votre"
    " vos ti tú tuyo usted ustedes vosotros".split()
)

FEATURES = (
    "log_words",
    "insult_density",
    "insult_count",
    "word_density",
    "word_count",
    "word_weight",
    "word_kinds",
    "beginning_density",
    "beginning_count",
    "beginning_weight",
    "hidden_count",
    "near_you",
    "you_density",
    "capitals",
    "shouts",
    "questions",
    "punctuation",
    "mixed_rate",
    "stretched_rate",
)


@dataclass(frozen=True)
class Lexicon:
    """Learned words and beginnings (by length) with their log odds."""

    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[int, dict[str, float]] = field(default_factory=dict)

    def begins(self, word: str) -> float:
        """The largest log odds of a beginning of ``word``, 0 without one."""
        return max((t.get(word[:k], 0.0) for k, t in self.beginnings.items()), default=0.0)


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The values of ``FEATURES``; a null text counts as empty."""
    text = text or ""
    low = text.lower()
    words = WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = set(words)
    insults = kinds & INSULTS
    known = kinds & lexicon.words.keys()
    begun = {w for w in kinds if lexicon.begins(w) > 0.0}
    you = kinds & SECOND_PERSON
    bad = insults | known | begun
    n_insults = n_known = n_begun = n_you = 0
    near = 0.0
    if bad or you:
        bad_at, you_at = [], []
        for k, w in enumerate(words):
            if w in bad:
                bad_at.append(k)
                n_insults += w in insults
                n_known += w in known
                n_begun += w in begun
            if w in you:
                you_at.append(k)
        n_you = len(you_at)
        near = _closest(bad_at, you_at)
    mixed = MIXED.findall(low)
    stretched = len(STRETCHED.findall(low))
    plain = [w.translate(PLAIN) for w in mixed] if mixed else []
    hidden = sum(w in INSULTS or w in lexicon.words for w in plain)
    if stretched:
        short = {w for w in WORD.findall(STRETCHED.sub(r"\1", low)) if w not in kinds}
        hidden += sum(w in INSULTS or w in lexicon.words for w in short)
    return [
        math.log1p(len(words)),
        n_insults / n,
        math.log1p(n_insults),
        n_known / n,
        math.log1p(n_known),
        sum(sorted((lexicon.words[w] for w in known), reverse=True)[:5]),
        math.log1p(len(known)),
        n_begun / n,
        math.log1p(n_begun),
        sum(sorted((lexicon.begins(w) for w in begun), reverse=True)[:5]),
        math.log1p(hidden),
        near,
        n_you / n,
        (len(text) - len(CAPITALS.sub("", text))) / chars,
        text.count("!") / n,
        text.count("?") / n,
        sum(map(text.count, ".,;:-")) / n,
        len(mixed) / n,
        stretched / n,
    ]


def _closest(left: list[int], right: list[int]) -> float:
    """1 for neighbours, less for larger gaps, 0 beyond ``NEAR_WORDS``; both lists are in order."""
    best, k = NEAR_WORDS + 1, 0
    for at in left:
        while k + 1 < len(right) and abs(right[k + 1] - at) <= abs(right[k] - at):
            k += 1
        if right and right[k] != at:
            best = min(best, abs(right[k] - at))
    return max(0.0, (NEAR_WORDS + 1 - best) / NEAR_WORDS)


def featured(rows: DataFrame, lexicon: Lexicon, keep: str) -> DataFrame:
    """The columns of the schema ``keep`` and the features of ``text``."""
    names = [part.split()[0] for part in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py(), lexicon) for t in batch.column("text")]
            columns = [pa.array(c, pa.float64()) for c in zip(*made, strict=True)]
            if columns:
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), *columns], names=[*names, *FEATURES]
                )

    schema = ", ".join([keep, *(f"{f} double" for f in FEATURES)])
    return rows.select(*names, F.col("text").cast("string")).mapInArrow(run, schema)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; rows with 1 are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def sampled_labels(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """``(doc, toxic, part)``: at most ``most`` labels that may be learned from.

    A repeated id counts once, as toxic if any of its labels says so. ``part`` is from 0 to 99.
    """
    usable = labels.filter(
        F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (remainder(F.col("doc_id")) != 1)
    )
    single = usable.groupBy(F.col("doc_id").alias("doc")).agg(
        F.max((F.col("toxic") > 0).cast("int")).alias("toxic")
    )
    order = F.xxhash64("doc")
    return single.orderBy(order, "doc").limit(most).select(
        "doc", "toxic", F.pmod(F.xxhash64(F.lit("part"), "doc"), F.lit(100)).alias("part")
    )


def without_copies(sample: DataFrame) -> DataFrame:
    """One of texts that share the smallest hash of their shingles, by either of two hashes.

    Copies of one toxic text would make all its words look toxic. Those that share a passage may go
    as well; it is a sample.
    """
    words = F.regexp_extract_all(F.lower("text"), F.lit(NATIVE_WORD), 0)
    rows = sample.withColumn("words", F.coalesce(words, F.array())).withColumn(
        "hashes",
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - 2)),
            lambda k: F.xxhash64(F.slice("words", k, 3)),
        ),
    )
    keyed = rows.select(
        *sample.columns,
        F.array_min("hashes").alias("low"),
        F.array_min(F.transform("hashes", lambda h: F.xxhash64(h))).alias("other"),
    )
    for key in ("low", "other"):
        first = Window.partitionBy(key).orderBy("doc")
        keyed = keyed.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")
    return keyed.select(*sample.columns)


def learned_lexicon(sample: DataFrame) -> Lexicon:
    """Words and beginnings that toxic texts have far more often, from ``(text, toxic)``."""
    sums = sample.agg(F.sum("toxic"), F.count(F.lit(1))).head()
    n_toxic, n = sums[0] or 0, sums[1]
    if not n_toxic or n_toxic == n:
        return Lexicon()
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(NATIVE_WORD), 0))
    split = sample.select("toxic", words.alias("words"))
    kinds = [F.transform("words", lambda w: F.struct(F.lit(0).alias("k"), w.alias("term")))]
    for k in BEGINNINGS:
        heads = F.transform(
            F.filter("words", lambda w, k=k: F.length(w) > k), lambda w, k=k: F.substring(w, 1, k)
        )
        kinds.append(
            F.transform(
                F.array_distinct(heads), lambda w, k=k: F.struct(F.lit(k).alias("k"), w.alias("term"))
            )
        )
    terms = (
        split.select("toxic", F.explode(F.concat(*kinds)).alias("t"))
        .groupBy("t.k", "t.term")
        .agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("all"))
    )
    share = n_toxic / n
    rate = F.col("bad") / F.col("all")
    # Twice the log likelihood ratio of the term's own share of toxic texts against the usual one.
    gain = lambda x, y: F.when(x > 0, F.col("all") * x * F.log(x / y)).otherwise(0.0)
    evidence = 2 * (gain(rate, F.lit(share)) + gain(1 - rate, F.lit(1 - share)))
    odds = F.log((F.col("bad") + share) / (F.col("all") - F.col("bad") + 1 - share)) - math.log(
        share / (1 - share)
    )
    found = (
        terms.withColumns({"evidence": evidence, "odds": odds})
        .filter((F.col("bad") >= LEAST_DOCUMENTS) & (F.col("evidence") >= LEAST_EVIDENCE))
        .filter(F.col("odds") > LEAST_ODDS)
        .orderBy(F.desc("evidence"), "k", "term")
        .limit(MOST_TERMS)
        .collect()
    )
    return Lexicon(
        {r["term"]: r["odds"] for r in found if r["k"] == 0},
        {k: {r["term"]: r["odds"] for r in found if r["k"] == k} for k in BEGINNINGS},
    )


def _assembled(rows: DataFrame) -> DataFrame:
    """How long a text is says nothing of how toxic it is, however well it may part a sample."""
    judged = [name for name in FEATURES if name != "log_words"]
    return VectorAssembler(inputCols=judged, outputCol="features").transform(rows)


@dataclass(frozen=True)
class Scorer:
    """Fitted models; without trees every document has the same score."""

    lexicon: Lexicon
    usual: float
    trees: object = None
    calibration: object = None

    def score(self, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
        """``(id, score)``"""
        return self.scored(
            docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")),
            ["id"],
        )

    def scored(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """``score`` of each ``text``, with the numbers ``keys``."""
        if self.trees is None:
            return rows.select(*keys, F.lit(self.usual).alias("score"))
        raw = self._raw(featured(rows, self.lexicon, ", ".join(f"{key} long" for key in keys)))
        told = self.calibration.transform(raw)
        mixed = (1 - OWN_SHARE) * F.col("calibrated") + OWN_SHARE * F.col("raw")
        return told.select(*keys, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)).alias("score"))

    def _raw(self, rows: DataFrame) -> DataFrame:
        judged = self.trees.transform(_assembled(rows))
        return judged.withColumn("raw", vector_to_array("probability")[1])


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    most_labelled: int = MOST_LABELLED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> Scorer:
    """Lexicon and trees from two parts of the sample, calibration from the third."""
    ship_package(docs.sparkSession)
    chosen = stored(sampled_labels(labels, most_labelled), "toxicity-labels")
    # The sample has at most ``most_labelled`` short rows.
    texts = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("text"))
    # One row for each id, however many have it.
    labelled = texts.join(F.broadcast(chosen), "doc").groupBy("doc", "toxic", "part")
    sample = stored(labelled.agg(F.min("text").alias("text")).coalesce(FILES), "toxicity-sample")
    sample = stored(without_copies(sample), "toxicity-texts")
    counted = sample.agg(F.sum("toxic"), F.count(F.lit(1))).head()
    usual = ((counted[0] or 0) + 1) / (counted[1] + 20)
    first, second = F.col("part") < FIRST_END, F.col("part") < SECOND_END
    lexicon = learned_lexicon(sample.filter(second))
    taught = [
        (sample.filter(first), learned_lexicon(sample.filter(second & ~first))),
        (sample.filter(second & ~first), learned_lexicon(sample.filter(first))),
        (sample.filter(~second), lexicon),
    ]
    parts = [featured(rows, known, "part long, toxic int") for rows, known in taught]
    rows = stored(reduce(DataFrame.unionByName, parts), "toxicity-features")
    train, check = rows.filter(second), rows.filter(~second)
    both = [r.select("toxic").distinct().count() == 2 for r in (train, check)]
    if not all(both):
        return Scorer(lexicon, usual)
    trees = GBTClassifier(
        labelCol="toxic",
        featuresCol="features",
        maxIter=TREES,
        maxDepth=DEPTH,
        stepSize=STEP,
        seed=7,
        checkpointInterval=-1,
    ).fit(_assembled(train.withColumn("toxic", F.col("toxic").cast("double"))))
    scorer = Scorer(lexicon, usual, trees)
    calibration = IsotonicRegression(
        labelCol="toxic", featuresCol="raw", predictionCol="calibrated"
    ).fit(scorer._raw(check).withColumn("toxic", F.col("toxic").cast("double")))
    return Scorer(lexicon, usual, trees, calibration)


def scored(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    most_labelled: int = MOST_LABELLED,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id, held_out, score, predicted`` for each row of ``docs``.

    Null and empty texts are scored as texts without words. Repeated rows get equal scores. Labels
    that are null, without id, or of held-out ids aren't used; without labels of both kinds in the
    parts that need them, all have the same score, about the share of toxic ones. Rows without an
    id aren't held out. An empty table gives no rows. Texts are taken whole.
    """
    scores = fitted(docs, labels, most_labelled, id_column, text_column).score(
        docs, id_column, text_column
    )
    return scores.select(
        F.col("id").alias(id_column),
        F.coalesce(remainder(F.col("id")) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose own text isn't rejected, whatever their ids."""
    scorer = fitted(docs, labels)
    rows = docs.select(*text_hashes(F.col("text")), "text")
    bad = scorer.scored(rows, ["h1", "h2"]).filter(F.col("score") >= threshold)
    bad = bad.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2")).distinct()
    bad = checked(stored(bad, "toxic-texts"))
    one, two = text_hashes(F.col("text"))
    return docs.join(bad, (one == F.col("__h1")) & (two == F.col("__h2")), "left_anti")
