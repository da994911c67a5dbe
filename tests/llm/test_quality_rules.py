import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import quality_rules as quality

FOLDER = "/root/testdata/sf0.001"


def by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, repeated = Counter(windows), set()
    for k, window in enumerate(windows):
        if often[window] > 1:
            repeated.update(range(k, k + 8))
    failed = len(words) < 20 or 100 * len(repeated) > 30 * len(words)
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(repeated),
        failed,
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def check(docs):
    rows = quality.judge(docs).select("doc_id", *COUNTS, "kept").collect()
    want = sorted((repr(r["doc_id"]), by_hand(r["text"])) for r in docs.collect())
    assert sorted((repr(r[0]), tuple(r[1:7])) for r in rows) == want
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    return rows


def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = check(docs)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").collect()
    kept = {r["doc_id"]: r["kept"] for r in rows if not r["base_failed"]}
    right = [kept[r[0]] == bool(r["quality"]) for r in labels if r[0] in kept]
    assert sum(right) / len(right) > 0.9


def test_odd_rows(documents):
    run = " ".join(f"w{k}" for k in range(11))
    texts = [
        None,
        "",
        " \t\n",
        "one",
        run + " x " + run,
        "a " * 30,
        " nbsp is a word\x0b!",
        "same\nsame\n \n\nsame",
        "z" * 300_000,
        "\U0001f600 \U0001f600",
    ]
    odd = documents(texts + [(3, "one"), (None, "one")])
    check(odd.withColumn("words", F.lit(1)).withColumn("id", F.lit("x")))


def test_very_long_text(documents):
    check(documents([" ".join(str(k % 7001) for k in range(60_000))]))


def test_empty_table(documents):
    assert quality.judge(documents([])).count() == 0


def test_estimate_finds_the_weak_rule():
    rng = random.Random(3)
    found = [0.9, 0.6, 0.8, 0.05]
    patterns = Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        votes = tuple(
            -1 if rng.random() < 0.2 else int(good or rng.random() >= f) for f in found
        )
        patterns[votes] += 1
    model = quality.estimate(patterns, 4)
    assert model.good == pytest.approx(0.8, abs=0.03)
    assert model.on_bad == pytest.approx(found, abs=0.05)
    assert min(model.on_good) > 0.98


def test_estimate_without_documents():
    assert quality.estimate({}, 2).good == quality.START_SHARE
