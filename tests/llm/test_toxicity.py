import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import toxicity

FOLDER = "/root/testdata/sf0.1"
LABELS = "doc_id long, quality int, toxic int"


def test_features():
    lexicon = toxicity.Lexicon({"blarg": 3.0}, {4: {"zonk": 2.0}, 5: {}, 6: {}})
    got = dict(zip(toxicity.FEATURES, toxicity.features("You BLARG! zonkish 1d10t x", lexicon)))
    assert got["word_kinds"] == got["word_count"] == pytest.approx(0.693147, abs=1e-5)
    assert got["word_weight"] == 3.0 and got["beginning_weight"] == 2.0
    assert got["near_you"] == 1.0 and got["shouts"] == pytest.approx(1 / 5)
    assert got["hidden_count"] > 0 and got["mixed_rate"] == pytest.approx(1 / 5)
    for text in (None, "", " \n", "\x00", "a" * 1_000_000, "é " * 100_000):
        assert len(toxicity.features(text, lexicon)) == len(toxicity.FEATURES)


def test_closest():
    rng = random.Random(1)
    for _ in range(300):
        a = sorted(rng.sample(range(60), rng.randrange(1, 6)))
        b = sorted(rng.sample(range(60), rng.randrange(1, 6)))
        gap = min((abs(x - y) for x in a for y in b if x != y), default=99)
        if not set(a) & set(b):
            want = max(0.0, (toxicity.NEAR_WORDS + 1 - gap) / toxicity.NEAR_WORDS)
            assert toxicity._closest(a, b) == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) == r["held_out"] for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    bad = [r for r in out if r["toxic"]]
    caught = sum(r["predicted"] for r in bad) / len(bad)
    wrong = sum(r["predicted"] for r in out if not r["toxic"]) / (len(out) - len(bad))
    assert caught > 0.85 and wrong < 0.01
    mean = lambda rows: sum(r["score"] for r in rows) / len(rows)
    assert mean(out) == pytest.approx(len(bad) / len(out), abs=0.05)


def test_odd_rows_without_labels(spark, documents):
    docs = documents([None, "", "x", (2, "x"), (None, "you idiot"), "w " * 100_000])
    odd = docs.withColumn("toxic", F.lit(1)).withColumn("score", F.lit("a")).withColumn("id", F.lit(0))
    none = spark.createDataFrame([], LABELS)
    rows = toxicity.scored(odd, none).collect()
    assert len(rows) == 6 and {r["score"] for r in rows} == {0.05}
    one_kind = spark.createDataFrame([(0, 1, 0), (None, 1, 1), (2, None, None), (2, 1, 0)], LABELS)
    assert {r["predicted"] for r in toxicity.scored(odd, one_kind).collect()} == {0}
    assert toxicity.scored(documents([]), none).count() == 0


def test_odd_rows_with_labels(spark, documents):
    clean = [(k, f"words of text number {k} here") for k in range(400)]
    bad = [(1000 + k, f"you are an idiot and {k} scum") for k in range(200)]
    odd = [(5000, None), (5001, ""), (5002, "you idiot scum"), (5002, "you idiot scum"), (None, "plain")]
    docs = documents(clean + bad + odd)
    labels = spark.createDataFrame([(i, 1, int(i >= 1000)) for i, _ in clean + bad], LABELS)
    rows = {(r["doc_id"]): r for r in toxicity.scored(docs, labels).collect()}
    assert rows[5002]["predicted"] == 1 and rows[5000]["predicted"] == rows[5001]["predicted"] == 0
    left = toxicity.accepted(docs, labels)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert 5002 not in ids and None in ids and {i for i, _ in clean} <= ids


class Fixed:
    """A scorer that knows one word."""

    def scored(self, rows, keys):
        return rows.select(*keys, F.coalesce(F.col("text").contains("scum").cast("double"), F.lit(0.0)).alias("score"))

    def score(self, docs, id_column, text_column):
        return self.scored(docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")), ["id"])


def test_rows_without_or_with_one_id_go_by_their_text(spark, documents, monkeypatch):
    monkeypatch.setattr(toxicity, "fitted", lambda *given: Fixed())
    rows = [(None, "scum"), (None, "plain"), (None, "plain too"), (None, None), (9, "scum"), (9, "fine")]
    left = toxicity.accepted(documents(rows), spark.createDataFrame([], LABELS)).collect()
    assert {(r["doc_id"], r["text"]) for r in left} == {rows[k] for k in (1, 2, 3, 5)}
    assert len(left) == 4
