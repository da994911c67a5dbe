"""Each stage of the pipeline against its brute-force version, on what the stage before it kept."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_fixtures import documents  # noqa: E402, F401
import corpus_pipeline  # noqa: E402
from test_line_dedup import by_hand as lines_by_hand  # noqa: E402
from test_simhash_near_dedup import classes_by_hand  # noqa: E402

from logmere.llm import line_dedup, queries, sentencepiece_nbest, simhash_near_dedup, toxicity  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The rows after each stage, by name."""
    docs, found = queries.table(spark, FOLDER, "documents"), {}
    found["start"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        found[name] = docs.collect()
        if name != "sentencepiece_nbest":
            assert docs.columns == COLUMNS
    return found


def test_toxic_documents_go(spark, kept):
    docs = queries.table(spark, FOLDER, "documents")
    judged = toxicity.scored(docs, queries.table(spark, FOLDER, "labels")).collect()
    fine = {r["doc_id"] for r in judged if not r["predicted"]}
    assert {r["doc_id"] for r in kept["toxicity"]} == fine


def test_repeated_lines_go(kept):
    rows = [(r["doc_id"], r["text"]) for r in kept["toxicity"]]
    before = dict(rows)
    want = lines_by_hand(rows, line_dedup.LEAST_CHARS, least_equal=1)
    want = [(i, t) for i, t in want if t.strip() or t == before[i]]
    assert sorted(((r["doc_id"], r["text"]) for r in kept["line_dedup"]), key=repr) == want
    assert all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"])


def test_one_of_each_class_stays(kept):
    rows = kept["line_dedup"]
    pairs = [(r["doc_id"], simhash_near_dedup.fingerprint(r["text"].encode())) for r in rows]
    first = classes_by_hand(pairs, simhash_near_dedup.RADIUS)
    want = sorted(i for i, v in pairs if first[v] == i)
    assert sorted(r["doc_id"] for r in kept["simhash_near_dedup"]) == want


def test_mixing_keeps_all(kept):
    key = lambda r: tuple(r)
    assert sorted(map(key, kept["mixing"])) == sorted(map(key, kept["simhash_near_dedup"]))


def test_pieces_of_all(kept):
    with open(sentencepiece_nbest.MODEL, "rb") as file:
        vocabulary = sentencepiece_nbest.Pieces(file.read())
    texts = {r["doc_id"]: r["text"] for r in kept["mixing"]}
    assert {r["doc_id"] for r in kept["sentencepiece_nbest"]} == set(texts)
    for r in kept["sentencepiece_nbest"]:
        ids = np.frombuffer(vocabulary.encode(texts[r["doc_id"]], 1)[0], np.int32)
        assert r["n_pieces"] == len(ids) and vocabulary.decode(ids) == texts[r["doc_id"]]


def test_run(spark, kept):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, kept["sentencepiece_nbest"]))


def test_odd_and_empty_documents(spark, documents):
    odd = documents([(1, None), (2, ""), (None, "x"), (4, "a b c"), (4, "a b c"), (5, "z" * 90_000)])
    for docs in (odd.withColumn("extra", F.lit(1)), documents([])):
        at = docs
        for _, stage in corpus_pipeline.STAGES[:4]:
            at = stage(spark, at, FOLDER)
            assert at.columns == docs.columns
        ids = {r["doc_id"] for r in corpus_pipeline.STAGES[4][1](spark, at, FOLDER).collect()}
        assert ids == ({1, None, 4, 5} if "extra" in docs.columns else set())


def test_rows_have_their_place_in_the_mixture_and_ids(spark, documents, tmp_path):
    from logmere.llm import mixing

    rows = [(k, f"text number {k}", f"src{k % 7}") for k in range(300)]
    docs = documents(rows)
    want = mixing.mix(docs, queries.TARGET_WEIGHTS)
    path = str(tmp_path / "mixture")
    mixing.in_order(want, rows_per_file=40).write.parquet(path)
    files = spark.read.parquet(path)
    assert len(files.inputFiles()) > 1
    want = {r["doc_id"]: r["position"] for r in want.collect()}
    with open(sentencepiece_nbest.MODEL, "rb") as file:
        vocabulary = sentencepiece_nbest.Pieces(file.read())
    for given in (files, files.filter("true").coalesce(1)):
        got = corpus_pipeline.encode_pieces(spark, given, FOLDER).collect()
        if given is files:
            assert {r["doc_id"]: r["position"] for r in got} == want
        assert sorted(r["position"] for r in got) == list(range(300))
        assert all(vocabulary.decode(np.array(r["ids"], np.int32)) == f"text number {r['doc_id']}" for r in got)
