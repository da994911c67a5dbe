import random
from itertools import product

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import sentencepiece_nbest as pieces


@pytest.fixture(scope="module")
def proto():
    with open(pieces.MODEL, "rb") as file:
        return file.read()


@pytest.fixture(scope="module")
def vocabulary(proto):
    return pieces.Pieces(proto)


def all_paths(vocabulary, text):
    """(score, ids) of every segmentation of a short text."""
    text = "▁" + text.replace(" ", "▁")
    found = []
    for cuts in product([0, 1], repeat=len(text) - 1):
        parts, at = [], 0
        for k, cut in enumerate([*cuts, 1], 1):
            if cut:
                parts.append(text[at:k])
                at = k
        score, ids = 0.0, []
        for p in parts:
            if p in vocabulary.scores:
                ids.append(vocabulary.scores[p][0])
                score += vocabulary.scores[p][1]
            elif len(p) == 1:
                ids += vocabulary.unknown(p)
                score += vocabulary.unknown_score
            else:
                break
        else:
            found.append((score, ids))
    return sorted(found, key=lambda x: -x[0])


TEXTS = ["the cat", "a  b", " lead", "on\nion", "ééÿ", "日本 語", "12 x3", "aaaaaaa", "\x00\x01", "in tens."]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_against_all_paths(vocabulary, text, n):
    want = all_paths(vocabulary, text)
    raw, score, others = vocabulary.encode(text, n)
    ids = np.frombuffer(raw, np.int32).tolist()
    got = [(score, ids)]
    for other, changes in others:
        changes = [{"at": c.at, "n": c.n, "ids": np.frombuffer(c.ids, np.int32).tolist()} for c in changes]
        got.append((other, pieces.changed(ids, changes)))
    assert [s for s, _ in got] == [s for s, _ in want[:n]]
    assert all((s, i) in want for s, i in got)
    assert len({tuple(i) for _, i in got}) == len(got)


def test_against_the_library(proto, vocabulary):
    """The same vocabulary, read by the library as a unigram model, gives the same N best."""
    from sentencepiece import sentencepiece_model_pb2 as model

    changed = model.ModelProto()
    changed.ParseFromString(proto)
    changed.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=changed.SerializeToString())
    rng = random.Random(2)
    words = ["the", "internation", "on", "ally", "Über", "mensch", "l'été", "words,", "x1y"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7)))
        several = library.nbest_encode(text, nbest_size=6)
        assert not any(library.is_byte(k) for path in several for k in path)
        theirs = [sum(vocabulary.scores[library.id_to_piece(k)][1] for k in p) for p in several]
        ours = vocabulary.encode(text, 6)
        assert [ours[1], *(s for s, _ in ours[2])] == theirs


def test_bounded_search_on_a_long_word(vocabulary):
    text = "ab" * 20_000 + "é" * 5
    raw, score, others = vocabulary.encode(text, 3)
    assert len(others) == 2 and others[0][0] <= score
    assert vocabulary.decode(np.frombuffer(raw, np.int32)) == text


def test_forgetting_changes_nothing(vocabulary, monkeypatch):
    text = " ".join(f"w{k % 37}" for k in range(500))
    want = vocabulary.encode(text, 4)
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    vocabulary.known.clear()
    for k in range(20):
        vocabulary.encode(f"other words {k}", 4)
    assert vocabulary.encode(text, 4) == want
    for k in range(20):
        vocabulary.encode(f"word {k}", 1)
        assert len(vocabulary.known.number) < 20
    assert vocabulary.encode(text, 4) == want


def test_long_texts_come_few_at_once():
    import pyarrow as pa

    texts = ["x" * 1_500_000, "x" * 1_500_000, None, "", "y"] + ["z"] * 1200
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = list(pieces.small(batch))
    assert [p.num_rows for p in parts] == [1, 1, 500, 500, 203]
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert list(pieces.small(batch.slice(0, 0))) == []


def test_round_trip(spark, documents):
    rng = random.Random(4)
    alphabet = " \n\tab éÜ日\U0001f600▁\x00.,1"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(200)]
    rows = [*texts, None, "", " ", "▁", "▁▁ ▁", "  x  ", "long " * 30_000]
    docs = documents(rows + [(3, "twice"), (3, "twice"), (None, "no id")])
    docs = docs.withColumn("ids", F.lit("x")).withColumn("score", F.lit(1))
    both = pieces.decode(pieces.encode(docs, 3)).collect()
    assert sorted((str(r["id"]), r["text"] or "", r["text"] is None) for r in both) == sorted(
        (str(r["doc_id"]), r["text"] or "", r["text"] is None) for r in docs.collect()
    )
    at_once = pieces.encode(docs, 3, decoded=True).collect()
    assert sorted(map(repr, at_once)) == sorted(map(repr, both))
    null = next(r for r in both if r["text"] is None)
    assert (null["ids"], null["score"], null["others"]) == (None, None, [])
    empty = next(r for r in both if r["text"] == "")
    assert (empty["ids"], empty["score"]) == ([], 0.0)


def test_empty_table_and_refusal(documents):
    assert pieces.encode(documents([])).count() == 0
    with pytest.raises(ValueError):
        pieces.encode(documents([]), 0)


def test_given_documents(spark, vocabulary):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.decode(pieces.encode(docs)).collect():
        assert r["text"] == texts[r["id"]]
        scores = [r["score"], *(o["score"] for o in r["others"])]
        assert scores == sorted(scores, reverse=True)
        for other in r["others"]:
            ids = pieces.changed(r["ids"], other["changes"])
            assert vocabulary.decode(np.array(ids)) == texts[r["id"]]
