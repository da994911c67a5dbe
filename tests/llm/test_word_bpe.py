import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from llm_fixtures import documents  # noqa: F401
from logmere.llm import word_bpe as bpe


@pytest.fixture(scope="module")
def model():
    with open(bpe.named(bpe.MODEL), encoding="utf-8") as file:
        return file.read()


@pytest.fixture(scope="module")
def pieces(model):
    return bpe.WordPieces(model)


@pytest.fixture(scope="module")
def library(model):
    made = Tokenizer.from_str(model)
    made.no_truncation()
    made.no_padding()
    return made


def check(pieces, library, texts):
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = pieces.encode(text)
        assert ids.tolist() == want.ids, ascii(text[:80])
        assert pieces.decode(ids) == library.decode(want.ids, skip_special_tokens=False)


TEXTS = [
    "",
    " \n\t ",
    "It's the cat's; we'll, I'VE, 'RE 's",
    "Ὀδυσσεύς ΣΊΣΥΦΟΣ İstanbul ẞ ŉ ǰ",
    "é ẹ́ ṩ ṩ 가나 한",
    "a<|endoftext|>b <|startoftext|><|endoftext|>",
    "<|endoftext|",
    "<|ENDOFTEXT|>",
    "٣٤ ½ Ⅷ 12345 x1y2",
    "日本語 \U0001f600‍\U0001f525    \x85x\x1c\x1f\x00",
    "a_b--c!!! $%&|<>",
    "x" * 5000 + "é" * 3000 + "!" * 2000,
]


def test_against_the_library(pieces, library):
    check(pieces, library, TEXTS)


def test_random_texts(pieces, library):
    rng = random.Random(5)
    alphabet = "aeiorstlnthgé'ÉΣσſß½ \n,.!́日\U0001f600<|>1"
    check(pieces, library, ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(3000)])


def test_all_characters(pieces, library):
    """One of each block of sixteen and all below U+3000; composed with what stands beside it, too."""
    codes = [*range(0x3000), *range(0x3000, 0x110000, 16)]
    chars = [chr(c) for c in codes if not 0xD800 <= c < 0xE000]
    check(pieces, library, [f"a{c}b {c}̣ 1{c}" for c in chars])


def plain_merges(pieces, word):
    """One merge at a time: the lowest rank, the leftmost place."""
    raw = word.encode()
    at = [pieces.inner[b] for b in raw[:-1]] + [pieces.last[raw[-1]]]
    while True:
        ranked = [
            (pieces.merges[a << 32 | b], k)
            for k, (a, b) in enumerate(zip(at, at[1:]))
            if a << 32 | b in pieces.merges
        ]
        if not ranked:
            return at
        merge, k = min(ranked)
        at[k : k + 2] = [merge & 0xFFFFFFFF]


def test_against_plain_merging(pieces):
    rng = random.Random(6)
    for _ in range(400):
        word = "".join(rng.choice("aaabenitrsé") for _ in range(rng.randrange(1, 40)))
        assert np.frombuffer(pieces.search(word), np.int32).tolist() == plain_merges(pieces, word)


def test_forgetting_changes_nothing(pieces, monkeypatch):
    text = " ".join(f"word{k % 50}s" for k in range(300))
    want = pieces.encode(text).tolist()
    monkeypatch.setattr(bpe, "REMEMBERED", 4)
    for k in range(30):
        pieces.encode(f"others{k} and{k}")
    assert pieces.encode(text).tolist() == want


def test_rows(spark, documents, pieces):
    rows = [*TEXTS, None, (50, "twice"), (50, "twice"), (None, "no id")]
    docs = documents(rows).withColumns({"ids": F.lit("x"), "id": F.lit(1)})
    got = bpe.encoded_and_decoded(docs)
    assert got.columns == ["id", "ids", "text"]
    want = [
        (r["doc_id"], pieces.encode(r["text"] or "").tolist(), pieces.decode(pieces.encode(r["text"] or "")))
        for r in docs.collect()
    ]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert bpe.encoded_and_decoded(documents([])).count() == 0
    kept = bpe.decode(got.withColumn("extra", F.lit(2)), to="again").collect()
    assert all(r["again"] == r["text"] and r["extra"] == 2 for r in kept)
    null = spark.createDataFrame([(1, None)], "id long, ids array<int>")
    assert [tuple(r) for r in bpe.decode(null).collect()] == [(1, None, None)]


def test_other_models_are_refused(model):
    with pytest.raises(ValueError):
        bpe.WordPieces(model.replace('"NFC"', '"NFD"', 1))


def test_given_documents(spark, library):
    from logmere.llm import queries
    import hashlib

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op12_word_bpe(spark, "/root/testdata/sf0.001").collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        back = library.decode(want, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
