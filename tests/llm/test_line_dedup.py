import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import line_dedup

LEAST = 12


def within(a, b, edits):
    """Whether the edit distance is at most ``edits``, by a table of distances near its diagonal."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = {k: k for k in range(edits + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for k in range(max(0, i - edits), min(len(b), i + edits) + 1):
            far = edits + 1
            new[k] = min(
                row.get(k, far) + 1,
                new.get(k - 1, far) + 1,
                row.get(k - 1, far) + (k == 0 or x != b[k - 1]),
            )
        if min(new.values()) > edits:
            return False
        row = new
    return row[len(b)] <= edits


def by_hand(rows, least=LEAST, edits=line_dedup.MAX_EDITS, least_equal=None):
    """Texts without late lines; each pair of different lines is compared."""
    last = 1 << 63
    counts = lambda x: len(x) >= (least_equal or least) and re.search(r"[^\x20\x09-\x0D]", x)

    def digest(text):
        return 42 if text is None else xxhash.xxh64(text.encode(), seed=42).intdigest()

    def signed(h):
        return h - (1 << 64) if h >= 1 << 63 else h

    keys = [(last if d is None else d, signed(digest(t)), k) for k, (d, t) in enumerate(rows)]
    places = {}
    for key, (_, text) in zip(keys, rows):
        for k, x in enumerate((text or "").split("\n")):
            if counts(x):
                places[x] = min(places.get(x, (key, k)), (key, k))
    late = {
        x
        for x in places
        if edits
        and len(x) >= least
        and any(len(y) >= least and places[y] < places[x] and within(x, y, edits) for y in places)
    }
    out = []
    for key, (doc, text) in zip(keys, rows):
        if text is None:
            out.append((doc, None))
            continue
        kept, seen = [], set()
        for x in text.split("\n"):
            if counts(x):
                own = places[x][0] == key
                if x in late or not own or x in seen:
                    continue
                seen.add(x)
            kept.append(x)
        out.append((doc, "\n".join(kept)))
    return sorted(out, key=repr)


def check(docs, least=LEAST, edits=line_dedup.MAX_EDITS):
    got = line_dedup.dedup_lines(docs, least, edits)
    assert got.columns == [*docs.columns, "lines_gone"]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    found = got.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == by_hand(rows, least, edits)
    return found


def edited(rng, line):
    k = rng.randrange(len(line))
    return rng.choice(
        [line, line[:k] + line[k + 1 :], line[:k] + "xé"[k % 2] + line[k:], line[:k] + "z" + line[k + 1 :]]
    )


@pytest.mark.parametrize("size, edits, few", [(14, 2, 4), (60, 1, 1), (60, 2, 6), (400, 2, 8), (60, 3, 12), (400, 3, 16)])
def test_random_edits(documents, monkeypatch, size, edits, few):
    """Keys of more than ``few`` rows go on to further variants."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    rng = random.Random(size)
    base = ["".join(rng.choice("aab cd") for _ in range(size)) for _ in range(6)]
    texts = []
    for _ in range(60):
        picked = []
        for _ in range(rng.randrange(4)):
            line = rng.choice(base)
            for _ in range(rng.randrange(edits + 2)):
                line = edited(rng, line)
            picked.append(line)
        texts.append("\n".join(["short", *picked, ""]))
    check(documents(texts), edits=edits)


def test_exact_only(documents):
    check(documents(["a long enough line\nb", "a long enough line\nc", "a long enough lines"]), edits=0)


def test_hot_line_and_many_variants(documents):
    line = "the very same line of text in most documents"
    texts = [line + "\nown words number " + str(k) for k in range(150)]
    texts += [line[:9] + chr(97 + k) + line[10:] for k in range(26)]
    check(documents(texts))


def test_very_long_lines(documents):
    rng = random.Random(1)
    line = "".join(rng.choice("abcdefg ") for _ in range(150_000))
    other = line[:70_001] + "#" + line[70_002:]
    check(documents([line, "x\n" + other, line[:-1], other + "!!"]))


def test_odd_rows(documents):
    same = "a line that repeats"
    rows = [
        (7, None),
        (6, ""),
        (5, same + "\n" + same + "\n\n"),
        (5, same),
        (None, same + "\nonly in the null one"),
        (2, "  \t  \x0b         \n"),
        (2, "  \t  \x0b         \n"),
        (1, "ünï cödé lïnë hérè"),
        (3, "ünï cödé lïne hérè"),
    ]
    odd = documents(rows).withColumn("line", F.lit("x")).withColumn("doc", F.lit(1))
    found = check(odd.withColumn("h1", F.lit(1)).withColumn("key", F.lit(1)))
    assert {r["doc_id"]: r["lines_gone"] for r in found}[3] == 1


def test_rows_that_share_an_id_or_have_none(documents):
    line = "one line that stands in all of them"
    rows = [(None, line)] * 5 + [(4, line + "\nown a"), (4, line + "\nown b"), (4, line + "\nown b"), (None, None)]
    found = check(documents(rows).withColumns({"lines_gone": F.lit("x"), "__doc": F.lit(1)}).drop("lines_gone"))
    assert sum(r["lines_gone"] for r in found) == 7
    named = documents([(None, line)] * 5).withColumns({"lines_gone": F.lit(9), "_key": F.lit(1), "_number": F.lit(1)})
    got = line_dedup.dedup_lines(named)
    assert got.columns.count("lines_gone") == 1
    assert sorted(r["lines_gone"] for r in got.collect()) == [0, 1, 1, 1, 1]


def test_nothing_left_and_empty_table(documents):
    found = check(documents(["one line is all of it"] * 3))
    assert sorted(r["lines_gone"] for r in found) == [0, 1, 1]
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, line_dedup.LEAST_CHARS)


def test_a_short_word_added(documents):
    """Two characters more are in reach of two edits, three of three."""
    line = "das ist der text der in allen dokumenten steht"
    texts = [line, line.replace("der in", "der so in"), line.replace("text", "te xt.")]
    for edits, gone in ((1, 0), (2, 1), (3, 2)):
        assert sum(r["lines_gone"] for r in check(documents(texts), edits=edits)) == gone
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(documents(texts), max_edits=4)


def test_short_lines_that_are_equal_go(documents):
    """Near ones stay: the floor is for the near match."""
    line = "a line long enough for the near match"
    docs = documents(["All rights reserved.\n\nx\n" + line, "x\n\nAll rights reserved!\n" + line + "s", "All rights reserved.\ny\ny"])
    left = line_dedup.dedup_lines(docs, least_equal=1).collect()
    assert {r["doc_id"]: (r["text"], r["lines_gone"]) for r in left} == {
        0: ("All rights reserved.\n\nx\n" + line, 0),
        1: ("\nAll rights reserved!", 2),
        2: ("y", 2),
    }


def test_distance_of_texts_with_long_equal_ends(spark):
    rng = random.Random(5)
    pairs = []
    for size in (0, 1, 5, 16, 33, 70, 300, 900):
        for _ in range(12):
            line = "".join(rng.choice("aab cdé") for _ in range(size))
            other = line
            for _ in range(rng.randrange(4)):
                other = edited(rng, other) if other else "é"
            pairs.append((line, other))
    found = (
        spark.createDataFrame(pairs, "x string, y string")
        .withColumn("near", line_dedup._within(F.col("x"), F.col("y"), 2, 2))
        .withColumn("odd", F.bit_count(line_dedup._odd_characters(F.col("x")).bitwiseXOR(line_dedup._odd_characters(F.col("y")))))
        .collect()
    )
    for r in found:
        assert r["near"] == within(r["x"], r["y"], 2)
        assert r["odd"] <= 4 or not r["near"]


def test_many_lines_with_a_word_changed_make_few_rows(documents, monkeypatch):
    """Some hundred of them are compared, not taken apart."""
    made, stored = {}, line_dedup.stored

    def counted(rows, name):
        out = stored(rows, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(line_dedup, "stored", counted)
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(10)]
    texts = [" ".join(words)]
    for _ in range(150):
        k = rng.randrange(len(words))
        texts.append(" ".join([*words[:k], words[k] + "".join(rng.choice("klmnopqr") for _ in range(4)), *words[k + 1 :]]))
    check(documents(texts))
    assert made["line-open"] <= 12 * len(texts)
