import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from llm_fixtures import DOCUMENTS
from logmere.llm import merkle_manifest as merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    doc, text, lang, source, n = row
    return digest(*map(framed, (doc, source, lang, n, text)))


def climb(nodes):
    """The last node, and for each of ``nodes`` its (left, right) from level to level."""
    steps, level, places = [[] for _ in nodes], nodes, list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for own, at in zip(steps, places):
            run = runs[at // 8]
            own.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        level, places = [digest(*run) for run in runs], [at // 8 for at in places]
    return level[0], steps


def by_hand(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, steps = {}, {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subroots[g], steps[g] = climb([leaf_of(r) for r in groups[g]])
    root, upper = climb([subroots[g] for g in order])
    found = []
    for g, above in zip(order, upper):
        for row, own in zip(groups[g], steps[g]):
            path = own + above
            text = row[1]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            at = leaf_of((row[0], text, *row[2:]))
            for left, right in path:
                at = digest(left, at, right)
            proof = digest(*(left + right for left, right in path))
            found.append((row[0], leaf_of(row), subroots[g], root, proof, at, at == root))
    return sorted(found, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, DOCUMENTS)
    # Names that the operator uses itself.
    for name in ("group", "digest", "at", "n", "leaf", "steps", "row", "changed"):
        docs = docs.withColumn(name, F.lit("x"))
    got = sorted(map(tuple, merkle.audited(docs).collect()), key=repr)
    assert got == by_hand(rows)
    return got


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 200, 600])
def test_sizes(spark, n):
    rng = random.Random(n)
    rows = [(k * 3, f"Text {rng.random()} É", "en", "s", k) for k in range(n)]
    got = check(spark, rows)
    assert n < 3 or {r[-1] for r in got} == {True, False}


def test_groups_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, f"W {k}", rng.choice([None, "", "é", "z", "Z", "日", "en"]), None, None) for k in range(300)]
    rows += [(None, "A", "en", "s", 1), (None, "B", "en", "s", 1), (3, None, None, None, None)]
    rows += [(5, "Same", "en", "s", 1)] * 20 + [(6, "", "q", "", -4), (7, "Ü" * 50_000, "lone", "s", 2)]
    check(spark, rows)


def test_many_groups(spark):
    check(spark, [(k, f"T{k}", f"lang{k % 70}", "s", 1) for k in range(150)])


def test_empty_table(spark):
    assert merkle.audited(spark.createDataFrame([], DOCUMENTS)).count() == 0


def test_framing_tells_fields_apart():
    assert framed("1:a") != framed("a") and framed("-") != framed(None) and framed("é") == "2:é"


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "doc_id", "text", "lang", "source", "n_chars"
    )
    got = sorted(map(tuple, merkle.audited(docs).collect()), key=repr)
    assert got == by_hand([tuple(r) for r in docs.collect()])


def test_no_window_takes_a_whole_group(spark):
    docs = spark.createDataFrame([(k, "x", "en", "s", 1) for k in range(100)], DOCUMENTS)
    plan = merkle.audited(docs)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" in plan and "lag(" in plan and "lead(" in plan
