import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmere.llm import vector_codes as codes

VECTORS = "vec_id long, embedding array<double>, label int"


def by_hand(rows, entries=codes.ENTRIES, parts=codes.PARTS):
    """``{row number: (code, error, label error)}`` and the digest, by whole numbers of any size."""
    fine = lambda v: v and all(x is not None and math.isfinite(x) for x in v)
    kept = [(k, r) for k, r in enumerate(rows) if fine(r[1])]
    order = sorted(kept, key=lambda x: (x[1][0] is None, x[1][0] or 0, x[1][1]))
    length = len(order[0][1][1])
    kept = [(k, r) for k, r in kept if len(r[1]) == length]
    order = [x for x in order if len(x[1][1]) == length]
    width = -(-length // parts)

    def cut(v):
        whole = [math.floor(256 * x) for x in v] + [0] * (parts * width - length)
        return [whole[p * width : (p + 1) * width] for p in range(parts)]

    cuts = {k: cut(r[1]) for k, r in kept}
    books = [[cuts[k][p] for k, _ in order[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v, book: min(range(len(book)), key=lambda e: (far(v, book[e]), e))
    for _ in range(codes.ROUNDS):
        moved = []
        for p, book in enumerate(books):
            own = [[] for _ in book]
            for k, _ in kept:
                own[nearest(cuts[k][p], book)].append(cuts[k][p])
            moved.append([[sum(x) // len(vs) for x in zip(*vs)] if vs else e for vs, e in zip(own, book)])
        books = moved
    found, sums = {}, {}
    for k, r in kept:
        code = [nearest(cuts[k][p], books[p]) for p in range(parts)]
        error = sum(far(cuts[k][p], books[p][code[p]]) for p in range(parts))
        found[k] = ("".join(f"{c:02x}" for c in code), error, r[2])
        sums[r[2]] = sums.get(r[2], 0) + error
    flat = ",".join(str(x) for book in books for e in book for x in e)
    digest = hashlib.sha256(flat.encode()).hexdigest()
    return sorted(
        ((rows[k][0], c, e, sums[label], digest) for k, (c, e, label) in found.items()), key=repr
    )


def check(spark, rows):
    # Names that the operator uses itself.
    table = spark.createDataFrame(rows, VECTORS).withColumns({"vector": F.lit(1), "codes": F.lit("x")})
    got = codes.summary(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(rows)


def vectors(rng, n, length, size=1.0, labels=5):
    return [
        (k, [rng.gauss(0, size) for _ in range(length)], rng.choice([None, *range(labels)]))
        for k in range(n)
    ]


@pytest.mark.parametrize("length, size", [(16, 1.0), (64, 0.1), (40, 3.0), (5, 1.0), (32, 200_000.0)])
def test_random_vectors(spark, length, size):
    check(spark, vectors(random.Random(length), 150, length, size))


def test_ties_take_the_first_entry(spark):
    rng = random.Random(3)
    rows = [(k, [float(rng.randrange(-1, 2)) / 256 for _ in range(16)], 1) for k in range(200)]
    check(spark, rows + rows[:7])


def test_few_odd_and_repeated_rows(spark):
    odd = [
        (7, None, 1),
        (3, [], 1),
        (1, [1.0, None, *[0.0] * 14], 1),
        (2, [math.nan] + [0.0] * 15, 2),
        (4, [math.inf] + [0.0] * 15, 2),
        (None, [0.5] * 16, None),
        (9, [0.25] * 16, 2),
        (9, [0.125] * 16, 2),
        (9, [0.125] * 16, 2),
        (12, [-0.001] * 16, None),
        (11, [1.0] * 15, 2),
    ]
    check(spark, odd)


def test_nothing_to_code(spark):
    for rows in ([], [(1, None, 2), (2, [], 3)]):
        got = codes.summary(spark.createDataFrame(rows, VECTORS))
        assert got.count() == 0 and len(got.columns) == 5


@pytest.mark.parametrize("bits", [3, 20, 29, 30])
def test_exact_products(bits):
    rng = np.random.default_rng(bits)
    a = rng.integers(-(1 << bits), 1 << bits, (40, 7))
    b = rng.integers(-(1 << bits), 1 << bits, (9, 7))
    want = [[sum(int(x) * int(y) for x, y in zip(u, v)) for v in b] for u in a]
    assert codes.dot_products(a, b).tolist() == want
    width = codes.limb_bits(7)
    for part in codes.limbs(a, width):
        assert (np.abs(part) <= 1 << (width - 1)).all()
    assert 7 * (1 << (width - 1)) ** 2 < 1 << 53
    whole = sum(x.astype(np.int64) << (width * k) for k, x in enumerate(codes.limbs(a, width)))
    assert (whole == a).all()


def test_components_of_any_size(spark):
    """Beyond the bound they count as the bound, so that no distance leaves a long."""
    rng = random.Random(8)
    rows = [(k, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(20, 300) for _ in range(16)], 1) for k in range(80)]
    got = codes.summary(spark.createDataFrame(rows, VECTORS)).collect()
    assert len(got) == 80 and all(0 <= r["error"] <= codes.MOST_LONG for r in got)
    assert 16 * (2 * codes.most_component(16)) ** 2 <= codes.MOST_LONG


def test_given_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    got = codes.summary(table).collect()
    assert sorted(map(tuple, got), key=repr) == by_hand(rows)
