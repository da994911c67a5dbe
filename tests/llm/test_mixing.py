import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import mixing


def by_hand(blocks, weights):
    """Which source takes each slot: every slot looks at all blocks; fresh start when one runs out."""
    left, order = {s: n for s, n in blocks.items() if n}, []
    while left:
        total = sum(weights[s] for s in left)
        given, slot, size = Counter(), 0, len(left)
        while len(left) == size:
            ready = [
                (Fraction((given[s] + 1) * total, weights[s]), s)
                for s in left
                if given[s] * total // weights[s] <= slot
            ]
            ready = [(-(-d.numerator // d.denominator), s) for d, s in ready]
            s = min(ready)[1]
            order.append(s)
            given[s] += 1
            left[s] -= 1
            slot += 1
            if not left[s]:
                del left[s]
    return order


def check(docs, weights, rest=1, block_rows=4):
    got = mixing.mix(docs, weights, rest, block_rows)
    assert got.columns == [*docs.columns, "position"]
    rows = sorted(got.collect(), key=lambda r: r["position"])
    assert [r["position"] for r in rows] == list(range(docs.count()))
    key = lambda r: r["source"] if r["source"] in weights else ""
    want_rows = Counter(key(r) for r in docs.collect())
    order = by_hand({s: -(-n // block_rows) for s, n in want_rows.items()}, {**weights, "": rest})
    at, left = 0, Counter(want_rows)
    for source in order:
        size = min(block_rows, left[source])
        assert {key(r) for r in rows[at : at + size]} == {source}
        left[source] -= size
        at += size
    assert at == len(rows)
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in docs.collect())
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_random_sources(documents, seed):
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    share = [rng.randrange(1, 9) for _ in names]
    rows = [(k, "t", rng.choices(names, share)[0]) for k in range(300)]
    check(documents(rows), {n: rng.randrange(1, 7) for n in names[:4]}, rng.randrange(1, 4))


@pytest.mark.parametrize("seed", range(20))
def test_deviation_is_under_one_block(seed):
    rng = random.Random(seed)
    weights = {str(k): rng.randrange(1, 40) for k in range(rng.randrange(1, 9))}
    total, seen = sum(weights.values()), defaultdict(int)
    order = mixing.period(weights)
    assert Counter(order) == weights
    for slot, name in enumerate(order, 1):
        seen[name] += 1
        assert all(abs(seen[s] - Fraction(slot * w, total)) < 1 for s, w in weights.items())


def test_odd_rows(documents):
    rows = [(1, "t", None), (2, "t", ""), (2, "t", ""), (None, None, "a"), (None, "x", "a"), (5, "", "zz")]
    odd = documents(rows).withColumn("__x", F.lit(1)).withColumn("slot", F.lit("y"))
    check(odd, {"a": 3, "missing": 2}, block_rows=1)
    check(odd, {}, block_rows=2)


def test_hot_source_and_empty_table(documents):
    check(documents([(k, "t", "hot" if k % 3 else f"s{k % 7}") for k in range(400)]), {"hot": 1, "s1": 9})
    assert mixing.mix(documents([]), {"a": 1}).count() == 0


def test_refused_weights(documents):
    for weights in ({"a": 0}, {"a": mixing.MOST_WEIGHT}):
        with pytest.raises(ValueError):
            mixing.mix(documents([]), weights)


def test_files_in_order(documents, tmp_path):
    docs = documents([(k, "t", "ab"[k % 2]) for k in range(100)])
    ordered = mixing.in_order(mixing.mix(docs, {"a": 2, "b": 1}), 30)
    assert ordered.columns == docs.columns
    want = [r["doc_id"] for r in mixing.mix(docs, {"a": 2, "b": 1}).orderBy("position").collect()]
    assert [r["doc_id"] for r in ordered.collect()] == want
