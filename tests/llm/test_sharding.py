import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_fixtures import documents  # noqa: F401
from logmere.llm import sharding

FOLDER = "/root/testdata/sf0.001"


def by_hand(texts, shards):
    """Smallest capacity by trying each one, and the greedy shard of each digest."""
    sizes = defaultdict(int)
    for text in texts:
        raw = (text or "").encode()
        sizes[hashlib.md5(raw).hexdigest()] += len(raw) + 1
    ordered = sorted(sizes.items())

    def fill(capacity):
        found, used, shard = {}, 0, 0
        for digest, size in ordered:
            if size > capacity:
                return None
            if used + size > capacity:
                shard, used = shard + 1, 0
            used += size
            found[digest] = shard
        return found if shard < shards else None

    low, high = 1, max(1, sum(sizes.values()))
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle) is not None else (middle + 1, high)
    return low, fill(low)


def check(docs, shards):
    rows = sharding.shard_documents(docs, shards).collect()
    texts = [r["text"] for r in docs.collect()]
    capacity, shard_of = by_hand(texts, shards)
    assert len(rows) == len(texts)
    assert all(r["shard"] == shard_of[r["digest"]] for r in rows)
    used = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        used[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(used.values()) <= capacity
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_given_documents(spark):
    check(spark.read.parquet(f"{FOLDER}/documents.parquet"), 16)


@pytest.mark.parametrize("shards", [1, 2, 5, 16])
def test_random_sizes_and_copies(documents, shards):
    rng = random.Random(shards)
    texts = ["x" * rng.choice([0, 1, 5, 40, 900]) + str(rng.randrange(30)) for _ in range(300)]
    check(documents(texts), shards)


def test_one_group_holds_most(documents):
    check(documents(["hot text"] * 200 + [f"t{k}" for k in range(100)]), 16)


def test_odd_rows(spark, documents):
    odd = documents([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "ü"), (5, "y" * 200_000)])
    odd = odd.withColumn("shard", F.lit("x")).withColumn("size", F.lit(1)).withColumn("digest", F.lit(0))
    check(odd, 4)
    rows = {r["doc_id"]: r for r in sharding.shard_documents(odd, 4).collect()}
    assert (rows[1]["size"], rows[1]["text_crc32"]) == (1, 0)
    assert rows[1]["shard"] == rows[2]["shard"]
    assert rows[None]["text_crc32"] == zlib.crc32("ü".encode())


def test_empty_table(documents, spark):
    assert sharding.shard_documents(documents([("1", "a")][:0])).count() == 0


def test_blocks_are_refined():
    blocks = [sharding.Block("0", 10, 1), sharding.Block("1", 10, 2), sharding.Block("2", 10, 1)]
    greedy = sharding.Greedy(blocks, 2)
    low, high = greedy.smallest(15, True), greedy.smallest(15, False)
    assert (low, high) == (15, 20)
    assert greedy.unsure(low, high) == [blocks[1]]
