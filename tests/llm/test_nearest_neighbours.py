import numpy as np
import pytest
from pyspark.sql import functions as F

from logmere.llm import nearest_neighbours as nn

KINDS = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every, k):
    """(query, id) in order for each query, by comparing all rows."""
    found = {}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows]
    matrix = np.array([v for _, v in good])
    ids = np.array([i for i, _ in good])
    for i, v in good:
        if i % every == 0:
            scores = matrix @ v
            order = [j for j in np.lexsort((ids, -np.round(scores, 9))) if ids[j] != i][:k]
            found[i] = [(int(ids[j]), scores[j]) for j in order]
    return found


def answers(frame, **options):
    out = {}
    for r in nn.nearest(frame, **options).collect():
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for rows in out.values():
        rows.sort()
        assert [r for r, _, _ in rows] == list(range(1, len(rows) + 1))
        assert [s for _, _, s in rows] == sorted((s for _, _, s in rows), reverse=True)
    return out


def test_recall_on_given_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    want = by_hand([(r["vec_id"], r["embedding"]) for r in table.collect()], 20, 20)
    got = answers(table)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9
    for q, rows in got.items():
        scores = dict(want[q])
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in rows if i in scores)


def test_recall_with_several_cells(spark, monkeypatch):
    monkeypatch.setattr(nn, "CELL_ROWS", 60)
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(24).tolist(), 0) for k in range(900)]
    want = by_hand([(i, v) for i, v, _ in rows], 50, 20)
    got = answers(spark.createDataFrame(rows, KINDS), every=50)
    hits = sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / (20 * len(want)) >= 0.9


def test_rounds_better_the_graph_they_start_from(spark, monkeypatch):
    monkeypatch.setattr(nn, "CELL_ROWS", 40)
    monkeypatch.setattr(nn, "TREES", 2)
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((800, 16)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    table = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], KINDS)
    nodes = nn.stored(nn.nodes_of(table, "vec_id", "embedding"), "nn-nodes")
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    close = np.argsort(-scores, axis=1)[:, :10]

    def recall(descend):
        graph, _ = nn.build_graph(nodes, len(vectors), descend)
        pairs = {(r["node"], r["other"]) for r in graph.collect()}
        return np.mean([(k, int(j)) in pairs for k in range(len(close)) for j in close[k]])

    started, settled = recall(False), recall(True)
    assert started < 0.7 and settled >= 0.9


def test_copies_ties_and_odd_vectors(spark):
    copies = [(k, [1.0, 0.0, 0.0], 0) for k in range(60)]
    near = [(100 + k, [1.0, 0.1 * k, -0.2], 0) for k in range(1, 10)]
    odd = [
        (200, None, 0),
        (220, [], 0),
        (240, [0.0, 0.0, 0.0], 0),
        (260, [1.0, None, 0.0], 0),
        (280, [float("nan"), 0.0, 1.0], 0),
        (300, [float("inf"), 0.0, 1.0], 0),
        (320, [1.0, 2.0], 0),
        (None, [1.0, 0.0, 0.0], 0),
        (340, [3e38, 1.0, 0.0], 0),
        (360, [1e-38, 0.0, 0.0], 0),
        (20, [1.0, 0.0, 0.0], 0),
    ]
    frame = spark.createDataFrame(copies + near + odd, KINDS)
    frame = frame.withColumn("node", F.lit(1)).withColumn("rank", F.lit("x"))
    got = answers(frame)
    assert set(got) == {0, 20, 40, 120, 340, 360} - {120}
    assert got[20][0][1] == 340
    assert [i for _, i, _ in got[20][1:]] == [i for i in range(20) if i != 20][:19]
    assert [i for _, i, _ in got[0][1:]] == list(range(1, 20))


def test_fewer_rows_than_asked(spark):
    rows = [(k, [float(k + 1), 1.0], 0) for k in range(5)]
    got = answers(spark.createDataFrame(rows, KINDS), every=1)
    assert all({i for _, i, _ in got[q]} == set(range(5)) - {q} for q in range(5))
    one = spark.createDataFrame(rows[:1], KINDS)
    assert nn.nearest(one).count() == 0 and nn.nearest(one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        nn.nearest(one, k=nn.NEIGHBOURS + 1)
