"""Approximate nearest neighbours by NN-descent, largest inner product first.

Equal vectors are one node. The graph starts from the cells of a few random projection trees; then,
round by round, a join brings each node's neighbours and reverse neighbours together, and those that
are close become neighbours, until little changes. Queries walk the graph greedily from their own
node and nodes of their tree cells: each hop joins the best candidates seen with their neighbours.

Between tasks vectors travel as 8-bit numbers; the last step takes the original vectors in double
precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from logmere.llm.common import ship_package, stored

NEIGHBOURS = 20
DEGREE = 32
TREES = 8
CELL_ROWS = 1_500
#: Partners that a node takes from a cell.
FROM_CELL = 16
#: The trees are cut by medians of at most so many vectors.
TREE_SAMPLE = 20_000
#: Fresh neighbours of a node that meet in one round, forward and reverse each.
MEETING = 24
#: The graph is settled when a round brings no more than this share of new neighbours.
LITTLE = 0.02
#: Guests keep so many of the closest others of a meeting.
CLOSEST = 12
BEAM = 140
EXPANDED = 28
DOORS = 2
SEED = 11
BUCKET_NODES = 5_000
COMPARED_AT_ONCE = 256

PAIRS = "node long, other long, score float"


def _valid(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    bad = F.exists(
        vector,
        lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")).cast("double")),
    )
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _small(vector: Column) -> Column:
    """Bytes of the components from -127 to 127, and the factor to get them back."""
    top = F.array_max(F.transform(vector, lambda x: F.abs(x)))
    return F.struct(
        F.transform(vector, lambda x: F.round(x / top * 127).cast("tinyint")).alias("parts"),
        F.greatest(F.lit(1e-15), F.least(F.lit(1e15), top / 127)).cast("float").alias("factor"),
    )


def _matrix(parts, factors) -> np.ndarray:
    """Float rows from 8-bit vectors."""
    rows = np.array([np.asarray(p, np.int8) for p in parts], np.float32)
    return rows * np.asarray(factors, np.float32)[:, None]


def _best(node: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Indices of each node's ``k`` largest scores, equal ones by smaller partner."""
    order = np.lexsort((other, -score, node))
    node = node[order]
    start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    rank = np.arange(len(node)) - np.repeat(start, np.diff(np.append(start, len(node))))
    return order[rank < k]


class Forest:
    """Random projection trees: the cell of a vector is where its projections fall.

    Each level cuts its cells at medians of the sample, so cells of a tree hold about as many.
    """

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        rng = np.random.default_rng(SEED)
        self.trees = []
        size = sample.shape[1] if len(sample) else 1
        for _ in range(TREES):
            planes = rng.standard_normal((max(1, levels), size)).astype(np.float32)
            if len(sample) > 1:  # along the difference of two vectors, as the data spread
                pairs = rng.integers(0, len(sample), (len(planes), 2))
                planes = sample[pairs[:, 0]] - sample[pairs[:, 1]] + 1e-3 * planes
            cuts, cell = [], np.zeros(len(sample), np.int64)
            for level in range(levels):
                seen = sample @ planes[level]
                cut = np.zeros(1 << level, np.float32)
                for c in np.unique(cell):
                    cut[c] = np.median(seen[cell == c])
                cuts.append(cut)
                cell = 2 * cell + (seen > cut[cell])
            self.trees.append((planes, cuts))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """One cell for each tree, by row."""
        out = np.zeros((len(vectors), len(self.trees)), np.int64)
        for k, (planes, cuts) in enumerate(self.trees):
            cell = np.zeros(len(vectors), np.int64)
            for level, cut in enumerate(cuts):
                cell = 2 * cell + (vectors @ planes[level] > cut[cell])
            out[:, k] = cell
        return out


def nodes_of(table: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``(node, members, vector, small)``: one row for each different vector.

    ``node`` is the smallest id. ``members`` are the smallest ``NEIGHBOURS`` + 1 ids: no result can
    need more, as equal vectors score alike and ties go to smaller ids.
    """
    vector = F.col(vector_column).cast("array<double>")
    rows = table.select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & _valid(F.col("vector")))
    size = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head()
    rows = rows.filter(F.size("vector") == (size["n"] if size else 0))
    same = rows.withColumns(
        {
            "key": F.xxhash64("vector"),
            "salt": F.pmod(F.xxhash64("id"), F.lit(32)),
        }
    )
    # Two steps, so that a vector most rows have isn't gathered by one task.
    def smallest(ids: Column) -> Column:
        return F.slice(F.array_sort(F.array_distinct(ids)), 1, NEIGHBOURS + 1)

    ranked = same.withColumn(
        "nth", F.row_number().over(Window.partitionBy("key", "vector", "salt").orderBy("id"))
    ).filter(F.col("nth") <= NEIGHBOURS + 1)
    some = ranked.groupBy("key", "vector", "salt").agg(F.collect_list("id").alias("ids"))
    groups = some.groupBy("key", "vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("members"))
    return groups.select(
        F.col("members")[0].alias("node"), "members", "vector", _small(F.col("vector")).alias("small")
    )


def _forest(nodes: DataFrame, count: int) -> Forest:
    """Trees from a bounded sample, the first vectors by digest of the node."""
    taken = nodes.select("node", "small").orderBy(F.xxhash64("node"), "node").limit(TREE_SAMPLE)
    rows = taken.select("small.parts", "small.factor").toPandas()
    levels = max(0, round(np.log2(max(1, count) / CELL_ROWS)))
    sample = _matrix(rows["parts"], rows["factor"]) if len(rows) else np.empty((0, 1), np.float32)
    return Forest(sample, levels)


def _start(nodes: DataFrame, forest: Forest) -> DataFrame:
    """Each node's best partners inside its cells."""
    bound = nodes.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                cells = bound.value.cells(_matrix(rows["parts"], rows["factor"]))
                for tree in range(cells.shape[1]):
                    yield rows.assign(cell=cells[:, tree] * TREES + tree)

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        node, found = rows["node"].to_numpy(), []
        vectors = _matrix(rows["parts"], rows["factor"])
        for at in range(0, len(node), COMPARED_AT_ONCE):
            scores = vectors[at : at + COMPARED_AT_ONCE] @ vectors.T
            here = np.arange(len(scores))
            scores[here, at + here] = -np.inf
            k = min(FROM_CELL, len(node) - 1)
            if k < 1:
                continue
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            found.append(
                pd.DataFrame(
                    {
                        "node": np.repeat(node[at : at + COMPARED_AT_ONCE], k),
                        "other": node[top].ravel(),
                        "score": np.take_along_axis(scores, top, axis=1).ravel(),
                    }
                )
            )
        empty = pd.DataFrame({"node": [], "other": [], "score": []})
        return pd.concat(found or [empty])

    flat = nodes.select("node", "small.parts", "small.factor")
    placed = flat.mapInPandas(place, "node long, parts array<tinyint>, factor float, cell long")
    placed = stored(placed, "nn-cells")
    # Vectors that no cut tells apart may fill a cell; it is dealt into several by digest.
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (2 * CELL_ROWS)).alias("shares"))
    dealt = placed.join(sizes, "cell").withColumn(
        "share", F.pmod(F.xxhash64("node", "cell"), F.col("shares"))
    )
    return dealt.groupBy("cell", "share").applyInPandas(
        lambda rows: compare(rows), PAIRS
    )


def _buckets(count: int) -> int:
    return max(12, -(-count // BUCKET_NODES))


def _kept(pairs: DataFrame, buckets: int, k: int) -> DataFrame:
    """Each node's ``k`` best partners, with whether the pair is fresh."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("fresh", kind="stable").drop_duplicates(["node", "other"])
        best = _best(*(rows[c].to_numpy() for c in ("node", "other", "score")), k)
        return rows.iloc[best][["node", "other", "score", "fresh"]]

    bucketed = pairs.withColumn("bucket", F.pmod(F.xxhash64("node"), F.lit(buckets)))
    return bucketed.groupBy("bucket").applyInPandas(run, PAIRS + ", fresh boolean")


def _met(graph: DataFrame, nodes: DataFrame, buckets: int) -> DataFrame:
    """New pairs among the neighbours and reverse neighbours of each node (the local join).

    Each node meets at most ``MEETING`` of its reverse neighbours, chosen by digest: in a graph of
    bounded degree a node may be the neighbour of very many.
    """
    forward = graph.select(F.col("node").alias("at"), F.col("other").alias("guest"), "fresh")
    drawn = Window.partitionBy("at").orderBy(F.xxhash64("guest", "at"))
    back = (
        graph.select(F.col("other").alias("at"), F.col("node").alias("guest"), "fresh")
        .withColumn("nth", F.row_number().over(drawn))
        .filter(F.col("nth") <= MEETING)
        .drop("nth")
    )
    guests = forward.unionByName(back).groupBy("at", "guest").agg(F.max("fresh").alias("fresh"))
    known = nodes.select(F.col("node").alias("guest"), "small.parts", "small.factor")
    guests = guests.join(known, "guest").withColumn(
        "bucket", F.pmod(F.xxhash64("at"), F.lit(buckets))
    )

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "guest"], kind="stable")
        at, guest = rows["at"].to_numpy(), rows["guest"].to_numpy()
        fresh, vectors = rows["fresh"].to_numpy(), _matrix(rows["parts"], rows["factor"])
        edges = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        left, right, score = [], [], []
        for a, b in zip(edges, np.append(edges[1:], len(at)), strict=True):
            own = vectors[a:b]
            scores = own @ own.T
            scores[~(fresh[a:b, None] | fresh[None, a:b])] = -np.inf
            np.fill_diagonal(scores, -np.inf)
            k = min(CLOSEST, b - a - 1)
            if k < 1:
                continue
            top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            best = np.take_along_axis(scores, top, axis=1)
            i, j = np.nonzero(best > -np.inf)
            left.append(guest[a:b][i])
            right.append(guest[a:b][top[i, j]])
            score.append(best[i, j])
        if not left:
            return pd.DataFrame({"node": [], "other": [], "score": []})
        left, right, score = map(np.concatenate, (left, right, score))
        both = pd.DataFrame({"node": left, "other": right, "score": score})
        both = both.drop_duplicates(["node", "other"])
        return both.iloc[_best(*(both[c].to_numpy() for c in ("node", "other", "score")), DEGREE)]

    return guests.groupBy("bucket").applyInPandas(run, PAIRS)


def build_graph(nodes: DataFrame, count: int, descend: bool = True) -> tuple[DataFrame, Forest]:
    """``(node, other, score, fresh)`` with ``DEGREE`` neighbours each, and the trees it began with.

    Rounds follow one another until the graph is settled; without ``descend`` there are none. A
    node's worst neighbour only gets better, so they come to an end.
    """
    buckets = _buckets(count)
    forest = _forest(nodes, count)
    begun = _start(nodes, forest).withColumn("fresh", F.lit(True))
    graph = stored(_kept(begun, buckets, DEGREE), "nn-graph")
    new_ones = DEGREE * count if descend else 0
    while new_ones > LITTLE * DEGREE * count:
        new = _met(graph, nodes, buckets).withColumn("fresh", F.lit(True))
        old = graph.withColumn("fresh", F.lit(False))
        graph = stored(_kept(old.unionByName(new), buckets, DEGREE), "nn-graph")
        new_ones = graph.filter("fresh").count()
    return graph, forest


def _entries(queries: DataFrame, nodes: DataFrame, forest: Forest) -> DataFrame:
    """``(query, node)``: where the queries start, their own node and some others of their cells."""
    bound = queries.sparkSession.sparkContext.broadcast(forest)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            cells = bound.value.cells(_matrix(rows["parts"], rows["factor"])) if len(rows) else []
            for tree in range(TREES if len(rows) else 0):
                yield pd.DataFrame({"node": rows["node"], "cell": cells[:, tree] * TREES + tree})

    kinds = "node long, cell long"
    flat = lambda rows: rows.select("node", "small.parts", "small.factor")
    drawn = Window.partitionBy("cell").orderBy(F.xxhash64("node"), "node")
    doors = (
        flat(nodes)
        .mapInPandas(place, kinds)
        .withColumn("nth", F.row_number().over(drawn))
        .filter(F.col("nth") <= DOORS)
        .select("cell", F.col("node").alias("door"))
    )
    asked = flat(queries).mapInPandas(place, kinds).withColumnRenamed("node", "query")
    entered = asked.join(doors, "cell").select("query", F.col("door").alias("node"))
    return entered.unionByName(queries.select(F.col("node").alias("query"), "node")).distinct()


def walk(queries: DataFrame, graph: DataFrame, nodes: DataFrame, forest: Forest) -> DataFrame:
    """``(query, node, score)``: the ``BEAM`` best nodes that a greedy search meets.

    ``queries``: rows of ``nodes``. Each hop opens the best
    ``EXPANDED`` nodes that haven't been opened; it ends when no query has such a node in its beam.
    """
    known = nodes.select("node", "small.parts", "small.factor")
    asked = queries.select(
        F.col("node").alias("query"), F.col("small.parts").alias("q"), F.col("small.factor").alias("qf")
    )
    buckets = F.pmod(F.xxhash64("query"), F.lit(64))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                left = _matrix(rows["parts"], rows["factor"])
                score = np.einsum("ij,ij->i", left, _matrix(rows["q"], rows["qf"]))
                yield pd.DataFrame(
                    {"query": rows["query"], "node": rows["node"], "score": score, "state": 0}
                )

    def beam(rows: pd.DataFrame) -> pd.DataFrame:
        """States: 0 met, 1 to be opened now, 2 opened."""
        rows = rows.sort_values("state", ascending=False, kind="stable")
        rows = rows.drop_duplicates(["query", "node"])
        rows = rows.iloc[_best(*(rows[c].to_numpy() for c in ("query", "node", "score")), BEAM)].copy()
        state = np.where(rows["state"].to_numpy() == 1, 2, rows["state"].to_numpy())
        waiting = np.flatnonzero(state == 0)
        query = rows["query"].to_numpy()[waiting]
        if len(waiting):
            start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
            nth = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
            state[waiting[nth < EXPANDED]] = 1
        rows["state"] = state
        return rows[["query", "node", "score", "state"]]

    kinds = "query long, node long, score float, state int"

    def met(pairs: DataFrame) -> DataFrame:
        sides = pairs.join(known, "node").join(asked, "query")
        return sides.mapInPandas(scored, kinds)

    def narrowed(rows: DataFrame) -> DataFrame:
        return stored(
            rows.withColumn("bucket", buckets).groupBy("bucket").applyInPandas(beam, kinds), "nn-beam"
        )

    beams = narrowed(met(_entries(queries, nodes, forest)))
    links = graph.select(F.col("node").alias("from"), "other")
    while (opened := beams.filter("state = 1")).head(1):
        reached = (
            opened.join(links, opened["node"] == links["from"])
            .select("query", F.col("other").alias("node"))
            .distinct()
            .join(beams.select("query", "node"), ["query", "node"], "left_anti")
        )
        beams = narrowed(beams.unionByName(met(reached)))
    return beams.select("query", "node", "score")


def nearest(
    table: DataFrame,
    every: int = 20,
    k: int = NEIGHBOURS,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for ids divisible by ``every``.

    The measure is the inner product of the original vectors in double precision; ties go to the
    smaller id. A row is no candidate for itself. Null ids, and vectors that are null, empty, zero
    or hold null or non-finite components, take no part, nor do vectors
    of another length than most have. Rows that share an id and a vector count once. With at most
    ``k`` other rows all of them are returned. An empty table gives no rows.
    """
    if not 1 <= k <= NEIGHBOURS:
        raise ValueError(f"k is from 1 to {NEIGHBOURS}")
    ship_package(table.sparkSession)
    nodes = stored(nodes_of(table, id_column, vector_column), "nn-nodes")
    count = nodes.count()
    graph, forest = build_graph(nodes, count)
    vector = F.col(vector_column).cast("array<double>")
    asked = (
        table.filter(F.col(id_column).isNotNull() & (F.col(id_column) % every == 0))
        .select(F.col(id_column).cast("long").alias("id"), vector.alias("vector"))
        .filter(_valid(F.col("vector")))
        .distinct()
    )
    # Equal vectors are one search, named by the smallest node of that vector.
    same = nodes.select("node", "members", "vector")
    asked = stored(asked.join(same, "vector").select("id", "node"), "nn-queries")
    searched = nodes.join(asked.select("node").distinct(), "node", "left_semi")
    found = walk(searched, graph, nodes, forest)
    own = searched.select(F.col("node").alias("query"), "node")
    pairs = found.select("query", "node").unionByName(own).distinct()
    sides = pairs.join(same, "node").join(
        searched.select(F.col("node").alias("query"), F.col("vector").alias("q")), "query"
    )
    product = F.aggregate(
        F.zip_with("vector", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x
    )
    scored = sides.select("query", "members", product.alias("score"))
    offered = scored.select("query", "score", F.explode("members").alias("vec_id"))
    # A query takes part in its own class, so one more than k is kept until it is left out.
    first = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = offered.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= k + 1)
    each = asked.select(F.col("id").alias("query_id"), F.col("node").alias("query")).join(best, "query")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        each.filter(F.col("vec_id") != F.col("query_id"))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
