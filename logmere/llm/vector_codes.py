"""Vector code compression: product codes by exact integer products in limbs.

Vectors become whole numbers and are cut into equal parts; each part position has a codebook, moved
a few times to the mean of what it is nearest to, and a vector's code is its parts' nearest entries.
A distance is |v|^2 - 2 v.c + |c|^2. The dot products come from float64 matrix products: numbers are
broken into limbs so small that no sum of products reaches 2^53, which makes each product exact; the
limbs' products are put together again in 64-bit integers, and the first least distance wins. So the
codes don't depend on how rows are dealt to tasks, nor on the order of any sum.

Each pass is map-only. A task sums its rows for each part and entry before the shuffle; codebooks
(parts x entries x part length numbers) are all that reaches the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from logmere.llm.common import checked, ship_package, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
ROWS_AT_ONCE = 4096
MOST_LONG = (1 << 63) - 1


def most_component(length: int) -> int:
    """Greatest whole number for which the squared distance of two vectors fits in a long."""
    return math.isqrt(MOST_LONG // max(length, 1)) // 2


def limb_bits(length: int) -> int:
    """Width of limbs (without sign) for which ``length`` products sum up below 2^53."""
    return (52 - max(length - 1, 1).bit_length()) // 2 + 1


def limbs(numbers: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 limbs from the lowest on, within half of 2^bits of zero; the last are not all zero."""
    out, half = [], 1 << (bits - 1)
    while True:
        low = ((numbers + half) & ((1 << bits) - 1)) - half
        out.append(low.astype(np.float64))
        numbers = (numbers - low) >> bits
        if not numbers.any():
            return out


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of 64-bit integers, exact as long as the true results fit."""
    bits = limb_bits(a.shape[1])
    out = np.zeros((len(a), len(b)), np.int64)
    for i, x in enumerate(limbs(a, bits)):
        for k, y in enumerate(limbs(b, bits)):
            out += (x @ y.T).astype(np.int64) << (bits * (i + k))
    return out


def nearest(vectors: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the first of the nearest entries, and its squared distance."""
    distances = (entries * entries).sum(1) - 2 * dot_products(vectors, entries)
    codes = distances.argmin(1)
    return codes, distances[np.arange(len(vectors)), codes] + (vectors * vectors).sum(1)


@dataclass(frozen=True)
class Shape:
    """How vectors of ``length`` components are scaled and cut; zeros fill up the last part."""

    length: int
    parts: int
    scale: int

    @property
    def part(self) -> int:
        return -(-self.length // self.parts)

    def whole(self, values: np.ndarray) -> np.ndarray:
        """Rows of components as whole numbers, (row, part, place)."""
        most = most_component(self.length)
        numbers = np.zeros((len(values), self.parts * self.part), np.int64)
        floors = np.floor(values.astype(np.float64) * self.scale)
        numbers[:, : self.length] = np.clip(floors, -most, most)
        return numbers.reshape(len(values), self.parts, self.part)


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == math.inf)
    return F.coalesce((F.size(vector) > 0) & ~F.exists(vector, odd), F.lit(False))


def _mapped(rows: DataFrame, shape: Shape, done: Callable, names: list[str], schema: str) -> DataFrame:
    """``done`` over blocks of ``rows``, each a batch and the whole numbers of its column ``vector``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                    batch = whole.slice(at, ROWS_AT_ONCE)
                    values = pc.list_flatten(batch.column("vector")).to_numpy()
                    yield batch, shape.whole(values.reshape(batch.num_rows, shape.length))

        yield from done(blocks())

    return rows.select(*names, "vector").mapInArrow(run, schema)


def moved(rows: DataFrame, shape: Shape, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the mean of its parts, rounded down."""

    def sums(blocks) -> Iterator[pa.RecordBatch]:
        count = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for _, parts in blocks:
            for p in range(shape.parts):
                codes, _ = nearest(parts[:, p], books[p])
                count[p] += np.bincount(codes, minlength=books.shape[1])
                order = np.argsort(codes, kind="stable")
                used, starts = np.unique(codes[order], return_index=True)
                total[p, used] += np.add.reduceat(parts[order, p], starts)
        p, e = np.nonzero(count)
        width = pa.array(np.arange(len(p) + 1) * shape.part, pa.int32())
        values = pa.ListArray.from_arrays(width, pa.array(total[p, e].ravel()))
        columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), values]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    partial = _mapped(rows, shape, sums, [], "part int, entry int, n long, total array<long>")
    # Sums as decimals: those of very many great numbers don't fit in a long.
    sums_of = [F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"s{k}") for k in range(shape.part)]
    found = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums_of).collect()
    new = books.copy()
    for r in found:
        new[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(shape.part)]
    return new


def digest_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``(id, label, codes, error)`` of each usable vector, and the codebooks (part, entry, place).

    Vectors that are null, empty, or hold null or non-finite components are left out, and so are
    those whose length isn't that of the usable vector with the smallest id. Codebooks start with the
    ``entries`` smallest ids (null ids last; of equal ids the smaller vector first), fewer if there
    are fewer vectors. If ``parts`` doesn't divide the length, zeros fill up the last parts.
    Components beyond what keeps every squared distance within a long (some 2^30 over the root of the
    length) count as that bound. Repeated rows get equal codes. Without usable vectors there are no
    rows.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    given = vectors.select(
        F.col(id_column).cast("long").alias("id"),
        F.col(label_column).alias("label"),
        F.col(vector_column).cast("array<double>").alias("vector"),
    ).filter(usable(F.col("vector")))
    first = [F.col("id").asc_nulls_last(), "vector"]
    smallest = given.orderBy(*first).limit(1).collect()
    shape = Shape(len(smallest[0]["vector"]) if smallest else parts, parts, scale)
    given = given.filter(F.size("vector") == shape.length)
    start = given.orderBy(*first).limit(entries).select("vector").collect()
    values = np.array([r["vector"] for r in start]).reshape(len(start), shape.length)
    books = shape.whole(values).transpose(1, 0, 2).copy()
    for _ in range(rounds if start else 0):
        books = moved(given, shape, books)

    def coded(blocks) -> Iterator[pa.RecordBatch]:
        for batch, numbers in blocks:
            found = [nearest(numbers[:, p], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], 1)
            error = sum(e for _, e in found)
            ends = pa.array(np.arange(len(codes) + 1) * parts, pa.int32())
            columns = [
                *batch.columns[:2],
                pa.ListArray.from_arrays(ends, pa.array(codes.ravel(), pa.int32())),
                pa.array(error, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "codes", "error"])

    kind = given.schema["label"].dataType.simpleString()
    schema = f"id long, label {kind}, codes array<int>, error long"
    return _mapped(given, shape, coded, ["id", "label"], schema), books


def summary(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """``id, code, error, label_error, codebooks_sha256``: see ``compressed``.

    ``code``: two hex digits for each part. ``label_error``: the errors of the same label summed up,
    those without one together; a sum beyond a long counts as the greatest long.
    """
    coded, books = compressed(vectors, id_column=id_column)
    digits = F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0"))
    rows = coded.select("id", "label", F.array_join(digits, "").alias("code"), "error")
    rows = stored(rows, "vector-codes")
    sums = rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"))
    sums = sums.select(
        F.col("label").alias("_label"),
        F.least(F.col("sum"), F.lit(MOST_LONG)).cast("long").alias("label_error"),
    )
    sums = checked(stored(sums, "vector-label-errors"))
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias(id_column),
        "code",
        "error",
        "label_error",
        F.lit(digest_of(books)).alias("codebooks_sha256"),
    )
