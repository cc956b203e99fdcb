"""Product-quantised vector codes: Lloyd rounds over integers whose nearest entries are found by LAESA.

Each part of a vector keeps its distances to a few fixed pivots, computed once and written with it. In each round the
entries' distances to the same pivots give lower bounds of all distances between parts and entries; entries are taken in
the order of their bounds, and exact integer distances are evaluated only while a bound doesn't exceed the best so far.
A round is one pass: tasks sum up their parts by entry, sums are added by key, and the codebook, whose size is a
parameter, goes to the driver and back.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.arrowmap import in_tasks, with_columns
from corpuslens.runtime import materialise, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Pivots of a part, and parts that are compared at once.
PIVOTS, SLICE = 8, 1024
#: Entries that are evaluated in one step, by their place in the order of bounds.
STEPS = (0, 1, 4, 12, 28, 60, 124, 256)


def limit(width: int) -> int:
    """Components are taken as this at most, so that squared distances of parts fit in 63 bits."""
    return min(2**31 - 1, math.isqrt(2**60 // max(1, width)))


def finite(vector: Column) -> Column:
    """Whether a vector has components and all of them are numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, number), F.lit(False))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows of integers, row by row."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


def pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to n of the entries that are far from one another: the first, then always the one farthest from those taken."""
    taken = [0]
    least = squared(entries, entries[0])
    while len(taken) < min(n, len(entries)) and least.max() > 0:
        taken.append(int(least.argmax()))
        least = np.minimum(least, squared(entries, entries[taken[-1]]))
    return entries[taken]


def distances(x: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Of each row to each pivot."""
    return np.sqrt(squared(x[:, None], fixed[None]).astype(float))


def nearest(x: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, entry_to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each part the nearest entry (ties to the lower index), its squared distance, and how many distances were evaluated in all."""
    n, k = len(x), len(entries)
    bound = np.zeros((n, k))
    for p in range(to_pivots.shape[1]):
        np.maximum(bound, np.abs(to_pivots[:, p, None] - entry_to_pivots[None, :, p]), out=bound)
    # roots are rounded
    bound -= 1e-6 + 1e-12 * float(max(to_pivots.max(initial=0), entry_to_pivots.max(initial=0)))
    order = np.argsort(bound, axis=1, kind="stable")
    best, index, count = np.full(n, np.iinfo(np.int64).max), np.full(n, k), 0
    rows, root = np.arange(n), np.full(n, np.inf)
    for a, b in zip(STEPS, [*STEPS[1:], k], strict=True):
        if a >= k or not len(rows):
            break
        block = order[rows, a : min(b, k)]
        r, c = np.nonzero(np.take_along_axis(bound[rows], block, 1) <= root[rows, None])
        at, entry = rows[r], block[r, c]
        count += len(at)
        d = np.full(block.shape, np.iinfo(np.int64).max)
        d[r, c] = squared(x[at], entries[entry])
        least = d.min(1)
        which = np.where(d == least[:, None], block, k).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (which < index[rows]))
        best[rows[better]], index[rows[better]] = least[better], which[better]
        root[rows] = np.sqrt(best[rows].astype(float))
        # bounds only grow along the order
        rows = rows[bound[rows, order[rows, min(b, k) - 1]] <= root[rows]]
    return index, best, count


class Codebooks:
    """entries: parts x entries x width, integers; fixed: the pivots of each part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.fixed = [pivots(part) for part in entries]

    def to_pivots(self, x: np.ndarray) -> np.ndarray:
        """n x parts x width -> n x parts x PIVOTS distances, 0 beyond the last pivot."""
        out = np.zeros((len(x), len(self.fixed), PIVOTS))
        for p, fixed in enumerate(self.fixed):
            for at in range(0, len(x), SLICE):
                out[at : at + SLICE, p, : len(fixed)] = distances(x[at : at + SLICE, p], fixed)
        return out

    def assigned(self, x: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Of each vector's parts the nearest entries and squared distances, and the evaluations made."""
        index, error, count = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64), 0
        own = self.to_pivots(self.entries.transpose(1, 0, 2))
        for p in range(x.shape[1]):
            for at in range(0, len(x), SLICE):
                part = slice(at, at + SLICE)
                index[part, p], error[part, p], n = nearest(x[part, p], to_pivots[part, p], self.entries[p], own[:, p])
                count += n
        return index, error, count

    def moved(self, sums: np.ndarray, counts: np.ndarray) -> None:
        """Entries become the floored means of their parts; those without any stay."""
        used = counts > 0
        self.entries = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], self.entries)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def _vectors(batch: pa.RecordBatch, parts: int) -> tuple[np.ndarray, np.ndarray]:
    n = batch.num_rows
    x = np.frombuffer(b"".join(batch.column("parts").to_pylist()), "<i4").reshape(n, parts, -1).astype(np.int64)
    return x, np.frombuffer(b"".join(batch.column("to_pivots").to_pylist()), "<f8").reshape(n, parts, PIVOTS)


def _sums(coded: DataFrame, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Of each part and entry the sum of the parts that are nearest to it, and their number: sums in tasks, then by key."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if batch.num_rows:
                x, to_pivots = _vectors(batch, parts)
                index, _, _ = books.assigned(x, to_pivots)
                key = (index + np.arange(parts) * entries).reshape(-1)
                np.add.at(sums, key, x.reshape(-1, width))
                counts += np.bincount(key, minlength=parts * entries)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["key", "n", "sums"])

    partial = coded.select("parts", "to_pivots").mapInArrow(in_tasks(run), "key bigint, n bigint, sums array<bigint>")
    total = partial.groupBy("key").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
    for r in total.collect():
        counts[r.key], sums[r.key] = r.n, r[2:]
    return sums.reshape(parts, entries, width), counts.reshape(parts, entries)


def quantise(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, code (an entry's index a part, two hex digits each), error, n_evaluated of each kept vector; and the final codebooks.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored. Dropped are vectors that are null or
    empty, or hold null or non-finite components, and those of another length than the kept vector of smallest vec_id
    (null ids come last, ties by components). Components become floor(scale * x), limit() in size at most; a length that
    parts don't divide is filled up with zeros. Codebooks start from the smallest vec_ids; fewer vectors than entries
    make fewer entries. Rows that repeat a vec_id count each. No kept vector gives no row and no codebooks. n_evaluated:
    exact distances that the batch of the row needed in the last pass, per vector.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(2.0**40)), F.lit(-(2.0**40)))))
    kept = vectors.where(finite(F.col("embedding").cast("array<double>"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", whole.alias("whole"))
    order = [F.asc_nulls_last("vec_id"), F.asc("whole")]
    first = kept.select("vec_id", "whole").orderBy(*order).limit(1).collect()
    if not first:
        return spark.createDataFrame([], kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0.0).alias("n_evaluated")).schema), None
    length = len(first[0].whole)
    width = -(-length // parts)
    most = limit(width)
    kept = kept.where(F.size("whole") == length)

    def cut(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(values), parts * width), np.int64)
        out[:, :length] = np.clip(values, -most, most)
        return out.reshape(len(values), parts, width)

    start = np.array([r.whole for r in kept.select("vec_id", "whole").orderBy(*order).limit(entries).collect()], np.int64)
    books = Codebooks(cut(start).transpose(1, 0, 2))

    def make(batch: pa.RecordBatch) -> list:
        if not batch.num_rows:
            return [[], []]
        x = cut(batch.column("whole").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length))
        return [[row.tobytes() for row in x.astype("<i4")], [row.tobytes() for row in books.to_pivots(x)]]

    coded = materialise(with_columns(kept, "parts binary, to_pivots binary", make).drop("whole"), "parts")
    for _ in range(rounds):
        books.moved(*_sums(coded, books))
    final = books

    def code(batch: pa.RecordBatch) -> list:
        if not batch.num_rows:
            return [[], [], []]
        x, to_pivots = _vectors(batch, parts)
        index, error, count = final.assigned(x, to_pivots)
        return [["".join(f"{i:02x}" for i in row) for row in index.tolist()], error.sum(1), [count / len(x)] * len(x)]

    return materialise(with_columns(coded, "code string, error bigint, n_evaluated double", code).drop("parts", "to_pivots"), "codes"), books


def compressed(vectors: DataFrame, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error (the errors of equal labels summed, nulls together), codebooks_sha256; see quantise()."""
    coded, books = quantise(vectors, rounds, parts, entries, scale)
    total = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    out = coded.join(total, F.col("label").eqNullSafe(F.col("__label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"))
