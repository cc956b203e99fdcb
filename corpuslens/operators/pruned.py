"""Exact cosine joins of whole corpora that skip what can't match.

Unit vectors are dealt to the nearest of a few pivots and, within a pivot's cell, cut by angle into blocks, which are
written once to the shared folder with the range of their vectors' angles to every pivot. By the triangle inequality on
the sphere, the ranges of two blocks bound the angles between their vectors: pairs of blocks that can't reach the
threshold are never read, and in pairs that are read, rows that can't reach the other block are left out of the matrix
product. Where only the n best of a base are asked for, its blocks are taken in the order of the bound, and rows whose
n-th best so far beats the bound are done. Where every pair is asked for, nothing can be skipped, and blocks are of one
cell and full.

Pairs leave a task in the order of their similarity, a few million at a time: stored by columns, similarities that are
equal (most are, once they are rounded) lie beside each other, and ids are of few blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.runtime import materialise, new_path, ship_package

#: Vectors in a block; a task holds two blocks and their product.
BLOCK_ROWS = 2000
#: Pivots at most, and vectors at most that they are chosen from (those with the least hashes; every vector is dealt to its pivot).
PIVOTS, SAMPLE = 128, 4096
#: Pairs that a task hands on at once.
PAIRS = 1 << 18
#: Pairs that a task gathers before it puts them in order (two blocks may have as many).
ORDERED = 1 << 22
#: Angles and products are rounded.
SLACK = 1e-7
#: Rounds in which pivots move to the middle of their cells in the sample.
SETTLED = 3


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k directions among which the rows of a sample lie close: drawn far apart, then moved to the middle of their cells."""
    rng = np.random.default_rng(11)
    taken = [0]
    best = sample @ sample[0]
    while len(taken) < min(k, len(sample)):
        weight = np.maximum(1 - best, 0) ** 2
        if not weight.sum() > 1e-9:
            break
        taken.append(int(rng.choice(len(sample), p=weight / weight.sum())))
        best = np.maximum(best, sample @ sample[taken[-1]])
    pivots = sample[taken].copy()
    for _ in range(SETTLED if len(pivots) > 1 else 0):
        cell = (sample @ pivots.T).argmax(1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        length = np.linalg.norm(sums, axis=1)
        pivots = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], pivots)
    return pivots


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros (a sum over the positions that both have is the same)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


@dataclass
class Block:
    ids: pa.Array
    owner: np.ndarray
    match: np.ndarray
    vectors: np.ndarray


def _write_block(place: str, rows: pa.Table) -> None:
    """The file appears under its name only when it is whole: a repeated task makes the same block again."""
    import uuid

    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(place)
    system.create_dir(path.rpartition("/")[0])
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out, pa.ipc.new_file(out, rows.schema) as writer:
        writer.write_table(rows)
    system.move(part, path)


def _read_block(place: str, width: int) -> Block:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(place)
    with system.open_input_file(path) as source:
        rows = pa.ipc.open_file(source).read_all().combine_chunks()
    plain = lambda c: rows[c].combine_chunks().to_numpy(zero_copy_only=False)
    return Block(rows["id"].combine_chunks(), plain("owner"), plain("match"), matrix(rows["unit"], width))


@dataclass
class Blocks:
    """Written blocks: folder; table (block, cell, n, lo, hi: of the angles to the pivot of each number)."""

    folder: str
    table: DataFrame
    count: int


TABLE = "block bigint, cell int, n bigint, lo array<double>, hi array<double>"


def write_blocks(units: DataFrame, pivots: np.ndarray, rows: int, count: int) -> Blocks:
    """Deal units (id, owner, match, unit) to blocks of at most so many rows, each of one cell and a range of angles."""
    spark, folder = units.sparkSession, new_path(units.sparkSession, "blocks")
    width = pivots.shape[1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = angles(matrix(batch.column("unit"), width), pivots)
            cell = to.argmin(1) if len(to) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(to[np.arange(len(cell)), cell])], names=[*batch.schema.names, "cell", "angle"])

    placed = units.mapInArrow(place, "id string, owner string, match string, unit array<double>, cell int, angle double")
    # equal vectors have equal angles: by a hash they can be parted, too
    order = ["cell", "angle", F.xxhash64("id"), "id"]
    dealt = placed.repartitionByRange(max(1, min(count, -(-count // 4) + spark.sparkContext.defaultParallelism)), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = 0

        def written(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            block = (rows["part"][0].as_py() << 32) + number
            number += 1
            _write_block(f"{folder}/{block}", rows.select(["id", "owner", "match", "unit"]))
            to = angles(matrix(rows["unit"], width), pivots)
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([rows["cell"][0].as_py()], pa.int32()), pa.array([rows.num_rows]), pa.array([to.min(0).tolist()]), pa.array([to.max(0).tolist()])], names=["block", "cell", "n", "lo", "hi"])

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if not held:
                return
            table = pa.Table.from_batches(held)
            cells = table["cell"].to_numpy()
            first = 0
            while first < len(cells):
                end = min(first + rows, int(np.searchsorted(cells, cells[first], "right")))
                if end == len(cells) and end - first < rows and not last:
                    break
                yield written(table.slice(first, end - first))
                first = end
            held = table.slice(first).to_batches() if first < len(cells) else []

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= 2 * rows:
                    yield from full(False)
        yield from full(True)

    return Blocks(folder, materialise(dealt.mapInArrow(write, TABLE), "table"), count)


#: Of a task: a block, and those that it meets.
WORK = "block bigint, cell int, lo double, hi double, partners array<struct<bound:double,block:bigint,cell:int,lo:double,hi:double,n:bigint>>"


def bound(lo_a: Column, hi_a: Column, lo_b: Column, hi_b: Column) -> Column:
    """Least angle between vectors of two blocks, from the ranges of their angles to each pivot."""
    gaps = F.zip_with(F.zip_with(lo_a, hi_b, lambda x, y: x - y), F.zip_with(lo_b, hi_a, lambda x, y: x - y), lambda x, y: F.greatest(x, y))
    return F.greatest(F.array_max(gaps), F.lit(0.0))


def _work(first: Blocks, second: Blocks, pivots: np.ndarray, reach: float, both_ways: bool) -> DataFrame:
    """Rows of WORK for the pairs of blocks whose vectors may be within the angle of reach."""
    spark = first.table.sparkSession
    radius = lambda b: {r.cell: r.hi for r in b.table.groupBy("cell").agg(F.max(F.col("hi")[F.col("cell")]).alias("hi")).collect()}
    one, two = radius(first), radius(second)
    between = angles(pivots, pivots)
    cells = [(p, q) for p in one for q in two if between[p, q] - one[p] - two[q] <= reach + SLACK]
    own = lambda df, s: df.select(*[F.col(c).alias(f"{c}_{s}") for c in df.columns])
    pairs = spark.createDataFrame(cells or [(-1, -1)], "cell_a int, cell_b int").join(own(first.table, "a"), "cell_a").join(own(second.table, "b"), "cell_b")
    if both_ways:
        pairs = pairs.where("block_a <= block_b")
    pairs = pairs.withColumn("bound", bound(F.col("lo_a"), F.col("hi_a"), F.col("lo_b"), F.col("hi_b"))).where(F.col("bound") <= reach + SLACK)
    parallel = spark.sparkContext.defaultParallelism
    # where there are few blocks on the one side, their partners are dealt to several tasks
    slots = max(1, min(-(-second.count // 2), -(-4 * parallel // max(1, first.count))))
    at = lambda s: [F.col(f"{e}_{s}")[F.col(f"cell_{s}")].alias(e) for e in ("lo", "hi")]
    met = F.struct("bound", F.col("block_b").alias("block"), F.col("cell_b").alias("cell"), *at("b"), F.col("n_b").alias("n"))
    work = pairs.groupBy("block_a", "cell_a", *[c.alias(f"{e}_own") for e, c in zip(("lo", "hi"), at("a"), strict=True)], F.pmod(F.xxhash64("block_b"), F.lit(slots)).alias("slot")).agg(F.collect_list(met).alias("partners"))
    work = work.select(F.col("block_a").alias("block"), F.col("cell_a").alias("cell"), F.col("lo_own").alias("lo"), F.col("hi_own").alias("hi"), "partners")
    return work.repartition(max(parallel, min(first.count * slots, 16 * parallel, 1 << 16), -(-first.count * slots // 8)))


class _Best:
    """The n best of each row of a block so far: by product, ties to the smaller id. What is held grows with what is found, not with n."""

    def __init__(self, rows: int, n: int, threshold: float):
        self.n = n
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.counts = np.zeros(rows, np.int64)
        self.least = np.full(rows, threshold)
        self.threshold = threshold

    def meet(self, rows: np.ndarray, product: np.ndarray, ids: np.ndarray) -> None:
        """Products of some rows (-inf for none) with vectors of these ids."""
        passed = (product >= self.least[rows, None]) & (product > -np.inf)
        some = np.flatnonzero(passed.any(1))
        if not len(some):
            return
        product, passed, at = product[some], passed[some], rows[some]
        if product.shape[1] > self.n:
            cut = np.partition(product, product.shape[1] - self.n, axis=1)[:, product.shape[1] - self.n]
            passed &= product >= cut[:, None]
        r, c = np.nonzero(passed)
        self.parts.append((at[r], product[r, c], ids[c]))
        self.counts += np.bincount(at[r], minlength=len(self.counts))
        if (self.counts[at] >= self.n).any():
            self._cut(at)

    def _cut(self, at: np.ndarray) -> None:
        """Leave the n best of those of some rows that have as many, and raise what others must reach there."""
        every, products, names = self.found()
        cut = np.zeros(len(self.counts), bool)
        cut[at] = self.counts[at] >= self.n
        full = cut[every]
        kept = [(every[~full], products[~full], names[~full])]
        every, products, names = every[full], products[full], names[full]
        rank = np.unique(names.astype(str), return_inverse=True)[1]
        order = np.lexsort((rank, -products, every))
        every, products, names = every[order], products[order], names[order]
        heads = np.flatnonzero(np.diff(every, prepend=-1))
        nth = np.arange(len(every)) - np.repeat(heads, np.diff(np.append(heads, len(every))))
        keep = nth < self.n
        last = nth == self.n - 1
        self.least[every[last]] = np.maximum(products[last], self.threshold)
        self.parts = [*kept, (every[keep], products[keep], names[keep])]
        self.counts = np.minimum(self.counts, self.n)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, products and ids of all that are held."""
        if len(self.parts) != 1:
            empty = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object))
            self.parts = [tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))] if self.parts else [empty]
        return self.parts[0]


#: Of each base and group of those that it meets: mergeable moments of its similarities.
MOMENTS = "base_id string, match string, n bigint, mean double, m2 double, min double, max double"
#: And of those that are high: their number and least id.
HIGH = "high bigint, first string"


class _Moments:
    def __init__(self, rows: int, high: float | None):
        self.rows, self.high = rows, high
        self.of: dict[str, tuple[np.ndarray, ...]] = {}
        self.highs: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def _count(self, name: str, part: np.ndarray, ids: np.ndarray) -> None:
        """Of products with vectors of these ids, which ascend: how many are high for each row, and the first."""
        reached = part >= self.high
        n, first = reached.sum(1), ids[reached.argmax(1)]
        old = self.highs.get(name)
        if old is not None:
            both, only = (n > 0) & (old[0] > 0), (n == 0) & (old[0] > 0)
            first[both] = np.minimum(first[both], old[1][both])
            first[only] = old[1][only]
            n = n + old[0]
        self.highs[name] = (n, first)

    def meet(self, product: np.ndarray, match: np.ndarray, ids: np.ndarray | None) -> None:
        """A product with vectors of these groups and ids (which ascend, and aren't looked at unless high ones are asked for), masked by NaN."""
        names, group = np.unique(np.where(match == None, "", [f"={m}" for m in match]).astype(str), return_inverse=True)  # noqa: E711
        for g, name in enumerate(names.tolist()):
            part = product[:, group == g]
            if self.high is not None:
                self._count(name, part, ids[group == g])
            there = ~np.isnan(part)
            n = there.sum(1)
            part = np.where(there, part, 0.0)
            mean = part.sum(1) / np.maximum(n, 1)
            m2 = (np.where(there, part - mean[:, None], 0.0) ** 2).sum(1)
            low, high = np.where(there, part, np.inf).min(1), np.where(there, part, -np.inf).max(1)
            old = self.of.get(name)
            if old is not None:
                both, gap = old[0] + n, mean - old[1]
                share = n / np.maximum(both, 1)
                mean, m2 = old[1] + gap * share, old[2] + m2 + gap**2 * old[0] * share
                n, low, high = both, np.minimum(low, old[3]), np.maximum(high, old[4])
            self.of[name] = (n, mean, m2, low, high)

    def batches(self, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        for name, (n, mean, m2, low, high) in self.of.items():
            some = np.flatnonzero(n)
            columns, names = [ids.take(pa.array(some)), pa.array([name[1:] if name else None] * len(some), pa.string()), *[pa.array(x[some]) for x in (n, mean, m2, low, high)]], ["base_id", "match", "n", "mean", "m2", "min", "max"]
            if self.high is not None:
                count, first = (x[some] for x in self.highs[name])
                columns, names = [*columns, pa.array(count), pa.array(first, pa.string(), mask=count == 0)], [*names, "high", "first"]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def _pairs(a: pa.Array, b: pa.Array, products: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a, b, pa.array(products)], names=["base_id", "similar_id", "similarity"])


class _Ordered:
    """Pairs of a block with others, handed on in the order of their products; reversed ones beside them, if both are asked for."""

    def __init__(self, own: pa.Array, both: bool):
        self.own, self.both, self.n = own, both, 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]] = []

    def meet(self, rows: np.ndarray, columns: np.ndarray, products: np.ndarray, ids: pa.Array) -> Iterator[pa.RecordBatch]:
        """Places of pairs in the block and among other ids, and their products."""
        if self.n + len(products) > ORDERED:
            yield from self.flush()
        if len(products):
            self.held.append((rows, columns, products, ids))
            self.n += len(products)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        rows, columns, products, others = zip(*self.held, strict=True)
        self.held, self.n = [], 0
        starts = np.cumsum([len(self.own), *map(len, others[:-1])], dtype=np.int32)
        ids = pa.concat_arrays([self.own, *others])
        rows, columns, products = np.concatenate(rows), np.concatenate([c + s for c, s in zip(columns, starts, strict=True)]), np.concatenate(products)
        order = np.argsort(products)
        step = PAIRS // 2 if self.both else PAIRS
        for s in range(0, len(order), step):
            part = order[s : s + step]
            a, b, found = rows[part], columns[part], products[part]
            if self.both:
                a, b, found = np.stack([a, b], 1).ravel(), np.stack([b, a], 1).ravel(), np.repeat(found, 2)
            yield _pairs(ids.take(pa.array(a)), ids.take(pa.array(b)), found)


@dataclass
class Join:
    """Blocks of a corpus and of its bases, and the work on their pairs; each method runs it."""

    first: Blocks
    second: Blocks
    work: DataFrame
    pivots: np.ndarray
    threshold: float
    both_ways: bool
    same: bool

    def _run(self, meet: Callable, schema: str) -> DataFrame:
        """meet(base block, partners in the order of their bounds, read) gives a task's batches; read(partner) its block."""
        one, two, width = self.first.folder, self.second.folder, self.pivots.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    own = _read_block(f"{one}/{row['block']}", width)
                    yield from meet(row, own, sorted(row["partners"], key=lambda p: (p["bound"], p["block"])), lambda p, own=own, row=row: own if one == two and p["block"] == row["block"] else _read_block(f"{two}/{p['block']}", width))

        return self.work.mapInArrow(run, schema)

    def _product(self) -> Callable:
        """(block, partner, its block, rows, columns) -> products, -inf where owners are the same or matches must be and aren't."""
        same = self.same

        def numbered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Equal numbers for equal values, -1 for none, as a column and a row."""
            import pandas as pd

            codes = pd.factorize(np.concatenate([a, b]))[0]
            return codes[: len(a), None], codes[None, len(a) :]

        def product(own: Block, other: Block, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
            out = own.vectors[rows] @ other.vectors[columns].T
            a, b = numbered(own.owner[rows], other.owner[columns])
            mask = a == b
            if same:
                a, b = numbered(own.match[rows], other.match[columns])
                mask |= (a != b) | (a < 0)
            out[mask] = -np.inf
            return out

        return product

    def _reaching(self) -> Callable:
        """(row, block, partner, block, least products a row) -> rows and columns that may reach the other block."""
        pivots = self.pivots

        def gap(vectors: np.ndarray, cell: int, lo: float, hi: float) -> np.ndarray:
            to = angles(vectors, pivots[cell : cell + 1])[:, 0]
            return np.maximum(np.maximum(lo - to, to - hi), 0.0)

        def reaching(row: dict, own: Block, partner: dict, other: Block, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            rows = np.flatnonzero(np.cos(gap(own.vectors, partner["cell"], partner["lo"], partner["hi"])) >= least - SLACK)
            columns = np.flatnonzero(np.cos(gap(other.vectors, row["cell"], row["lo"], row["hi"])) >= (least[rows].min() if len(rows) else np.inf) - SLACK)
            return rows, columns

        return reaching

    def pairs(self, counted: bool = False) -> DataFrame:
        """base_id, similar_id, similarity of all pairs at or above the threshold; counted: products and all (those of every pair) of each block instead."""
        threshold, both_ways, product, reaching = self.threshold, self.both_ways, self._product(), self._reaching()

        def meet(row: dict, own: Block, partners: list[dict], read: Callable) -> Iterator[pa.RecordBatch]:
            made, one_way, two_ways = 0, _Ordered(own.ids, False), _Ordered(own.ids, True)
            for p in partners:
                other = read(p)
                rows, columns = reaching(row, own, p, other, np.full(len(own.ids), threshold))
                if not len(rows) or not len(columns):
                    continue
                to = two_ways if both_ways and p["block"] != row["block"] else one_way
                made += len(rows) * len(columns) * (2 if to.both else 1)
                if not counted:
                    values = product(own, other, rows, columns)
                    i, j = np.nonzero(values >= threshold)
                    yield from to.meet(rows.astype(np.int32)[i], columns.astype(np.int32)[j], values[i, j], other.ids)
            yield from one_way.flush()
            yield from two_ways.flush()
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([made])], names=["products"])

        return self._run(meet, "products bigint" if counted else "base_id string, similar_id string, similarity double")

    def best(self, n: int, counted: bool = False) -> DataFrame:
        """base_id, similar_id, similarity of at least the n best of each base at or above the threshold (of each task that has a part of its partners)."""
        threshold, product, reaching = self.threshold, self._product(), self._reaching()

        def meet(row: dict, own: Block, partners: list[dict], read: Callable) -> Iterator[pa.RecordBatch]:
            found, made = _Best(len(own.ids), n, threshold), 0
            for p in partners:
                # partners come in the order of their bounds: no later one reaches what all rows have
                if math.cos(p["bound"]) < found.least.min() - SLACK:
                    break
                other = read(p)
                rows, columns = reaching(row, own, p, other, found.least)
                if len(rows) and len(columns):
                    made += len(rows) * len(columns)
                    found.meet(rows, product(own, other, rows, columns), np.array(other.ids.take(pa.array(columns)).to_pylist(), object))
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array([made])], names=["products"])
            else:
                i, products, names = found.found()
                for s in range(0, len(i), PAIRS):
                    yield _pairs(own.ids.take(pa.array(i[s : s + PAIRS])), pa.array(names[s : s + PAIRS].tolist(), pa.string()), products[s : s + PAIRS])

        return self._run(meet, "products bigint" if counted else "base_id string, similar_id string, similarity double")

    def moments(self, high: float | None = None) -> DataFrame:
        """MOMENTS of the similarities of each base with all others, by their match; high: and HIGH of those that are as high. Nothing is skipped: all similarities count."""
        product = self._product()

        def meet(row: dict, own: Block, partners: list[dict], read: Callable) -> Iterator[pa.RecordBatch]:
            found = _Moments(len(own.ids), high)
            for p in partners:
                other = read(p)
                columns, ids = np.arange(len(other.ids)), None
                if high is not None:
                    ids = np.array(other.ids.to_pylist(), object)
                    columns = np.argsort(ids)
                    ids = ids[columns]
                values = product(own, other, np.arange(len(own.ids)), columns)
                found.meet(np.where(values == -np.inf, np.nan, values), other.match[columns], ids)
            yield from found.batches(own.ids)

        return self._run(meet, MOMENTS if high is None else f"{MOMENTS}, {HIGH}")


def merged(moments: DataFrame, *keys: str) -> DataFrame:
    """MOMENTS united by keys: n, avg, stddev (of a sample), min, max."""
    n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    spread = F.sum(F.col("m2") + F.col("n") * F.col("mean") ** 2) - total * total / n
    return moments.groupBy(*keys).agg(n.alias("n"), (total / n).alias("avg"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias("stddev"), F.min("min").alias("min"), F.max("max").alias("max"))


def prepare(units: DataFrame, threshold: float, base: DataFrame | None = None, block_rows: int = BLOCK_ROWS, same: bool = False, halves: bool = False, whole: bool = False) -> Join:
    """Write the blocks of units (id, owner, match, unit; lengths of 1) and of base (like them; none: all of units are bases) and plan the work.

    Pairs of the same owner never match; same: nor do those whose match differs or is null. halves: without bases,
    two blocks meet once for both directions, which serves pairs() only. whole: every pair is asked for, so nothing is
    dealt to pivots. The driver gets the pivots' sample (SAMPLE vectors at most) and the cells' radii (PIVOTS at most).
    """
    spark = units.sparkSession
    ship_package(spark)
    sizes = units.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("d")).first()
    sides = sizes if base is None else base.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("d")).first()
    n, width = sizes.n, max(sizes.d or 1, sides.d or 1)
    count = max(1, -(-n // block_rows), min(-(-spark.sparkContext.defaultParallelism // 2), 4 * n // block_rows))
    rows = max(1, -(-n // count))
    if count > 1 and not whole:
        sample = units.select("id", "unit").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
        pivots = choose_pivots(matrix(sample["unit"], width), min(PIVOTS, count))
    else:
        pivots = np.eye(1, width)
    second = write_blocks(units, pivots, rows, count)
    first = second
    if base is not None:
        first = write_blocks(base, pivots, rows, max(1, -(-sides.n // rows)))
    reach = math.acos(max(-1.0, min(1.0, threshold)))
    both_ways = halves and base is None
    return Join(first, second, _work(first, second, pivots, reach, both_ways), pivots, threshold, both_ways, same)
