"""Near-duplicate vectors: navigable small-world graphs per shard, every vector searched in every shard.

Equal vectors are one class. Classes are dealt to shards by a hash; a task builds the graph of a shard (hnsw.py),
widens its beam until an audit against exact comparison passes, and writes graph and vectors as one file to the shared
folder. Then each pair of shards is a row: its task searches the vectors of the one in the graph of the other, and
verifies what it finds in double precision. It gives numbers of links and, of the links, a spanning forest between balls
of the two shards, so links within groups of copies never become rows. Components are found by contraction.
"""

from __future__ import annotations

import hashlib
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import hnsw
from corpuslens.llm.arrowmap import in_tasks, with_columns
from corpuslens.llm.textarrays import mix
from corpuslens.operators.components import connected_components
from corpuslens.runtime import materialise, new_path, ship_package

#: Classes in a shard at most, about; shards at least (tasks are pairs of shards).
SHARD_ROWS, LEAST_SHARDS = 1 << 16, 4
#: Products that are held at once.
HELD = 1 << 21


def keyed(vectors: DataFrame) -> DataFrame:
    """vec_id, key (digest of 128 bits of the components), raw (components as doubles); both null where a vector can't be linked.

    These are vectors that are null, empty or zero, or have null or non-finite components.
    """

    def make(batch: pa.RecordBatch) -> list:
        keys, raws = [], []
        for v in batch.column("embedding"):
            x = np.array([], float) if v.values is None or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
            good = len(x) > 0 and bool(np.isfinite(x).all()) and bool(x.any())
            raw = x.tobytes() if good else None
            keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
            raws.append(raw)
        return [keys, raws]

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return with_columns(rows, "key binary, raw binary", make).drop("embedding")


def units(raw: list[bytes]) -> np.ndarray:
    """Rows of length 1 of vectors that have equally many components."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


@dataclass
class Shard:
    """Vectors of one length of a shard, those of a ball together: ball k has rows starts[k] to starts[k + 1], its leader first."""

    graph: hnsw.Graph
    vectors: np.ndarray
    keys: np.ndarray
    copies: np.ndarray
    starts: np.ndarray
    tried: list[tuple[int, float]]

    @staticmethod
    def build(keys: list[bytes], raw: list[bytes], copies: np.ndarray, threshold: float) -> Shard:
        # by digest, so that a repeated task builds the same graph
        order = sorted(range(len(keys)), key=keys.__getitem__)
        numbers = mix(np.frombuffer(b"".join(keys[i][:8] for i in order), "<u8"))
        vectors = units([raw[i] for i in order])
        graph, leader = hnsw.build(vectors, numbers, threshold)
        by_ball = np.argsort(leader, kind="stable")
        starts = np.searchsorted(leader[by_ball], np.arange(graph.size + 1))
        found = Shard(graph, vectors[by_ball], np.array([keys[order[i]] for i in by_ball], object), copies[order][by_ball], starts, [])
        found.tried = graph.audit(threshold, found.least(threshold), mix(numbers[by_ball][starts[:-1]]))
        return found

    def least(self, threshold: float) -> float:
        """What a leader's product with a query must be at least if its ball may hold a link."""
        whole = len(self.starts) == len(self.vectors) + 1
        return (threshold if whole else hnsw.plus_half(threshold)) - hnsw.SLACK

    def balls(self) -> np.ndarray:
        """The ball of each vector."""
        return np.repeat(np.arange(self.graph.size), np.diff(self.starts))

    def alone(self, q: np.ndarray, rows: np.ndarray, balls: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, cosine) of the links of queries with the only vectors of balls."""
        step = max(1, HELD // max(1, q.shape[1]))
        for k in range(0, len(rows), step):
            x, y = rows[k : k + step], self.starts[balls[k : k + step]]
            cosine = np.einsum("ij,ij->i", q[x], self.vectors[y])
            keep = cosine >= threshold
            yield x[keep], y[keep], cosine[keep]

    def crowded(self, q: np.ndarray, rows: np.ndarray, balls: np.ndarray) -> Iterator[tuple[np.ndarray, int, int, np.ndarray]]:
        """(queries, first row, end row, their cosines) of queries and the balls of several vectors that they may be linked with."""
        order = np.argsort(balls, kind="stable")
        rows, balls = rows[order], balls[order]
        bounds = np.append(np.flatnonzero(np.diff(balls, prepend=-1)), len(balls)).tolist()
        for x, y in zip(bounds, bounds[1:], strict=False):
            first, end = int(self.starts[balls[x]]), int(self.starts[balls[x] + 1])
            step = max(1, HELD // (end - first))
            for k in range(x, y, step):
                some = rows[k : min(k + step, y)]
                yield some, first, end, q[some] @ self.vectors[first:end].T

    def near(self, q: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, ball) that the graph finds and that may hold a link, and whether the ball is of one vector."""
        rows, balls = self.graph.within(q.astype(np.float32), self.least(threshold))
        return rows, balls, np.diff(self.starts)[balls] == 1

    def links(self, q: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, row, cosine) of the vectors here with a cosine of at least the threshold."""
        rows, balls, one = self.near(q, threshold)
        yield from self.alone(q, rows[one], balls[one], threshold)
        for some, first, _, cosine in self.crowded(q, rows[~one], balls[~one]):
            i, j = np.nonzero(cosine >= threshold)
            yield some[i], first + j, cosine[i, j]


def _written(place: str, data: bytes) -> None:
    """A file appears under its name only when it is whole, so a repeated task may write it again."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(place)
    system.create_dir(path.rpartition("/")[0])
    part = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def _saved(shards: dict[int, Shard]) -> bytes:
    out: dict[str, np.ndarray] = {"lengths": np.array(sorted(shards), np.int64)}
    for d, s in shards.items():
        g = s.graph
        out |= {f"{d}_vectors": s.vectors, f"{d}_keys": np.frombuffer(b"".join(s.keys.tolist()), np.uint8).reshape(-1, 16), f"{d}_copies": s.copies, f"{d}_starts": s.starts, f"{d}_levels": g.levels, f"{d}_graph": np.array([g.entry, g.size, g.beam, len(g.near)])}
        out |= {f"{d}_near{k}": x for k, x in enumerate(g.near)}
    buffer = io.BytesIO()
    np.savez(buffer, **out)
    return buffer.getvalue()


def _loaded(place: str) -> dict[int, Shard]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(place)
    with system.open_input_stream(path) as source:
        held = np.load(io.BytesIO(source.read()))
    out = {}
    for d in held["lengths"].tolist():
        entry, size, beam, levels = held[f"{d}_graph"].tolist()
        vectors, starts = held[f"{d}_vectors"], held[f"{d}_starts"]
        graph = hnsw.Graph(vectors[starts[:-1]].astype(np.float32), held[f"{d}_levels"], [held[f"{d}_near{k}"] for k in range(levels)], entry, size, beam)
        keys = np.array([x.tobytes() for x in held[f"{d}_keys"]], object)
        out[d] = Shard(graph, vectors, keys, held[f"{d}_copies"], starts, [])
    return out


@dataclass
class Index:
    """Graphs of all classes of equal vectors, a file for each shard in folder. audits: shard, length, classes, leaders, beam, recall."""

    folder: str
    shards: int
    threshold: float
    audits: DataFrame
    inner: DataFrame


def index(classes: DataFrame, threshold: float, shard_rows: int = SHARD_ROWS) -> Index:
    """Build the graphs over classes (key, raw, copies). inner: edges a, b between the leader of each ball and its members."""
    spark = classes.sparkSession
    ship_package(spark)
    shards = max(LEAST_SHARDS, -(-classes.count() // shard_rows))
    dealt, folder = new_path(spark, "dealt"), new_path(spark, "graphs")
    # each shard by several tasks, so that none writes two whole ones
    owner = F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")
    classes.withColumn("shard", owner).repartition(F.col("shard"), F.pmod(F.xxhash64("key", F.lit(1)), F.lit(16))).write.partitionBy("shard").parquet(dealt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for batch in batches:
            for shard in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(f"{dealt}/shard={shard}")
                built: dict[int, Shard] = {}
                if system.get_file_info(path).type != fs.FileType.NotFound:
                    rows = parquet.read_table(path, filesystem=system, partitioning=None).combine_chunks()
                    raw, keys, copies = rows["raw"].to_pylist(), rows["key"].to_pylist(), rows["copies"].to_numpy()
                    lengths = np.array([len(x) // 8 for x in raw], np.int64)
                    for d in np.unique(lengths).tolist():
                        at = np.flatnonzero(lengths == d)
                        built[d] = Shard.build([keys[i] for i in at], [raw[i] for i in at], copies[at], threshold)
                _written(f"{folder}/{shard}.npz", _saved(built))
                for d, s in built.items():
                    beam, recall = s.tried[-1]
                    yield _rows(BUILT, shard=[shard], length=[d], classes=[len(s.vectors)], leaders=[s.graph.size], beam=[beam], recall=[recall])
                    balls = s.balls()
                    rest = np.setdiff1d(np.arange(len(balls)), s.starts[:-1])
                    yield _rows(BUILT, a=s.keys[s.starts[balls[rest]]].tolist(), b=s.keys[rest].tolist())

    made = materialise(spark.range(0, shards, 1, shards).mapInArrow(in_tasks(run), ", ".join(f"{n} {t}" for n, (t, _) in BUILT.items())), "built")
    audits = made.where("a IS NULL").drop("a", "b")
    return Index(folder, shards, threshold, audits, made.where("a IS NOT NULL").select("a", "b"))


BUILT = {"shard": ("bigint", pa.int64()), "length": ("bigint", pa.int64()), "classes": ("bigint", pa.int64()), "leaders": ("bigint", pa.int64()), "beam": ("bigint", pa.int64()), "recall": ("double", pa.float64()), "a": ("binary", pa.binary()), "b": ("binary", pa.binary())}
FOUND = {"key": ("binary", pa.binary()), "n": ("bigint", pa.int64()), "a": ("binary", pa.binary()), "b": ("binary", pa.binary())}


def _rows(kinds: dict, **columns: list) -> pa.RecordBatch:
    """A batch with these columns, null in the others."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * n), t) for k, (_, t) in kinds.items()], names=list(kinds))


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges between vertices a (of one kind) and b (of another), those that connect what those before them don't."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (to := up.get(x, x)) != x:
            up[x] = x = up.get(to, to)
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = root(x), root(-1 - y)
        if p != q:
            up[p] = q
            keep.append(i)
    return a[keep], b[keep]


def _met(queries: Shard, shard: Shard, own: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of each vector of queries in a shard (copies counted, itself not), and a spanning forest of the balls that are linked."""
    count = np.zeros(len(queries.vectors), np.int64)
    mine, theirs = queries.balls(), shard.balls()
    width, linked = shard.graph.size, np.zeros(0, np.int64)
    for part in shard.graph.batches(len(queries.vectors)):
        new, q, at = [linked], queries.vectors[part], part.start
        rows, balls, one = shard.near(q, threshold)
        for x, to, _ in shard.alone(q, rows[one], balls[one], threshold):
            x = x + at
            if own:
                x, to = x[x != to], to[x != to]
            np.add.at(count, x, shard.copies[to])
            new.append(np.unique(mine[x] * width + theirs[to]))
        for x, first, end, cosine in shard.crowded(q, rows[~one], balls[~one]):
            x, hit = x + at, cosine >= threshold
            if own:
                inside = np.flatnonzero((x >= first) & (x < end))
                hit[inside, x[inside] - first] = False
            count[x] += hit @ shard.copies[first:end]
            new.append(np.unique(mine[x[hit.any(1)]]) * width + theirs[first])
        linked = np.unique(np.concatenate(new))
    a, b = linked // max(1, width), linked % max(1, width)
    if own:
        a, b = a[a != b], b[a != b]
    return count, *forest(a, b)


def links(built: Index, spark: SparkSession) -> DataFrame:
    """key, n: what a class is linked with in a shard (rows, a class's own not counted); and edges a, b that connect what is linked."""
    s, folder, threshold = built.shards, built.folder, built.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict[int, Shard]] = {}

        def shard(k: int) -> dict[int, Shard]:
            if k not in held:
                while len(held) > 1:
                    del held[next(iter(held))]
                held[k] = _loaded(f"{folder}/{k}.npz")
            held[k] = held.pop(k)  # the one met last
            return held[k]

        for batch in batches:
            for pair in batch.column(0).to_pylist():
                graph, queries = shard(pair // s), shard(pair % s)
                for d in graph.keys() & queries.keys():
                    g, q = graph[d], queries[d]
                    count, a, b = _met(q, g, pair // s == pair % s, threshold)
                    some = np.flatnonzero(count)
                    yield _rows(FOUND, key=q.keys[some].tolist(), n=count[some])
                    yield _rows(FOUND, a=q.keys[q.starts[a]].tolist(), b=g.keys[g.starts[b]].tolist())

    pairs = spark.range(0, s * s, 1, min(s * s, 64 * spark.sparkContext.defaultParallelism))
    return materialise(pairs.mapInArrow(in_tasks(run), ", ".join(f"{n} {t}" for n, (t, _) in FOUND.items())), "links")


def classes_of(rows: DataFrame) -> DataFrame:
    """key, raw, copies, least (the smallest vec_id) of the classes of equal vectors among rows of keyed()."""
    return materialise(rows.where("key IS NOT NULL AND vec_id IS NOT NULL").groupBy("key").agg(F.min("raw").alias("raw"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "classes")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Row of vectors -> vec_id, n_links (other rows linked with it), component_id (smallest vec_id reachable), kept (it is its own).

    vectors: vec_id (integer), embedding (array of numbers); other columns are ignored. Linked are vectors of the same
    length whose cosine, in double precision, is at least the threshold (above 0). Links are searched in graphs, whose
    audits (Index.audits) give the share that is found; none below the threshold is reported. Vectors that are null,
    empty or zero, or hold null or non-finite components, are linked with nothing; so is a null vec_id, whose component
    is null and which is kept. Equal vectors are linked with one another. Rows that repeat a vec_id count one by one as
    links, and are one vertex in components. An empty table gives no row.
    """
    rows = materialise(keyed(vectors), "keyed")
    classes = classes_of(rows)
    ids = rows.drop("raw")
    built = index(classes.drop("least"), threshold, shard_rows)
    met = links(built, vectors.sparkSession)
    edges = built.inner.union(met.where("a IS NOT NULL").select("a", "b"))
    known = ids.where("vec_id IS NOT NULL")
    repeated = not known.groupBy("vec_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    if repeated:
        first = known.where("key IS NOT NULL").groupBy("vec_id").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a <> z")
        edges = edges.union(known.join(first, "vec_id").where("key <> a").select("a", F.col("key").alias("b")))
    label = connected_components(edges).select(F.col("id").alias("key"), F.col("component").alias("label"))
    counted = met.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n"))
    found = classes.select("key", "copies", "least").join(label, "key", "left").join(counted, "key", "left")
    found = materialise(found.select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "least", F.coalesce("label", "key").alias("label")), "found")
    least = found.groupBy("label").agg(F.min("least").alias("component_id"))
    out = ids.join(found.join(least, "label").select(F.col("key").alias("__key"), "n_links", "component_id"), (F.col("key") == F.col("__key")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    if repeated:
        out = materialise(out, "repeated")
        least = out.groupBy("vec_id").agg(F.min("component_id").alias("__least"))
        out = out.join(least.withColumnRenamed("vec_id", "__id"), F.col("vec_id") == F.col("__id"), "left").select("vec_id", "n_links", F.coalesce("__least", "component_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
