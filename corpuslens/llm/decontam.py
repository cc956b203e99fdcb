"""Benchmark decontamination with suffix arrays of the training words.

Each task turns the documents it reads, about SHARD_WORDS words at a time, into one sequence of word numbers and
sorts the suffixes of that sequence (prefix doubling up to DEPTH words, so suffixes are ordered by their first DEPTH
words). Every suffix of every benchmark item that is long enough to begin a window (shorter ones can't match one) is then
looked up by binary search, all at once; occurrences on one diagonal are joined into the longest verbatim matches with
their places. The documents are never shuffled. Words are told apart by hashes of 64 bits.

The benchmark is sent to the tasks in blocks of about BLOCK_BYTES of text (or one item). The documents pass once: each
suffix array is searched for all blocks, one after the other.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import textarrays as ta
from corpuslens.llm.arrowmap import in_tasks
from corpuslens.runtime import new_path, ship_package

SHARD_WORDS = 400_000
DEPTH = 16
BLOCK_BYTES = 8 << 20

MATCH = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"
SPANS = "array<struct<first:bigint,last:bigint>>"


def suffix_array(seq: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Positions of seq in the order of their next depth values; what lies beyond the end counts as 0."""
    rank, h = seq.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while h < depth:
        key = rank * (int(rank.max(initial=0)) + 1)
        key[: len(seq) - h] += rank[h:]
        order = np.argsort(key)
        key = key[order]
        new = np.empty(len(seq), np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank, h = new + 1, 2 * h
        if len(seq) and rank.max() == len(seq):
            break
    return order


class Shard:
    """The words of some documents, sorted for search."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, n_docs: int):
        self.known, number = np.unique(hashes, return_inverse=True)
        #: a 0 after each document, so that nothing matches across its end
        self.place = np.arange(len(hashes)) + doc
        self.seq = np.zeros(len(hashes) + n_docs, np.int64)
        self.seq[self.place] = number + 1
        self.sa = suffix_array(self.seq)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Of each word its number here, -1 if it doesn't occur."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, -1)

    def ranges(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of query, the range of the suffix array whose suffixes begin with it. At most DEPTH columns."""
        n, width = len(self.sa), query.shape[1]
        padded = np.concatenate([self.seq, np.zeros(width, np.int64)])
        found = []
        for upper in (False, True):
            lo, hi = np.zeros(len(query), np.int64), np.full(len(query), n)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                here = self.sa[np.minimum(mid, n - 1)]
                less = np.zeros(len(query), bool)
                equal = np.ones(len(query), bool)
                for k in range(width):
                    value = padded[here + k]
                    less |= equal & (value < query[:, k])
                    equal &= value == query[:, k]
                go = (less | equal if upper else less) & (lo < hi)
                lo, hi = np.where(go, mid + 1, lo), np.where(go | (lo >= hi), hi, mid)
            found.append(lo)
        return found[0], found[1]


class Tests:
    """Benchmark items as word hashes, and their windows grouped by width."""

    def __init__(self, items: list[tuple[str | None, str | None]], n: int):
        self.ids = [i for i, _ in items]
        _, _, data, offsets = next(ta.pieces(pa.array([t for _, t in items], pa.large_string()), 1 << 40), (0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64)))
        starts, ends, item = ta.words(data, offsets, ta.ALNUM)
        self.hashes = ta.word_hashes(data, starts, ends)
        count = np.bincount(item, minlength=len(items))
        self.first = np.concatenate([[0], np.cumsum(count)])
        self.windows: dict[int, np.ndarray] = {}
        by: dict[int, list[np.ndarray]] = {}
        for i, c in enumerate(count):
            if c:
                width = min(int(c), n)
                by.setdefault(width, []).append(self.first[i] + np.arange(c - width + 1))
        self.windows = {w: np.concatenate(x) for w, x in by.items()}

    def occurrences(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the shard, word of the tests, and width."""
        number, out = shard.numbers(self.hashes), []
        for width, first in self.windows.items():
            for k in range(width):
                first = first[number[first + k] >= 0]
            if len(first):
                lo, hi = shard.ranges(number[first[:, None] + np.arange(width)])
                size = hi - lo
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                out.append((shard.sa[at], np.repeat(first, size), np.full(len(at), width)))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _search(shard_words: list, blocks: list[Callable[[], Tests]], n_rows: int) -> tuple[list, list, list]:
    """Of each document: words, covered spans, longest matches."""
    hashes = np.concatenate([x[0] for x in shard_words])
    doc = np.concatenate([x[1] for x in shard_words])
    n_words = np.bincount(doc, minlength=n_rows)
    base = np.concatenate([[0], np.cumsum(n_words)])
    shard = Shard(hashes, doc, n_rows)
    spans, matches = [[] for _ in range(n_rows)], [[] for _ in range(n_rows)]
    cover = np.zeros(len(hashes) + 1, np.int64)
    for load in blocks:
        tests = load()
        place, test, width = tests.occurrences(shard)
        if not len(place):
            continue
        word = np.searchsorted(shard.place, place)
        of = doc[word]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + width, -1)
        item = np.searchsorted(tests.first, test, "right") - 1
        order = np.lexsort((word, word - test, item))
        word, test, item, width, of = word[order], test[order], item[order], width[order], of[order]
        same = (item[1:] == item[:-1]) & (word[1:] - test[1:] == word[:-1] - test[:-1]) & (word[1:] == word[:-1] + 1) & (of[1:] == of[:-1])
        head = np.flatnonzero(np.concatenate([[True], ~same]))
        tail = np.concatenate([head[1:], [len(word)]]) - 1
        for h, t in zip(head.tolist(), tail.tolist(), strict=True):
            d, i = int(of[h]), int(item[h])
            matches[d].append({"item_id": tests.ids[i], "doc_word": int(word[h] - base[d]), "item_word": int(test[h] - tests.first[i]), "n_words": int(word[t] - word[h] + width[t])})
    hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
    if hit.any():
        edge = np.zeros(len(hashes) + 1, bool)
        edge[base[1:-1]] = True  # a span ends with its document
        begin = np.flatnonzero(hit[1:] & (~hit[:-1] | edge))
        end = np.flatnonzero(hit[:-1] & (~hit[1:] | edge))
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            d = int(doc[a])
            spans[d].append({"first": a - int(base[d]), "last": b - 1 - int(base[d])})
    return n_words.tolist(), spans, matches


def _scan(batches: Iterator[pa.RecordBatch], blocks: list[Callable[[], Tests]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, held in _shards(batch.column("__text")):
            n_words, spans, matches = _search(held, blocks, end - first)
            rest = batch.slice(first, end - first)
            yield pa.RecordBatch.from_arrays([*(rest.column(i) for i in range(len(schema) - 3)), pa.array(n_words, pa.int64()), pa.array(spans, schema.field("__spans").type), pa.array(matches, schema.field("__matches").type)], schema=schema)


def _shards(column: pa.Array) -> Iterator[tuple[int, int, list]]:
    held, count, begin = [], 0, 0
    for first, end, data, offsets in ta.pieces(column):
        starts, ends, doc = ta.words(data, offsets, ta.ALNUM)
        held.append((ta.word_hashes(data, starts, ends), doc + (first - begin)))
        count += len(starts)
        if count >= SHARD_WORDS:
            yield begin, end, held
            held, count, begin = [], 0, end
    if held:
        yield begin, len(column), held


def find_matches(docs: DataFrame, benchmark: DataFrame, n: int = 13, keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Row of docs -> doc_id, the columns named by keep, n_words, spans of hit words, longest matches per item.

    docs: doc_id, text; benchmark: item_id, text. Words are runs of digits, a-z (either case) and characters beyond
    ASCII. A window is n words of an item, or all of a shorter one. Null and empty texts have no words and no match,
    items without words never match; repeated rows are each reported; other columns are ignored unless kept. With an
    empty benchmark nothing is hit. n is at most DEPTH.
    """
    if not 1 <= n <= DEPTH:
        raise ValueError(f"n must be 1 to {DEPTH}")
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    ship_package(spark)
    out = docs.select(F.col("doc_id"), *(F.col(c) for c in keep if c != "doc_id"), F.col("text").alias("__text"))
    schema = type(out.schema)([*out.schema.fields[:-1], *spark.createDataFrame([], f"__n bigint, __spans {SPANS}, __matches {MATCH}").schema.fields])
    arrow, blocks = to_arrow_schema(schema), _blocks(spark, benchmark, n, block_bytes)
    found = out.mapInArrow(in_tasks(lambda it: _scan(it, blocks, arrow)), schema)
    return found.select(*out.columns[:-1], F.col("__n").alias("n_words"), F.col("__spans").alias("spans"), F.col("__matches").alias("matches"))


def _blocks(spark: SparkSession, benchmark: DataFrame, n: int, block_bytes: int) -> list[Callable[[], Tests]]:
    """What loads each block of the benchmark in a task: one block is broadcast, several are files that Spark sends to every executor and of which a task holds one at a time."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // block_bytes))
    if count == 1:
        held = spark.sparkContext.broadcast(Tests([tuple(r) for r in rows.collect()], n))
        return [lambda: held.value]
    folder, names = new_path(spark, "tests"), []
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    for b in range(count):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b)
        names.append(f"tests-{uuid.uuid4().hex}.pickle")
        with system.open_output_stream(f"{path}/{names[-1]}") as f:
            f.write(pickle.dumps(Tests([tuple(r) for r in part.collect()], n)))
        spark.sparkContext.addFile(f"{folder}/{names[-1]}")
    return [lambda name=name: _read(name) for name in names]


def _read(name: str) -> Tests:
    with open(SparkFiles.get(name), "rb") as f:
        return pickle.load(f)


#: What contamination() adds to doc_id and kept columns.
ADDED = ("n_words", "n_hit", "items", "matches", "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, keep: tuple[str, ...] = ()) -> DataFrame:
    """Row of docs -> doc_id, kept columns, n_words, n_hit, items (sorted ids), matches, contaminated.

    Contaminated: some word is hit and at least a twentieth of the words are. Items without id count as one, after all
    others. Kept columns must not be called like the new ones.
    """
    if taken := [c for c in keep if c.lower() in (*ADDED, "spans")]:
        raise ValueError(f"columns {taken} can't be kept under these names")
    found = find_matches(docs, benchmark, n, keep)
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda t, s: t + s["last"] - s["first"] + 1)
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.withColumn("n_hit", hit).withColumn("items", items).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).drop("spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13) -> DataFrame:
    """The rows of docs that are not contaminated, with their own columns, whatever their names."""
    others = {c: f"__own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    held = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(k) for c, k in others.items()])
    flagged = contamination(held, benchmark, n, keep=("text", *others.values()))
    return flagged.where(~F.col("contaminated")).select(*[F.col(others.get(c, c)).alias(c) for c in docs.columns])
