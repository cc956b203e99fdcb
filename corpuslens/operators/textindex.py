"""Substring search through an index of trigrams.

Rows are written in blocks, and for each field the trigrams that the lower-case texts of a block have as postings
(trigram, block), partitioned by a hash of the trigram: a small share of the texts' own size. A search reads the postings
of its own trigrams only, intersects them by block, reads the blocks that are left, and looks which rows really contain
the query. Queries of fewer than three characters have no trigram and scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.search import contains_any_case
from corpuslens.runtime import new_path, ship_package

#: Rows of a block and postings' partitions.
BLOCK_ROWS, PARTS = 2000, 64
#: Trigrams of a query that are looked up at most; all rows of blocks that have these are verified.
LOOKED_UP = 12
#: Blocks that are named in a filter of folders; more are joined.
NAMED = 1000


def grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


@dataclass
class TextIndex:
    """rows: the indexed table in blocks (columns, __block); postings: field, gram, __block by __part."""

    rows: DataFrame
    postings: DataFrame
    columns: list[str]
    fields: list[str]
    parts: int

    def candidates(self, query: str, fields: list[str]) -> DataFrame | None:
        """__block of the blocks of which a field has all trigrams of a query that are looked up; none if it has no trigram."""
        found = sorted(grams(query.lower()))
        if not found:
            return None
        # spread over the query
        found = found if len(found) <= LOOKED_UP else [found[i * len(found) // LOOKED_UP] for i in range(LOOKED_UP)]
        # on the driver: literal parts prune folders
        wanted = self.rows.sparkSession.createDataFrame([(g,) for g in found], "gram string").select("gram", part_of(F.col("gram"), self.parts).alias("p")).collect()
        own = self.postings.where(F.col("__part").isin(sorted({r.p for r in wanted}))).where(F.col("gram").isin(found) & F.col("field").isin(fields))
        # a block that several tasks have read has a trigram more than once
        return own.groupBy("field", "__block").agg(F.count_distinct("gram").alias("c")).where(F.col("c") == len(found)).select("__block").distinct()

    def hits(self, query: str, fields: list[str]) -> DataFrame:
        """Rows of which one of the fields contains a query in any case; an empty query is in all that have a text."""
        if unknown := set(fields) - set(self.fields):
            raise ValueError(f"not indexed: {sorted(unknown)}")
        some = reduce(lambda a, b: a | b, [contains_any_case(f, query) for f in fields])
        met = self.candidates(query, fields)
        if met is None:
            return self.rows.where(some)
        blocks = [r[0] for r in met.limit(NAMED + 1).collect()]
        own = self.rows.where(F.col("__block").isin(blocks)) if len(blocks) <= NAMED else self.rows.join(met, "__block", "left_semi")
        return own.where(some)

    def search(self, query: str, fields: list[str], where: Column | None = None) -> DataFrame:
        """The rows that text_search() over the table gives."""
        found = self.hits(query, fields)
        return (found if where is None else found.where(where)).select(*self.columns)

    def ranked(self, query: str, weights: dict[str, int], order: list[Column], limit: int) -> DataFrame:
        """The first rows by the weight of the first field (in the order given) that contains a query, then by an order; place counts from 1.

        Only if there are fewer hits than asked for is the rest of the table read.
        """
        weight = F.lit(0)
        for f, w in reversed(weights.items()):
            weight = F.when(contains_any_case(f, query), w).otherwise(weight)
        by = [F.desc("__weight"), *order]
        hits = self.hits(query, list(weights)).withColumn("__weight", weight)
        first = hits.orderBy(*by).limit(limit)
        if (n := first.count()) < limit:
            rest = self.rows.withColumn("__weight", weight).where(F.col("__weight") == 0).orderBy(*by).limit(limit - n)
            first = first.unionByName(rest.select(*first.columns))
        from pyspark.sql import Window

        # as many rows as asked for
        return first.withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("bigint")).select(*self.columns, "place")


def part_of(gram: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(parts)).cast("int")


def build(df: DataFrame, fields: list[str], parts: int = PARTS, block_rows: int = BLOCK_ROWS) -> TextIndex:
    """Write df in blocks, and the postings of some of its fields. Null texts have no trigram."""
    spark = df.sparkSession
    ship_package(spark)
    stored, posted = new_path(spark, "rows"), new_path(spark, "postings")
    numbered = df.withColumn("__row", F.monotonically_increasing_id())
    # a block is a run of rows of a partition
    # rows keep their order within a partition, so a block is written by one task
    blocked = numbered.withColumn("__block", F.shiftright("__row", 33) * (1 << 20) + F.floor(F.col("__row").bitwiseAND(F.lit((1 << 33) - 1)) / block_rows)).drop("__row")
    blocked.write.partitionBy("__block").parquet(stored)
    rows = spark.read.schema(blocked.select(*df.columns, "__block").schema).parquet(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, str], set[str]] = {}

        def told(keep: int | None) -> Iterator[pa.RecordBatch]:
            for block, f in [k for k in held if k[0] != keep]:
                found = sorted(held.pop((block, f)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(found)), pa.array(found), pa.array([block] * len(found))], names=["field", "gram", "__block"])

        for batch in batches:
            blocks = batch.column("__block").to_pylist()
            for f in fields:
                for block, text in zip(blocks, batch.column(f).to_pylist(), strict=True):
                    if text:
                        held.setdefault((block, f), set()).update(grams(text))
            # rows of a block come one after the other
            if blocks:
                yield from told(blocks[-1])
        yield from told(None)

    low = rows.select("__block", *[F.lower(F.col(f)).alias(f) for f in fields])
    post = low.mapInArrow(run, "field string, gram string, __block bigint").withColumn("__part", part_of(F.col("gram"), parts))
    # files are sorted, so their statistics skip row groups
    post.hint("rebalance", F.col("__part")).sortWithinPartitions("__part", "gram", "field", "__block").write.partitionBy("__part").parquet(posted)
    return TextIndex(rows, spark.read.schema(post.select("field", "gram", "__block", "__part").schema).parquet(posted), df.columns, fields, parts)
