"""Pages of long lists: sorted once by ranges, so that a page reads the ranges it overlaps, however deep it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.runtime import new_path

#: Rows of a range, about.
RANGE_ROWS = 100_000


@dataclass
class Pages:
    """A table sorted by an order and written by ranges; sizes: rows of each range, in the order."""

    rows: DataFrame
    columns: list[str]
    order: list[Column]
    sizes: list[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.sizes)

    def ranges(self, first: int, end: int) -> list[tuple[int, int]]:
        """(range, rows before it) of the ranges that have any of the rows from first up to end."""
        out, before = [], 0
        for k, n in self.sizes:
            if before < end and before + n > first:
                out.append((k, before))
            before += n
        return out

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of a page (from 1), in order. Only files of its ranges are read; a page beyond the last is empty."""
        first = (number - 1) * size
        met = self.ranges(first, first + size)
        within = F.lit(False)
        for k, before in met:
            # places in a range count from 0
            within |= (F.col("__range") == k) & F.col("__place").between(first - before, first + size - before - 1)
        return self.rows.where(F.col("__range").isin([k for k, _ in met])).where(within).orderBy("__range", "__place").select(*self.columns)


def paged(df: DataFrame, order: list[Column], ranges: int | None = None) -> Pages:
    """Sort df by an order (which ends with an id) into ranges of about RANGE_ROWS and write it; the driver gets a count for each range."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "pages")
    n = ranges or max(1, -(-df.count() // RANGE_ROWS))
    # the upper bits of the number are the range, the lower 33 the place in it
    number = F.monotonically_increasing_id()
    lines = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__number", number)
    lines = lines.select(*df.columns, F.shiftright("__number", 33).cast("int").alias("__range"), F.col("__number").bitwiseAND(F.lit((1 << 33) - 1)).alias("__place"))
    lines.write.partitionBy("__range").parquet(path)
    rows = spark.read.schema(lines.select(*df.columns, "__place", "__range").schema).parquet(path)
    sizes = sorted((r["__range"], r.n) for r in rows.groupBy("__range").agg(F.count("*").alias("n")).collect())
    return Pages(rows, df.columns, order, sizes)
