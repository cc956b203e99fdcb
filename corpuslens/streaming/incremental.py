"""Totals that follow newly arrived files, in whatever order their rows come."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


@dataclass
class Revised:
    """Totals by key and span of time that late rows correct, kept as tables in a folder.

    Each batch adds a table of differences: sums of its rows, and of each distinct value the ones that no batch before
    had (those are kept by day, so a batch reads the days it touches). Totals are the sums of the differences, so a late
    row revises its day as an early one would. With a horizon, rows older than the newest time of the batches before less
    the horizon, and rows without a time, change no total: they are kept aside with their batch. A batch that is run
    again, after a restart, replaces its own tables and looks at those of the batches before it only.

    time: a column; unit: the span (day, hour); keys: columns; sums: aggregates that add up over rows, by name; distinct:
    values that are counted once a key and span, by name (null values aren't).
    """

    folder: str
    time: str
    unit: str
    keys: list[str]
    sums: dict[str, Column]
    distinct: dict[str, Column] = field(default_factory=dict)
    horizon: str | None = None

    def _table(self, spark: SparkSession, name: str, schema: T.StructType, before: int | None = None) -> DataFrame:
        """A table's rows of the batches before one; empty while there is none."""
        path = f"{self.folder}/{name}"
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not files.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(files):
            return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("batch", T.LongType())]))
        rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
        return rows if before is None else rows.where(F.col("batch") < before)

    def _write(self, rows: DataFrame, name: str, number: int, *by: str) -> None:
        # a day's rows go to as many tasks as they need: few files for a small batch
        rows = rows.hint("rebalance", *[F.col(c) for c in by]) if by else rows
        out = rows.write.mode("overwrite")
        (out.partitionBy(*by) if by else out).parquet(f"{self.folder}/{name}/batch={number}")

    def _spanned(self, rows: DataFrame) -> DataFrame:
        at = F.col(self.time).cast("timestamp")
        return rows.withColumns({"__at": at, "__span": F.date_trunc(self.unit, at), "__day": F.to_date(at)})

    def take(self, batch: DataFrame, number: int) -> None:
        """A batch's differences, new distinct values, late rows and newest time."""
        spark, keys = batch.sparkSession, ["__day", "__span", *self.keys]
        newest = self._table(spark, "newest", T.StructType([T.StructField("at", T.TimestampType())]), number).agg(F.max("at")).first()[0]
        rows = self._spanned(batch)
        late = F.col("__at").isNull()
        if self.horizon and newest is not None:
            late |= F.col("__at") < F.lit(newest) - F.expr(f"INTERVAL {self.horizon}")
        self._write(rows.where(late).select(*batch.columns), "late", number)
        rows = rows.where(~late)
        zero = {name: F.lit(0) for name in (*self.sums, *self.distinct)}
        parts = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in self.sums.items()]).select(*keys, *self.sums, *[zero[n].alias(n) for n in self.distinct])
        for name, value in self.distinct.items():
            met = rows.select(*keys, value.alias("__value")).where("__value IS NOT NULL").distinct()
            days = [r[0] for r in met.select("__day").distinct().collect()]
            known = self._table(spark, f"seen_{name}", met.schema, number).where(F.col("__day").isin(days)).drop("batch")
            self._write(met.join(known, [*keys, "__value"], "left_anti"), f"seen_{name}", number, "__day")
            new = self._table(spark, f"seen_{name}", met.schema).where(F.col("batch") == number)
            counted = new.groupBy(*keys).agg(F.count("*").alias(name))
            parts = parts.unionByName(counted.select(*keys, *[zero[n].alias(n) if n != name else F.col(n) for n in (*self.sums, *self.distinct)]))
        self._write(self._added(parts), "differences", number, "__day")
        self._write(rows.agg(F.max("__at").alias("at")), "newest", number)

    def _added(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("__day", "__span", *self.keys).agg(*[F.sum(n).alias(n) for n in (*self.sums, *self.distinct)])

    def _differences(self, like: DataFrame) -> DataFrame:
        probe = self._added(self._spanned(like).groupBy(F.col("__day"), F.col("__span"), *self.keys).agg(*[c.alias(n) for n, c in self.sums.items()], *[F.count(c).alias(n) for n, c in self.distinct.items()]))
        return self._table(like.sparkSession, "differences", probe.schema)

    def totals(self, like: DataFrame) -> DataFrame:
        """span, keys, sums and counts as they stand. like: the stream, or any rows of its columns."""
        return self._added(self._differences(like)).drop("__day").withColumnRenamed("__span", "span")

    def revisions(self, like: DataFrame, number: int) -> DataFrame:
        """The totals that a batch has changed, as they stand."""
        changed = self._differences(like).where(F.col("batch") == number).select("__span", *self.keys).withColumnRenamed("__span", "span")
        on = F.lit(True)
        totals = self.totals(like)
        for c in ("span", *self.keys):
            on &= totals[c].eqNullSafe(changed[c])
        return totals.join(changed, on, "left_semi")

    def late(self, like: DataFrame) -> DataFrame:
        """Rows beyond the horizon or without a time, with their batch."""
        return self._table(like.sparkSession, "late", like.schema)


def daily_page_metrics(folder: str, horizon: str | None = None) -> Revised:
    """Of events (ts, event_name, page_location, user_pseudo_id, ga_session_id): views and sessions per page and day."""
    session = F.concat("user_pseudo_id", F.lit("-"), "ga_session_id")
    return Revised(folder, "ts", "day", ["page_location"], {"pageviews": F.count_if(F.col("event_name") == "page_view")}, {"sessions": session}, horizon)


def hourly_usage(folder: str, horizon: str | None = None) -> Revised:
    """Of usage logs (log_ts, provider, response_time_ms, cost_estimate, success): requests, milliseconds, cost and successes per provider and hour."""
    sums = {"requests": F.count("*"), "timed": F.count("response_time_ms"), "total_ms": F.sum("response_time_ms"), "cost": F.sum("cost_estimate"), "successes": F.count_if("success")}
    return Revised(folder, "log_ts", "hour", ["provider"], sums, {}, horizon)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process what has arrived and stop; a run with the same checkpoint goes on there."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
