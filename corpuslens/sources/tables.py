"""Readers and writers."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.runtime import materialise

COURSE = "id bigint, attributes struct<slug:string,name:string,description:string,createdAt:string,updatedAt:string>, _corrupt string"
ARTICLE = (
    "id bigint, attributes struct<POST_TITLE:string,LINK:string,KOZA_ID:string,description:string,"
    "article:array<struct<title:string,text:string,paragraph:array<struct<subtitle:string,text:string>>>>,"
    "QandA:array<struct<Question:string,Answer:string>>,createdAt:string,updatedAt:string>, _corrupt string"
)


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed JSON documents, one a line; what can't be read is in _corrupt."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable rows, and the corrupt ones. The parsed documents are kept in the shared folder: the raw files are read once."""
    df = materialise(df, "parsed")
    return df.where("_corrupt IS NULL").drop("_corrupt"), df.where("_corrupt IS NOT NULL").select("_corrupt")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def parameter_query(spark: SparkSession, text: str, args: dict[str, Any] | list[Any], **tables: DataFrame) -> DataFrame:
    """SQL with named (:x) or positional (?) parameters, over DataFrames named in braces."""
    return spark.sql(text, args=args, **tables)


def append(df: DataFrame, path: str, batch: str | None = None) -> None:
    """All rows or none. With a batch's name, rows get it as a column, and a batch that is appended again replaces its rows: a failed job can be run once more.

    A table is appended to with names, or without them, from its first rows on.
    """
    if batch is None:
        df.write.mode("append").parquet(path)
    else:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def write_clustered(df: DataFrame, path: str, day: str, cluster: list[str]) -> None:
    """A table partitioned by a day column, sorted within files by the cluster columns. A day's rows go to as many tasks as they need."""
    df.hint("rebalance", F.col(day)).sortWithinPartitions(day, *cluster).write.partitionBy(day).mode("overwrite").parquet(path)


def table_facts(df: DataFrame) -> DataFrame:
    """Rows, columns and schema of a table in files; bytes, and when the first and the last of its files were written."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    size = files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("bytes"), F.min("file_modification_time").alias("created"), F.max("file_modification_time").alias("modified"))
    # one row each
    return df.agg(F.count("*").alias("rows")).withColumns({"columns": F.lit(len(df.columns)), "schema": F.lit(df.schema.simpleString()), "__one": F.lit(1)}).join(size.withColumn("__one", F.lit(1)), "__one").drop("__one")
