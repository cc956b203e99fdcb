"""The registered queries: for each operator a callable and, where SQL can express it, DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.fixtures import AS_OF, HOST, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Tables = Callable[[str], DataFrame]


def query(name: str, sql: str | None = None) -> Callable:
    """Register f(tables), which gets the tables and views by name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(lambda table: view(spark, sf_dir, table))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return f

    return add


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def r6(*columns: str) -> dict[str, Column]:
    """Columns rounded to six digits."""
    return {c: F.round(c, 6) for c in columns}


def load() -> None:
    """Import the modules that register."""
    from corpuslens import queries_engagement, queries_pairs, queries_search, queries_text  # noqa: F401


TS, SITE = f"TIMESTAMP '{AS_OF}'", HOST
