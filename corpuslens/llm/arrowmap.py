"""New columns computed batch by batch in Python workers, beside those that a DataFrame has."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Collection, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from corpuslens.runtime import ship_package

#: Makes the new columns' values from a batch.
Make = Callable[[pa.RecordBatch], list]


def release() -> None:
    """Give the memory that a task no longer needs back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def in_tasks(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with its memory released when a task is over."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


class Recent:
    """Values of strings that a worker has met lately, in about so many bytes: of two generations the older goes when the younger is full."""

    #: bytes of an entry besides its characters
    ENTRY = 200

    def __init__(self, limit: int):
        self.limit, self.size = limit // 2, 0
        self.young: dict[str, object] = {}
        self.old: dict[str, object] = {}

    def missing(self, keys: set[str]) -> list[str]:
        """Those of keys that have no value here; the others will be found in young until the next call."""
        if self.size > self.limit:
            self.old, self.young, self.size = self.young, {}, 0
        unmet = keys.difference(self.young)
        known = unmet.intersection(self.old)
        self.add(known, map(self.old.__getitem__, known))
        return list(unmet.difference(known))

    def add(self, keys: Collection[str], values: Iterable) -> None:
        self.young.update(zip(keys, values, strict=True))
        self.size += sum(map(len, keys)) + self.ENTRY * len(keys)

    def clear(self) -> None:
        self.__init__(2 * self.limit)


def with_columns(df: DataFrame, ddl: str, make: Make, done: Callable[[], object] | None = None) -> DataFrame:
    """df with the columns of ddl, which make(batch) returns as lists or arrays in that order, a value per row. done() ends a task."""
    spark = df.sparkSession
    ship_package(spark)
    old, new = df.schema, spark.createDataFrame([], ddl).schema
    schema = type(old)([*old.fields, *new.fields])
    arrow, added = to_arrow_schema(schema), to_arrow_schema(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                made = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(make(batch), added, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=arrow)
        finally:
            if done is not None:
                done()

    return df.mapInArrow(in_tasks(run), schema)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names in any case, so that new ones can have them."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])
