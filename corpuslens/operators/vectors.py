"""Cosine similarities: of columns, of given pairs, and of whole corpora."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.operators import lsh, pruned
from corpuslens.runtime import materialise


def dot(a: Column, b: Column) -> Column:
    """Sum of products over positions that both have."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def has_vector(a: Column) -> Column:
    """A vector counts only if it isn't empty."""
    return F.coalesce(F.size(a), F.lit(0)) > 0


def cosine(a: Column, b: Column) -> Column:
    """Null where either is null, empty or of length 0."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(df: DataFrame, vector: str = "content_embedding", to: str = "unit") -> DataFrame:
    """Rows that have a vector which isn't 0, with it scaled to length 1: norms are taken once a row, not once a pair."""
    length = norm(F.col(vector))
    return df.where(has_vector(F.col(vector))).withColumn("__n", length).where("__n > 0").withColumn(to, F.transform(vector, lambda v: v.cast("double") / F.col("__n"))).drop("__n")


def confidence(score: Column) -> Column:
    return F.when(score >= 0.8, 0.95).when(score >= 0.6, 0.85).when(score >= 0.4, 0.75).otherwise(0.65)


def pair_similarity(pairs: DataFrame, vectors: DataFrame, a: str, b: str, id_col: str = "id", vector: str = "content_embedding") -> DataFrame:
    """Pairs whose two ids have vectors, with their cosine similarity; the others are left out. Two equi-joins."""
    v = unit(vectors.select(id_col, vector), vector)
    left = v.select(F.col(id_col).alias(a), F.col("unit").alias("__x"))
    right = v.select(F.col(id_col).alias(b), F.col("unit").alias("__y"))
    return pairs.join(left, a).join(right, b).withColumn("similarity", dot(F.col("__x"), F.col("__y"))).drop("__x", "__y")


def nearest_to(query: DataFrame, candidates: DataFrame, id_col: str = "id", vector: str = "content_embedding", threshold: float = -2.0, top: int | None = None, same: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """candidates with base_id and their similarity to each row of query (itself left out), above a threshold, the top of each if given; same: of an equal value there.

    columns: of candidates that are asked for beside their ids (all, if not given). Without any, similarities come from
    the tasks that multiply, and nothing is joined to them.
    """
    found = similarity_join(candidates, threshold, top, id_col, None, vector, base=query, same=same).select("base_id", F.col("similar_id").alias(id_col), "similarity")
    if columns is not None:
        if not columns:
            return found
        candidates = candidates.select(id_col, *columns)
    # Spark takes the similarities for as small as the list of blocks that they come from, and would send them to the driver and to each executor
    return candidates.join(found.hint("merge"), id_col)


def _units(df: DataFrame, vector: str, id_col: str, owner: str | None = None, match: str | None = None) -> DataFrame:
    own = F.col(owner) if owner else F.col(id_col)
    group = F.col(match).cast("string") if match else F.lit(None).cast("string")
    return materialise(unit(df, vector).select(F.col(id_col).cast("string").alias("id"), own.cast("string").alias("owner"), group.alias("match"), "unit"), "units")


def joined(vectors: DataFrame, threshold: float, id_col: str = "id", owner: str | None = None, vector: str = "content_embedding", block_rows: int = pruned.BLOCK_ROWS, base: DataFrame | None = None, match: str | None = None, same: bool = False, halves: bool = False, whole: bool = False) -> pruned.Join:
    """The written blocks and the planned work of a join, see similarity_join()."""
    side = None if base is None else _units(base, vector, id_col, owner, match)
    return pruned.prepare(_units(vectors, vector, id_col, owner, match), threshold, side, block_rows, same, halves, whole)


def similarity_join(vectors: DataFrame, threshold: float, top: int | None = None, id_col: str = "id", owner: str | None = None, vector: str = "content_embedding", block_rows: int = pruned.BLOCK_ROWS, base: DataFrame | None = None, same: str | None = None) -> DataFrame:
    """base_id, similar_id, similarity of all ordered pairs of a corpus at or above a threshold, top per base if given.

    Vectors are written once to the shared folder in blocks of close ones; pairs of blocks, and rows of blocks, that can't
    reach the threshold (or, with top, the n-th best that a base has by then) are never multiplied: see pruned.py.
    owner: pairs with the same value there are left out (and a vector and itself always). base: rows like those of
    vectors (some of them, or others) whose matches alone are looked for; only they are then multiplied with all. same:
    a column in which both must have the same value, not null; only such matches count towards the top.
    """
    join = joined(vectors, threshold, id_col, owner, vector, block_rows, base, same, same is not None, top is None, top is None and threshold <= -1)
    return join.pairs() if top is None else top_per(join.best(top), top)


def similarity_stats(vectors: DataFrame, by: str, id_col: str = "id", vector: str = "content_embedding", base: DataFrame | None = None, high: float | None = None) -> DataFrame:
    """Mergeable moments (pruned.MOMENTS) of each base's similarities with all others, by their value of a column: a row each, made beside the products.

    high: beside them, number and least id of the others that are at least so similar (pruned.HIGH).
    """
    return materialise(joined(vectors, -2.0, id_col, None, vector, base=base, match=by, whole=True).moments(high), "moments")


def top_per(found: DataFrame, n: int, base: str = "base_id", score: str = "similarity", tie: str = "similar_id") -> DataFrame:
    """The n best per base, ties by id."""
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(base).orderBy(F.desc(score), tie))).where(F.col("rank") <= n)


def lsh_candidates(vectors: DataFrame, threshold: float, id_col: str = "id", vector: str = "content_embedding", recall: float = 0.9) -> DataFrame:
    """Approximate similarity join (pairs a < b) that finds so large a share at least of the pairs at the threshold; similarities are exact. See lsh.py."""
    return lsh.approximate_join(_units(vectors, vector, id_col), threshold, recall)[0]


def embed(df: DataFrame, text: str, to: str = "content_embedding", model=None, dims: int = 256) -> DataFrame:
    """df with vectors of its texts: by a pandas UDF (text -> array<double>) if given, else hashed words scaled to length 1.

    Null texts have no vector; a model gives null where it fails.
    """
    if model is not None:
        return df.withColumn(to, model(F.col(text)))
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+"), lambda w: w != "")
    counted = HashingTF(numFeatures=dims, inputCol="__w", outputCol="__v").transform(df.withColumn("__w", words)).withColumn("__v", vector_to_array("__v"))
    return counted.withColumn("__n", norm(F.col("__v"))).withColumn(to, F.when(F.col("__n") > 0, F.transform("__v", lambda v: v / F.col("__n")))).drop("__w", "__v", "__n")


def merge_neighbours(first: DataFrame, fallback: DataFrame, n: int, base: str = "base_id", other: str = "similar_id", score: str = "similarity") -> DataFrame:
    """Per base the first list, filled up by those of the fallback that it lacks where it has fewer than n / 2, cut to n."""
    size = first.groupBy(base).agg(F.count("*").alias("__c"))
    extra = fallback.join(first.select(base, other), [base, other], "left_anti").join(size, base, "left").where(F.coalesce("__c", F.lit(0)) < n / 2).drop("__c")
    both = first.withColumn("__o", F.lit(0)).unionByName(extra.withColumn("__o", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy(base).orderBy("__o", F.desc(score), other))).where(F.col("rank") <= n).drop("__o")
