"""Lists of the nearest of each base, kept up to date with changes instead of built again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.vectors import similarity_join, top_per
from corpuslens.runtime import materialise

LIST = ["base_id", "similar_id", "similarity"]


def build(articles: DataFrame, n: int, threshold: float, bases: DataFrame | None = None, vector: str = "content_embedding") -> DataFrame:
    """base_id, similar_id, similarity of the n nearest of each base (none: of every article) at or above a threshold, ties by id."""
    return similarity_join(articles, threshold, n, vector=vector, base=bases).select(*LIST)


def touched(lists: DataFrame, bases: DataFrame, changed: DataFrame, n: int) -> DataFrame:
    """id of the bases whose lists must be built again: changed ones, and those that lose one of a full list.

    A list of fewer than n has all that reach the threshold, so one that it loses leaves no room for another.
    """
    lost = lists.join(changed.select(F.col("id").alias("similar_id")), "similar_id", "left_semi").select("base_id").distinct()
    full = lists.groupBy("base_id").agg(F.count("*").alias("c")).where(F.col("c") >= n)
    again = changed.select("id").union(full.join(lost, "base_id", "left_semi").select(F.col("base_id").alias("id"))).distinct()
    return again.join(bases.select("id"), "id", "left_semi")


def refresh(lists: DataFrame, articles: DataFrame, changed: DataFrame, n: int, threshold: float, bases: DataFrame | None = None, vector: str = "content_embedding") -> DataFrame:
    """lists (as build() makes them) after articles have changed: equal to a full build over articles.

    articles: as they are now; changed: id of each article that is new, gone, or differs in its vector or in being a base
    (ids may repeat). Touched lists are built again, against all articles; the others only meet the new vectors, and lose
    what is gone. The work is that of the touched bases with all articles and of all bases with the changed ones.
    """
    changed = materialise(changed.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL").distinct(), "changed")
    bases = articles if bases is None else bases
    again = materialise(touched(lists, bases, changed, n), "touched")
    fresh = articles.join(changed, "id", "left_semi")
    others = bases.join(again, "id", "left_anti")
    built = build(articles, n, threshold, bases.join(again, "id", "left_semi"), vector)
    met = build(fresh, n, threshold, others, vector)
    out = lambda df, name: df.join(changed.select(F.col("id").alias(name)), name, "left_anti")
    kept = out(out(lists.select(*LIST), "similar_id"), "base_id").join(again.select(F.col("id").alias("base_id")), "base_id", "left_anti")
    return built.unionByName(top_per(kept.unionByName(met), n).select(*LIST))
