"""Scores of article pairs from their chunk matches and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What chunk titles contain, by weight
TITLE_WORDS = ("タイトル", "title", "見出し")
INTRO_WORDS = ("はじめに", "概要", "導入", "とは", "について")
CLOSING_WORDS = ("まとめ", "結論", "おわりに", "ポイント")
REFERENCE_WORDS = ("参考", "関連", "リンク", "注釈", "補足")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def chunk_weight(title: Column, index: Column, total: Column) -> Column:
    """Weight of a chunk; one without a title weighs 1 wherever it stands."""
    low = F.lower(title)
    return (
        F.when(F.coalesce(title, F.lit("")) == "", 1.0)
        .when(_any(low, TITLE_WORDS) | (index == 0), 5.0)
        .when(_any(low, INTRO_WORDS) | (index == 1), 3.0)
        .when(_any(low, CLOSING_WORDS) | (index == total - 1), 2.0)
        .when(_any(low, REFERENCE_WORDS), 0.5)
        .otherwise(1.0)
    )


def ranked_matches(matches: DataFrame, top_chunks: int) -> DataFrame:
    """Of each base chunk's matches over all articles, the best top_chunks (ties by chunk id)."""
    w = Window.partitionBy("base_chunk_id").orderBy(F.desc("similarity"), "similar_chunk_id")
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_chunks)


def article_pairs(matches: DataFrame, totals: DataFrame, keep: int = 10) -> DataFrame:
    """Chunk matches (base_article, similar_article, base/similar chunk id and index, base_title, similarity) per article pair.

    totals: article_id, chunks with a vector. Columns: avg and peak similarity, distinct chunks of either side, their
    ratio to the smaller article, blended score, and the best matches (ties by chunk ids).
    """
    best = F.struct((-F.col("similarity")).alias("minus"), "base_chunk_id", "similar_chunk_id", "base_index", "base_title", "similarity")
    pairs = matches.groupBy("base_article", "similar_article").agg(
        F.avg("similarity").alias("avg_similarity"), F.max("similarity").alias("max_similarity"),
        F.count_distinct("base_chunk_id").alias("base_chunks"), F.count_distinct("similar_chunk_id").alias("similar_chunks"),
        F.slice(F.array_sort(F.collect_list(best)), 1, keep).alias("matches"),
    )
    for side in ("base", "similar"):
        pairs = pairs.join(totals.select(F.col("article_id").alias(f"{side}_article"), F.col("chunks").alias(f"{side}_total")), f"{side}_article", "left")
    return pairs.withColumn("matching_ratio", matching_ratio()).withColumn("blended", blended())


def matching_ratio() -> Column:
    return F.try_divide(F.least("base_chunks", "similar_chunks"), F.least("base_total", "similar_total"))


def blended() -> Column:
    return F.least(F.col("avg_similarity") * 0.70 + F.coalesce("matching_ratio", F.lit(0.0)) * 0.30, F.lit(1.0))


def weighted_ratio(matches: Column, base_total: Column, similar_total: Column) -> Column:
    """Weight of the matches over the smaller article's number of chunks, at most 1."""
    weight = F.aggregate(matches, F.lit(0.0), lambda s, m: s + chunk_weight(m["base_title"], m["base_index"], base_total))
    return F.coalesce(F.least(F.try_divide(weight, F.least(base_total, similar_total)), F.lit(1.0)), F.lit(0.0))


def longest_run(indexes: Column) -> Column:
    """Longest run of consecutive numbers in a list, sorted; an equal neighbour starts anew."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, i: Column) -> Column:
        run = F.when(i == s["last"] + 1, s["run"] + 1).otherwise(1)
        return F.struct(i.cast("bigint").alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(indexes), start, step, lambda s: s["best"])


def run_bonus(run: Column) -> Column:
    return F.when(run >= 5, 0.15).when(run == 4, 0.12).when(run == 3, 0.09).when(run == 2, 0.05).otherwise(0.0)


def days_within(a: Column, b: Column, days: int = 30) -> Column:
    """Whether two times are at most so many days apart; false where one is null."""
    apart = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp")))
    return F.coalesce(apart <= days * 86_400_000_000, F.lit(False))


def title_overlap(a: Column, b: Column) -> Column:
    """Common words over the larger set of words; null where a title is."""
    x, y = (F.array_distinct(F.split(c, r"(?U)\s+")) for c in (a, b))
    return F.try_divide(F.size(F.array_intersect(x, y)), F.greatest(F.size(x), F.size(y)))


def metadata_bonus(base: str = "base", other: str = "similar") -> Column:
    """At most 0.2, from structs of id, koza_id, created_at, updated_at, search_keywords, title."""
    a, b = F.col(base), F.col(other)
    words = F.coalesce(title_overlap(F.nullif(a["title"], F.lit("")), F.nullif(b["title"], F.lit(""))), F.lit(0.0)) * 0.05
    shared = F.coalesce(F.least(F.size(F.array_intersect(a["search_keywords"], b["search_keywords"])) * 0.01, F.lit(0.05)), F.lit(0.0))
    return F.least(
        F.when(a["koza_id"].eqNullSafe(b["koza_id"]), 0.05).otherwise(0.0)
        + F.when(days_within(a["created_at"], b["created_at"]), 0.03).otherwise(0.0)
        + F.when(days_within(a["updated_at"], b["updated_at"]), 0.02).otherwise(0.0) + shared + words,
        F.lit(0.20),
    )


def enhanced(avg: Column, ratio: Column, run: Column, metadata: Column) -> Column:
    return F.least(avg * 0.60 + ratio * 0.25 + run + F.least(metadata * 0.5, F.lit(0.05)), F.lit(1.0))


def breakdown(avg: Column, ratio: Column, run: Column, metadata: Column) -> Column:
    """The parts of enhanced(), as texts with three decimals (half up)."""
    parts = {"base_score": avg * 0.60, "weighted_ratio_score": ratio * 0.25, "run_bonus": run, "metadata_bonus": F.least(metadata * 0.5, F.lit(0.05)), "weighted_ratio": ratio}
    return F.struct(*[F.format_string("%.3f", v.cast("double")).alias(k) for k, v in parts.items()])
