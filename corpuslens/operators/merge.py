"""Table maintenance as snapshots: functions of a table and its changes that return the new table.

Changes must have one row per key; unique() says so early.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a matched row takes: the change's value, the old value, the change's unless null, the change's unless empty.
REPLACE, KEEP, COALESCE, NONEMPTY = "replace", "keep", "coalesce", "nonempty"


def unique(changes: DataFrame, key: str) -> DataFrame:
    """changes, failing at run time where a key occurs twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return changes.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit(f"{key} occurs twice: "), F.col(key).cast("string")))).otherwise(F.lit(True)).cast("boolean")).drop("__n")


def merge(target: DataFrame, changes: DataFrame, key: str, rules: dict[str, str]) -> DataFrame:
    """target with rows of changes merged in: matched ones by each column's rule, others inserted. Columns that rules doesn't name are kept; those a side lacks are null."""
    names = target.columns
    t = target.select(*[F.col(c).alias(f"t_{c}") for c in names], F.lit(True).alias("t__"))
    s = changes.select(*[F.col(c).alias(f"s_{c}") for c in changes.columns], F.lit(True).alias("s__"))
    both = t.join(s, F.col(f"t_{key}") == F.col(f"s_{key}"), "full_outer")

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(f"t_{c}", f"s_{c}")
        if c not in changes.columns:
            return F.col(f"t_{c}")
        old, new = F.col(f"t_{c}"), F.col(f"s_{c}")
        rule = rules.get(c, KEEP)
        matched = {REPLACE: new, KEEP: old, COALESCE: F.coalesce(new, old), NONEMPTY: F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(old) if rule == NONEMPTY else old}[rule]
        return F.when(F.col("s__").isNull(), old).when(F.col("t__").isNull(), new).otherwise(matched)

    return both.select(*[value(c).alias(c) for c in names])


COURSE_RULES = {c: REPLACE for c in ("slug", "name", "description", "total_articles", "total_pageviews", "updated_at", "last_synced")}
ARTICLE_RULES = {c: REPLACE for c in ("title", "link", "koza_id", "full_content", "full_content_html", "qanda_content", "content_type", "updated_at", "last_synced")} | {"pageviews": COALESCE, "content_embedding": NONEMPTY, "embedding_model": COALESCE}


def split_new(batch: DataFrame, target: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the batch whose key the target lacks, and those that it has."""
    return batch.join(target.select(key), key, "left_anti"), batch.join(target.select(key), key, "left_semi")


def replace_keys(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """target without the keys of rows, and rows."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def check_merge(target: DataFrame, batch: DataFrame, key: str, as_of: Column, synced: str = "last_synced", minutes: int = 5) -> DataFrame:
    """Rows of the target that are in the batch, and how many of the target were synced in the last minutes."""
    found = target.join(batch.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return found.agg(F.count("__k").alias("in_batch"), F.count_if(F.col(synced) >= as_of - F.expr(f"INTERVAL {minutes} MINUTES")).alias("recently_synced"))


def set_values(target: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """target with the other columns of values wherever these have the key and aren't null."""
    names = [c for c in values.columns if c != key]
    new = values.select(key, *[F.col(c).alias(f"new_{c}") for c in names])
    return target.join(new, key, "left").withColumns({c: F.coalesce(f"new_{c}", c) for c in names}).drop(*[f"new_{c}" for c in names])


def unexpired(cache: DataFrame, as_of: Column) -> DataFrame:
    return cache.where(F.col("expires_at") >= as_of)


def normalised_cache(rows: DataFrame) -> DataFrame:
    """Cache rows with types and defaults; texts are cut to 500 characters."""
    return rows.select(
        F.col("base_article_id").cast("string"), F.col("similar_article_id").cast("string"), F.col("similarity_score").cast("double"),
        F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.8)).alias("confidence_score"), F.coalesce(F.col("traffic_impact_prediction").cast("bigint"), F.lit(0)).alias("traffic_impact_prediction"),
        F.coalesce("recommendation_type", F.lit("MONITOR")).alias("recommendation_type"), F.left(F.coalesce("explanation_text", F.lit("")), F.lit(500)).alias("explanation_text"), "cached_at", "expires_at",
    )


def apply_status(target: DataFrame, actions: DataFrame, key: str) -> DataFrame:
    """target with the status and time of each key's latest action (key, status, at; ties by status)."""
    last = actions.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("at"), "status"))).where("__r = 1")
    out = target.join(last.select(key, F.col("status").alias("__s"), F.col("at").alias("__at")), key, "left")
    return out.withColumns({"status": F.coalesce("__s", "status"), "updated_at": F.coalesce("__at", "updated_at")}).drop("__s", "__at")
