"""Statistics of corpora, courses, chunks, caches and providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.pruned import merged
from corpuslens.operators.vectors import has_vector


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, digits)).otherwise(F.lit(0.0))


def _filled(c: str) -> Column:
    return F.coalesce(F.char_length(c), F.lit(0)) > 0


def corpus(articles: DataFrame) -> DataFrame:
    v, n = has_vector(F.col("content_embedding")), F.count("*")
    return articles.agg(n.alias("total"), F.count_if(v).alias("with_vector"), F.count_if(~v).alias("without_vector"), F.count_if(_filled("full_content")).alias("with_content"), F.count_if(~_filled("full_content")).alias("without_content"), F.avg(F.coalesce("pageviews", F.lit(0))).alias("avg_pageviews"), F.max("updated_at").alias("last_updated"), percent(F.count_if(v), n).alias("coverage"))


def by_course(articles: DataFrame, courses: DataFrame) -> DataFrame:
    """Articles, vectors and coverage per course, with its name or one made from its id."""
    v, n = has_vector(F.col("content_embedding")), F.count("*")
    sums = articles.groupBy("koza_id").agg(n.alias("articles"), F.count_if(v).alias("vectors"), percent(F.count_if(v), n).alias("coverage"))
    return sums.join(courses.select(F.col("id").alias("koza_id"), "name"), "koza_id", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("講座"), "koza_id")))


def courses_with_articles(courses: DataFrame, articles: DataFrame) -> DataFrame:
    counts = articles.groupBy(F.col("koza_id").alias("id")).agg(F.count("id").alias("articles"))
    return courses.join(counts, "id").where("articles >= 1").select("id", "slug", "name", "articles")


def course_list(courses: DataFrame, articles: DataFrame) -> DataFrame:
    """Courses with counts, views, vectors, their rate, and how much of the articles has text and vectors."""
    v = has_vector(F.col("content_embedding"))
    sums = articles.groupBy(F.col("koza_id").alias("id")).agg(F.count("*").alias("articles"), F.sum(F.coalesce("pageviews", F.lit(0))).alias("pageviews"), F.avg("pageviews").alias("avg_pageviews"), F.count_if(v).alias("vectors"), F.count_if(_filled("full_content")).alias("texts"), F.max("updated_at").alias("last_updated"))
    out = courses.join(sums, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("articles", "pageviews", "vectors", "texts")})
    whole = F.greatest("articles", F.lit(1))
    return out.withColumns({"vector_rate": F.round(F.col("vectors") / whole, 4), "text_rate": F.round(F.col("texts") / whole, 4)}).drop("texts")


def one_course(articles: DataFrame, course: str | None = None) -> DataFrame:
    """Statistics of a course, or of each."""
    rows = articles.where(F.col("koza_id") == course) if course else articles
    words = F.size(F.filter(F.split("full_content", r"(?U)\s+"), lambda w: w != ""))
    return rows.groupBy("koza_id").agg(F.count("*").alias("articles"), F.avg("pageviews").alias("avg_pageviews"), F.sum("pageviews").alias("pageviews"), F.count_if(has_vector(F.col("content_embedding"))).alias("vectors"), F.avg(words).alias("avg_words"), F.min("created_at").alias("first_created"), F.max("created_at").alias("last_created"))


def views_and_likes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("koza_id").agg(F.count("*").alias("articles"), F.sum("view_count").alias("views"), F.sum("like_count").alias("likes"))


def search_stats(articles: DataFrame) -> DataFrame:
    return articles.agg(F.count("*").alias("articles"), F.count_distinct("koza_id").alias("courses"), F.sum("pageviews").alias("pageviews"), F.round(F.avg("pageviews"), 2).alias("avg_pageviews"), F.max("pageviews").alias("max_pageviews"), F.min("pageviews").alias("min_pageviews"), F.max("engaged_sessions").alias("max_engaged"))


def chunk_stats(chunks: DataFrame, text: str) -> DataFrame:
    """avg_chunk_index is what the corpus tools have called chunks per article; chunks_per_article is that."""
    n, v = F.count("*"), F.count_if(has_vector(F.col("content_embedding")))
    size = F.char_length(text)
    return chunks.agg(n.alias("chunks"), F.count_distinct("article_id").alias("articles"), F.avg(size).alias("avg_length"), F.min(size).alias("min_length"), F.max(size).alias("max_length"), v.alias("vectors"), percent(v, n).alias("coverage"), F.avg("chunk_index").alias("avg_chunk_index"), F.try_divide(n, F.count_distinct("article_id")).alias("chunks_per_article"))


def neighbour_stats(moments: DataFrame) -> DataFrame:
    """Of each base, statistics of its similarities, from their moments."""
    return merged(moments, "base_id")


def similarity_by_course(moments: DataFrame) -> DataFrame:
    """Of each base, statistics by course."""
    return merged(moments, "base_id", "match").select("base_id", F.col("match").alias("koza_id"), "n", "avg", "max")


def cache_stats(cache: DataFrame, as_of: Column) -> DataFrame:
    ok = F.count_if(F.col("expires_at") > as_of)
    return cache.agg(F.count("*").alias("entries"), F.count_distinct("base_article_id").alias("bases"), F.avg("similarity_score").alias("avg_score"), F.min("cached_at").alias("oldest"), F.max("cached_at").alias("newest"), ok.alias("valid"), (F.count("*") - ok).alias("expired"))


def cache_actions(cache: DataFrame, as_of: Column, action: Column) -> DataFrame:
    """Scores, entries per action, and valid entries a base to two decimals."""
    ok, bases = F.count_if(F.col("expires_at") > as_of), F.count_distinct("base_article_id")
    kinds = [F.count_if(action == a).alias(a.lower()) for a in ("MERGE_CONTENT", "REDIRECT_301", "CROSS_LINK", "MONITOR")]
    return cache.agg(F.count("*").alias("entries"), F.min("similarity_score").alias("min_score"), F.max("similarity_score").alias("max_score"), *kinds, (F.floor(ok / bases * 100 + 0.5) / 100).alias("coverage"))


def provider_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("provider").agg(F.count("*").alias("requests"), F.avg("response_time_ms").alias("avg_ms"), F.sum("cost_estimate").alias("cost"), F.count_if("success").alias("successes"), F.count_if(~F.col("success")).alias("failures"))


def provider_comparison(usage: DataFrame) -> DataFrame:
    """p95 is the element at rank ceil(0.95 n): partial sums are counts of distinct whole milliseconds, of which there are few."""
    n = F.count("*")
    return usage.groupBy("provider").agg(n.alias("requests"), F.avg("response_time_ms").alias("avg_ms"), F.min("response_time_ms").alias("min_ms"), F.max("response_time_ms").alias("max_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY response_time_ms)").cast("bigint").alias("p95_ms"), F.avg("cost_estimate").alias("avg_cost"), F.sum("cost_estimate").alias("cost"), percent(F.count_if("success"), n).alias("success_rate"))


def cost_savings(usage: DataFrame, dear: str = "hosted", cheap: str = "local", unit: float = 50.0) -> DataFrame:
    """What all requests would have cost at the dear provider's unit price, less what they did."""
    n, cost = F.count("*"), F.sum("cost_estimate")
    by = lambda p: F.coalesce(F.sum(F.when(F.col("provider") == p, F.col("cost_estimate"))), F.lit(0.0))
    return usage.agg((n * unit).alias("full_cost"), by(dear).alias("dear_cost"), by(cheap).alias("cheap_cost"), (n * unit - cost).alias("savings"), F.when(n > 0, F.round((n * unit - cost) / (n * unit) * 100, 2)).otherwise(F.lit(0.0)).alias("savings_percent"))


def monitoring_summary(usage: DataFrame) -> DataFrame:
    """The mean latency is the mean of the providers' means."""
    return provider_usage(usage).agg(F.sum("requests").alias("requests"), F.sum("cost").alias("cost"), F.avg("avg_ms").alias("avg_ms"), F.count("*").alias("providers"))


def proposals_by_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.sum(F.size("article_ids")).alias("articles"))


def run_by_field(rows: DataFrame, field: str, success: Column) -> DataFrame:
    return rows.groupBy(F.col(field).alias("field_type")).agg(F.count("*").alias("n"), F.count_if(success).alias("successes"))


def provider_recency(usage: DataFrame, as_of: Column) -> DataFrame:
    last = usage.groupBy("provider").agg(F.max("log_ts").alias("last_used"))
    ago = F.unix_micros(as_of) - F.unix_micros(F.col("last_used").cast("timestamp"))
    return last.withColumn("state", F.when(ago < 3_600_000_000, "active").when(ago < 86_400_000_000, "idle").otherwise("inactive"))


def active_groups(groups: DataFrame) -> DataFrame:
    """Number of active groups, and of articles in them."""
    return groups.where("status = 'active'").agg(F.count("*").alias("active_groups"), F.coalesce(F.sum(F.size("article_ids")), F.lit(0)).cast("bigint").alias("articles"))
