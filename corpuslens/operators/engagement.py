"""Page engagement rolled up from analytics events to articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recent_days(events: DataFrame, as_of: str, days: int = 7, day: str = "event_date") -> DataFrame:
    """Events of the newest days (at most so many, of those that exist up to as_of). The list of days is small and joined."""
    newest = events.where(F.col(day) <= F.lit(as_of).cast("date")).select(day).distinct().orderBy(F.desc(day)).limit(days)
    return events.join(F.broadcast(newest), day, "left_semi")


def parameter(params: str, key: str, kind: str) -> Column:
    """Value of a key in an array of key / value structs; null if absent."""
    return F.try_element_at(F.filter(params, lambda p: p["key"] == key), F.lit(1))["value"][kind]


def article_page(url: str, host: str, section: str = "column") -> Column:
    """Whether a URL is that of an article page."""
    quoted = host.replace(".", r"\.")
    c = F.col(url)
    return c.isNotNull() & c.like(f"%{host}%{section}%") & c.rlike(rf"https://{quoted}/[^/]+/{section}/[^?#]+")


def session_id() -> Column:
    """Null, and so not counted, if either part is."""
    return F.concat("user_pseudo_id", F.lit("-"), "ga_session_id")


def page_metrics(events: DataFrame, limit: int | None = None) -> DataFrame:
    """Per page_location: views, distinct organic, engaged and all sessions, engagement; pages with a view, most viewed first."""
    s = session_id()
    out = events.groupBy("page_location").agg(
        F.count_if(F.col("event_name") == "page_view").alias("pageviews"),
        F.count_distinct(F.when(F.col("traffic_medium") == "organic", s)).alias("organic_sessions"),
        F.count_distinct(F.when(F.coalesce("engagement_time_msec", F.lit(0)) > 0, s)).alias("engaged_sessions"),
        F.sum(F.coalesce("engagement_time_msec", F.lit(0))).alias("engagement_msec"),
        F.count_distinct(s).alias("sessions"),
    ).where("pageviews >= 1")
    return out if limit is None else out.orderBy(F.desc("pageviews"), "page_location").limit(limit)


def view_metrics(events: DataFrame, limit: int = 5000) -> DataFrame:
    """Views only, with the number of distinct beginnings of a location."""
    out = events.where("event_name = 'page_view'").groupBy("page_location").agg(F.count("*").alias("pageviews"), F.count_distinct(F.substring("page_location", 1, 100)).alias("url_variations"))
    return out.orderBy(F.desc("pageviews"), "page_location").limit(limit)


def url_path(url: Column, host: str, section: str = "column") -> Column:
    """Normalised path of a URL on a host (port included in the comparison): one trailing slash, null if it isn't a page of the section."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 1)
    path = F.btrim(rest, F.lit("/"))
    return F.when((netloc == host) & F.contains(path, F.lit(f"/{section}/")), F.concat(path, F.lit("/")))


def link_key(slug: Column, link: Column, section: str = "column") -> Column:
    trimmed = F.btrim(link)
    return F.concat(slug, F.lit(f"/{section}/"), F.when(F.endswith(trimmed, F.lit("/")), trimmed).otherwise(F.concat(trimmed, F.lit("/"))))


def key_map(courses: DataFrame, articles: DataFrame) -> DataFrame:
    """path -> article id (the smallest of several), and how many there were."""
    both = articles.select("id", "koza_id", "link").join(courses.select(F.col("id").alias("koza_id"), "slug"), "koza_id").where("slug <> '' AND link <> ''")
    return both.groupBy(link_key(F.col("slug"), F.col("link")).alias("path")).agg(F.min("id").alias("id"), F.count("*").alias("candidates"))


#: Registers of a session sketch as a power of two; its relative standard error is about 0.83 / sqrt(2 ** SKETCH).
SKETCH = 12


def page_day_sketches(events: DataFrame, host: str, day: str = "event_date", size: int = SKETCH) -> DataFrame:
    """Per normalised path and day: views, engagement, and sketches of all, organic and engaged sessions, which unite over days and paths without the events."""
    s = session_id()
    sketch = lambda c, name: F.hll_sketch_agg(c, size).alias(name)
    rows = events.withColumn("path", url_path(F.col("page_location"), host)).where("path IS NOT NULL")
    return rows.groupBy("path", day).agg(
        F.count_if(F.col("event_name") == "page_view").alias("pageviews"), F.sum(F.coalesce("engagement_time_msec", F.lit(0))).alias("engagement_msec"), sketch(s, "sessions"),
        sketch(F.when(F.col("traffic_medium") == "organic", s), "organic_sessions"), sketch(F.when(F.coalesce("engagement_time_msec", F.lit(0)) > 0, s), "engaged_sessions"),
    )


def from_sketches(sketches: DataFrame, first: str | None = None, last: str | None = None, day: str = "event_date", keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """METRICS of the days from first to last (included), from page_day_sketches(); numbers of sessions are estimates. Paths with a view."""
    rows = sketches
    if first is not None:
        rows = rows.where(F.col(day) >= F.lit(first).cast("date"))
    if last is not None:
        rows = rows.where(F.col(day) <= F.lit(last).cast("date"))
    estimate = lambda c: F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c)
    return rows.groupBy(*keys).agg(F.sum("pageviews").alias("pageviews"), estimate("organic_sessions"), estimate("engaged_sessions"), F.sum("engagement_msec").alias("engagement_msec"), estimate("sessions")).where("pageviews >= 1")


METRICS = ("pageviews", "organic_sessions", "engaged_sessions", "engagement_msec", "sessions")


def by_path(metrics: DataFrame, host: str) -> DataFrame:
    """Sums of the page metrics per normalised path (sums of distinct counts; see exact_by_path)."""
    return metrics.withColumn("path", url_path(F.col("page_location"), host)).where("path IS NOT NULL").groupBy("path").agg(*[F.sum(m).alias(m) for m in METRICS])


def exact_by_path(events: DataFrame, host: str) -> DataFrame:
    """The same from the events, with sessions counted once a path."""
    pathed = events.withColumn("page_location", url_path(F.col("page_location"), host)).where("page_location IS NOT NULL")
    return page_metrics(pathed).withColumnRenamed("page_location", "path")


def average_seconds(msec: Column, sessions: Column) -> Column:
    return F.when(sessions > 0, msec / (sessions * 1000)).otherwise(F.lit(0.0))


def changed(new: DataFrame, articles: DataFrame) -> DataFrame:
    """Rows of new (id and metrics) that differ from the articles': any count, or the mean time by more than 0.1."""
    old = articles.select("id", *[F.coalesce(c, F.lit(0)).alias(f"old_{c}") for c in ("pageviews", "organic_sessions", "engaged_sessions", "avg_engagement_time")])
    differs = (F.col("pageviews") != F.col("old_pageviews")) | (F.col("organic_sessions") != F.col("old_organic_sessions")) | (F.col("engaged_sessions") != F.col("old_engaged_sessions")) | (F.abs(F.col("avg_engagement_time") - F.col("old_avg_engagement_time")) > 0.1)
    return new.join(old, "id").where(differs)


def short_title(title: Column, n: int = 50) -> Column:
    return F.when(F.char_length(title) > n, F.concat(F.left(title, F.lit(n)), F.lit("..."))).otherwise(title)


def update_summary(changes: DataFrame) -> DataFrame:
    return changes.agg(F.sum("old_pageviews").alias("old_total"), F.sum("pageviews").alias("new_total"), (F.sum("pageviews") - F.sum("old_pageviews")).alias("difference"))


def course_totals(courses: DataFrame, articles: DataFrame) -> DataFrame:
    """courses with the number of their articles and the sum of their views, 0 for none; articles without a course are left out."""
    sums = articles.where("koza_id <> ''").groupBy(F.col("koza_id").alias("id")).agg(F.count("*").alias("total_articles"), F.sum(F.coalesce("pageviews", F.lit(0))).alias("total_pageviews"))
    return courses.join(sums, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total_articles", "total_pageviews")})


def article_updates(events: DataFrame, courses: DataFrame, articles: DataFrame, host: str) -> DataFrame:
    """From events to the articles' changed metrics."""
    paths = by_path(page_metrics(events.where(article_page("page_location", host))), host)
    found = paths.join(key_map(courses, articles), "path").withColumn("avg_engagement_time", average_seconds(F.col("engagement_msec"), F.col("sessions")))
    return changed(found.select("id", "pageviews", "organic_sessions", "engaged_sessions", "avg_engagement_time"), articles)


def apply_updates(articles: DataFrame, updates: DataFrame) -> DataFrame:
    """articles with the metrics of updates (id and four metrics); mean times are rounded to four decimals."""
    names = ("pageviews", "organic_sessions", "engaged_sessions", "avg_engagement_time")
    new = updates.select("id", *[F.col(c).alias(f"new_{c}") for c in names])
    out = articles.join(new, "id", "left").withColumns({c: F.coalesce(F.round(f"new_{c}", 4) if c == "avg_engagement_time" else F.col(f"new_{c}"), F.col(c)) for c in names})
    return out.drop(*[f"new_{c}" for c in names])
