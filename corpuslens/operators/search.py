"""Listing, search, filters, orders and pages over articles and results. Orders always end with an id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.vectors import has_vector


def contains_any_case(column: str, query: str, escape: bool = True) -> Column:
    """Whether a text contains a query in any case; unescaped, % and _ in it are wildcards."""
    low = F.lower(F.col(column))
    return F.contains(low, F.lit(query.lower())) if escape else low.like(f"%{query.lower()}%")


def article_filter(df: DataFrame, title: str | None = None, course: str | None = None, views: tuple[int | None, int | None] = (None, None), engaged: tuple[int | None, int | None] = (None, None), content_type: str | None = None) -> DataFrame:
    """Each condition that is given; an upper bound of 0 is none."""
    if title:
        df = df.where(contains_any_case("title", title))
    if course:
        df = df.where(F.col("koza_id") == course)
    if content_type:
        df = df.where(F.col("content_type") == content_type)
    for c, (lo, hi) in (("pageviews", views), ("engaged_sessions", engaged)):
        if lo:
            df = df.where(F.col(c) >= lo)
        if hi:
            df = df.where(F.col(c) <= hi)
    return df


def facets(df: DataFrame, title: str | None = None, actions: list[str] | None = None, similarity: tuple[float, float] = (0, 100), views: tuple[int, int | None] = (0, None), same_course: str | None = None, courses: list[str] | None = None) -> DataFrame:
    """Filter of similar articles: similarity in percent; same_course leaves only that course, else any of courses."""
    if title:
        df = df.where(contains_any_case("title", title))
    if actions:
        df = df.where(F.col("recommendation_type").isin(actions))
    df = df.where((F.col("similarity") * 100).between(*similarity) & (F.coalesce("pageviews", F.lit(0)) >= views[0]))
    if views[1] is not None:
        df = df.where(F.coalesce("pageviews", F.lit(0)) <= views[1])
    if same_course is not None:
        return df.where(F.col("koza_id") == same_course)
    return df.where(F.col("koza_id").isin(courses)) if courses else df


def text_search(df: DataFrame, query: str, fields: list[str], course: str | None = None) -> DataFrame:
    found = df.where(reduce(lambda a, b: a | b, [contains_any_case(f, query) for f in fields]))
    return found.where(F.col("koza_id") == course) if course else found


def published(df: DataFrame, course: str | None = None, status: str = "status") -> DataFrame:
    out = df.where(F.col(status) == "published")
    return out.where(F.col("koza_id") == course) if course else out


def chunk_worklist(df: DataFrame, least: int = 100) -> DataFrame:
    """Articles with text or HTML of more than least characters."""
    long = lambda c: F.coalesce(F.char_length(c), F.lit(0)) > least
    return df.where(reduce(lambda a, b: a | b, [long(c) for c in ("full_content", "full_content_html") if c in df.columns]))


def embedding_worklist(df: DataFrame, force: bool = False, course: str | None = None, least: int = 50) -> DataFrame:
    """Articles that lack a vector (or all) and have text; order_worklist() puts the most viewed, longest, newest first."""
    out = df.where(F.char_length("full_content") > least)
    out = out if force else out.where(~has_vector(F.col("content_embedding")))
    return out.where(F.col("koza_id") == course) if course else out


def order_worklist(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc_nulls_last("pageviews"), F.desc(F.char_length("full_content")), F.desc_nulls_last("updated_at"), "id")


def progress(df: DataFrame, offset: int, size: int) -> DataFrame:
    """Size of a work list, where the next batch begins, whether there is one, percent done."""
    n = F.count("*")
    following = F.least(F.lit(offset + size), n)
    return df.agg(n.alias("total"), following.alias("next_offset"), (following < n).alias("has_more"), F.when(n > 0, F.round(following / n * 100, 1)).otherwise(F.lit(100.0)).alias("percent"))


def seeds(df: DataFrame, least: int = 100, n: int = 20) -> DataFrame:
    """Most viewed articles with a vector."""
    return df.where((F.col("pageviews") >= least) & has_vector(F.col("content_embedding"))).orderBy(F.desc("pageviews"), "id").limit(n)


RANGES = {"1h": "INTERVAL 1 HOUR", "24h": "INTERVAL 24 HOURS", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}


def since(ts: str, as_of: Column, name: str) -> Column:
    """Whether a time is in a named range up to as_of; unknown names are 24 hours."""
    return F.col(ts) >= as_of - F.expr(RANGES.get(name, RANGES["24h"]))


def by_id(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.where(F.col(key).cast("string") == value).limit(1)


def by_slug_link(articles: DataFrame, courses: DataFrame, slug: str, link: str) -> DataFrame:
    found = articles.where(F.col("link") == link).join(courses.where(F.col("slug") == slug).select(F.col("id").alias("koza_id"), "slug"), "koza_id")
    return found.orderBy("id").limit(1)


def long_articles(df: DataFrame, least: int = 500, n: int = 10) -> DataFrame:
    return df.where(F.char_length("full_content") > least).orderBy(F.desc_nulls_last("pageviews"), "id").limit(n)


def url_path(slug: Column, link: Column) -> Column:
    return F.concat(F.lit("/"), slug, F.lit("/"), link)


def absolute_url(slug: Column, link: Column, host: str) -> Column:
    rest = F.regexp_replace(link, "^/", "")
    return F.when(F.coalesce(slug, F.lit("")) != "", F.concat(F.lit(f"https://{host}/"), slug, F.lit("/column/"), rest)).otherwise(F.concat(F.lit(f"https://{host}/"), rest))


#: Sort keys of article lists.
SORTS = {
    "pageviews_desc": [F.desc_nulls_last, "pageviews"], "pageviews_asc": [F.asc_nulls_last, "pageviews"],
    "engagement_desc": [F.desc_nulls_last, "engaged_sessions"], "engagement_asc": [F.asc_nulls_last, "engaged_sessions"],
    "title_asc": [F.asc_nulls_last, "title"], "title_desc": [F.desc_nulls_last, "title"],
    "updated_desc": [F.desc_nulls_last, "updated_at"], "updated_asc": [F.asc_nulls_last, "updated_at"],
}
FIELDS = ("updated_at", "created_at", "title", "pageviews")


def sort_columns(name: str) -> list[Column]:
    order, column = SORTS.get(name, SORTS["pageviews_desc"])
    return [order(column), F.col("id").asc()]


def field_columns(field: str, descending: bool = True) -> list[Column]:
    c = field if field in FIELDS else "updated_at"
    return [F.desc_nulls_last(c) if descending else F.asc_nulls_last(c), F.col("id").asc()]


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Rows of a page (from 1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(df: DataFrame, number: int, size: int) -> DataFrame:
    n = F.count("*")
    pages = F.ceil(n / size)
    return df.agg(n.alias("total"), pages.alias("pages"), (F.lit(number) < pages).alias("has_next"), F.lit(number > 1).alias("has_prev"))


def relevance(query: str) -> Column:
    """3 for a hit in the title, 2 in the text, 1 in the link."""
    return F.when(contains_any_case("title", query), 3).when(contains_any_case("full_content", query), 2).when(contains_any_case("link", query), 1).otherwise(0)


def course_map(courses: DataFrame) -> DataFrame:
    """id and name of the courses that have a name, by id."""
    return courses.where("name IS NOT NULL AND name <> ''").orderBy("id").select("id", "name")
