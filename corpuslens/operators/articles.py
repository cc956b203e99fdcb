"""Articles from nested CMS documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.text import bounded, html_text, iso_time, string_id


def _parts(*parts: Column) -> Column:
    return F.array_join(F.filter(F.flatten(F.array(*parts)), lambda p: p.isNotNull()), "\n")


def _tag(name: str, c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>")))


def _text(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) != "", c)


def assembled(docs: DataFrame) -> DataFrame:
    """Article rows of CMS documents: HTML (title h1, description, sections h2, paragraphs h3, questions as dl) and plain text."""
    a = F.col("attributes")
    none = F.array().cast("array<string>")
    paragraphs = lambda s: F.coalesce(F.flatten(F.transform(s["paragraph"], lambda p: F.array(_tag("h3", p["subtitle"]), _text(p["text"])))), none)
    body = F.coalesce(F.flatten(F.transform(a["article"], lambda s: F.concat(F.array(_tag("h2", s["title"]), _text(s["text"])), paragraphs(s)))), none)
    qa_html = F.when(F.coalesce(F.size(a["QandA"]), F.lit(0)) > 0, F.concat(F.lit("<dl>"), F.array_join(F.transform(a["QandA"], lambda q: F.concat(F.lit("<dt>"), F.coalesce(q["Question"], F.lit("")), F.lit("</dt><dd>"), F.coalesce(q["Answer"], F.lit("")), F.lit("</dd>"))), ""), F.lit("</dl>")))
    qa = F.array_join(F.coalesce(F.flatten(F.transform(a["QandA"], lambda q: F.array(F.concat(F.lit("Q: "), F.coalesce(q["Question"], F.lit(""))), F.concat(F.lit("A: "), F.coalesce(q["Answer"], F.lit("")))))), none), "\n")
    markup = _parts(F.array(_tag("h1", a["POST_TITLE"]), _tag("div", a["description"])), body, F.array(qa_html))
    none_of = frozenset()
    return docs.select(
        string_id(F.col("id")).alias("id"), F.coalesce(a["POST_TITLE"], F.lit("")).alias("title"), F.coalesce(a["LINK"], F.lit("")).alias("link"), string_id(a["KOZA_ID"]).alias("koza_id"),
        html_text(markup, "\n", none_of, False).alias("full_content"), markup.alias("full_content_html"), html_text(qa, "\n", none_of, False).alias("qanda_content"), F.lit("article").alias("content_type"),
        F.lit(None).cast("bigint").alias("pageviews"), F.array().cast("array<double>").alias("content_embedding"), F.lit(None).cast("string").alias("embedding_model"),
        iso_time(a["createdAt"]).alias("created_at"), iso_time(a["updatedAt"]).alias("updated_at"),
    )


# Characters that a field of a record may have
FIELD_LIMITS = {"full_content": 50_000, "full_content_html": 50_000, "qanda_content": 10_000, "description": 5_000}


def limited(rows: DataFrame) -> DataFrame:
    """rows with those of their text fields that have a limit cut there and marked."""
    return rows.withColumns({c: bounded(F.col(c), n) for c, n in FIELD_LIMITS.items() if c in rows.columns})


def course_rows(docs: DataFrame) -> DataFrame:
    a = F.col("attributes")
    return docs.select(string_id(F.col("id")).alias("id"), a["slug"].alias("slug"), a["name"].alias("name"), a["description"].alias("description"), F.lit(0).cast("bigint").alias("total_articles"), F.lit(0).cast("bigint").alias("total_pageviews"), iso_time(a["createdAt"]).alias("created_at"), iso_time(a["updatedAt"]).alias("updated_at"))
