"""The tables that the registered queries work on, as views over the given ones, in SQL that Spark and DuckDB share.

A name in braces is a given table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
HOST = "www.example.test"

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Events by the document that they are of: half of them over 200 much-visited ones, half over all.
OF_DOC = """(SELECT *, CASE WHEN event_id % 2 = 0 THEN event_id % 200 ELSE CAST(floor(event_id / 2) AS BIGINT) % (SELECT COUNT(*) FROM {documents}) END AS of_doc FROM {events})"""

VIEWS = {
    "v_courses": """
        SELECT source AS id, source AS slug, concat('Course ', source) AS name FROM {documents} GROUP BY source""",
    "v_events": f"""
        SELECT e.event_id, e.ts, CAST(e.ts AS DATE) AS event_date,
               CASE e.event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'user_engagement' ELSE e.event_type END AS event_name,
               CAST(e.user_id AS STRING) AS user_pseudo_id, CAST(extract(day FROM e.ts) AS STRING) AS ga_session_id,
               CASE WHEN e.user_id % 3 = 0 THEN 'organic' ELSE 'referral' END AS traffic_medium,
               CAST(floor(e.value * 1000) AS BIGINT) AS engagement_time_msec,
               concat('https://{HOST}/', d.source, '/column/doc-', CAST(d.doc_id AS STRING),
                      CASE e.event_id % 4 WHEN 0 THEN '/' WHEN 1 THEN '?ref=x' WHEN 2 THEN '#top' ELSE '' END) AS page_location
        FROM {OF_DOC} e JOIN {{documents}} d ON d.doc_id = e.of_doc""",
    "v_metrics": f"""
        SELECT CAST(of_doc AS STRING) AS id,
               SUM(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS pageviews,
               COUNT(DISTINCT CASE WHEN event_type = 'click' THEN user_id END) AS engaged_sessions,
               COUNT(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id END) AS organic_sessions,
               SUM(value) / COUNT(*) AS avg_engagement_time
        FROM {OF_DOC} e GROUP BY of_doc""",
    "v_articles": """
        SELECT CAST(d.doc_id AS STRING) AS id, split_part(d.text, chr(10), 1) AS title, concat('doc-', CAST(d.doc_id AS STRING)) AS link,
               d.source AS koza_id, d.text AS full_content, d.lang AS content_type,
               CAST(m.pageviews AS BIGINT) AS pageviews, m.engaged_sessions, m.organic_sessions, m.avg_engagement_time,
               split(concat(d.lang, ',', d.source, ',k', CAST(d.n_chars % 7 AS STRING)), ',') AS search_keywords,
               v.embedding AS content_embedding, o1.o_orderdate AS created_at, o2.o_orderdate AS updated_at
        FROM {documents} d LEFT JOIN {v_metrics} m ON m.id = CAST(d.doc_id AS STRING)
        LEFT JOIN {embeddings} v ON v.vec_id = d.doc_id
        LEFT JOIN {orders} o1 ON o1.o_orderkey = d.doc_id LEFT JOIN {orders} o2 ON o2.o_orderkey = d.doc_id + 500""",
    "v_chunks": """
        SELECT concat(CAST(CAST(floor(vec_id / 10) AS BIGINT) AS STRING), '_', CAST(vec_id % 10 AS STRING)) AS chunk_id,
               CAST(CAST(floor(vec_id / 10) AS BIGINT) AS STRING) AS article_id, CAST(vec_id % 10 AS BIGINT) AS chunk_index,
               CASE label WHEN 0 THEN '概要' WHEN 1 THEN 'まとめ' WHEN 2 THEN '参考' WHEN 3 THEN '' ELSE concat('Section ', CAST(label AS STRING)) END AS chunk_title,
               embedding AS content_embedding
        FROM {embeddings}""",
    "v_usage": """
        SELECT ts AS log_ts, CAST(user_id AS STRING) AS session_id, CASE WHEN user_id % 2 = 0 THEN 'hosted' ELSE 'local' END AS provider,
               'text_generation' AS request_type, CAST(floor(value) AS BIGINT) AS response_time_ms,
               CASE WHEN user_id % 2 = 0 THEN 50.0E0 ELSE 5.0E0 END AS cost_estimate, event_type <> 'error' AS success
        FROM {events}""",
    "v_cache": """
        SELECT CAST(p.base AS STRING) AS base_article_id, CAST(p.similar AS STRING) AS similar_article_id,
               (p.base * 7 + p.similar * 3) % 100 / 100.0E0 AS similarity_score, o.o_orderdate AS cached_at, e.ts AS expires_at
        FROM (SELECT a.vec_id AS base, b.vec_id AS similar, (a.vec_id * 37 + b.vec_id % 3) % (SELECT COUNT(*) FROM {events}) AS of_event
              FROM {embeddings} a JOIN {embeddings} b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 4) p
        JOIN {orders} o ON o.o_orderkey = p.base JOIN {events} e ON e.event_id = p.of_event""",
    "v_proposals": """
        SELECT CAST(o_orderkey AS STRING) AS proposal_id,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS status,
               split(concat(CAST(o_custkey AS STRING), ',', CAST(o_custkey + 1 AS STRING)), ',') AS article_ids, o_orderdate AS created_at
        FROM {orders}""",
}


#: Orders as dates of documents (of the ids so many before their keys). Keys that no document has are left out before anything moves.
DATES = """(SELECT o_orderkey - %d AS doc_id, o_orderdate FROM {orders}
                              WHERE o_orderkey BETWEEN (SELECT MIN(doc_id) + %d FROM {documents}) AND (SELECT MAX(doc_id) + %d FROM {documents}))"""

#: Views for Spark, same rows. v_articles: whatever is joined meets the ids first, by them alone, so each text moves once at most, is
#: never sorted, and only goes along where it is asked for (titles are cut before the join). v_cache: the band of neighbours is four equal
#: joins instead of a range over all pairs; of orders and events, only keys in the range of what they are joined to move (x % n isn't beyond x).
FOR_SPARK = {
    "v_articles": f"""
        SELECT /*+ SHUFFLE_HASH(n) */ CAST(d.doc_id AS STRING) AS id, d.title, concat('doc-', CAST(d.doc_id AS STRING)) AS link,
               d.source AS koza_id, d.text AS full_content, d.lang AS content_type,
               n.pageviews, n.engaged_sessions, n.organic_sessions, n.avg_engagement_time,
               split(concat(d.lang, ',', d.source, ',k', CAST(d.n_chars % 7 AS STRING)), ',') AS search_keywords,
               n.content_embedding, n.created_at, n.updated_at
        FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM {{documents}}) d
        LEFT JOIN (SELECT k.doc_id, CAST(m.pageviews AS BIGINT) AS pageviews, m.engaged_sessions, m.organic_sessions, m.avg_engagement_time,
                          v.embedding AS content_embedding, o1.o_orderdate AS created_at, o2.o_orderdate AS updated_at
                   FROM (SELECT DISTINCT doc_id FROM {{documents}}) k LEFT JOIN ({VIEWS["v_metrics"].replace("CAST(of_doc AS STRING) AS id", "of_doc")}) m ON m.of_doc = k.doc_id
                   LEFT JOIN {DATES % (500, 500, 500)} o2 ON o2.doc_id = k.doc_id
                   LEFT JOIN {DATES % (0, 0, 0)} o1 ON o1.doc_id = k.doc_id
                   LEFT JOIN {{embeddings}} v ON v.vec_id = k.doc_id) n ON n.doc_id = d.doc_id""",
    "v_cache": VIEWS["v_cache"]
    .replace("{embeddings} b ON b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 4", "(SELECT vec_id, explode(sequence(vec_id - 4, vec_id - 1)) AS of FROM {embeddings}) b ON b.of = a.vec_id")
    .replace("{orders} o", "(SELECT * FROM {orders} WHERE o_orderkey BETWEEN (SELECT MIN(vec_id) FROM {embeddings}) AND (SELECT MAX(vec_id) FROM {embeddings})) o")
    .replace("{events} e", "(SELECT * FROM {events} WHERE event_id BETWEEN (SELECT least(MIN(vec_id) * 37 - 2, 0) FROM {embeddings}) AND (SELECT greatest(MAX(vec_id) * 37 + 2, 0) FROM {embeddings})) e"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or one of the views, over the tables in sf_dir."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FOR_SPARK.get(name, VIEWS[name])
    return spark.sql(sql, **{n: view(spark, sf_dir, n) for n in sorted(set(re.findall(r"\{(\w+)\}", sql)))})


def with_views(sql: str) -> str:
    """DuckDB SQL in which the views that it names are defined first."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bv_\w+", text):
            if name in VIEWS and name not in order:
                need(VIEWS[name])
                order.append(name)

    need(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({re.sub(r'[{}]', '', VIEWS[n])})" for n in order)
    rest = sql.strip()
    if rest.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {rest[14:]}"
    return f"WITH {ctes}, {rest[4:]}" if rest.upper().startswith("WITH ") else f"WITH {ctes} {rest}"
