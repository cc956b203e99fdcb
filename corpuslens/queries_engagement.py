"""Queries of sources, table maintenance and engagement."""

from pyspark.sql import functions as F

from corpuslens.operators import engagement as eng
from corpuslens.operators import merge, stats
from corpuslens.queries import SITE, TS, Tables, as_of, query, r6
from corpuslens.sources import tables as src

PAGE = f"page_location LIKE '%{SITE}%column%' AND regexp_matches(page_location, 'https://www\\.example\\.test/[^/]+/column/[^?#]+')"
SESSION = "user_pseudo_id || '-' || ga_session_id"
METRICS = f"""SELECT page_location, count(*) FILTER (event_name = 'page_view') AS pageviews,
    count(DISTINCT CASE WHEN traffic_medium = 'organic' THEN {SESSION} END) AS organic_sessions,
    count(DISTINCT CASE WHEN coalesce(engagement_time_msec, 0) > 0 THEN {SESSION} END) AS engaged_sessions,
    CAST(sum(coalesce(engagement_time_msec, 0)) AS BIGINT) AS engagement_msec, count(DISTINCT {SESSION}) AS sessions"""
PATH = f"""CASE WHEN regexp_extract(page_location, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 1) = '{SITE}'
    AND contains(trim(regexp_extract(page_location, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/'), '/column/')
    THEN trim(regexp_extract(page_location, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)', 2), '/') || '/' END"""
PM = f"pm AS ({METRICS} FROM v_events WHERE {PAGE} GROUP BY page_location HAVING count(*) FILTER (event_name = 'page_view') >= 1)"
ROLL = f"""roll AS (SELECT path, CAST(sum(pageviews) AS BIGINT) AS pageviews, CAST(sum(organic_sessions) AS BIGINT) AS organic_sessions, CAST(sum(engaged_sessions) AS BIGINT) AS engaged_sessions,
    CAST(sum(engagement_msec) AS BIGINT) AS engagement_msec, CAST(sum(sessions) AS BIGINT) AS sessions FROM (SELECT *, {PATH} AS path FROM pm) WHERE path IS NOT NULL GROUP BY path)"""
KEYS = """keys AS (SELECT c.slug || '/column/' || CASE WHEN trim(link) LIKE '%/' THEN trim(link) ELSE trim(link) || '/' END AS path, min(a.id) AS id, count(*) AS candidates
    FROM v_articles a JOIN v_courses c ON c.id = a.koza_id WHERE c.slug <> '' AND link <> '' GROUP BY 1)"""
NEW = """new AS (SELECT id, pageviews, organic_sessions, engaged_sessions, CASE WHEN sessions > 0 THEN engagement_msec / (sessions * 1000) ELSE 0.0 END AS avg_engagement_time FROM roll JOIN keys USING (path))"""
OLD = "old AS (SELECT id, coalesce(pageviews, 0) AS old_pageviews, coalesce(organic_sessions, 0) AS old_organic, coalesce(engaged_sessions, 0) AS old_engaged, coalesce(avg_engagement_time, 0) AS old_avg FROM v_articles)"
CHANGED = "changed AS (SELECT new.*, old_pageviews FROM new JOIN old USING (id) WHERE pageviews <> old_pageviews OR organic_sessions <> old_organic OR engaged_sessions <> old_engaged OR abs(avg_engagement_time - old_avg) > 0.1)"
ALL = f"WITH {PM}, {ROLL}, {KEYS}, {NEW}, {OLD}, {CHANGED}"


def at(time: str) -> str:
    """SQL of a time as text."""
    return f"strftime({time}, '%Y-%m-%d %H:%M:%S')"


def written(*columns: str) -> dict:
    """Times as text."""
    return {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in columns}


@query("s03_recent_events", f"""SELECT event_id, event_date FROM v_events WHERE event_date IN (SELECT DISTINCT event_date FROM v_events WHERE event_date <= CAST({TS} AS DATE) ORDER BY event_date DESC LIMIT 7)""")
def s03(t: Tables):
    return eng.recent_days(t("v_events"), "2024-01-31").select("event_id", "event_date")


@query("s04_read_table", "SELECT doc_id, lang FROM documents WHERE n_chars > 1000")
def s04(t: Tables):
    return t("documents").where("n_chars > 1000").select("doc_id", "lang")


@query("s05_parameter_query", "SELECT doc_id FROM documents WHERE lang = 'de' AND n_chars >= 500")
def s05(t: Tables):
    docs = t("documents")
    return src.parameter_query(docs.sparkSession, "SELECT doc_id FROM {docs} WHERE lang = :lang AND n_chars >= :least", {"lang": "de", "least": 500}, docs=docs)


@query("s08_table_facts", "SELECT count(*) AS rows, 5 AS columns, true AS has_bytes, true AS in_order FROM documents")
def s08(t: Tables):
    return src.table_facts(t("documents")).select("rows", "columns", (F.col("bytes") > 0).alias("has_bytes"), (F.col("created") <= F.col("modified")).alias("in_order"))


def limit(n: int) -> str:
    return f"CASE WHEN length(text || text || text) > {n} THEN left(text || text || text, {n}) || '...[truncated]' ELSE text || text || text END"


@query("s09_bounded_text", f"SELECT doc_id, {limit(50_000)} AS full_content, {limit(10_000)} AS qanda_content, {limit(5_000)} AS description FROM documents")
def s09(t: Tables):
    from corpuslens.operators.articles import limited

    # three times the text, so that all limits are met
    text = F.concat("text", "text", "text")
    return limited(t("documents").select("doc_id", *[text.alias(c) for c in ("full_content", "qanda_content", "description")]))


@query("p01_event_parameter", "SELECT event_id, page_location AS page, engagement_time_msec AS msec FROM v_events")
def p01(t: Tables):
    entry = lambda k, s, i: F.struct(F.lit(k).alias("key"), F.struct(s.cast("string").alias("string_value"), i.cast("bigint").alias("int_value")).alias("value"))
    null = F.lit(None)
    e = t("v_events").withColumn("event_params", F.array(entry("page_location", F.col("page_location"), null), entry("engagement_time_msec", null, F.col("engagement_time_msec"))))
    return e.select("event_id", eng.parameter("event_params", "page_location", "string_value").alias("page"), eng.parameter("event_params", "engagement_time_msec", "int_value").alias("msec"))


@query("p02_article_pages", f"SELECT event_id, page_location FROM v_events WHERE {PAGE}")
def p02(t: Tables):
    return t("v_events").where(eng.article_page("page_location", SITE)).select("event_id", "page_location")


@query("a01_page_metrics", f"WITH {PM} SELECT * FROM pm")
def a01(t: Tables):
    return eng.page_metrics(t("v_events").where(eng.article_page("page_location", SITE)))


@query("a02_page_metrics_reduced", f"WITH n AS (SELECT * FROM v_events WHERE event_date = (SELECT max(event_date) FROM v_events)) {METRICS} FROM n GROUP BY page_location HAVING count(*) FILTER (event_name = 'page_view') >= 1 ORDER BY pageviews DESC, page_location LIMIT 500")
def a02(t: Tables):
    return eng.page_metrics(eng.recent_days(t("v_events"), "2024-12-31", 1), 500)


@query("a03_view_metrics", "SELECT page_location, count(*) AS pageviews, count(DISTINCT left(page_location, 100)) AS url_variations FROM v_events WHERE event_name = 'page_view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5000")
def a03(t: Tables):
    return eng.view_metrics(t("v_events"))


@query("a04_path_rollup", f"WITH {PM}, {ROLL} SELECT * FROM roll")
def a04(t: Tables):
    return eng.by_path(a01(t), SITE)


@query("a04_path_rollup_exact", f"WITH e AS (SELECT * EXCLUDE (page_location), {PATH} AS page_location FROM v_events) {METRICS.replace('page_location,', 'page_location AS path,')} FROM e WHERE page_location IS NOT NULL GROUP BY page_location HAVING count(*) FILTER (event_name = 'page_view') >= 1")
def a04_exact(t: Tables):
    return eng.exact_by_path(t("v_events"), SITE)


@query("a04_sketched_sessions", f"WITH e AS (SELECT * EXCLUDE (page_location), {PATH} AS page_location FROM v_events) SELECT page_location AS path, count(*) FILTER (event_name = 'page_view') AS pageviews, true AS within FROM e WHERE page_location IS NOT NULL GROUP BY page_location HAVING count(*) FILTER (event_name = 'page_view') >= 1")
def a04_sketched(t: Tables):
    """Sessions of all days united from sketches of single days, and whether they are within 5 % and 3 of the exact ones."""
    e = t("v_events")
    exact = eng.exact_by_path(e, SITE).select("path", *[F.col(m).alias(f"exact_{m}") for m in eng.METRICS])
    both = eng.from_sketches(eng.page_day_sketches(e, SITE)).join(exact, "path")
    near = [F.abs(F.col(m) - F.col(f"exact_{m}")) <= 3 + 0.05 * F.col(f"exact_{m}") for m in ("sessions", "organic_sessions", "engaged_sessions")]
    return both.select("path", "pageviews", (near[0] & near[1] & near[2] & (F.col("engagement_msec") == F.col("exact_engagement_msec"))).alias("within"))


@query("a05_changed_metrics", f"{ALL} SELECT id, pageviews, organic_sessions, engaged_sessions, round(avg_engagement_time, 6) AS avg_engagement_time FROM changed")
def a05(t: Tables):
    return eng.article_updates(t("v_events"), t("v_courses"), t("v_articles"), SITE).select("id", "pageviews", "organic_sessions", "engaged_sessions", F.round("avg_engagement_time", 6).alias("avg_engagement_time"))


@query("a06_update_summary", f"{ALL} SELECT CAST(sum(old_pageviews) AS BIGINT) AS old_total, CAST(sum(pageviews) AS BIGINT) AS new_total, CAST(sum(pageviews) - sum(old_pageviews) AS BIGINT) AS difference FROM changed")
def a06(t: Tables):
    return eng.update_summary(eng.article_updates(t("v_events"), t("v_courses"), t("v_articles"), SITE))


@query("a07_course_totals", "SELECT c.id, c.slug, c.name, count(a.id) AS total_articles, CAST(coalesce(sum(coalesce(a.pageviews, 0)), 0) AS BIGINT) AS total_pageviews FROM v_courses c LEFT JOIN v_articles a ON a.koza_id = c.id GROUP BY ALL")
def a07(t: Tables):
    return eng.course_totals(t("v_courses"), t("v_articles"))


@query("j02_url_key_map", f"WITH {KEYS} SELECT * FROM keys")
def j02(t: Tables):
    return eng.key_map(t("v_courses"), t("v_articles"))


@query("j04_metrics_to_articles", f"WITH {PM}, {ROLL}, {KEYS} SELECT id, path, pageviews, sessions FROM roll JOIN keys USING (path)")
def j04(t: Tables):
    return a04(t).join(j02(t), "path").select("id", "path", "pageviews", "sessions")


@query("t09_url_path", f"SELECT event_id, {PATH} AS path FROM v_events")
def t09(t: Tables):
    return t("v_events").select("event_id", eng.url_path(F.col("page_location"), SITE).alias("path"))


@query("t10_link_key", "SELECT id, koza_id || '/column/' || CASE WHEN trim(link) LIKE '%/' THEN trim(link) ELSE trim(link) || '/' END AS key FROM v_articles")
def t10(t: Tables):
    return t("v_articles").select("id", eng.link_key(F.col("koza_id"), F.col("link")).alias("key"))


@query("t11_short_title", "SELECT id, CASE WHEN length(title) > 50 THEN left(title, 50) || '...' ELSE title END AS title FROM v_articles")
def t11(t: Tables):
    return t("v_articles").select("id", eng.short_title(F.col("title")).alias("title"))


@query("u01_union_days", "SELECT event_date, count(*) AS n FROM v_events GROUP BY 1")
def u01(t: Tables):
    e = t("v_events")
    return e.where("event_id % 2 = 0").unionByName(e.where("event_id % 2 = 1")).groupBy("event_date").agg(F.count("*").alias("n"))


@query("z06_metric_sync", f"""{ALL.replace("FROM v_events WHERE", "FROM recent WHERE").replace("WITH pm", "WITH recent AS (SELECT * FROM v_events WHERE event_date IN (SELECT DISTINCT event_date FROM v_events WHERE event_date <= DATE '2024-01-31' ORDER BY event_date DESC LIMIT 7)), pm")}
    SELECT a.id, coalesce(c.pageviews, a.pageviews) AS pageviews, coalesce(c.organic_sessions, a.organic_sessions) AS organic_sessions, coalesce(c.engaged_sessions, a.engaged_sessions) AS engaged_sessions,
           round(coalesce(round(c.avg_engagement_time, 4), a.avg_engagement_time), 6) AS avg_engagement_time FROM v_articles a LEFT JOIN changed c USING (id)""")
def z06(t: Tables):
    from corpuslens.plans.jobs import sync_metrics

    return sync_metrics(t("v_events"), t("v_courses"), t("v_articles"), SITE, "2024-01-31").select("id", "pageviews", "organic_sessions", "engaged_sessions", F.round("avg_engagement_time", 6).alias("avg_engagement_time"))


# table maintenance: orders that are not open as a table, those of all but the lowest priority as changes


def _old_new(t: Tables):
    o = t("orders")
    old = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("slug"), F.col("o_orderpriority").alias("name"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("last_synced"))
    new = o.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("new").alias("slug"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("name"), F.col("o_orderdate").alias("created_at"), as_of().alias("last_synced"))
    return old, new


OLDNEW = f"""o AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS slug, o_orderpriority AS name, o_orderdate AS created_at FROM orders WHERE o_orderstatus <> 'O'),
 n AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'new' AS slug, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS name, o_orderdate AS created_at FROM orders WHERE o_orderpriority <> '5-LOW')"""


@query("d01_merge_courses", f"WITH {OLDNEW} SELECT coalesce(o.id, n.id) AS id, coalesce(n.slug, o.slug) AS slug, CASE WHEN n.id IS NULL THEN o.name ELSE n.name END AS name, CAST(coalesce(o.created_at, n.created_at) AS DATE) AS created_on FROM o FULL JOIN n ON o.id = n.id")
def d01(t: Tables):
    old, new = _old_new(t)
    return merge.merge(old, merge.unique(new, "id"), "id", merge.COURSE_RULES).select("id", "slug", "name", F.col("created_at").cast("date").alias("created_on"))


@query("d02_merge_articles", """WITH o AS (SELECT * FROM v_articles), n AS (SELECT id, 'T' AS title, CASE WHEN pageviews % 2 = 0 THEN pageviews + 1 END AS pageviews, CASE WHEN pageviews % 3 = 0 THEN content_embedding END AS v FROM v_articles WHERE pageviews IS NOT NULL)
    SELECT o.id, coalesce(n.title, o.title) AS title, coalesce(n.pageviews, o.pageviews) AS pageviews, coalesce(len(coalesce(n.v, o.content_embedding)), 0) AS dims FROM o LEFT JOIN n USING (id)""")
def d02(t: Tables):
    a = t("v_articles").select("id", "title", "pageviews", "content_embedding")
    new = a.where("pageviews IS NOT NULL").select("id", F.lit("T").alias("title"), F.when(F.col("pageviews") % 2 == 0, F.col("pageviews") + 1).alias("pageviews"), F.when(F.col("pageviews") % 3 == 0, F.col("content_embedding")).alias("content_embedding"))
    return merge.merge(a, new, "id", merge.ARTICLE_RULES).select("id", "title", "pageviews", F.coalesce(F.size("content_embedding"), F.lit(0)).cast("bigint").alias("dims"))


@query("d03_split_new", f"WITH {OLDNEW} SELECT id, id NOT IN (SELECT id FROM o) AS fresh FROM n")
def d03(t: Tables):
    old, new = _old_new(t)
    fresh, known = merge.split_new(new, old, "id")
    return fresh.select("id", F.lit(True).alias("fresh")).union(known.select("id", F.lit(False)))


@query("d04_replace_keys", f"WITH {OLDNEW} SELECT id, slug FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT id, slug FROM n")
def d04(t: Tables):
    old, new = _old_new(t)
    return merge.replace_keys(old, new, "id").select("id", "slug")


@query("d05_check_merge", f"WITH {OLDNEW} SELECT (SELECT count(*) FROM n) AS in_batch, (SELECT count(*) FROM n) AS recently_synced")
def d05(t: Tables):
    old, new = _old_new(t)
    merged = merge.merge(old.withColumn("last_synced", F.col("last_synced").cast("timestamp")), new, "id", merge.COURSE_RULES)
    return merge.check_merge(merged.where(F.col("last_synced") <= as_of()), new, "id", as_of())


@query("d06_bulk_update", f"""{ALL} SELECT a.id, coalesce(c.pageviews, a.pageviews) AS pageviews, round(coalesce(round(c.avg_engagement_time, 4), a.avg_engagement_time), 6) AS avg_engagement_time FROM v_articles a LEFT JOIN changed c USING (id)""")
def d06(t: Tables):
    return eng.apply_updates(t("v_articles"), eng.article_updates(t("v_events"), t("v_courses"), t("v_articles"), SITE)).select("id", "pageviews", F.round("avg_engagement_time", 6).alias("avg_engagement_time"))


@query("d07_set_vectors", "SELECT id, CASE WHEN pageviews > 10 THEN 'm2' ELSE 'm1' END AS embedding_model FROM v_articles")
def d07(t: Tables):
    a = t("v_articles").select("id", "pageviews", F.lit("m1").alias("embedding_model"))
    return merge.set_values(a, a.where("pageviews > 10").select("id", F.lit("m2").alias("embedding_model")), "id").select("id", "embedding_model")


@query("d08_purge_expired", "SELECT base_article_id, similar_article_id FROM v_cache WHERE expires_at >= TIMESTAMP '2024-01-15 00:00:00'")
def d08(t: Tables):
    return merge.unexpired(t("v_cache"), F.lit("2024-01-15 00:00:00").cast("timestamp")).select("base_article_id", "similar_article_id")


@query("d09_normalised_cache", f"SELECT base_article_id, similar_article_id, similarity_score, 0.8::DOUBLE AS confidence_score, CAST(0 AS BIGINT) AS traffic_impact_prediction, 'MONITOR' AS recommendation_type, repeat('x', 500) AS explanation_text, {at('cached_at')} AS cached_at, {at('expires_at')} AS expires_at FROM v_cache")
def d09(t: Tables):
    rows = t("v_cache").withColumns({"confidence_score": F.lit(None).cast("double"), "traffic_impact_prediction": F.lit(None).cast("bigint"), "recommendation_type": F.lit(None).cast("string"), "explanation_text": F.repeat(F.lit("x"), F.lit(700))})
    return merge.normalised_cache(rows).withColumns(written("cached_at", "expires_at"))


STATUS = """WITH a AS (SELECT CAST(o_orderkey AS VARCHAR) AS proposal_id, CASE WHEN l_linenumber % 2 = 0 THEN 'approved' ELSE 'rejected' END AS status, l_linenumber AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'),
    b AS (SELECT proposal_id, status FROM a QUALIFY row_number() OVER (PARTITION BY proposal_id ORDER BY n DESC, status) = 1)
    SELECT p.proposal_id, coalesce(b.status, p.status) AS status FROM v_proposals p LEFT JOIN b USING (proposal_id)"""


@query("d10_proposal_actions", STATUS)
def d10(t: Tables):
    o = t("orders").where("o_orderpriority = '1-URGENT'").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    actions = o.select(F.col("o_orderkey").cast("string").alias("proposal_id"), F.when(F.col("l_linenumber") % 2 == 0, "approved").otherwise("rejected").alias("status"), F.timestamp_seconds(F.col("l_linenumber")).alias("at"))
    p = t("v_proposals").withColumn("updated_at", F.col("created_at").cast("timestamp"))
    return merge.apply_status(p, actions, "proposal_id").select("proposal_id", "status")


@query("d11_group_actions", STATUS.replace("'approved' ELSE 'rejected'", "'executed' ELSE 'pending'").replace("p.proposal_id,", "p.proposal_id AS group_id,"))
def d11(t: Tables):
    o = t("orders").where("o_orderpriority = '1-URGENT'").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    actions = o.select(F.col("o_orderkey").cast("string").alias("group_id"), F.when(F.col("l_linenumber") % 2 == 0, "executed").otherwise("pending").alias("status"), F.timestamp_seconds(F.col("l_linenumber")).alias("at"))
    g = t("v_proposals").withColumnRenamed("proposal_id", "group_id").withColumn("updated_at", F.col("created_at").cast("timestamp"))
    return merge.apply_status(g, actions, "group_id").select("group_id", "status")


# statistics

HAS = "coalesce(len(content_embedding), 0) > 0"


def pct(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN round({a} / {b} * 100, 2) ELSE 0.0 END"


@query("a08_corpus_stats", f"SELECT count(*) AS total, count(*) FILTER ({HAS}) AS with_vector, count(*) FILTER (NOT {HAS}) AS without_vector, count(*) FILTER (length(full_content) > 0) AS with_content, count(*) FILTER (NOT length(full_content) > 0) AS without_content, round(avg(coalesce(pageviews, 0)), 6) AS avg_pageviews, {at('max(updated_at)')} AS last_updated, {pct(f'count(*) FILTER ({HAS})', 'count(*)')} AS coverage FROM v_articles")
def a08(t: Tables):
    return stats.corpus(t("v_articles")).withColumns(r6("avg_pageviews") | written("last_updated"))


@query("a09_stats_by_course", f"SELECT koza_id, coalesce(c.name, '講座' || koza_id) AS name, count(*) AS articles, count(*) FILTER ({HAS}) AS vectors, {pct(f'count(*) FILTER ({HAS})', 'count(*)')} AS coverage FROM v_articles a LEFT JOIN v_courses c ON c.id = koza_id AND c.id <> 'src1' GROUP BY 1, 2")
def a09(t: Tables):
    return stats.by_course(t("v_articles"), t("v_courses").where("id <> 'src1'"))


@query("a10_courses_with_articles", "SELECT c.id, slug, name, count(a.id) AS articles FROM v_courses c LEFT JOIN v_articles a ON a.koza_id = c.id AND a.pageviews > 5 GROUP BY ALL HAVING count(a.id) >= 1")
def a10(t: Tables):
    return stats.courses_with_articles(t("v_courses"), t("v_articles").where("pageviews > 5"))


@query("a11_course_list", f"SELECT c.id, slug, name, count(a.id) AS articles, CAST(coalesce(sum(coalesce(pageviews, 0)), 0) AS BIGINT) AS pageviews, round(avg(pageviews), 6) AS avg_pageviews, count(*) FILTER ({HAS}) AS vectors, round(count(*) FILTER ({HAS}) / greatest(count(a.id), 1), 4) AS vector_rate, round(count(*) FILTER (length(full_content) > 0) / greatest(count(a.id), 1), 4) AS text_rate FROM v_courses c LEFT JOIN v_articles a ON a.koza_id = c.id GROUP BY ALL")
def a11(t: Tables):
    return stats.course_list(t("v_courses"), t("v_articles")).withColumns(r6("avg_pageviews")).drop("last_updated")


@query("a12_one_course", f"SELECT koza_id, count(*) AS articles, round(avg(pageviews), 6) AS avg_pageviews, CAST(sum(pageviews) AS BIGINT) AS pageviews, count(*) FILTER ({HAS}) AS vectors, round(avg(len(list_filter(string_split_regex(full_content, '\\s+'), lambda w: w <> ''))), 6) AS avg_words, {at('min(created_at)')} AS first_created, {at('max(created_at)')} AS last_created FROM v_articles GROUP BY 1")
def a12(t: Tables):
    return stats.one_course(t("v_articles")).withColumns(r6("avg_pageviews", "avg_words") | written("first_created", "last_created"))


@query("a13_views_likes", "SELECT koza_id, count(*) AS articles, CAST(sum(pageviews) AS BIGINT) AS views, CAST(sum(engaged_sessions) AS BIGINT) AS likes FROM v_articles WHERE content_type = 'en' GROUP BY 1")
def a13(t: Tables):
    from corpuslens.operators.search import published

    a = t("v_articles").withColumns({"status": F.when(F.col("content_type") == "en", "published").otherwise("draft"), "view_count": F.col("pageviews"), "like_count": F.col("engaged_sessions")})
    return stats.views_and_likes(published(a))


@query("a14_search_stats", "SELECT count(*) AS articles, count(DISTINCT koza_id) AS courses, CAST(sum(pageviews) AS BIGINT) AS pageviews, round(avg(pageviews), 2) AS avg_pageviews, max(pageviews) AS max_pageviews, min(pageviews) AS min_pageviews, max(engaged_sessions) AS max_engaged FROM v_articles")
def a14(t: Tables):
    return stats.search_stats(t("v_articles"))


@query("a15_chunk_stats", "SELECT count(*) AS chunks, count(DISTINCT article_id) AS articles, round(avg(length(chunk_title)), 6) AS avg_length, min(length(chunk_title)) AS min_length, max(length(chunk_title)) AS max_length, count(*) AS vectors, 100.0::DOUBLE AS coverage, round(avg(chunk_index), 6) AS avg_chunk_index, round(count(*) / count(DISTINCT article_id), 6) AS chunks_per_article FROM v_chunks")
def a15(t: Tables):
    return stats.chunk_stats(t("v_chunks"), "chunk_title").withColumns(r6("avg_length", "avg_chunk_index", "chunks_per_article"))


MID = "TIMESTAMP '2024-01-15 00:00:00'"


@query("a21_cache_stats", f"SELECT count(*) AS entries, count(DISTINCT base_article_id) AS bases, round(avg(similarity_score), 6) AS avg_score, {at('min(cached_at)')} AS oldest, {at('max(cached_at)')} AS newest, count(*) FILTER (expires_at > {MID}) AS valid, count(*) FILTER (NOT expires_at > {MID}) AS expired FROM v_cache")
def a21(t: Tables):
    return stats.cache_stats(t("v_cache"), F.lit("2024-01-15 00:00:00").cast("timestamp")).withColumns(r6("avg_score") | written("oldest", "newest"))


CACHED = "CASE WHEN similarity_score >= 0.8 THEN 'MERGE_CONTENT' WHEN similarity_score >= 0.6 THEN 'REDIRECT_301' WHEN similarity_score >= 0.4 THEN 'CROSS_LINK' ELSE 'MONITOR' END"


@query("a22_cache_actions", f"SELECT count(*) AS entries, round(min(similarity_score), 6) AS min_score, round(max(similarity_score), 6) AS max_score, count(*) FILTER ({CACHED} = 'MERGE_CONTENT') AS merge_content, count(*) FILTER ({CACHED} = 'REDIRECT_301') AS redirect_301, count(*) FILTER ({CACHED} = 'CROSS_LINK') AS cross_link, count(*) FILTER ({CACHED} = 'MONITOR') AS monitor, floor(count(*) FILTER (expires_at > {MID}) / count(DISTINCT base_article_id) * 100 + 0.5) / 100 AS coverage FROM v_cache")
def a22(t: Tables):
    from corpuslens.operators.recommend import cached

    return stats.cache_actions(t("v_cache"), F.lit("2024-01-15 00:00:00").cast("timestamp"), cached(F.col("similarity_score"))).withColumns(r6("min_score", "max_score"))


USAGE = f"SELECT provider, count(*) AS requests, round(avg(response_time_ms), 6) AS avg_ms, round(sum(cost_estimate), 6) AS cost, count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures FROM v_usage WHERE log_ts >= {TS} - INTERVAL 7 DAYS GROUP BY 1"


@query("a23_provider_usage", USAGE)
def a23(t: Tables):
    from corpuslens.operators.search import since

    return stats.provider_usage(t("v_usage").where(since("log_ts", as_of(), "7d"))).withColumns(r6("avg_ms", "cost"))


@query("a24_provider_comparison", f"SELECT provider, count(*) AS requests, round(avg(response_time_ms), 6) AS avg_ms, min(response_time_ms) AS min_ms, max(response_time_ms) AS max_ms, quantile_disc(response_time_ms, 0.95) AS p95_ms, round(avg(cost_estimate), 6) AS avg_cost, round(sum(cost_estimate), 6) AS cost, {pct('count(*) FILTER (success)', 'count(*)')} AS success_rate FROM v_usage GROUP BY 1")
def a24(t: Tables):
    return stats.provider_comparison(t("v_usage")).withColumns(r6("avg_ms", "avg_cost", "cost"))


@query("a25_cost_savings", "SELECT count(*) * 50.0E0 AS full_cost, sum(cost_estimate) FILTER (provider = 'hosted') AS dear_cost, sum(cost_estimate) FILTER (provider = 'local') AS cheap_cost, count(*) * 50.0E0 - sum(cost_estimate) AS savings, round((count(*) * 50.0E0 - sum(cost_estimate)) / (count(*) * 50.0E0) * 100, 2) AS savings_percent FROM v_usage")
def a25(t: Tables):
    return stats.cost_savings(t("v_usage"))


@query("a26_monitoring_summary", "SELECT CAST(sum(n) AS BIGINT) AS requests, round(sum(c), 6) AS cost, round(avg(m), 6) AS avg_ms, count(*) AS providers FROM (SELECT provider, count(*) AS n, sum(cost_estimate) AS c, avg(response_time_ms) AS m FROM v_usage GROUP BY 1)")
def a26(t: Tables):
    return stats.monitoring_summary(t("v_usage")).withColumns(r6("cost", "avg_ms"))


@query("a27_proposals_by_status", "SELECT status, count(*) AS n, CAST(sum(len(article_ids)) AS BIGINT) AS articles FROM v_proposals GROUP BY 1")
def a27(t: Tables):
    return stats.proposals_by_status(t("v_proposals"))


@query("a27_active_groups", "SELECT count(*) AS active_groups, CAST(sum(len(article_ids)) AS BIGINT) AS articles FROM v_proposals WHERE status = 'approved'")
def a27_groups(t: Tables):
    groups = t("v_proposals").withColumn("status", F.when(F.col("status") == "approved", "active").otherwise(F.col("status")))
    return stats.active_groups(groups)


@query("a28_run_by_field", f"SELECT content_type AS field_type, count(*) AS n, count(*) FILTER ({HAS}) AS successes FROM v_articles GROUP BY 1")
def a28(t: Tables):
    from corpuslens.operators.vectors import has_vector

    return stats.run_by_field(t("v_articles"), "content_type", has_vector(F.col("content_embedding")))


@query("a30_provider_recency", f"SELECT provider, CASE WHEN max(log_ts) > {TS} - INTERVAL 1 HOUR THEN 'active' WHEN max(log_ts) > {TS} - INTERVAL 24 HOURS THEN 'idle' ELSE 'inactive' END AS state FROM v_usage GROUP BY 1")
def a30(t: Tables):
    return stats.provider_recency(t("v_usage"), as_of()).select("provider", "state")


@query("p13_time_range", f"SELECT session_id, log_ts FROM v_usage WHERE log_ts >= {TS} - INTERVAL 24 HOURS")
def p13(t: Tables):
    from corpuslens.operators.search import since

    return t("v_usage").where(since("log_ts", as_of(), "no such range")).select("session_id", "log_ts")
