"""Queries of similarities, scores, actions and groups."""

from pyspark.sql import functions as F

from corpuslens.operators import grouping, recommend, scoring, stats, vectors
from corpuslens.plans import jobs
from corpuslens.queries import TS, Tables, as_of, query, r6
from corpuslens.runtime import materialise

D = "CAST({} AS DOUBLE[])"
COS = f"list_cosine_similarity({D.format('a.content_embedding')}, {D.format('b.content_embedding')})"
MATCHES = f"""m AS (SELECT a.chunk_id AS base_chunk_id, b.chunk_id AS similar_chunk_id, a.article_id AS base_article, b.article_id AS similar_article, a.chunk_index AS base_index, a.chunk_title AS base_title, {COS} AS similarity
    FROM v_chunks a JOIN v_chunks b ON a.article_id <> b.article_id WHERE {COS} >= 0.2 QUALIFY row_number() OVER (PARTITION BY a.chunk_id ORDER BY {COS} DESC, b.chunk_id) <= 10)"""
PAIRS = f"""{MATCHES}, t AS (SELECT article_id, count(*) AS chunks FROM v_chunks GROUP BY 1),
 p AS (SELECT base_article, similar_article, avg(similarity) AS avg_similarity, max(similarity) AS max_similarity, count(DISTINCT base_chunk_id) AS base_chunks, count(DISTINCT similar_chunk_id) AS similar_chunks,
       list({{'m': -similarity, 'b': base_chunk_id, 's': similar_chunk_id, 'i': base_index, 't': base_title}} ORDER BY -similarity, base_chunk_id, similar_chunk_id)[1:10] AS matches FROM m GROUP BY 1, 2),
 q AS (SELECT p.*, x.chunks AS base_total, y.chunks AS similar_total, least(base_chunks, similar_chunks) / least(x.chunks, y.chunks) AS matching_ratio FROM p JOIN t x ON x.article_id = base_article JOIN t y ON y.article_id = similar_article),
 r AS (SELECT *, least(avg_similarity * 0.70 + matching_ratio * 0.30, 1.0) AS blended FROM q)"""


def of_chunks(t: Tables):
    return jobs.chunk_matches(t("v_chunks"), None, 0.2, 10)


def pairs(t: Tables):
    totals = t("v_chunks").groupBy("article_id").agg(F.count_if(vectors.has_vector(F.col("content_embedding"))).alias("chunks"))
    return scoring.article_pairs(of_chunks(t), totals, 10)


#: Every article whose id is divisible by 50, against all.
NEAR = f"SELECT a.id AS base_id, b.id, b.koza_id, {COS} AS similarity FROM v_articles a JOIN v_articles b ON a.id <> b.id WHERE CAST(a.id AS INTEGER) % 50 = 0 AND a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL"
BEST = "row_number() OVER (PARTITION BY base_id ORDER BY similarity DESC, id)"
SIM = "round(similarity, 6) AS similarity"


def bases(articles):
    return articles.where("CAST(id AS INT) % 50 = 0")


def near(t: Tables):
    a = t("v_articles")
    return vectors.nearest_to(bases(a), a, columns=[])


def moments(t: Tables):
    a = t("v_articles")
    return vectors.similarity_stats(a, "koza_id", base=bases(a))


@query("v01_cosine", f"SELECT a.chunk_id AS a, b.chunk_id AS b, round({COS}, 6) AS similarity FROM v_chunks a JOIN v_chunks b ON b.article_id = a.article_id AND b.chunk_index = a.chunk_index + 1")
def v01(t: Tables):
    c = t("v_chunks")
    n = c.select("article_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("chunk_id").alias("b"), F.col("content_embedding").alias("y"))
    return c.join(n, ["article_id", "chunk_index"]).select(F.col("chunk_id").alias("a"), "b", F.round(vectors.cosine(F.col("content_embedding"), F.col("y")), 6).alias("similarity"))


@query("v02_cosine_distance", f"SELECT base_id, id, round(1 - similarity, 6) AS distance FROM ({NEAR})")
def v02(t: Tables):
    return near(t).select("base_id", "id", F.round(1 - F.col("similarity"), 6).alias("distance"))


@query("v03_zero_vectors", f"SELECT base_id, id, round(similarity, 6) AS similarity FROM ({NEAR}) WHERE CAST(id AS INTEGER) % 3 <> 1 AND CAST(base_id AS INTEGER) % 3 <> 1")
def v03(t: Tables):
    a = t("v_articles").withColumn("content_embedding", F.when(F.col("id").cast("int") % 3 == 1, F.transform("content_embedding", lambda v: v * 0)).otherwise(F.col("content_embedding")))
    return vectors.nearest_to(bases(a), a, columns=[]).select("base_id", "id", F.round("similarity", 6).alias("similarity"))


@query("v04_similarity_join", f"SELECT a.id AS base_id, b.id AS similar_id, round({COS}, 6) AS similarity FROM v_articles a JOIN v_articles b ON a.id <> b.id WHERE a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL AND {COS} >= 0.3")
def v04(t: Tables):
    return vectors.similarity_join(t("v_articles"), 0.3, block_rows=300).withColumns(r6("similarity"))


@query("v05_lsh_join")
def v05(t: Tables):
    return vectors.lsh_candidates(t("v_articles"), 0.4).withColumns(r6("similarity"))


@query("v06_confidence", "SELECT base_article_id, similar_article_id, CASE WHEN similarity_score >= 0.8 THEN 0.95 WHEN similarity_score >= 0.6 THEN 0.85 WHEN similarity_score >= 0.4 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM v_cache")
def v06(t: Tables):
    return t("v_cache").select("base_article_id", "similar_article_id", vectors.confidence(F.col("similarity_score")).alias("confidence"))


@query("v07_embed", "SELECT id, text IS NULL OR trim(text, chr(10) || ' ') = '' AS none, CASE WHEN NOT (text IS NULL OR trim(text, chr(10) || ' ') = '') THEN 1.0::DOUBLE END AS length FROM (SELECT id, CASE WHEN CAST(id AS INTEGER) % 7 <> 0 THEN full_content END AS text FROM v_articles)")
def v07(t: Tables):
    rows = t("v_articles").select("id", F.when(F.col("id").cast("int") % 7 != 0, F.col("full_content")).alias("text"))
    return vectors.embed(rows, "text", dims=32).select("id", F.col("content_embedding").isNull().alias("none"), F.round(vectors.norm(F.col("content_embedding")), 6).alias("length"))


@query("j05_query_vector", f"SELECT base_id, id, {SIM} FROM ({NEAR})")
def j05(t: Tables):
    return near(t).select("base_id", "id", F.round("similarity", 6).alias("similarity"))


@query("j06_chunk_matches", f"SELECT a.chunk_id AS base_id, b.chunk_id AS similar_id, round({COS}, 6) AS similarity FROM v_chunks a JOIN v_chunks b ON a.article_id <> b.article_id WHERE {COS} >= 0.2")
def j06(t: Tables):
    return vectors.similarity_join(t("v_chunks"), 0.2, None, "chunk_id", "article_id").withColumns(r6("similarity"))


@query("j07_zip_product", f"SELECT a.chunk_id, round(list_dot_product({D.format('a.content_embedding')}, {D.format('a.content_embedding')}), 5) AS squared FROM v_chunks a")
def j07(t: Tables):
    return t("v_chunks").select("chunk_id", F.round(vectors.dot(F.col("content_embedding"), F.col("content_embedding")), 5).alias("squared"))


@query("j08_pair_list", f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS similarity FROM v_articles a JOIN v_articles b ON CAST(b.id AS INTEGER) = CAST(a.id AS INTEGER) + 3 WHERE a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL")
def j08(t: Tables):
    a = t("v_articles")
    return vectors.pair_similarity(a.select(F.col("id").alias("a"), (F.col("id").cast("int") + 3).cast("string").alias("b")), a, "a", "b").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("j09_batch_pairs", f"SELECT a.id AS base, b.id AS target, round({COS}, 6) AS similarity, CASE WHEN {COS} >= 0.8 THEN 0.95 WHEN {COS} >= 0.6 THEN 0.85 WHEN {COS} >= 0.4 THEN 0.75 ELSE 0.65 END::DOUBLE AS confidence FROM v_cache JOIN v_articles a ON a.id = base_article_id JOIN v_articles b ON b.id = similar_article_id WHERE a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL")
def j09(t: Tables):
    p = t("v_cache").select(F.col("base_article_id").alias("base"), F.col("similar_article_id").alias("target"))
    return vectors.pair_similarity(p, t("v_articles"), "base", "target").select("base", "target", F.round("similarity", 6).alias("similarity"), vectors.confidence(F.col("similarity")).alias("confidence"))


@query("w01_ranked_matches", f"WITH {MATCHES} SELECT base_chunk_id, similar_chunk_id, {SIM} FROM m")
def w01(t: Tables):
    return of_chunks(t).select("base_chunk_id", "similar_chunk_id", F.round("similarity", 6).alias("similarity"))


@query("w03_longest_run", f"WITH {MATCHES}, d AS (SELECT base_article, similar_article, base_index AS i, row_number() OVER (PARTITION BY base_article, similar_article ORDER BY base_index) AS n FROM (SELECT DISTINCT base_article, similar_article, base_index FROM m)) SELECT base_article, similar_article, max(c) AS run FROM (SELECT base_article, similar_article, count(*) AS c FROM d GROUP BY base_article, similar_article, i - n) GROUP BY 1, 2")
def w03(t: Tables):
    return of_chunks(t).groupBy("base_article", "similar_article").agg(scoring.longest_run(F.collect_set("base_index")).cast("bigint").alias("run"))


@query("w04_top_per_base", f"SELECT a.id AS base_id, b.id AS similar_id, round({COS}, 6) AS similarity FROM v_articles a JOIN v_articles b ON a.id <> b.id WHERE a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL AND {COS} >= 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) <= 5")
def w04(t: Tables):
    return vectors.similarity_join(t("v_articles"), 0.0, 5).drop("rank").withColumns(r6("similarity"))


@query("a16_neighbour_stats", f"SELECT base_id, count(*) AS n, round(avg(similarity), 6) AS avg, round(stddev_samp(similarity), 6) AS stddev, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max FROM ({NEAR}) GROUP BY 1")
def a16(t: Tables):
    return stats.neighbour_stats(moments(t)).withColumns(r6("avg", "stddev", "min", "max"))


@query("a17_similarity_by_course", f"SELECT base_id, koza_id, count(*) AS n, round(avg(similarity), 6) AS avg, round(max(similarity), 6) AS max FROM ({NEAR}) GROUP BY 1, 2")
def a17(t: Tables):
    return stats.similarity_by_course(moments(t)).withColumns(r6("avg", "max"))


@query("a18_article_pairs", f"WITH {PAIRS} SELECT base_article, similar_article, round(avg_similarity, 6) AS avg_similarity, round(max_similarity, 6) AS max_similarity, base_chunks, similar_chunks, len(matches) AS n_matches FROM r")
def a18(t: Tables):
    return pairs(t).select("base_article", "similar_article", F.round("avg_similarity", 6).alias("avg_similarity"), F.round("max_similarity", 6).alias("max_similarity"), "base_chunks", "similar_chunks", F.size("matches").cast("bigint").alias("n_matches"))


@query("a19_matching_ratio", f"WITH {PAIRS} SELECT base_article, similar_article, round(matching_ratio, 6) AS matching_ratio FROM r")
def a19(t: Tables):
    return pairs(t).select("base_article", "similar_article", F.round("matching_ratio", 6).alias("matching_ratio"))


@query("a20_blended_score", f"WITH {PAIRS} SELECT base_article, similar_article, round(blended, 6) AS blended FROM r")
def a20(t: Tables):
    return pairs(t).select("base_article", "similar_article", F.round("blended", 6).alias("blended"))


WEIGHT = """CASE WHEN coalesce({t}, '') = '' THEN 1.0 WHEN contains({t}, 'タイトル') OR contains(lower({t}), 'title') OR {i} = 0 THEN 5.0 WHEN contains({t}, '概要') OR {i} = 1 THEN 3.0
    WHEN contains({t}, 'まとめ') OR {i} = {n} - 1 THEN 2.0 WHEN contains({t}, '参考') THEN 0.5 ELSE 1.0 END"""


@query("r01_chunk_weight", f"SELECT chunk_id, CAST({WEIGHT.format(t='chunk_title', i='chunk_index', n='n')} AS DOUBLE) AS weight FROM (SELECT *, count(*) OVER (PARTITION BY article_id) AS n FROM v_chunks)")
def r01(t: Tables):
    c = t("v_chunks")
    n = c.groupBy("article_id").agg(F.count("*").alias("n"))
    return c.join(n, "article_id").select("chunk_id", scoring.chunk_weight(F.col("chunk_title"), F.col("chunk_index"), F.col("n")).alias("weight"))


WR = f"least(list_sum(list_transform(matches, lambda x: {WEIGHT.format(t='x.t', i='x.i', n='base_total')})) / least(base_total, similar_total), 1.0)"
RUN = "list_reduce(list_transform(list_sort(list_transform(matches, lambda x: x.i)), lambda v: {'last': v, 'run': 1, 'best': 1}), lambda s, v: {'last': v.last, 'run': CASE WHEN v.last = s.last + 1 THEN s.run + 1 ELSE 1 END, 'best': greatest(s.best, CASE WHEN v.last = s.last + 1 THEN s.run + 1 ELSE 1 END)}).best"
BONUS = f"CASE WHEN {RUN} >= 5 THEN 0.15 WHEN {RUN} = 4 THEN 0.12 WHEN {RUN} = 3 THEN 0.09 WHEN {RUN} = 2 THEN 0.05 ELSE 0.0 END"


@query("r02_weighted_ratio", f"WITH {PAIRS} SELECT base_article, similar_article, round({WR}, 6) AS weighted_ratio FROM r")
def r02(t: Tables):
    return pairs(t).select("base_article", "similar_article", F.round(scoring.weighted_ratio(F.col("matches"), F.col("base_total"), F.col("similar_total")), 6).alias("weighted_ratio"))


@query("r03_run_bonus", f"WITH {PAIRS} SELECT base_article, similar_article, CAST({BONUS} AS DOUBLE) AS bonus FROM r")
def r03(t: Tables):
    return pairs(t).select("base_article", "similar_article", scoring.run_bonus(scoring.longest_run(F.transform("matches", lambda m: m["base_index"]))).alias("bonus"))


def near_in_time(c: str) -> str:
    return f"coalesce(abs(epoch_us(CAST(x.{c} AS TIMESTAMP)) - epoch_us(CAST(y.{c} AS TIMESTAMP))) <= 2592000000000, false)"


WORDS = "list_distinct(string_split_regex(nullif({}.title, ''), '\\s+'))"
OVER = f"len(list_intersect({WORDS.format('x')}, {WORDS.format('y')})) / greatest(len({WORDS.format('x')}), len({WORDS.format('y')}))"
META = f"""least(CASE WHEN x.koza_id IS NOT DISTINCT FROM y.koza_id THEN 0.05 ELSE 0.0 END + CASE WHEN {near_in_time('created_at')} THEN 0.03 ELSE 0.0 END + CASE WHEN {near_in_time('updated_at')} THEN 0.02 ELSE 0.0 END
    + coalesce(least(len(list_intersect(x.search_keywords, y.search_keywords)) * 0.01, 0.05), 0.0) + coalesce({OVER}, 0.0) * 0.05, 0.20)"""
PAIR = "FROM v_articles x JOIN v_articles y ON CAST(y.id AS INTEGER) = CAST(x.id AS INTEGER) + 3"


def shifted(t: Tables):
    a = t("v_articles")
    sides = lambda s: a.select(F.col("id").alias(f"{s}_article"), F.struct("id", "title", "koza_id", "pageviews", "organic_sessions", "avg_engagement_time", "created_at", "updated_at", "search_keywords", "full_content").alias(s))
    return sides("base").withColumn("similar_article", (F.col("base_article").cast("int") + 3).cast("string")).join(sides("similar"), "similar_article")


@query("r04_metadata_bonus", f"SELECT x.id AS base, y.id AS similar, round({META}, 6) AS bonus {PAIR}")
def r04(t: Tables):
    return shifted(t).select(F.col("base_article").alias("base"), F.col("similar_article").alias("similar"), F.round(scoring.metadata_bonus(), 6).alias("bonus"))


@query("t27_days_within", f"SELECT x.id, {near_in_time('created_at')} AS near {PAIR}")
def t27(t: Tables):
    return shifted(t).select(F.col("base_article").alias("id"), scoring.days_within(F.col("base.created_at"), F.col("similar.created_at")).alias("near"))


@query("t28_title_overlap", f"SELECT x.id, round({OVER}, 6) AS overlap {PAIR}")
def t28(t: Tables):
    return shifted(t).select(F.col("base_article").alias("id"), F.round(scoring.title_overlap(F.nullif(F.col("base.title"), F.lit("")), F.nullif(F.col("similar.title"), F.lit(""))), 6).alias("overlap"))


SCORED = f"""{PAIRS}, z AS (SELECT r.*, x.koza_id = y.koza_id AS same, x.pageviews AS bv, y.pageviews AS sv, least(avg_similarity * 0.60 + {WR} * 0.25 + {BONUS} + least({META} * 0.5, 0.05), 1.0) AS score
    FROM r JOIN v_articles x ON x.id = base_article JOIN v_articles y ON y.id = similar_article WHERE y.pageviews >= 0)"""


def ladder(s: str, r: str, same: str) -> str:
    return f"""CASE WHEN {s} >= 0.95 AND {r} >= 0.5 THEN 'MERGE_CONTENT 100' WHEN {s} >= 0.92 AND {r} >= 0.3 AND {same} THEN 'MERGE_CONTENT 90' WHEN {s} >= 0.90 THEN 'REDIRECT_301 85' WHEN {s} >= 0.88 AND {r} >= 0.2 AND {same} THEN 'REDIRECT_301 80'
    WHEN {s} >= 0.85 AND {same} THEN 'REDIRECT_301 70' WHEN {s} >= 0.75 OR ({s} >= 0.70 AND {r} >= 0.15) THEN 'CROSS_LINK 60' WHEN {s} >= 0.65 AND {same} AND {r} <= 0.1 AND {r} > 0 THEN 'REVIEW 50'
    WHEN {s} >= 0.65 AND NOT {same} AND {r} <= 0.15 AND {r} > 0 THEN 'REVIEW 45' WHEN {s} >= 0.60 THEN 'MONITOR 40' ELSE 'MONITOR 0' END"""


def similar(t: Tables, limit: int | None):
    return jobs.similar_articles(t("v_chunks"), t("v_articles"), None, 0.2, 10, 0, limit)


@query("r05_enhanced_score", f"WITH {SCORED} SELECT base_article, similar_article, round(score, 6) AS score FROM z")
def r05(t: Tables):
    return similar(t, None).select("base_article", "similar_article", F.round("score", 6).alias("score"))


def fixed3(x: str) -> str:
    return f"printf('%.3f', {x} + 1e-9)"


@query("r05_breakdown", f"""WITH {SCORED.replace("AS sv, least(", f"AS sv, {WR} AS wr, {BONUS} AS bonus, {META} AS meta, least(")} SELECT base_article, similar_article, {fixed3('avg_similarity * 0.60')} AS base_score, {fixed3('wr * 0.25')} AS weighted_ratio_score,
    {fixed3('bonus')} AS run_bonus, {fixed3('least(meta * 0.5, 0.05)')} AS metadata_bonus, {fixed3('wr')} AS weighted_ratio FROM z""")
def r05_breakdown(t: Tables):
    parts = scoring.breakdown(*map(F.col, ("avg_similarity", "weighted_ratio", "run_bonus", "metadata_bonus")))
    return similar(t, None).select("base_article", "similar_article", parts.alias("parts")).select("base_article", "similar_article", "parts.*")


@query("z01_similar_articles", f"""WITH {SCORED}, k AS (SELECT *, {ladder('score', 'matching_ratio', 'same')} AS rule FROM z)
    SELECT base_article, similar_article, round(score, 6) AS score, split_part(rule, ' ', 1) AS recommendation_type, CAST(split_part(rule, ' ', 2) AS INTEGER) AS priority, round(score * 0.95 + 0.05, 6) AS confidence_score,
           CAST(row_number() OVER (PARTITION BY base_article ORDER BY CAST(split_part(rule, ' ', 2) AS INTEGER) DESC, score DESC, similar_article) AS INTEGER) AS rank
    FROM k QUALIFY row_number() OVER (PARTITION BY base_article ORDER BY CAST(split_part(rule, ' ', 2) AS INTEGER) DESC, score DESC, similar_article) <= 20""")
def z01(t: Tables):
    return similar(t, 20).select("base_article", "similar_article", F.round("score", 6).alias("score"), "recommendation_type", "priority", F.round("confidence_score", 6).alias("confidence_score"), "rank")


GRID = "(SELECT base_article_id || '-' || similar_article_id AS pair, 0.5 + similarity_score / 2 AS score, (CAST(base_article_id AS INTEGER) % 11) / 10.0E0 AS ratio, CAST(similar_article_id AS INTEGER) % 2 = 0 AS same, CAST(base_article_id AS BIGINT) * 7 AS bv, CAST(similar_article_id AS BIGINT) * 11 AS sv FROM v_cache)"


def grid(t: Tables):
    n, m = F.col("base_article_id").cast("int"), F.col("similar_article_id").cast("int")
    return t("v_cache").select(F.concat_ws("-", "base_article_id", "similar_article_id").alias("pair"), (0.5 + F.col("similarity_score") / 2).alias("score"), (n % 11 / 10.0).alias("matching_ratio"), (m % 2 == 0).alias("same_course"), (n.cast("bigint") * 7).alias("bv"), (m.cast("bigint") * 11).alias("sv"))


@query("r10_unified_ladder", f"SELECT pair, split_part(rule, ' ', 1) AS recommendation_type, CAST(split_part(rule, ' ', 2) AS INTEGER) AS priority, round(score * 0.95 + 0.05, 6) AS confidence_score FROM (SELECT *, {ladder('score', 'ratio', 'same')} AS rule FROM {GRID})")
def r10(t: Tables):
    return recommend.unified(grid(t)).select("pair", "recommendation_type", "priority", F.round("confidence_score", 6).alias("confidence_score"))


@query("o06_ranked_actions", f"SELECT pair, row_number() OVER (ORDER BY CAST(split_part(rule, ' ', 2) AS INTEGER) DESC, score DESC, pair) AS place FROM (SELECT *, {ladder('score', 'ratio', 'same')} AS rule FROM {GRID}) ORDER BY place LIMIT 50")
def o06(t: Tables):
    order = [F.desc("priority"), F.desc("score"), F.col("pair").asc()]
    return recommend.unified(grid(t)).orderBy(*order).limit(50).withColumn("place", F.row_number().over(vectors.Window.orderBy(*order)).cast("bigint")).select("pair", "place")


@query("r06_direction", f"SELECT pair, CASE WHEN action = 'MERGE_CONTENT' AND sv > bv OR action = 'REDIRECT_301' AND sv > 2 * bv THEN 'similar' WHEN action IN ('MERGE_CONTENT', 'REDIRECT_301') THEN 'base' END AS keep_side FROM (SELECT *, split_part({ladder('score', 'ratio', 'same')}, ' ', 1) AS action FROM {GRID})")
def r06(t: Tables):
    keep, _ = recommend.direction(F.lit("base"), F.lit("similar"), F.col("bv"), F.col("sv"), F.col("recommendation_type"))
    return recommend.unified(grid(t)).select("pair", keep.alias("keep_side"))


@query("r11_realtime_ladder", f"SELECT pair, CASE WHEN score >= 0.94 THEN 'MERGE_CONTENT' WHEN score >= 0.80 THEN 'REDIRECT_301' WHEN score >= 0.70 THEN 'CROSS_LINK' ELSE 'MONITOR' END AS action, round(score * 0.9 + 0.1, 6) AS confidence FROM {GRID}")
def r11(t: Tables):
    return grid(t).select("pair", recommend.realtime(F.col("score")).alias("action"), F.round(F.col("score") * 0.9 + 0.1, 6).alias("confidence"))


@query("r12_cache_ladder", "SELECT base_article_id, similar_article_id, CASE WHEN similarity_score >= 0.8 THEN 'MERGE_CONTENT' WHEN similarity_score >= 0.6 THEN 'REDIRECT_301' WHEN similarity_score >= 0.4 THEN 'CROSS_LINK' ELSE 'MONITOR' END AS action FROM v_cache")
def r12(t: Tables):
    return t("v_cache").select("base_article_id", "similar_article_id", recommend.cached(F.col("similarity_score")).alias("action"))


@query("r13_explanations")
def r13(t: Tables):
    rows = recommend.unified(grid(t))
    return rows.select("pair", "rule", recommend.explanation(F.col("score"), F.col("matching_ratio"), F.col("same_course"), F.col("bv"), F.col("sv"), F.lit(3), F.col("rule")).alias("explanation"))


@query("r14_actions_used", f"SELECT split_part({ladder('score', 'ratio', 'same')}, ' ', 1) AS recommendation_type, count(*) AS n, CAST(CASE recommendation_type WHEN 'MERGE_CONTENT' THEN 100 WHEN 'REDIRECT_301' THEN 80 WHEN 'CROSS_LINK' THEN 60 WHEN 'REVIEW' THEN 50 ELSE 40 END AS INTEGER) AS action_priority FROM {GRID} GROUP BY 1")
def r14(t: Tables):
    rows = recommend.unified(grid(t))
    return rows.join(F.broadcast(recommend.actions(rows.sparkSession)), "recommendation_type").groupBy("recommendation_type", "action_priority").agg(F.count("*").alias("n"))


@query("r23_playbook_used", f"SELECT split_part({ladder('score', 'ratio', 'same')}, ' ', 1) AS recommendation_type, count(*) AS n, CAST(CASE recommendation_type WHEN 'MERGE_CONTENT' THEN 7 WHEN 'REDIRECT_301' THEN 5 WHEN 'CROSS_LINK' THEN 5 ELSE 4 END AS BIGINT) AS n_steps FROM {GRID} GROUP BY 1")
def r23(t: Tables):
    rows = recommend.unified(grid(t))
    return rows.join(F.broadcast(recommend.actions(rows.sparkSession)), "recommendation_type").groupBy("recommendation_type", F.size("steps").cast("bigint").alias("n_steps")).agg(F.count("*").alias("n"))


TRAFFIC = f"(SELECT *, bv + sv AS current_combined_pv, CAST(floor((bv + sv) * (1 + score * 0.3) + 0.5) AS BIGINT) AS predicted_pv FROM {GRID})"
PCT = "CASE WHEN current_combined_pv > 0 THEN CAST(floor((predicted_pv - current_combined_pv) / current_combined_pv * 100 + 0.5) AS BIGINT) ELSE 0 END"


@query("r15_traffic", f"SELECT pair, current_combined_pv, predicted_pv, predicted_pv - current_combined_pv AS expected_increase, {PCT} AS increase_percentage, CASE WHEN score > 0.7 THEN 'high' WHEN score > 0.5 THEN 'medium' ELSE 'low' END AS confidence_level FROM {TRAFFIC}")
def r15(t: Tables):
    return grid(t).select("pair", *[c.alias(k) for k, c in recommend.traffic(F.col("bv"), F.col("sv"), F.col("score")).items()])


@query("r16_cache_traffic", f"SELECT pair, CAST(trunc((bv + sv) * (1 + score * 0.2)) AS BIGINT) AS predicted FROM {GRID}")
def r16(t: Tables):
    return grid(t).select("pair", recommend.cache_traffic(F.col("bv"), F.col("sv"), F.col("score")).alias("predicted"))


COMMON = "list_filter(x.search_keywords, lambda k: list_contains(list_transform(y.search_keywords, lambda v: lower(v)), lower(k)))"


@query("r17_content_analysis", f"SELECT x.id, len({COMMON}) AS n_common, CAST(floor(len({COMMON}) / len(x.search_keywords) * 100 + 0.5) AS BIGINT) AS overlap_percentage, floor(length(x.full_content) / length(y.full_content) * 100 + 0.5) / 100 AS length_ratio, CAST(CASE WHEN length(x.full_content) < 1000 AND length(y.full_content) < 1000 THEN 1 ELSE 0 END + CASE WHEN abs(length(x.full_content) - length(y.full_content)) > 2000 THEN 1 ELSE 0 END AS BIGINT) AS n_advice {PAIR}")
def r17(t: Tables):
    c = recommend.content_analysis(F.col("base.search_keywords"), F.col("similar.search_keywords"), F.col("base.full_content"), F.col("similar.full_content"))
    return shifted(t).select(F.col("base_article").alias("id"), F.size(c["common_keywords"]).cast("bigint").alias("n_common"), c["overlap_percentage"].alias("overlap_percentage"), c["length_ratio"].alias("length_ratio"), F.size(c["advice"]).cast("bigint").alias("n_advice"))


@query("t29_keyword_overlap", f"SELECT x.id, array_to_string({COMMON}, ',') AS common {PAIR}")
def t29(t: Tables):
    return shifted(t).select(F.col("base_article").alias("id"), F.array_join(recommend.keyword_overlap(F.col("base.search_keywords"), F.col("similar.search_keywords")), ",").alias("common"))


POINTS = f"CAST(least(floor(score * 100 + CASE WHEN bv + sv > 1000 THEN 10 ELSE 0 END + CASE WHEN bv + sv > 5000 THEN 10 ELSE 0 END + CASE WHEN (bv % 130 + sv % 130) / 2 > 60 THEN 5 ELSE 0 END + CASE WHEN ({PCT}) > 20 THEN 15 ELSE 0 END + 0.5), 100) AS BIGINT)"


def pointed(t: Tables):
    tr = recommend.traffic(F.col("bv"), F.col("sv"), F.col("score"))
    return grid(t).withColumns(tr).withColumn("points", recommend.integration_score(F.col("score"), F.col("bv"), F.col("sv"), (F.col("bv") % 130).cast("double"), (F.col("sv") % 130).cast("double"), F.col("increase_percentage")))


@query("r18_integration_score", f"SELECT pair, {POINTS} AS points FROM {TRAFFIC}")
def r18(t: Tables):
    return pointed(t).select("pair", F.col("points").cast("bigint").alias("points"))


@query("r19_pair_priority", f"SELECT pair, least({POINTS} + CASE WHEN score > 0.8 THEN 10 ELSE 0 END + CASE WHEN predicted_pv > 10000 THEN 15 ELSE 0 END, 100) AS priority FROM {TRAFFIC}")
def r19(t: Tables):
    return pointed(t).select("pair", recommend.pair_priority(F.col("points"), F.col("score"), F.col("predicted_pv")).cast("bigint").alias("priority"))


@query("r20_risks", f"""SELECT pair, coalesce(nullif(concat_ws(' / ', CASE WHEN action = 'MERGE_CONTENT' AND bv > 5000 THEN '高トラフィック記事の統合によるSEOリスク' END, CASE WHEN action = 'MERGE_CONTENT' THEN '統合作業中の一時的な順位下落の可能性' END,
    CASE WHEN action = 'REDIRECT_301' THEN 'リダイレクト実装時の技術的リスク / 短期的なトラフィック減少の可能性' END, CASE WHEN bv > 1000 OR sv > 1000 THEN 'オーガニック検索への影響' END), ''), 'リスクは低いと評価されます') AS risks
    FROM (SELECT *, split_part({ladder('score', 'ratio', 'same')}, ' ', 1) AS action FROM {GRID})""")
def r20(t: Tables):
    return recommend.unified(grid(t)).select("pair", F.array_join(recommend.risks(F.col("recommendation_type"), F.col("bv"), F.col("bv"), F.col("sv")), " / ").alias("risks"))


@query("r20_steps", f"""SELECT pair, n_steps, timeline FROM (SELECT pair, split_part({ladder('score', 'ratio', 'same')}, ' ', 1) AS action FROM {GRID})
    JOIN (VALUES ('MERGE_CONTENT', 7, '2-4週間'), ('REDIRECT_301', 5, '1-2週間'), ('CROSS_LINK', 5, '1週間'), ('REVIEW', 4, '未定'), ('MONITOR', 4, '継続的')) s(action, n_steps, timeline) USING (action)""")
def r20_steps(t: Tables):
    rows = recommend.unified(grid(t))
    return rows.join(F.broadcast(recommend.actions(rows.sparkSession).select("recommendation_type", "steps", "timeline")), "recommendation_type").select("pair", F.size("steps").alias("n_steps"), "timeline")


REPORT = f"""WITH known AS (SELECT base_article_id, similar_article_id, max(similarity_score) AS s FROM v_cache WHERE expires_at >= {TS} - INTERVAL 20 DAYS GROUP BY 1, 2),
 p AS (SELECT x.id AS base_article, y.id AS similar_article, coalesce(s, 0.5) AS similarity, x.pageviews AS bv, y.pageviews AS sv, x.koza_id = y.koza_id AS same FROM v_articles x JOIN v_articles y ON CAST(y.id AS INTEGER) = CAST(x.id AS INTEGER) + 3 LEFT JOIN known ON base_article_id = x.id AND similar_article_id = y.id)
 SELECT base_article, similar_article, similarity, split_part({ladder('similarity', '0.5', 'same')}, ' ', 1) AS recommendation_type, CAST(floor((coalesce(bv, 0) + coalesce(sv, 0)) * (1 + similarity * 0.3) + 0.5) AS BIGINT) AS predicted_pv FROM p"""


def report(t: Tables):
    a = t("v_articles")
    p = a.select(F.col("id").alias("base_article"), (F.col("id").cast("int") + 3).cast("string").alias("similar_article"), F.lit(None).cast("double").alias("similarity"))
    return jobs.recommendations(p, a, t("v_cache"), as_of() - F.expr("INTERVAL 20 DAYS"))


@query("z04_recommendations", REPORT)
def z04(t: Tables):
    return report(t).where("error IS NULL").select("base_article", "similar_article", "similarity", "recommendation_type", "predicted_pv")


@query("r21_cached_similarity", REPORT.replace("split_part(" + ladder("similarity", "0.5", "same") + ", ' ', 1) AS recommendation_type, CAST(floor((coalesce(bv, 0) + coalesce(sv, 0)) * (1 + similarity * 0.3) + 0.5) AS BIGINT) AS predicted_pv", "similarity = 0.5 AS unknown"))
def r21(t: Tables):
    return report(t).where("error IS NULL").select("base_article", "similar_article", "similarity", (F.col("similarity") == 0.5).alias("unknown"))


@query("r22_pair_errors", "SELECT count(*) AS pairs, count(*) FILTER (y.id IS NULL) AS errors FROM v_articles x LEFT JOIN v_articles y ON CAST(y.id AS INTEGER) = CAST(x.id AS INTEGER) + 3")
def r22(t: Tables):
    return report(t).agg(F.count("*").alias("pairs"), F.count("error").alias("errors"))


def nearest(found):
    return found.select("base_id", "id", F.round("similarity", 6).alias("similarity"))


@query("o07_nearest_in_course", f"""WITH n AS (SELECT a.id AS base_id, b.id, {COS} AS similarity FROM v_articles a JOIN v_articles b ON a.id <> b.id AND b.koza_id = a.koza_id WHERE CAST(a.id AS INTEGER) % 50 = 0 AND a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL AND b.pageviews >= 0)
    SELECT base_id, id, {SIM} FROM (SELECT * FROM n QUALIFY {BEST} <= 10) WHERE similarity >= 0.0""")
def o07(t: Tables):
    a = t("v_articles")
    return nearest(jobs.nearest_articles(a, bases(a), 0.0, 10, same_course=True, min_pageviews=0, limit_first=True))


@query("o08_nearest_published", f"SELECT base_id, id, {SIM} FROM (SELECT * FROM ({NEAR} AND b.content_type = 'en') WHERE similarity >= 0.1 QUALIFY {BEST} <= 5)")
def o08(t: Tables):
    from corpuslens.operators.search import published

    a = t("v_articles").withColumn("status", F.when(F.col("content_type") == "en", "published").otherwise("draft"))
    return nearest(jobs.nearest_articles(published(a), bases(a), 0.1, 5))


@query("o09_nearest_ten", f"SELECT base_id, id, {SIM} FROM (SELECT * FROM ({NEAR}) QUALIFY {BEST} <= 10)")
def o09(t: Tables):
    a = t("v_articles")
    return nearest(jobs.nearest_articles(a, bases(a), -1.1, 10))


@query("z02_nearest_articles", f"SELECT base_id, id, {SIM} FROM (SELECT * FROM ({NEAR}) WHERE similarity >= 0.2 QUALIFY {BEST} <= 5)")
def z02(t: Tables):
    a = t("v_articles")
    return nearest(jobs.nearest_articles(a, bases(a), 0.2, 5))


@query("z03_similarity_cache", f"""WITH s AS (SELECT id FROM v_articles WHERE pageviews >= 10 AND content_embedding IS NOT NULL ORDER BY pageviews DESC, id LIMIT 20),
    n AS (SELECT a.id AS base_article_id, b.id AS similar_article_id, {COS} AS s, a.pageviews AS bv, b.pageviews AS sv FROM v_articles a JOIN v_articles b ON a.id <> b.id WHERE a.id IN (SELECT id FROM s) AND b.content_embedding IS NOT NULL AND {COS} >= 0 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) <= 20)
    SELECT base_article_id, similar_article_id, round(s, 6) AS similarity_score, CAST(trunc((coalesce(bv, 0) + coalesce(sv, 0)) * (1 + s * 0.2)) AS BIGINT) AS traffic_impact_prediction FROM n""")
def z03(t: Tables):
    return jobs.build_similarity_cache(t("v_articles"), as_of(), min_pageviews=10).select("base_article_id", "similar_article_id", F.round("similarity_score", 6).alias("similarity_score"), "traffic_impact_prediction")


def analysis(t: Tables):
    a = t("v_articles")
    return jobs.neighbour_analysis(a, bases(a), 0.2)


@query("z05_neighbour_analysis", f"SELECT base_id, koza_id, count(*) AS n, round(avg(similarity), 6) AS avg, round(max(similarity), 6) AS max FROM ({NEAR}) GROUP BY 1, 2")
def z05(t: Tables):
    return analysis(t)[2].withColumns(r6("avg", "max"))


@query("z05_high_list", f"SELECT base_id, id, {SIM} FROM (SELECT * FROM ({NEAR}) WHERE similarity >= 0.2 QUALIFY {BEST} <= 20)")
def z05_high(t: Tables):
    return nearest(analysis(t)[1])


@query("z05_neighbour_stats", f"SELECT base_id, count(*) AS n, round(avg(similarity), 6) AS avg, round(stddev_samp(similarity), 6) AS stddev, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max FROM ({NEAR}) GROUP BY 1")
def z05_stats(t: Tables):
    return analysis(t)[0].select("base_id", "n", *[F.round(c, 6).alias(c) for c in ("avg", "stddev", "min", "max")])


@query("z03_refreshed_lists", f"SELECT a.id AS base_id, b.id AS similar_id, round({COS}, 6) AS similarity FROM v_articles a JOIN v_articles b ON a.id <> b.id WHERE a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL AND {COS} >= 0.1 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {COS} DESC, b.id) <= 5")
def z03_refreshed(t: Tables):
    """Lists of an earlier state (some articles not there, some with another vector, some gone since), after a refresh with what differs."""
    from corpuslens.operators import toplists

    now = materialise(t("v_articles").select("id", "content_embedding"), "now")
    n = F.col("id").cast("int")
    turned = F.when(n % 13 == 7, F.reverse("content_embedding")).otherwise(F.col("content_embedding"))
    gone = now.where(n % 17 == 3).select(F.concat("id", F.lit("x")).alias("id"), "content_embedding")
    before = now.where(n % 11 != 5).select("id", turned.alias("content_embedding")).unionByName(gone)
    lists = materialise(toplists.build(before, 5, 0.1), "lists")
    changed = now.where((n % 11 == 5) | (n % 13 == 7)).select("id").union(gone.select("id"))
    return toplists.refresh(lists, now, changed, 5, 0.1).withColumns(r6("similarity"))


@query("u03_merged_neighbours", """WITH f AS (SELECT base_article_id AS base_id, similar_article_id AS similar_id, similarity_score AS similarity FROM v_cache WHERE similarity_score >= 0.5),
    g AS (SELECT base_article_id AS base_id, similar_article_id AS similar_id, similarity_score AS similarity FROM v_cache),
    e AS (SELECT g.* FROM g LEFT JOIN (SELECT base_id, count(*) AS c FROM f GROUP BY 1) USING (base_id) WHERE coalesce(c, 0) < 2.5 AND (base_id, similar_id) NOT IN (SELECT (base_id, similar_id) FROM f)),
    u AS (SELECT *, 0 AS o FROM f UNION ALL SELECT *, 1 FROM e) SELECT base_id, similar_id, similarity FROM u QUALIFY row_number() OVER (PARTITION BY base_id ORDER BY o, similarity DESC, similar_id) <= 5""")
def u03(t: Tables):
    g = t("v_cache").select(F.col("base_article_id").alias("base_id"), F.col("similar_article_id").alias("similar_id"), F.col("similarity_score").alias("similarity"))
    return vectors.merge_neighbours(g.where("similarity >= 0.5"), g, 5).drop("rank")


LINKS = "SELECT base_article_id AS a, similar_article_id AS b, similarity_score AS similarity FROM v_cache WHERE similarity_score >= 0.8"


def links(t: Tables):
    return t("v_cache").where("similarity_score >= 0.8").select(F.col("base_article_id").alias("a"), F.col("similar_article_id").alias("b"), F.col("similarity_score").alias("similarity"))


@query("g01_pairs_of_list", f"SELECT a.id AS a, b.id AS b, round({COS}, 6) AS similarity FROM v_articles a JOIN v_articles b ON a.id < b.id WHERE a.koza_id = 'src1' AND b.koza_id = 'src1' AND a.content_embedding IS NOT NULL AND b.content_embedding IS NOT NULL AND {COS} >= 0.1")
def g01(t: Tables):
    a = t("v_articles")
    return grouping.pairs_of(a.where("koza_id = 'src1'").select("id"), a, 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("g02_one_hop_groups")
def g02(t: Tables):
    return grouping.one_hop(links(t))


@query("g03_components", f"""WITH RECURSIVE l AS ({LINKS}), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), w(id, r) AS (SELECT a, a FROM e UNION SELECT w.id, e.b FROM w JOIN e ON e.a = w.r) SELECT id, min(r) AS component FROM w GROUP BY 1""")
def g03(t: Tables):
    return grouping.transitive(links(t))


@query("g04_group_summary")
def g04(t: Tables):
    return grouping.summary(grouping.one_hop(links(t)), t("v_articles")).select("group", F.array_join("members", ",").alias("members"), "n", "courses", F.round("mean_similarity", 6).alias("mean_similarity"), "strategy", F.array_join("benefits", ",").alias("benefits"), "priority")
