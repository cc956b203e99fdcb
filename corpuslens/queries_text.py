"""Queries of text functions, enrichment, chunking, CMS documents and streams."""

from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import chunking
from corpuslens.operators import recommend as rec
from corpuslens.queries import Tables, query, r6
from corpuslens.runtime import new_path

PLAIN = "regexp_replace(html, '<[^>]*>', ' ', 'g')"
for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&hellip;", "…"), ("&mdash;", "—")):
    PLAIN = f"replace({PLAIN}, '{entity}', '{char}')"


def docs(t: Tables):
    return t("documents").select("doc_id", "text", "lang", "source")


@query("t01_html_text")
def t01(t: Tables):
    return t("pages").select("page_id", tx.html_text(F.col("html"), " ", frozenset(), False).alias("text"))


@query("t02_html_text_chunks")
def t02(t: Tables):
    return t("pages").select("page_id", tx.html_text(F.col("html")).alias("text"))


@query("t03_html_text_plain")
def t03(t: Tables):
    return t("pages").select("page_id", tx.html_text(F.col("html"), "").alias("text"))


@query("t04_strip_tags", f"SELECT page_id, trim(regexp_replace({PLAIN}, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM pages")
def t04(t: Tables):
    return t("pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query("t05_simple_text", "SELECT doc_id, CASE WHEN length(x) > 2000 THEN left(x, 1997) || '...' ELSE x END AS text FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(lang || ' ' || text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM documents)")
def t05(t: Tables):
    return docs(t).select("doc_id", tx.simple_text(F.col("lang"), F.col("text"), limit=2000).alias("text"))


@query("t07_iso_time", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) END AS day FROM orders")
def t07(t: Tables):
    text = F.when(F.col("o_orderkey") % 7 == 0, "no time").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:00:00.000Z")))
    return t("orders").select("o_orderkey", tx.iso_time(text).cast("date").alias("day"))


@query("t08_string_id", "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders")
def t08(t: Tables):
    return t("orders").select("o_orderkey", tx.string_id(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey"))).alias("id"))


@query("t12_collapse", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents")
def t12(t: Tables):
    return docs(t).select("doc_id", tx.collapse(F.col("text")).alias("text"))


HITS = {f: " + ".join(f"CAST(contains(x, '{k}') AS INTEGER)" for k in ks) for f, ks in tx.FIELD_KEYWORDS.items()}
#: A sentence before the whole text of three of four documents.
PLANTED = "(CASE doc_id % 4 WHEN 0 THEN '簿記と税務の決算' || chr(10) WHEN 1 THEN '保険と年金、社会保険' || chr(10) WHEN 2 THEN '' ELSE 'システムの設計 税金' || chr(10) END || coalesce(text, ''))"
#: A course for each document: a known one, one of the list, or one that has neither
COURSE = "CASE WHEN doc_id % 5 = 0 THEN source ELSE CAST(doc_id % 50 AS VARCHAR) END"


def planted():
    n = F.col("doc_id") % 4
    return F.concat(F.when(n == 0, "簿記と税務の決算\n").when(n == 1, "保険と年金、社会保険\n").when(n == 2, "").otherwise("システムの設計 税金\n"), F.coalesce("text", F.lit("")))


def course():
    return F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise((F.col("doc_id") % 50).cast("string"))


@query("t13_subject_field", f"""WITH d AS (SELECT doc_id, lower({PLANTED} || ' ') AS x, CASE WHEN doc_id % 9 = 0 THEN 'takken' ELSE 'c' END AS slug FROM documents), s AS (SELECT doc_id, slug, {', '.join(f'{h} AS {f}' for f, h in HITS.items())} FROM d),
    m AS (SELECT *, greatest({', '.join(HITS)}) AS best FROM s) SELECT doc_id, CASE WHEN slug = 'takken' THEN 'real_estate' WHEN best = 0 THEN 'general' {' '.join(f"WHEN {f} = best THEN '{f}'" for f in HITS)} END AS field FROM m""")
def t13(t: Tables):
    slug = F.when(F.col("doc_id") % 9 == 0, "takken").otherwise("c")
    return docs(t).select("doc_id", tx.field_of(F.lit(None).cast("string"), slug, planted(), F.lit(None).cast("string")).alias("field"))


def replaced(text: str, words: list[str]) -> str:
    for w in words:
        text = f"replace({text}, '{w}', '【{w}】')"
    return text


def steps(text: str, *patterns: tuple[str, str]) -> str:
    for p, to in patterns:
        text = f"regexp_replace({text}, '{p}', '{to}', 'g')"
    return text


DEFINED = (r"(?m)(?:^|\n)([^\n]{1,50}とは[？?]?)\s*(?:\n|$)", "\n【\\1】\n")
LISTS = ((r"(?m)(?:^|\n)・([^\n]+)", "\n- \\1"), (r"(?m)(?:^|\n)(\d+)\.([^\n]+)", "\n\\1. \\2"))
MARKED = steps(f"('簿記とは？\n・一つ\n1.二つ\n重要：三つ\n' || {PLANTED})", DEFINED, (r"([^\s]+(?:法|規則|規定|基準|要件|条例))", r"《\1》"), (r"([第]?\d+条[の]?\d*(?:第\d+項)?)", r"《\1》"), *LISTS, (r"(?m)(?:^|\n)(ポイント|重要|注意|要点|まとめ)[：:]([^\n]+)", "\n★\\1: \\2"))


@query("t14_structured", f"SELECT doc_id, {MARKED} AS text FROM documents")
def t14(t: Tables):
    return docs(t).select("doc_id", tx.structured(F.concat(F.lit("簿記とは？\n・一つ\n1.二つ\n重要：三つ\n"), planted())).alias("text"))


LAW_MARKED = steps(f"('宅建業法第35条の2とは？\n・宅建業法と供託\n1.民法90条\n重要：年金と税関\nまとめ：証券\n' || {PLANTED})", DEFINED, (r"([^\s]+法[第]?\d+条[の]?\d*(?:第\d+項)?)", r"《\1》"), *LISTS, (r"(?m)(?:^|\n)(ポイント|重要|注意)[：:]([^\n]+)", "\n★\\1: \\2"))
# the expected keywords of each course, written out
OF_COURSES = {
    "1": "行政書士法 許認可 官公署 代理 代行", "2": "労働基準法 社会保険 労災 雇用保険 年金", "3": "ライフプランニング リスク管理 金融資産 タックスプランニング 不動産 相続", "4": "宅建業法 都市計画法 建築基準法 重要事項説明 媒介契約",
    "5": "マンション管理適正化法 区分所有法 管理組合 修繕積立金", "6": "仕訳 貸借対照表 損益計算書 減価償却 棚卸資産", "26": "ITパスポート 情報セキュリティ システム開発 データベース", "27": "関税法 通関業法 輸出入 税関",
    "45": "司法書士法 不動産登記 商業登記 供託", "46": "アルゴリズム データ構造 プログラミング システム設計", "47": "金融商品取引法 証券 投資信託 デリバティブ",
}


@query("t15_structured_by_course", f"SELECT doc_id, CASE course {' '.join(f"WHEN '{k}' THEN {replaced('x', ws.split())}" for k, ws in OF_COURSES.items())} ELSE x END AS text FROM (SELECT doc_id, {COURSE} AS course, {LAW_MARKED} AS x FROM documents)")
def t15(t: Tables):
    text = F.concat(F.lit("宅建業法第35条の2とは？\n・宅建業法と供託\n1.民法90条\n重要：年金と税関\nまとめ：証券\n"), planted())
    return docs(t).select("doc_id", course().alias("course"), tx.law_structured(text).alias("text")).select("doc_id", tx.course_marks(F.col("text"), F.col("course")).alias("text"))


@query("t16_questions")
def t16(t: Tables):
    return docs(t).select("doc_id", tx.structured_qa(F.concat(F.lit("Q: a"), F.col("source"), F.lit("\nA: b\nQ：c\nA：d "), F.col("text"))).alias("text"))


@query("t17_term_marks", f"SELECT doc_id, {replaced(replaced(PLANTED, tx.FIELD_KEYWORDS['finance']), tx.TERMS)} AS text FROM documents")
def t17(t: Tables):
    return docs(t).select("doc_id", tx.enhanced_terms(planted(), F.lit("finance")).alias("text"))


# the expected lists, written out
LAW = "宅建業法 宅地建物取引士 重要事項説明 営業保証金 供託所 宅建業者 媒介契約 売買契約 賃貸借契約 重要事項 契約書面 37条書面 35条書面 免許 登録 更新 監督処分 指示処分 業務停止 免許取消 罰則 行政書士 社会保険労務士 ファイナンシャルプランナー 簿記 マンション管理士 管理業務主任者 司法書士 通関士".split()
NAMES = """(VALUES ('1', '行政書士'), ('2', '社会保険労務士'), ('3', 'FP（ファイナンシャルプランナー）'), ('4', '宅建士（宅地建物取引士）'), ('5', 'マンション管理士・管理業務主任者'), ('6', '簿記2級・3級'), ('26', 'IT（ITパスポート）'),
    ('27', '通関士'), ('28', '旅行業務取扱管理者'), ('39', '年金アドバイザー3級'), ('40', '危険物取扱者乙種4類'), ('45', '司法書士'), ('46', '基本情報技術者'), ('47', '証券外務員')) l(course, listed)"""
LAW_TEXT = "('免許と登録、通関士 行政書士 src3 重要事項説明 ' || coalesce(text, ''))"


@query("t18_law_term_marks", f"""SELECT doc_id, CASE WHEN c.name IS NULL AND listed IS NULL THEN x ELSE replace(x, coalesce(c.name, listed), '【' || coalesce(c.name, listed) || '】') END AS text
    FROM (SELECT doc_id, {COURSE} AS course, {replaced(LAW_TEXT, LAW)} AS x FROM documents) LEFT JOIN (SELECT source AS course, source AS name FROM documents WHERE source <> 'src1' GROUP BY 1) c USING (course) LEFT JOIN {NAMES} USING (course)""")
def t18(t: Tables):
    names = t("v_courses").where("id <> 'src1'").select(F.col("id").alias("course"), F.col("slug").alias("known"))
    rows = docs(t).withColumn("course", course()).join(names, "course", "left").withColumn("name", tx.course_name(F.col("course"), F.col("known")))
    return rows.select("doc_id", tx.law_terms(F.concat(F.lit("免許と登録、通関士 行政書士 src3 重要事項説明 "), F.coalesce("text", F.lit(""))), F.col("course"), F.col("name")).alias("text"))


@query("t19_labelled", "SELECT doc_id, 'タイトル: ' || lang || chr(10) || chr(10) || '講座: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '分野: 法律' ELSE '' END || CASE WHEN trim(text, ' ') <> '' THEN chr(10) || chr(10) || '内容: ' || trim(text, ' ') ELSE '' END AS text FROM documents")
def t19(t: Tables):
    return docs(t).select("doc_id", tx.labelled(F.col("lang"), F.col("source"), F.when(F.col("doc_id") % 2 == 0, "legal").otherwise("general"), F.col("text"), F.lit("")).alias("text"))


NORMAL = "text || ' http://a.b/c x@y.zz ！！ ☆'"
for p in ("[◆◇■□●○▲△▼▽★☆※]", "[！？]{2,}|[。、]{2,}", "https?://[^\\s]+", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"):
    NORMAL = f"regexp_replace({NORMAL}, '{p}', '', 'g')"


@query("t20_normalised", f"SELECT doc_id, replace(regexp_replace(regexp_replace({NORMAL}, '\\n\\s*\\n\\s*\\n+', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), chr(10) || ' ', chr(10)) AS text FROM documents")
def t20(t: Tables):
    return docs(t).select("doc_id", tx.normalised(F.concat("text", F.lit(" http://a.b/c x@y.zz ！！ ☆"))).alias("text"))


@query("t21_priority_cut")
def t21(t: Tables):
    return docs(t).select("doc_id", tx.priority_cut(F.regexp_replace("text", "\n", "\n\n"), 1000).alias("text"))


@query("t22_minimum_length", "SELECT doc_id, length(trim(text)) < 50 AS fallback FROM documents")
def t22(t: Tables):
    return docs(t).select("doc_id", (F.char_length(F.btrim("text", F.lit(" "))) < 50).alias("fallback"))


@query("t23_enriched")
def t23(t: Tables):
    rows = docs(t).select("doc_id", F.col("lang").alias("title"), F.col("text").alias("full_content"), F.lit("").alias("qanda_content"), F.col("source").alias("course_name"), F.col("source").alias("course_slug"))
    return tx.enriched(rows).select("doc_id", "field_type", "embedding_text")


@query("a29_text_stats", "SELECT doc_id, CAST(length(text) AS INTEGER) AS original_length, CAST(length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS INTEGER) AS processed_length, regexp_matches(trim(regexp_replace(text, '\\s+', ' ', 'g')), 'Q[0-9]*:') AS has_questions FROM documents")
def a29(t: Tables):
    s = tx.text_stats(F.col("text"), tx.collapse(F.col("text")))
    return docs(t).select("doc_id", *[s[c].alias(c) for c in ("original_length", "processed_length", "has_questions")])


@query("t24_course_names", f"SELECT doc_id, coalesce(c.name, listed, '講座' || course) AS name FROM (SELECT doc_id, {COURSE} AS course FROM documents) LEFT JOIN v_courses c ON c.id = course AND c.id <> 'src1' LEFT JOIN {NAMES} USING (course)")
def t24(t: Tables):
    names = t("v_courses").where("id <> 'src1'").select(F.col("id").alias("course"), "name")
    return docs(t).withColumn("course", course()).join(names, "course", "left").select("doc_id", tx.course_name(F.col("course"), F.col("name")).alias("name"))


@query("t25_sentence_cut", "SELECT doc_id, CASE WHEN length(p) <= 300 THEN p WHEN contains(left(p, 300), '.') AND 300 - instr(reverse(left(p, 300)), '.') + 1 > 240 THEN left(p, 300 - instr(reverse(left(p, 300)), '.') + 1) || '...' ELSE left(p, 300) || '...' END AS text FROM (SELECT doc_id, trim(regexp_replace(text, '<[^>]*>', '', 'g')) AS p FROM documents)")
def t25(t: Tables):
    return docs(t).select("doc_id", tx.sentence_cut(F.col("text"), 300, ".").alias("text"))


@query("t26_more_keywords", "SELECT lang AS field, source AS keyword FROM documents WHERE doc_id % 2 = 0 UNION SELECT lang, source FROM documents WHERE doc_id % 3 = 0")
def t26(t: Tables):
    d = docs(t).select("doc_id", F.col("lang").alias("field"), F.col("source").alias("keyword"))
    return d.where("doc_id % 2 = 0").drop("doc_id").unionByName(d.where("doc_id % 3 = 0").drop("doc_id")).dropDuplicates()


@query("t30_rounding", "SELECT o_orderkey, CAST(floor(o_totalprice + 0.5) AS BIGINT) AS half_up, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders)")
def t30(t: Tables):
    v = F.col("o_totalprice").cast("double")
    return t("orders").select("o_orderkey", rec.half_up(v).cast("bigint").alias("half_up"), v.cast("bigint").alias("whole"))


@query("t31_chunk_text", "SELECT chunk_id, '記事タイトル: ' || article_id || chr(10) || 'セクション: ' || chunk_title || chr(10) || chr(10) || chunk_id AS text FROM v_chunks")
def t31(t: Tables):
    return t("v_chunks").select("chunk_id", tx.chunk_text(F.col("article_id"), F.col("chunk_title"), F.col("chunk_id")).alias("text"))


def sentences(c: str) -> str:
    head = "left(p, 1500)"
    return f"(SELECT CASE WHEN length(p) <= 1500 THEN p WHEN contains({head}, '。') AND 1500 - instr(reverse({head}), '。') + 1 > 1200 THEN left(p, 1500 - instr(reverse({head}), '。') + 1) || '...' ELSE {head} || '...' END FROM (SELECT trim(regexp_replace(coalesce({c}, ''), '<[^>]*>', '', 'g')) AS p))"


@query("t32_pair_prompts", f"""SELECT x.id, 'Article A: ' || x.title || chr(10) || {sentences('x.full_content')} || chr(10) || chr(10) || 'Article B: ' || y.title || chr(10) || {sentences('y.full_content')} || chr(10) || chr(10) || 'Where do the two overlap, and what should be done?' AS prompt
    FROM v_articles x JOIN v_articles y ON CAST(y.id AS INTEGER) = CAST(x.id AS INTEGER) + 1""")
def t32(t: Tables):
    a = t("v_articles").select("id", "title", "full_content")
    b = a.select((F.col("id").cast("int") - 1).cast("string").alias("id"), F.col("title").alias("t2"), F.col("full_content").alias("c2"))
    return a.join(b, "id").select("id", tx.pair_prompt(F.col("title"), F.col("t2"), F.col("full_content"), F.col("c2")).alias("prompt"))


@query("t33_pair_sentences", "SELECT base_article_id, similar_article_id, base_article_id || ' / ' || similar_article_id || ': ' || printf('%.1f', similarity_score * 100) || '% MONITOR' AS text FROM v_cache")
def t33(t: Tables):
    return t("v_cache").select("base_article_id", "similar_article_id", tx.pair_sentence(F.col("base_article_id"), F.col("similar_article_id"), F.col("similarity_score"), F.lit("MONITOR")).alias("text"))


PROMPT = """'Base article' || chr(10) || '- title: ' || coalesce(x.title, '') || chr(10) || '- course: ' || coalesce(x.koza_id, 'N/A') || chr(10) || '- views a month: ' || format('{:,}', coalesce(x.pageviews, 0) * 1000) || chr(10)
    || 'Similar article' || chr(10) || '- title: ' || coalesce(y.title, '') || chr(10) || '- course: ' || coalesce(y.koza_id, 'N/A') || chr(10) || '- views a month: ' || format('{:,}', coalesce(y.pageviews, 0) * 1000) || chr(10)
    || '- similarity: ' || printf('%.3f', similarity_score) || chr(10) || 'Action: MONITOR' || chr(10) || 'Say in at most 150 characters why it helps, what it does for search results, and what to watch out for.'"""


@query("t33_cache_prompts", f"SELECT base_article_id, similar_article_id, {PROMPT} AS prompt FROM v_cache JOIN v_articles x ON x.id = base_article_id JOIN v_articles y ON y.id = similar_article_id")
def t33_prompts(t: Tables):
    side = lambda s: t("v_articles").select(F.col("id").alias(f"{s}_article_id"), F.col("title").alias(f"{s}_title"), F.col("koza_id").alias(f"{s}_course"), (F.coalesce("pageviews", F.lit(0)) * 1000).alias(f"{s}_views"))
    rows = t("v_cache").join(side("base"), "base_article_id").join(side("similar"), "similar_article_id")
    prompt = tx.cache_prompt(*[F.col(f"{s}_{c}") for s in ("base", "similar") for c in ("title", "course", "views")], F.col("similarity_score"), F.lit("MONITOR"))
    return rows.select("base_article_id", "similar_article_id", prompt.alias("prompt"))


# chunking: over pages, and over lines of documents as sections


def sections(t: Tables):
    lines = docs(t).select(F.col("doc_id").cast("string").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.select("id", "pos", F.concat(F.lit("s"), "pos").alias("title"), "text")


@query("c01_split_sections")
def c01(t: Tables):
    return chunking.split_sections(t("pages"), "page_id", "html", "article")


@query("c02_fragment_sections")
def c02(t: Tables):
    return chunking.split_sections(t("pages"), "page_id", "html")


L = "l AS (SELECT CAST(doc_id AS VARCHAR) AS id, unnest(range(0, len(s))) AS pos, s FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)), x AS (SELECT id, pos, 's' || pos AS title, regexp_replace(s[pos + 1], '^\\s+|\\s+$', '', 'g') AS text FROM l)"


@query("c03_merge_short", f"WITH {L}, g AS (SELECT *, sum(CASE WHEN pos = 0 OR length(text) >= 200 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS k FROM x) SELECT id, min(pos) AS pos, first(title ORDER BY pos) AS title, string_agg(CASE WHEN pos = 0 OR length(text) >= 200 THEN text ELSE chr(10) || chr(10) || title || chr(10) || text END, '' ORDER BY pos) AS text FROM g GROUP BY id, k")
def c03(t: Tables):
    return chunking.merge_short(sections(t))


@query("c04_split_long")
def c04(t: Tables):
    return chunking.split_long(chunking.merge_short(sections(t)))


@query("c05_overlap", f"WITH {L}, w AS (SELECT id, pos, title, text, lag(text) OVER (PARTITION BY id ORDER BY pos) AS b, lead(text) OVER (PARTITION BY id ORDER BY pos) AS a FROM x) SELECT id, pos AS chunk_index, title, CASE WHEN b IS NULL THEN text ELSE right(b, 100) || ' ' || text END || CASE WHEN a IS NULL THEN '' WHEN a <> '' AND length(a) < 50 THEN ' ' || a || '。' WHEN a = '' THEN ' ' ELSE ' ' || left(a, 50) END AS text FROM w")
def c05(t: Tables):
    s = sections(t).select("id", F.col("pos").alias("chunk_index"), "title", F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"))
    return chunking.overlapped(s)


@query("w02_neighbouring_chunks", f"WITH {L} SELECT id, pos, lag(title) OVER (PARTITION BY id ORDER BY pos) AS before, lead(title) OVER (PARTITION BY id ORDER BY pos) AS after FROM x")
def w02(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("pos")
    return sections(t).select("id", "pos", F.lag("title").over(w).alias("before"), F.lead("title").over(w).alias("after"))


def pages(t: Tables):
    return t("pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("full_content_html"), F.lit("").alias("full_content"))


@query("c06_chunks_v1")
def c06(t: Tables):
    return chunking.chunk_rows(chunking.chunks(pages(t), root="article", variant="v1"))


@query("c07_chunks")
def c07(t: Tables):
    return chunking.chunk_rows(chunking.chunks(pages(t), root="article"))


# CMS documents, landed as JSON first


def landed(t: Tables, kind: str):
    d = docs(t)
    spark, path = d.sparkSession, new_path(d.sparkSession, kind)
    if kind == "courses":
        rows = d.select("source").distinct().select(F.crc32(F.col("source").cast("binary")).alias("id"), F.struct(F.col("source").alias("slug"), F.col("source").alias("name"), F.lit("").alias("description"), F.lit("2024-01-01T00:00:00.000Z").alias("createdAt"), F.lit(None).cast("string").alias("updatedAt")).alias("attributes"))
    else:
        # the whole text: blocks between empty lines are sections, their lines after the first are paragraphs
        paragraphs = lambda b: F.transform(F.slice(F.split(b, "\n"), 2, F.size(F.split(b, "\n"))), lambda x: F.struct(F.lit("p").alias("subtitle"), x.alias("text")))
        sections = F.transform(F.split(F.coalesce("text", F.lit("")), "\n\n"), lambda b: F.struct(F.lit("s").alias("title"), F.split(b, "\n")[0].alias("text"), paragraphs(b).alias("paragraph")))
        qa = F.when(F.col("doc_id") % 2 == 0, F.array(F.struct(F.lit("q").alias("Question"), F.col("lang").alias("Answer"))))
        rows = d.select(F.col("doc_id").alias("id"), F.struct(F.concat(F.lit("t"), "doc_id").alias("POST_TITLE"), F.concat(F.lit("doc-"), "doc_id").alias("LINK"), F.col("source").alias("KOZA_ID"), F.col("lang").alias("description"), sections.alias("article"), qa.alias("QandA"), F.lit("2024-01-01T00:00:00.000Z").alias("createdAt"), F.lit("not a time").alias("updatedAt")).alias("attributes"))
    rows.write.json(path)
    return spark, path


@query("s01_course_documents", "SELECT DISTINCT source AS slug, source AS name, '' AS description FROM documents")
def s01(t: Tables):
    from corpuslens.sources import tables as src

    spark, path = landed(t, "courses")
    return src.read_documents(spark, path, src.COURSE).select("attributes.slug", "attributes.name", "attributes.description")


@query("s02_article_documents", """SELECT doc_id AS id, 't' || doc_id AS POST_TITLE, CAST(len(string_split(coalesce(text, ''), chr(10) || chr(10))) AS INTEGER) AS sections FROM documents""")
def s02(t: Tables):
    from corpuslens.sources import tables as src

    spark, path = landed(t, "articles")
    good, _ = src.quarantine(src.read_documents(spark, path, src.ARTICLE))
    return good.select("id", "attributes.POST_TITLE", F.size("attributes.article").alias("sections"))


@query("s06_append", "SELECT count(*) * 2 AS rows FROM documents")
def s06(t: Tables):
    from corpuslens.sources import tables as src

    d = docs(t)
    path = new_path(d.sparkSession, "appended")
    # the second batch twice, as after a failure
    for batch in ("first", "second", "second"):
        src.append(d, path, batch)
    return src.read_table(d.sparkSession, path).agg(F.count("*").alias("rows"))


@query("s07_clustered_table", "SELECT event_date, provider, n FROM (SELECT CAST(log_ts AS DATE) AS event_date, provider, count(*) AS n FROM v_usage GROUP BY 1, 2) WHERE event_date = DATE '2024-01-10'")
def s07(t: Tables):
    from corpuslens.sources import tables as src

    u = t("v_usage").withColumn("event_date", F.to_date("log_ts"))
    path = new_path(u.sparkSession, "usage")
    src.write_clustered(u, path, "event_date", ["provider", "request_type"])
    return src.read_table(u.sparkSession, path, where="event_date = DATE '2024-01-10'").groupBy("event_date", "provider").agg(F.count("*").alias("n"))


@query("t06_assembled")
def t06(t: Tables):
    from corpuslens.operators.articles import assembled
    from corpuslens.sources import tables as src

    spark, path = landed(t, "articles")
    return assembled(src.read_documents(spark, path, src.ARTICLE)).select("id", "title", "link", "koza_id", "full_content", "full_content_html", "qanda_content")


@query("z07_cms_sync", "SELECT CAST(doc_id AS VARCHAR) AS id, 't' || doc_id AS title, source AS koza_id, CAST(CASE WHEN doc_id < 50 THEN 7 END AS BIGINT) AS pageviews FROM documents")
def z07(t: Tables):
    from corpuslens.operators.articles import assembled, course_rows
    from corpuslens.plans.jobs import sync_cms
    from corpuslens.queries import as_of
    from corpuslens.sources import tables as src

    spark, path = landed(t, "articles")
    found = src.quarantine(src.read_documents(spark, path, src.ARTICLE))[0]
    spark, path = landed(t, "courses")
    courses = src.quarantine(src.read_documents(spark, path, src.COURSE))[0]
    old = assembled(found).where("CAST(id AS INT) < 50").withColumns({"pageviews": F.lit(7).cast("bigint"), "title": F.lit("old"), "last_synced": as_of()})
    none = course_rows(courses).withColumn("last_synced", as_of()).limit(0)
    return sync_cms(courses, found, none, old, as_of())[1].select("id", "title", "koza_id", "pageviews")


# streams, run over what is there


def replayed(rows, name: str, totals, batches: int = 3):
    """Totals of rows that arrive as files, in no order of time, in about so many batches."""
    from corpuslens.streaming.incremental import run_available

    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    files = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(path)
    kept = totals(new_path(spark, "totals"))
    run_available(stream, new_path(spark, "progress"), kept.take)
    return kept.totals(rows)


@query("x01_daily_page_metrics", "SELECT CAST(ts AS DATE) AS day, page_location, count(*) FILTER (event_name = 'page_view') AS pageviews, count(DISTINCT user_pseudo_id || '-' || ga_session_id) AS sessions FROM v_events GROUP BY 1, 2")
def x01(t: Tables):
    from corpuslens.streaming.incremental import daily_page_metrics

    e = t("v_events").select(F.col("ts").cast("timestamp").alias("ts"), "event_name", "page_location", "user_pseudo_id", "ga_session_id")
    return replayed(e, "events", daily_page_metrics).select(F.to_date("span").alias("day"), "page_location", "pageviews", "sessions")


@query("x02_hourly_usage", "SELECT hour(log_ts) AS hour, CAST(log_ts AS DATE) AS day, provider, count(*) AS requests, round(avg(response_time_ms), 6) AS avg_ms, round(sum(cost_estimate), 6) AS cost, count(*) FILTER (success) AS successes FROM v_usage GROUP BY ALL")
def x02(t: Tables):
    from corpuslens.streaming.incremental import hourly_usage

    rows = replayed(t("v_usage").withColumn("log_ts", F.col("log_ts").cast("timestamp")), "usage", hourly_usage)
    rows = rows.withColumn("avg_ms", F.try_divide("total_ms", "timed"))
    return rows.select(F.hour("span").cast("bigint").alias("hour"), F.to_date("span").alias("day"), "provider", "requests", "avg_ms", "cost", "successes").withColumns(r6("avg_ms", "cost"))
