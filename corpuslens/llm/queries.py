"""The registered queries of the operators here, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuslens.llm import bpe, codes, decontam, dedup, langid, neardup, resample, secrets, token_counts, toxicity, vectordup, warc, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


ORACLE_SQL["op8_decontamination"] = r"""
WITH dw AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM bn)),
ks AS (SELECT DISTINCT k FROM wins),
dwin AS (SELECT doc_id, k, j, array_to_string(w[j:j + k - 1], ' ') AS win
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS j FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT d.doc_id, d.k, d.j, x.item_id FROM dwin d JOIN wins x ON d.k = x.k AND d.win = x.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + k)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    done = bpe.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern)
    return done.select("doc_id", bpe.count().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_token_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = wavelet.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, words_apart=True)
    return docs.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op4_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


ORACLE_SQL["op4_minhash_neardup"] = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) = 1 THEN w
             ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n, sh FROM s),
u AS (SELECT doc_id, n, unnest(sh) AS x FROM n),
f AS (SELECT x FROM u GROUP BY x HAVING count(*) > 1),
v AS (SELECT doc_id, n, x FROM u SEMI JOIN f USING (x)),
links AS (SELECT a.doc_id AS p, b.doc_id AS q FROM v a JOIN v b ON a.x = b.x AND a.doc_id < b.doc_id
          WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT p, q FROM links UNION SELECT q, p FROM links),
reach(id, r) AS (SELECT p, p FROM e UNION SELECT reach.id, e.q FROM reach JOIN e ON e.p = reach.r),
c AS (SELECT id, min(r) AS m FROM reach GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(c.m, n.doc_id) AS component_id, coalesce(c.m, n.doc_id) = n.doc_id AS kept
FROM n LEFT JOIN c ON c.id = n.doc_id
"""


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("locator")


ORACLE_SQL["op10_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS p FROM documents),
g AS (SELECT p, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM t GROUP BY p)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(p) AS text_sha256 FROM t JOIN g USING (p)
"""


def fold(parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), train=fold(3) != 1)
    found = toxicity.score(docs, model)
    return found.select("doc_id", (fold(3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic").cast("int").alias("predicted"), F.col("toxic_segments").alias("segments"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.select("doc_id", "text", "lang"), train=fold(4) != 2)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_parts").alias("parts"))


@query
def op2_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), payloads=False)
    return found.where("reason IS NULL").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op2_warc_salvage"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN last <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN last <> page_id THEN last END AS refers_to
FROM p LEFT JOIN g USING (h)
"""


@query
def op9_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *[count(k) for k in secrets.BASE], F.sha2(secrets.listed(base).cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


ORACLE_SQL["op9_secret_links"] = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(f"SELECT doc_id, {_sql(k)} AS kind, {i} AS rank, regexp_extract_all(text, {_sql(p)}) AS ms, string_split_regex(text, {_sql(p)}) AS ps FROM t" for i, (k, p) in enumerate(secrets.PATTERNS.items()))}),
r AS (SELECT doc_id, kind, rank, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM m WHERE len(ms) > 0),
h AS (SELECT doc_id, kind, rank, i, ms[i] AS s, length(ps[i]) AS gap, length(ms[i]) AS n FROM r),
c AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM h),
v AS (SELECT doc_id, kind, rank, CAST(e - n AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM c
      WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(s, {_sql(secrets.PATTERNS["assign"])}, 2)) >= 6
                      WHEN 'access' THEN n >= 20 WHEN 'hex' THEN n >= 24
                      WHEN 'secret' THEN regexp_matches(s, '[a-z]') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[0-9]') ELSE true END),
base AS (SELECT * FROM v WHERE rank < 3),
weak AS (SELECT w.* FROM v w WHERE w.rank >= 3
    AND EXISTS (SELECT 1 FROM v o WHERE o.doc_id = w.doc_id AND greatest(o.b, w.b) - least(o.e, w.e) BETWEEN 0 AND {secrets.SCOPE}
        AND CASE w.kind WHEN 'secret' THEN o.kind IN ('access', 'ident', 'endpoint') ELSE o.kind IN ('assign', 'hex', 'secret') END)
    AND NOT EXISTS (SELECT 1 FROM base o WHERE o.doc_id = w.doc_id AND greatest(o.b, w.b) < least(o.e, w.e))),
a AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (rank < 3) AS bs,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM a GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(bs, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (doc_id)
"""


@query
def op7_edit_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document before and after its runs of four or more digits are masked."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", token_counts.replacements("text", "[0-9]{4,}", "<number>"))
    built = token_counts.build(docs, path, pattern).withColumn("n_before", F.col("n_tokens"))
    return token_counts.edit(built, path, pattern).select("doc_id", "n_before", F.size("edits").cast("bigint").alias("n_edits"), F.col("n_tokens").alias("n_after"), "n_encoded")


@query
def op11_vector_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


ORACLE_SQL["op11_vector_neardup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id AS p, b.vec_id AS q FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(id, r) AS (SELECT p, p FROM l UNION SELECT reach.id, l.q FROM reach JOIN l ON l.p = reach.r),
c AS (SELECT id, min(r) AS m FROM reach GROUP BY id),
n AS (SELECT p, count(*) AS n FROM l GROUP BY p)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.m, e.vec_id) AS component_id, coalesce(c.m, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.p = e.vec_id LEFT JOIN c ON c.id = e.vec_id
"""


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def _rounds_sql(rounds: int) -> str:
    """Codebooks b0, b1, ... and the parts' nearest entries a0, a1, ... (key: squared distance * 256 + entry)."""
    out = ["b0 AS MATERIALIZED (SELECT part, rank - 1 AS entry, pos, x FROM p WHERE rank <= 256)"]
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) AS key FROM (
            SELECT p.vec_id, p.part, b.entry, CAST(sum((p.x - b.x) * (p.x - b.x)) AS BIGINT) AS d FROM p JOIN b{k} b ON b.part = p.part AND b.pos = p.pos GROUP BY ALL) GROUP BY ALL)""")
        if k < rounds:
            out.append(f"""m{k} AS (SELECT part, key % 256 AS entry, pos, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM a{k} JOIN p USING (vec_id, part) GROUP BY ALL),
            b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return ",\n".join(out)


ORACLE_SQL["op13_vector_codes"] = f"""
WITH k AS (SELECT vec_id, label, embedding AS e, row_number() OVER (ORDER BY vec_id) AS rank FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
i AS (SELECT vec_id, rank, len(e) // 4 AS width, unnest(range(len(e))) AS j, unnest(e) AS y FROM k),
p AS MATERIALIZED (SELECT vec_id, rank, j // width AS part, j % width AS pos, CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT) AS x FROM i),
{_rounds_sql(codes.ROUNDS)},
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS h FROM b{codes.ROUNDS}),
c AS (SELECT vec_id, string_agg(format('{{:02x}}', key % 256), '' ORDER BY part) AS code, CAST(sum(key // 256) AS BIGINT) AS error FROM a{codes.ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM k JOIN c USING (vec_id), h
"""
