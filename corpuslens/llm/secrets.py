"""Secrets in texts, with credentials linked from their parts; DataFrame functions only.

Base kinds are reported wherever they match. Weak kinds (identifiers, long mixed tokens, endpoints) are reported only if
a complementary part stands within SCOPE code points of them in the same text and no base span overlaps them: an
interval join of all spans on text and bucket of places. Places come from cutting a text at a kind's matches and
summing up the lengths of what is between.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.runtime import materialise

#: kind -> pattern (leftmost matches that don't overlap), in the order in which equal starts are listed
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "ident": r"""(?i)(access_?key_?id|client_?id|account_?id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}""",
    "secret": r"[A-Za-z0-9+/_-]{32,}",
    "endpoint": r"(?i)(https?|postgres|postgresql|mysql|redis|amqp)://[A-Za-z0-9._~:/?#@!$&*+,;=%-]+",
}
BASE = ("assign", "access", "hex")
#: role of a kind, and the roles that complete a weak one
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "ident": "id", "secret": "secret", "endpoint": "endpoint"}
COMPLETES = {"ident": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}
SCOPE = 400
#: of hex and access, only what can be long enough is looked for; the runs are maximal, so these are the same matches
_SEARCH = PATTERNS | {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}


def _by_kind(of) -> Column:
    first, *rest = PATTERNS
    return reduce(lambda c, k: c.when(F.col("kind") == k, of(k)), rest, F.when(F.col("kind") == first, of(first)))


def _passes(kind: str) -> Column:
    match = F.col("hit.match")
    if kind == "assign":
        return F.char_length(F.regexp_extract(match, PATTERNS[kind], 2)) >= 6
    if kind == "secret":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def find_spans(docs: DataFrame) -> DataFrame:
    """doc_id, copy (hash of the text, so that rows that repeat a doc_id stay apart), kind, start, end (code points, end exclusive) of all candidates."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(text, F.lit(_SEARCH[k]), F.lit(0)).alias("matches")) for k in PATTERNS])
    rows = docs.select("doc_id", "text", F.explode(F.filter(found, lambda x: F.size(x["matches"]) > 0)).alias("found"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("copy"), "found.kind", "found.matches", "text")
    cut = _by_kind(lambda k: F.split("text", _SEARCH[k], -1))
    hits = F.zip_with("matches", F.slice(cut, F.lit(1), F.size("matches")), lambda m, p: F.struct(m.alias("match"), F.char_length(p).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("len")))
    rows = rows.select("doc_id", "copy", "kind", F.posexplode(hits).alias("pos", "hit"))
    rows = rows.select("doc_id", "copy", "kind", "pos", "hit.gap", "hit.len", _by_kind(_passes).alias("passes")).distinct()
    through = Window.partitionBy("doc_id", "copy", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(through))
    return rows.where("passes").select("doc_id", "copy", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def linked(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak spans that a complementary part completes and no base span overlaps, with those parts (kind, start, end) in links.

    Both sides of the join are dealt out by text and by the buckets of scope places that they reach, so a bucket holds
    few spans whatever the length of the text.
    """
    keys = ["doc_id", "copy"]
    role = _by_kind(lambda k: F.lit(ROLE[k]))
    reach = lambda a, b: F.sequence(F.floor(a / scope), F.floor(b / scope))
    weak = spans.where(~F.col("kind").isin(*BASE)).withColumn("bucket", F.explode(reach(F.greatest(F.col("start") - scope, F.lit(0)), F.col("end") + scope)))
    other = spans.select(*[F.col(k) for k in keys], F.col("start").alias("start2"), F.col("end").alias("end2"), role.alias("role2"), F.col("kind").alias("kind2"), F.col("kind").isin(*BASE).alias("base2")).withColumn("bucket", F.explode(reach(F.col("start2"), F.col("end2"))))
    near = weak.join(other.withColumnRenamed("doc_id", "doc_id2").withColumnRenamed("copy", "copy2").withColumnRenamed("bucket", "bucket2"), F.col("doc_id").eqNullSafe(F.col("doc_id2")) & F.col("copy").eqNullSafe(F.col("copy2")) & (F.col("bucket") == F.col("bucket2")))
    gap = F.greatest("start", "start2") - F.least("end", "end2")
    completes = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("role2").isin(*roles) for k, roles in COMPLETES.items()])
    part = F.when((gap >= 0) & (gap <= scope) & completes, F.struct(F.col("kind2").alias("kind"), F.col("start2").alias("start"), F.col("end2").alias("end")))
    # no more than what fits into the scope on either side of a span
    judged = near.groupBy(*keys, "kind", "start", "end").agg(F.array_sort(F.collect_set(part)).alias("links"), F.max(F.col("base2") & (gap < 0)).alias("covered"))
    return judged.where((F.size("links") > 0) & ~F.col("covered")).select(*keys, "kind", "start", "end", "links")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Row of docs (doc_id, text) -> doc_id, spans: array of (start, rank, kind, end, links) by start, then kind in the order of PATTERNS.

    links: the parts (kind, start, end) that complete a weak span; none for base spans.

    Null and empty texts have no spans, repeated rows have the same ones each, other columns are ignored, an empty table
    gives no row.
    """
    spans = materialise(find_spans(docs), "spans")
    weak = linked(spans, scope)
    kept = spans.where(F.col("kind").isin(*BASE)).withColumn("links", F.array().cast(weak.schema["links"].dataType)).unionByName(weak)
    rank = _by_kind(lambda k: F.lit(list(PATTERNS).index(k)))
    by_doc = kept.groupBy("doc_id", "copy").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "links"))).alias("spans"))
    by_doc = by_doc.select(F.col("doc_id").alias("doc_id2"), F.col("copy").alias("copy2"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("copy"))
    out = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("doc_id2")) & F.col("copy").eqNullSafe(F.col("copy2")), "left")
    return out.select("doc_id", F.coalesce("spans", F.array().cast(by_doc.schema["spans"].dataType)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
