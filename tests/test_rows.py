"""Rows of queries that SQL can't express, by plain loops over the whole tables; markup against the parser."""

import decimal
import random
import re
import unicodedata

import pytest

import html as entities
from corpuslens import queries
from corpuslens.fixtures import view
from corpuslens.functions import markup
from corpuslens.functions import text as tx
from corpuslens.operators import chunking, recommend

from oracle import SF

queries.load()
SPACE = chunking.SPACE
SPACES = f"[{SPACE}]"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


# markup


@pytest.fixture
def by_parser(monkeypatch):
    """plain_text() and sections() as the parser of the standard library alone gives them."""

    def run(f):
        with monkeypatch.context() as m:
            m.setattr(tx, "tokens", lambda x: None)
            m.setattr(chunking, "tokens", lambda x: None)
            return f()

    return run


ARGUMENTS = [(" ", tx.DROPPED, True), ("", frozenset(), False), (" ", frozenset(), False)]


def test_all_pages_are_read_as_by_the_parser(spark, by_parser):
    pages = [r.html for r in table(spark, "pages")]
    assert sum(markup.tokens(p or "") is not None for p in pages) > 0.9 * len(pages)
    read = lambda: [[tx.plain_text(p, *a) for a in ARGUMENTS] + [chunking.sections(p, r) for r in ("article", "fragment")] for p in pages]
    assert read() == by_parser(read)


BITS = ["<p>", "</p>", "<h1>", "</h1>", '<H2 class="a">', "</h2 >", "<br>", "<br/>", '<img alt="x &amp; y">', "<img ALT='q'>", '<img src="a" alt="b"/>', "<script>", "</script>", "</SCRIPT >", "</ script>", "<style>", "</style>", "<nav>", "</nav>", "<nav/>", "<article>", "</article>", "<div id=x>", '<div id="x" hidden>', "</div>", "<!-- c -->", "<!-- > -->", "<!---->", "<!-->", "<!--->", "<!-- -- >", "<!DOCTYPE html>", "<![CDATA[x]]>", "<?pi?>", "<!x>", "<", "</", "< b", "</>", "a", "text ", "&amp;", "&amp", "&", "&#65;", "&#65", "&#x41;", "&lt;b&gt;", "&nosuch;", "\n", "ｃ", "\xa0", '"', '<a href="x>y">', '<a href="x"title="y">', "</p x>", "<p", "<a-b>", "<title>", "</title>", "\x00", "<b\n>", "-->"]


def test_broken_markup_is_read_as_by_the_parser(by_parser):
    rng = random.Random(0)
    pages = ["".join(rng.choices(BITS, k=rng.randrange(1, 13))) for _ in range(8000)]
    regular = sum(markup.tokens(p) is not None for p in pages)
    assert 500 < regular < 7500
    read = lambda: [[tx.plain_text(p, *a) for a in ARGUMENTS] + [chunking.sections(p, r) for r in ("article", "fragment", "p")] for p in pages]
    assert read() == by_parser(read)


def test_html_queries(spark, by_parser):
    """t01 to t03, c01 and c02 over all pages."""
    pages = {r.page_id: r.html for r in table(spark, "pages")}
    for name, a in (("t01_html_text", (" ", frozenset(), False)), ("t02_html_text_chunks", ()), ("t03_html_text_plain", ("",))):
        got = {r.page_id: r.text for r in queries.QUERIES[name](spark, SF).collect()}
        assert got == by_parser(lambda: {i: tx.plain_text(p, *a) for i, p in pages.items()})  # noqa: B023
    for name, root in (("c01_split_sections", "article"), ("c02_fragment_sections", "fragment")):
        got = sorted((r.id, r.pos, r.title, r.text) for r in queries.QUERIES[name](spark, SF).collect())
        assert got == by_parser(lambda: sorted((str(i), k, *s) for i, p in pages.items() for k, s in enumerate(chunking.sections(p, root))))  # noqa: B023


# chunks


def chunks_by_loops(page, old):
    """The chunks of a page: title and text."""
    least, most, overlap = (300, 1500, 50) if old else (chunking.MIN, chunking.MAX, chunking.OVERLAP)
    merged = []
    for pos, (title, text) in enumerate(chunking.sections(page, "article")):
        text = text.strip(SPACE)
        if len(text) >= least or (not old and pos == 0):
            merged.append((title, text))
        elif merged:
            merged[-1] = (merged[-1][0], merged[-1][1] + f"\n\n{title}\n{text}")
    parts = []
    for title, text in merged:
        if len(text) <= most:
            parts.append((title, text))
            continue
        pieces = []
        ended = lambda s: s if s.endswith("。") else s + "。"
        if old or "\n" not in text:
            pieces = [("\n", ended(s)) for s in text.split("。") if re.sub(SPACES, "", s)]
        else:
            for line in text.split("\n"):
                line = line.strip(SPACE)
                if len(line) > most:
                    pieces += [(" ", ended(s)) for s in line.split("。") if s]
                elif line:
                    pieces.append(("\n", line))
        now, done = "", []
        for joiner, piece in pieces:
            if now and len(now) + len(piece) > most:
                done.append(now)
                now = ""
            now = now + joiner + piece if now else piece
        parts += [(f"{title} (パート{i + 1})", p.strip(SPACE)) for i, p in enumerate([*done, now] if now else done)]
    out = []
    for i, (title, text) in enumerate(parts):
        head = tail = ""
        if i and not old:
            before = parts[i - 1][1]
            s = before.split("。")
            joined = "。".join(x for x in (s[-3:] if len(s) >= 3 else s) if re.sub(SPACES, "", x)) + "。"
            head = (joined if len(s) > 1 and len(joined) <= overlap else before[-overlap:]) + " "
        if i + 1 < len(parts):
            first = parts[i + 1][1].split("。")[0]
            first = first + "。" if first else first
            tail = " " + (first if len(first) <= overlap // 2 else parts[i + 1][1][: overlap // 2])
        if (head + text + tail).strip(SPACE):
            out.append((i, title, head + text + tail))
    return out


@pytest.mark.parametrize("name, old", [("c06_chunks_v1", True), ("c07_chunks", False)])
def test_chunk_queries(spark, name, old):
    got = sorted((r.article_id, r.chunk_index, r.chunk_title, r.chunk_text) for r in queries.QUERIES[name](spark, SF).collect())
    want = sorted((str(r.page_id), i, title, text) for r in table(spark, "pages") for i, title, text in chunks_by_loops(r.html, old))
    assert got == want and len(got) > 40
    assert all(r.chunk_id == f"{r.article_id}_{r.chunk_index}" for r in queries.QUERIES[name](spark, SF).collect())


# enrichment

LINE = "(?:^|(?<=\n)|\n)"


def marked(text, words):
    for w in words:
        text = text.replace(w, f"【{w}】")
    return text


def enriched_by_loops(title, content, course, limit=8000):
    plain = unicodedata.normalize("NFKC", entities.unescape(tx.plain_text(content, "", nfkc=False)))
    low = f"{plain} {title}".lower()
    named = [f for f, ks in tx.FIELD_COURSES.items() if any(k in course.lower() for k in ks)]
    counts = {f: sum(k in low for k in ks) for f, ks in tx.FIELD_KEYWORDS.items()}
    best = max(counts, key=counts.get)
    field = named[0] if named else best if counts[best] else "general"
    space, line = f"[^{SPACE}]", r"(?:^|\n)"
    x = re.sub(line + rf"([^\n]{{1,50}}とは[？?]?){SPACES}*(?:\n|$)", "\n【\\1】\n", plain, flags=re.M)
    x = re.sub(rf"({space}+(?:法|規則|規定|基準|要件|条例))", r"《\1》", x)
    x = re.sub(r"([第]?\d+条[の]?\d*(?:第\d+項)?)", r"《\1》", x)
    x = re.sub(line + r"・([^\n]+)", "\n- \\1", x, flags=re.M)
    x = re.sub(line + r"(\d+)\.([^\n]+)", "\n\\1. \\2", x, flags=re.M)
    x = re.sub(line + r"(ポイント|重要|注意|要点|まとめ)[：:]([^\n]+)", "\n★\\1: \\2", x, flags=re.M)
    x = marked(marked(x, tx.FIELD_KEYWORDS.get(field, [])), tx.TERMS)
    parts = [f"タイトル: {title.strip(' ')}"] if title.strip(" ") else []
    parts += [f"講座: {course}"] if course else []
    parts += [f"分野: {tx.FIELD_NAMES.get(field, field)}"] if field != "general" else []
    parts += [f"内容: {x.strip(' ')}"] if x.strip(" ") else []
    x = "\n\n".join(parts)
    x = re.sub("[◆◇■□●○▲△▼▽★☆※]", "", x)
    x = re.sub("[！？]{2,}|[。、]{2,}", "", x)
    x = re.sub(rf"https?://{space}+", "", x)
    x = re.sub(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "", x)
    x = re.sub(rf"\n{SPACES}*\n{SPACES}*\n+", "\n\n", x)
    x = re.sub("[ \t]+", " ", x).replace("\n ", "\n")
    if len(x) > limit:
        value = lambda s: 100 * s.startswith("タイトル:") + 90 * s.startswith(("講座:", "分野:")) + sum(s.count(f"【{w}】") * 10 for w in tx.SECTION_WORDS) + 5 * len(re.findall(r"[第]?\d+条[の]?\d*(?:第\d+項)?", s)) + 20 * ("Q:" in s or "A:" in s) + min(len(s) // 100, 10)
        out, full = "", False
        for s in sorted(x.split("\n\n"), key=lambda s: -value(s)):
            if full:
                break
            if len(out) + len(s) + 2 <= limit:
                out += s + "\n\n"
            else:
                full, left = True, limit - len(out)
                out = out + s[: left - 10] + "..." if left > 100 else out
        x = out.strip(SPACE)
    x = x.strip(SPACE)
    if len(x) < 50:
        y = re.sub(rf"{SPACES}+", " ", re.sub(r"<[^>]+>", " ", f"{title} {content} ")).strip(" ")
        x = y if len(y) <= limit else y[: limit - 3] + "..."
    return field, x


def test_enriched_texts(spark):
    """t23 over all documents, and documents that meet each rule."""
    from pyspark.sql import functions as F

    rows = [(r.doc_id, r.lang or "", r.text or "", r.source or "") for r in table(spark, "documents")]
    got = {r.doc_id: (r.field_type, r.embedding_text) for r in queries.QUERIES["t23_enriched"](spark, SF).collect()}
    for d, lang, text, source in rows:
        assert got[d] == enriched_by_loops(lang, text, source), d
    rng = random.Random(6)
    words = ["宅建業法", "重要：年金\n", "\n・一つ\n", "\n1.二つ\n", "簿記とは？\n", "第35条の2第1項", "税関と通関", "a@b.com.x@y.zz", "x.y@q", "http://a.b/c ", "！！", "★", "\n\n\n\n", "  ", "Q: a\nA: b\n\n", "<b>太字</b>", "&amp;", "登録", "言葉。、", "text " * 40, "\n\n" + "長い文。" * 700]
    odd = [("題", "".join(rng.choices(words, k=rng.randrange(1, 14))), rng.choice(["FP講座", "", "src1"])) for _ in range(120)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(odd)], "i int, title string, full_content string, course_name string").withColumns({"qanda_content": F.lit(""), "course_slug": F.col("course_name")})
    for r in tx.enriched(df).collect():
        assert (r.field_type, r.embedding_text) == enriched_by_loops(*odd[r.i]), odd[r.i]


# explanations and groups


def half_up(x, digits):
    """As Java formats a double."""
    return str(decimal.Decimal(repr(x)).quantize(decimal.Decimal(1).scaleb(-digits), decimal.ROUND_HALF_UP))


def test_explanations(spark):
    rows = {}
    for r in view(spark, SF, "v_cache").collect():
        n, m = int(r.base_article_id), int(r.similar_article_id)
        rows[f"{n}-{m}"] = (0.5 + r.similarity_score / 2, n % 11 / 10.0, m % 2 == 0, n * 7, m * 11)
    got = queries.QUERIES["r13_explanations"](spark, SF).collect()
    assert len(got) == len(rows) and len({r.rule for r in got}) > 5
    for r in got:
        score, ratio, same, base, similar = rows[r.pair]
        notes = recommend.COURSE_NOTES.get(r.rule, ("", ""))
        if r.rule == "merge_any":
            advice = recommend.MERGE_ADVICE[0] % similar if similar > base else recommend.MERGE_ADVICE[1] % base
        else:
            advice = recommend.REDIRECT_ADVICE[0] % similar if similar > 2 * base else recommend.REDIRECT_ADVICE[1] % base
        want = recommend.EXPLANATIONS[r.rule]
        for i, v in enumerate((half_up(score * 100, 1), half_up(ratio * 100, 0), "3", notes[0] if same else notes[1], advice)):
            want = want.replace(f"{{{i}}}", v)
        assert r.explanation == want


def test_groups_and_their_summaries(spark):
    from test_rules import greedy

    pairs = sorted({(r.base_article_id, r.similar_article_id, r.similarity_score) for r in view(spark, SF, "v_cache").collect() if r.similarity_score >= 0.8})
    courses = {r.id: r.koza_id for r in view(spark, SF, "v_articles").select("id", "koza_id").collect()}
    want = greedy(pairs)
    found: dict = {}
    for r in queries.QUERIES["g02_one_hop_groups"](spark, SF).collect():
        found.setdefault(r.group, []).append((r.a, r.b))
    assert {k: sorted(v) for k, v in found.items()} == want and len(want) > 20
    by_pair = {(a, b): s for a, b, s in pairs}
    got = {r.group: r for r in queries.QUERIES["g04_group_summary"](spark, SF).collect()}
    assert set(got) == set(want)
    for group, members in want.items():
        r, ids = got[group], sorted({v for p in members for v in p})
        mean = sum(by_pair[p] for p in members) / len(members)
        known = {courses[i] for i in ids if courses.get(i) is not None}
        benefits = [t for t, yes in zip(recommend_benefits(), (mean > 0.9, len(known) > 1, len(ids) >= 3), strict=True) if yes]
        assert (r.members, r.n, r.courses, r.strategy, r.benefits) == (",".join(ids), len(ids), len(known), "same_course" if len(known) == 1 else "cross_course", ",".join(benefits))
        assert r.mean_similarity == pytest.approx(mean, abs=1e-6) and (r.priority == ("high" if mean > 0.9 else "medium" if mean > 0.8 else "low") or min(abs(mean - 0.9), abs(mean - 0.8)) < 1e-9)


def recommend_benefits():
    from corpuslens.operators.grouping import BENEFITS

    return BENEFITS


def test_an_append_can_be_repeated(spark, tmp_path):
    from corpuslens.sources import tables

    rows = spark.range(5)
    for batch in ("a", "b", "b"):
        tables.append(rows, f"{tmp_path}/t", batch)
    got = tables.read_table(spark, f"{tmp_path}/t")
    assert got.count() == 10 and {r.batch for r in got.collect()} == {"a", "b"}
    tables.append(rows, f"{tmp_path}/plain")
    tables.append(rows, f"{tmp_path}/plain")
    assert tables.read_table(spark, f"{tmp_path}/plain").count() == 10
