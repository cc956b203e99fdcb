"""Text cleaning, classification and templates, as column expressions; HTML parsing, NFKC and lists of terms in Arrow functions."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.functions import terms
from corpuslens.functions.markup import texts, tokens
from corpuslens.runtime import ship_to_active

DROPPED = frozenset({"script", "style", "meta", "link", "nav", "footer"})
VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})

# Keywords of fields, in order
FIELD_KEYWORDS = {
    "legal": ["法律", "条文", "規則", "規定", "手続", "申請", "届出", "登録", "許可", "免許", "契約", "権利", "義務", "責任", "損害", "賠償", "処分", "罰則", "違反"],
    "real_estate": ["宅建業法", "重要事項説明", "媒介契約", "売買契約", "賃貸借", "都市計画法", "建築基準法", "区分所有法", "マンション", "管理組合", "修繕", "供託"],
    "finance": ["ライフプランニング", "リスク管理", "金融資産", "タックスプランニング", "相続", "投資信託", "証券", "保険", "年金", "税金", "控除", "所得", "資産運用"],
    "labor": ["労働基準法", "社会保険", "労災", "雇用保険", "年金", "健康保険", "厚生年金", "労働契約", "就業規則", "賃金", "休暇", "解雇", "退職"],
    "technology": ["システム", "データベース", "ネットワーク", "セキュリティ", "プログラミング", "アルゴリズム", "データ構造", "開発", "設計", "テスト", "運用", "保守"],
    "accounting": ["仕訳", "貸借対照表", "損益計算書", "減価償却", "棚卸資産", "固定資産", "流動資産", "負債", "資本", "収益", "費用", "決算", "税務"],
    "trade": ["関税法", "通関業法", "輸出入", "税関", "関税", "貿易", "通関", "検査", "申告", "許可", "承認", "輸出", "輸入", "原産地"],
    "travel": ["旅行業法", "旅行業務", "取扱管理者", "企画旅行", "手配旅行", "旅程管理", "添乗", "宿泊", "運送", "観光", "ツアー", "パッケージ"],
}
# What names of courses contain, by field, in order
FIELD_COURSES = {
    "real_estate": ["宅建", "宅地建物", "マンション管理", "管理業務", "takken", "mankan"],
    "finance": ["fp", "ファイナンシャル", "証券", "年金", "gaimuin", "nenkin"],
    "labor": ["社会保険労務士", "社労士", "sharoushi"],
    "legal": ["行政書士", "司法書士", "gyosei", "shoshi"],
    "technology": ["it", "基本情報", "fe", "システム"],
    "accounting": ["簿記", "boki"],
    "trade": ["通関士", "tsukanshi"],
    "travel": ["旅行", "ryokou"],
    "safety": ["危険物", "kikenbutsu"],
}
# Terms that are marked everywhere, names of fields, patterns
TERMS = ["重要", "注意", "ポイント", "必要", "義務", "権利", "責任", "手続", "申請", "登録", "許可", "免許", "資格", "試験", "法律", "規則", "規定", "基準", "要件", "条件"]
FIELD_NAMES = {"real_estate": "不動産", "finance": "金融・保険", "labor": "労務・社会保険", "legal": "法律", "technology": "IT・技術", "accounting": "会計・簿記", "trade": "貿易・物流", "travel": "旅行・観光", "safety": "安全管理"}
SECTION_WORDS = ["重要", "注意", "ポイント", "必要", "義務", "権利", "法律", "規則"]
LEGAL = r"([^\s]+(?:法|規則|規定|基準|要件|条例))"
ARTICLES = r"([第]?\d+条[の]?\d*(?:第\d+項)?)"
QA = r"Q[:：]\s*([^\n]+(?:\n(?!A[:：])[^\n]*)*)\s*A[:：]\s*([^\n]+(?:\n(?!Q[:：])[^\n]*)*)"


# Fixed values of the law variant: references to articles, marked terms; keywords and names of courses by their id
LAW_ARTICLES = r"([^\s]+法[第]?\d+条[の]?\d*(?:第\d+項)?)"
LAW_TERMS = ["宅建業法", "宅地建物取引士", "重要事項説明", "営業保証金", "供託所", "宅建業者", "媒介契約", "売買契約", "賃貸借契約", "重要事項", "契約書面", "37条書面", "35条書面", "免許", "登録", "更新", "監督処分", "指示処分", "業務停止", "免許取消", "罰則", "行政書士", "社会保険労務士", "ファイナンシャルプランナー", "簿記", "マンション管理士", "管理業務主任者", "司法書士", "通関士"]
COURSE_KEYWORDS = {
    "1": ["行政書士法", "許認可", "官公署", "代理", "代行"],
    "2": ["労働基準法", "社会保険", "労災", "雇用保険", "年金"],
    "3": ["ライフプランニング", "リスク管理", "金融資産", "タックスプランニング", "不動産", "相続"],
    "4": ["宅建業法", "都市計画法", "建築基準法", "重要事項説明", "媒介契約"],
    "5": ["マンション管理適正化法", "区分所有法", "管理組合", "修繕積立金"],
    "6": ["仕訳", "貸借対照表", "損益計算書", "減価償却", "棚卸資産"],
    "26": ["ITパスポート", "情報セキュリティ", "システム開発", "データベース"],
    "27": ["関税法", "通関業法", "輸出入", "税関"],
    "45": ["司法書士法", "不動産登記", "商業登記", "供託"],
    "46": ["アルゴリズム", "データ構造", "プログラミング", "システム設計"],
    "47": ["金融商品取引法", "証券", "投資信託", "デリバティブ"],
}
COURSE_NAMES = {
    "1": "行政書士", "2": "社会保険労務士", "3": "FP（ファイナンシャルプランナー）", "4": "宅建士（宅地建物取引士）", "5": "マンション管理士・管理業務主任者", "6": "簿記2級・3級", "26": "IT（ITパスポート）",
    "27": "通関士", "28": "旅行業務取扱管理者", "39": "年金アドバイザー3級", "40": "危険物取扱者乙種4類", "45": "司法書士", "46": "基本情報技術者", "47": "証券外務員",
}


class _Text(HTMLParser):
    """Pieces of text outside the dropped elements; alt texts of images count as text."""

    def __init__(self, drop: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.drop, self.depth, self.pieces = drop, 0, []

    def handle_starttag(self, tag, attrs):
        if tag in self.drop and tag not in VOID:
            self.depth += 1
        elif tag == "img" and not self.depth and (alt := dict(attrs).get("alt")):
            self.pieces.append(f" {alt} ")

    def handle_endtag(self, tag):
        if tag in self.drop and tag not in VOID and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.depth:
            self.pieces.append(data)


def parsed(markup: str, drop: frozenset[str]) -> list[str]:
    """Pieces of text by the parser, which takes any markup."""
    parser = _Text(drop)
    parser.feed(markup)
    parser.close()
    return parser.pieces


def plain_text(markup: str | None, separator: str = " ", drop: frozenset[str] = DROPPED, nfkc: bool = True) -> str:
    """Text of HTML; with a separator, stripped pieces joined by it."""
    if not markup:
        return ""
    found = tokens(markup)
    pieces = list(texts(found, drop - VOID)) if found is not None else parsed(markup, drop)
    text = html.unescape(separator.join(p for p in (x.strip() for x in pieces) if p) if separator else "".join(pieces))
    return unicodedata.normalize("NFKC", text) if nfkc and not text.isascii() else text


def html_text(markup: Column, separator: str = " ", drop: frozenset[str] = DROPPED, nfkc: bool = True) -> Column:
    """plain_text() of a column, batch by batch; null is empty."""
    ship_to_active()

    @F.pandas_udf(T.StringType())
    def convert(s: pd.Series) -> pd.Series:
        return s.map(lambda x: plain_text(x, separator, drop, nfkc))

    return convert(F.coalesce(markup, F.lit("")))


def strip_tags(text: Column) -> Column:
    """Tags and colour boxes out, eight entities decoded (&amp; first), white space collapsed."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[/?(?:red|blue|green|yellow)box\]", "")
    out = F.regexp_replace(out, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&hellip;", "…"), ("&mdash;", "—")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(out, r"[ \t\n\r\f\u000B]+", " "))


def collapse(text: Column) -> Column:
    """White space of any kind to single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"^ | $", "")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def cut(text: Column, n: int, mark: str = "...") -> Column:
    return let(text, lambda x: F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n - len(mark))), F.lit(mark))).otherwise(x))


def bounded(text: Column, n: int) -> Column:
    """Texts of more than n characters are cut there and marked."""
    return let(text, lambda x: F.when(F.char_length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("...[truncated]"))).otherwise(x))


def simple_text(*parts: Column, limit: int = 8000) -> Column:
    """Fallback enrichment: parts joined, tags out, blanks collapsed, cut."""
    return cut(collapse(F.regexp_replace(F.concat_ws(" ", *parts), r"<[^>]+>", " ")), limit)


def iso_time(text: Column) -> Column:
    return F.try_to_timestamp(text)


def string_id(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def field_of(course_name: Column, course_slug: Column, content: Column, title: Column) -> Column:
    """Subject field: by the course's name or slug, else by most keywords in the text (the first field wins ties), else general."""
    return field_of_lower(F.lower(F.coalesce(course_name, F.lit(""))), F.lower(F.coalesce(course_slug, F.lit(""))), F.lower(F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(title, F.lit("")))))


def field_of_lower(name: Column, slug: Column, text: Column) -> Column:
    """field_of() of lower-case texts."""
    courses = F.array(*[F.struct(F.array(*map(F.lit, ks)).alias("words"), F.lit(f).alias("field")) for f, ks in FIELD_COURSES.items()])
    named = let(F.struct(name.alias("name"), slug.alias("slug")), lambda c: F.filter(courses, lambda w: F.exists(w["words"], lambda k: F.contains(c["name"], k) | F.contains(c["slug"], k))))
    return F.coalesce(F.get(named, F.lit(0))["field"], terms.most_named(text, FIELD_KEYWORDS, "general"))


def _where(text: Column, needle: str, pattern: str, to: str) -> Column:
    """Replacement by a pattern in texts that contain what every match of it does; the others aren't run through it."""
    return let(text, lambda x: F.when(F.contains(x, F.lit(needle)), F.regexp_replace(x, pattern, to)).otherwise(x))


def _where_any(text: Column, needles: list[str], pattern: str, to: str) -> Column:
    """Replacement by a pattern in texts that contain any of what its matches contain one of."""
    some = lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needles])
    return let(text, lambda x: F.when(some(x), F.regexp_replace(x, pattern, to)).otherwise(x))


# What opens a definition, a bullet, a numbered line
DEFINITION, BULLET, NUMBER = r"(?:^|\n)([^\n]{1,50}とは[？?]?)\s*(?:\n|$)", r"(?:^|\n)・([^\n]+)", r"(?:^|\n)(\d+)\.([^\n]+)"
_FLAGS = "(?mdU)"


def _definitions(text: Column) -> Column:
    return _where(text, "とは", _FLAGS + DEFINITION, "\n【$1】\n")


def _lists_and_points(text: Column, words: str) -> Column:
    out = _where(text, "・", _FLAGS + BULLET, "\n- $1")
    out = F.regexp_replace(out, _FLAGS + NUMBER, "\n$1. $2")
    return _where_any(out, words.split("|"), f"{_FLAGS}(?:^|\n)({words})[：:]([^\n]+)", "\n★$1: $2")


def structured(text: Column) -> Column:
    """Definitions, legal terms, article references, bullets, numbers and key points in uniform marks."""
    out = _definitions(text)
    out = let(out, lambda x: F.when(x.rlike("法|規則|規定|基準|要件|条例"), F.regexp_replace(x, _FLAGS + LEGAL, "《$1》")).otherwise(x))
    return _lists_and_points(_where(out, "条", _FLAGS + ARTICLES, "《$1》"), "ポイント|重要|注意|要点|まとめ")


def law_structured(text: Column) -> Column:
    """The law variant of structured(): only whole references to articles of a law are marked, and three words open key points."""
    return _lists_and_points(_where(_definitions(text), "条", _FLAGS + LAW_ARTICLES, "《$1》"), "ポイント|重要|注意")


def course_marks(text: Column, course: Column) -> Column:
    """The keywords of a course put into 【】, one after the other; other courses have none."""
    return terms.marked_by(text, course, COURSE_KEYWORDS)


def course_name(course: Column, known: Column) -> Column:
    """The name of a course: the known one, else that of the list, else one made from its id."""
    names = F.create_map(*[F.lit(x) for item in COURSE_NAMES.items() for x in item])
    return F.coalesce(known, F.try_element_at(names, course), F.concat(F.lit("講座"), course))


def law_terms(text: Column, course: Column, name: Column) -> Column:
    """The terms of the law variant in marks, then the course's name, unless it is only made from the id."""
    out = keyword_marks(text, LAW_TERMS)
    return F.when((F.coalesce(name, F.lit("")) != "") & (name != F.concat(F.lit("講座"), course)), F.replace(out, name, F.concat(F.lit("【"), name, F.lit("】")))).otherwise(out)


def keyword_marks(text: Column, words: list[str]) -> Column:
    """Each word in turn put into 【】 wherever it stands."""
    return terms.marked(text, words)


def structured_qa(text: Column) -> Column:
    """Questions and answers numbered; a text without pairs as it is."""
    pattern = F.lit("(?mdU)" + QA)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("q"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("a"))
    numbered = F.transform(pairs, lambda p, i: F.concat(F.lit("Q"), i + 1, F.lit(": "), collapse(p["q"]), F.lit("\nA"), i + 1, F.lit(": "), collapse(p["a"])))
    return F.when(F.size(pairs) > 0, F.array_join(numbered, "\n")).otherwise(text)


def enhanced_terms(text: Column, field: Column) -> Column:
    """The field's keywords, then the common terms, in marks; sequential, so terms in both are marked twice."""
    return terms.marked_by(text, field, FIELD_KEYWORDS, TERMS)


def labelled(title: Column, course: Column, field: Column, content: Column, qa: Column) -> Column:
    """Parts that aren't empty, labelled and parted by blank lines."""
    name = F.lit(None).cast("string")
    for f, n in FIELD_NAMES.items():
        name = F.when(field == f, n).otherwise(name)
    part = lambda label, c: let(F.btrim(c), lambda x: F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit(label), x)))
    return F.concat_ws("\n\n", part("タイトル: ", title), F.when(F.coalesce(course, F.lit("")) != "", F.concat(F.lit("講座: "), course)), F.when(field != "general", F.concat(F.lit("分野: "), F.coalesce(name, field))), part("内容: ", content), part("Q&A: ", qa))


def normalised(text: Column) -> Column:
    """Decoration, repeated signs, URLs and addresses out; blank lines and blanks squeezed."""
    text = let(text, lambda x: F.when(x.rlike("[\u203b\u25a0-\u2606]"), F.regexp_replace(x, "[◆◇■□●○▲△▼▽★☆※]", "")).otherwise(x))
    text = _where_any(text, list("！？。、"), "[！？]{2,}|[。、]{2,}", "")
    text = _where(text, "://", r"(?U)https?://[^\s]+", "")
    # a match begins where a run of such characters does, or where the match before has ended: no run is tried from each of its places
    text = _where(text, "@", r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "")
    text = F.regexp_replace(text, r"(?U)\n\s*\n\s*\n+", "\n\n")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), "\n ", "\n")


def section_priority(section: Column) -> Column:
    """What a section is worth when a text must be cut."""
    words = sum((F.floor((F.char_length(section) - F.char_length(F.replace(section, F.lit(f"【{w}】"), F.lit("")))) / len(f"【{w}】")) * 10 for w in SECTION_WORDS), F.lit(0))
    return (
        F.when(F.startswith(section, F.lit("タイトル:")), 100).otherwise(0) + F.when(F.startswith(section, F.lit("講座:")) | F.startswith(section, F.lit("分野:")), 90).otherwise(0) + words
        + F.regexp_count(section, F.lit("(?U)" + ARTICLES)) * 5 + F.when(F.contains(section, F.lit("Q:")) | F.contains(section, F.lit("A:")), 20).otherwise(0) + F.least(F.floor(F.char_length(section) / 100), F.lit(10))
    )


def priority_cut(text: Column, limit: int = 8000) -> Column:
    """Longer texts keep their sections in order of priority (ties in order of place) as long as they fit, and a part of the next if over 100 characters are left."""
    sections = F.transform(F.split(text, "\n\n"), lambda s, i: F.struct((-section_priority(s)).alias("minus"), i.alias("i"), s.alias("s")))
    start = F.struct(F.lit("").alias("out"), F.lit(False).alias("full"))

    def step(acc: Column, x: Column) -> Column:
        fits = F.char_length(acc["out"]) + F.char_length(x["s"]) + 2 <= limit
        left = limit - F.char_length(acc["out"])
        part = F.when(left > 100, F.concat(acc["out"], F.left(x["s"], left - 10), F.lit("..."))).otherwise(acc["out"])
        return F.struct(F.when(acc["full"], acc["out"]).when(fits, F.concat(acc["out"], x["s"], F.lit("\n\n"))).otherwise(part).alias("out"), (acc["full"] | ~fits).alias("full"))

    best = F.aggregate(F.array_sort(sections), start, step, lambda a: a["out"])
    return F.when(F.char_length(text) > limit, F.regexp_replace(best, r"(?U)^\s+|\s+$", "")).otherwise(text)


def enriched(df: DataFrame, limit: int = 8000, to: str = "embedding_text") -> DataFrame:
    """df (title, full_content, qanda_content, course_name, course_slug) with the text that is turned into a vector, and field_type."""
    empty = F.lit("")
    out = df.withColumns({"__c": html_text(F.col("full_content"), ""), "__q": html_text(F.col("qanda_content"), ""), "__t": F.coalesce("title", empty)})
    low = lambda c: F.lower(F.coalesce(c, empty))
    out = out.withColumns({"__n": low("course_name"), "__s": low("course_slug"), "__l": F.lower(F.concat("__c", F.lit(" "), "__t"))})
    out = out.withColumn("field_type", field_of_lower(F.col("__n"), F.col("__s"), F.col("__l")))
    # what is used more than once below is a column first, so that it is computed once a row
    out = out.withColumns({"__c": structured(F.col("__c")), "__q": structured_qa(F.col("__q"))}).withColumn("__c", enhanced_terms(F.col("__c"), F.col("field_type")))
    out = out.withColumn(to, normalised(labelled(F.col("__t"), F.col("course_name"), F.col("field_type"), F.col("__c"), F.col("__q"))))
    out = out.withColumn(to, priority_cut(F.col(to), limit)).withColumn(to, F.regexp_replace(to, r"(?U)^\s+|\s+$", ""))
    short = simple_text(F.col("__t"), F.coalesce("full_content", empty), F.coalesce("qanda_content", empty), limit=limit)
    return out.withColumn(to, F.when(F.char_length(to) < 50, short).otherwise(F.col(to))).drop("__c", "__q", "__t", "__n", "__s", "__l")


def text_stats(before: Column, after: Column) -> dict[str, Column]:
    """Lengths, ratio, flags and counts of an enrichment."""
    n, m = F.char_length(F.coalesce(before, F.lit(""))), F.char_length(F.coalesce(after, F.lit("")))
    return {
        "original_length": n, "processed_length": m, "compression_ratio": F.when(n > 0, m / n).otherwise(F.lit(0.0)), "has_questions": F.coalesce(after, F.lit("")).rlike("Q[0-9]*:"),
        "questions": F.regexp_count(F.coalesce(after, F.lit("")), F.lit("Q[0-9]*:")), "emphasised": F.regexp_count(F.coalesce(after, F.lit("")), F.lit("【[^】]*】")),
    }


def sentence_cut(text: Column, n: int = 1500, mark: str = "。") -> Column:
    """Tags out, cut at n, back to the last full stop if that is beyond four fifths, with dots."""

    def back(head: Column) -> Column:
        last = n - F.instr(F.reverse(head), mark) + 1
        return F.when((F.instr(head, mark) > 0) & (last > n * 0.8), F.substring(head, F.lit(1), last)).otherwise(head)

    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", ""))
    return let(plain, lambda x: F.when(F.char_length(x) <= n, x).otherwise(F.concat(let(F.left(x, F.lit(n)), back), F.lit("..."))))


def chunk_text(article_title: Column, section: Column, text: Column) -> Column:
    return F.concat(F.lit("記事タイトル: "), article_title, F.lit("\nセクション: "), section, F.lit("\n\n"), text)


def pair_prompt(a_title: Column, b_title: Column, a_text: Column, b_text: Column, n: int = 1500) -> Column:
    """Prompt that asks how two articles overlap."""
    return F.concat(F.lit("Article A: "), a_title, F.lit("\n"), sentence_cut(a_text, n), F.lit("\n\nArticle B: "), b_title, F.lit("\n"), sentence_cut(b_text, n), F.lit("\n\nWhere do the two overlap, and what should be done?"))


def pair_sentence(a_title: Column, b_title: Column, score: Column, action: Column) -> Column:
    """One templated sentence on a cached pair."""
    return F.concat(a_title, F.lit(" / "), b_title, F.lit(": "), F.format_string("%.1f", score * 100), F.lit("% "), action)


def cache_prompt(a_title: Column, a_course: Column, a_views: Column, b_title: Column, b_course: Column, b_views: Column, score: Column, action: Column) -> Column:
    """Prompt that asks for a short reason to carry out an action on a cached pair."""

    def side(name: str, title: Column, course: Column, views: Column) -> list[Column]:
        return [F.lit(f"{name}\n- title: "), F.coalesce(title, F.lit("")), F.lit("\n- course: "), F.coalesce(course, F.lit("N/A")), F.lit("\n- views a month: "), F.format_number(F.coalesce(views, F.lit(0)).cast("bigint"), 0), F.lit("\n")]

    end = [F.lit("- similarity: "), F.format_string("%.3f", score), F.lit("\nAction: "), action, F.lit("\nSay in at most 150 characters why it helps, what it does for search results, and what to watch out for.")]
    return F.concat(*side("Base article", a_title, a_course, a_views), *side("Similar article", b_title, b_course, b_views), *end)


def display_views(n: Column) -> Column:
    return F.when(n >= 1_000_000, F.concat(F.format_string("%.1f", n / 1_000_000), F.lit("M"))).when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("K"))).otherwise(n.cast("string"))


def highlighted(text: Column, query: str) -> Column:
    """Hits of a query, in any case, in marks; nothing for an empty one."""
    import re

    return text if not query else F.regexp_replace(text, f"(?iu)({re.escape(query)})", "<mark>$1</mark>")


def tags(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))
