"""Articles split into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslens.functions.markup import BOTH, END, START, TEXT, referenced, tokens
from corpuslens.functions.text import HEADINGS, VOID, collapse, plain_text
from corpuslens.runtime import ship_package

MIN, MAX, OVERLAP = 200, 800, 100
FIRST = "冒頭"


class _Cutter:
    """Tags and texts in order, cut at headings that are direct children of the root."""

    def __init__(self, root: str):
        self.root, self.open, self.base = root, [], 0 if root == "fragment" else None
        self.found: list[list] = [[FIRST, [], True]]
        self.heading = None

    def start(self, tag: str, raw: str) -> None:
        if self.base is not None and len(self.open) == self.base and tag in HEADINGS:
            self.heading = len(self.open)
            self.found.append(["", [], False])
        if self.base is not None:
            self.add(raw)
        if tag not in VOID:
            self.open.append(tag)
            if self.base is None and tag == self.root:
                self.base = len(self.open)

    def end(self, tag: str) -> None:
        if tag not in self.open:
            return
        while self.open:
            top = self.open.pop()
            if self.base is not None and self.base > len(self.open):
                self.base = -1 if self.root != "fragment" else 0
            if self.base != -1:
                self.add(f"</{top}>")
            if self.heading is not None and len(self.open) == self.heading:
                self.heading = None
            if top == tag:
                break

    def add(self, raw: str) -> None:
        if self.base is None or self.base == -1:
            return
        if self.heading is not None:
            self.found[-1][0] += raw
        else:
            self.found[-1][1].append(raw)


class _Sections(HTMLParser):
    """The parser, which takes any markup, before a cutter."""

    def __init__(self, cutter: _Cutter):
        super().__init__(convert_charrefs=False)
        self.cutter = cutter

    def handle_starttag(self, tag, attrs):
        self.cutter.start(tag, self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self.cutter.add(self.get_starttag_text())

    def handle_endtag(self, tag):
        self.cutter.end(tag)

    def handle_data(self, data):
        self.cutter.add(data)

    def handle_entityref(self, name):
        self.cutter.add(f"&{name};")

    def handle_charref(self, name):
        self.cutter.add(f"&#{name};")


def _parts(markup: str, root: str) -> list[list]:
    """[title, pieces of the body, whether it is what is before the first heading] of each section, as markup."""
    cutter, found = _Cutter(root), tokens(markup)
    # a reference without its semicolon is for the parser
    if found is None or not all(referenced(source) for kind, _, source in found if kind == TEXT):
        parser = _Sections(cutter)
        parser.feed(markup)
        parser.close()
        return cutter.found
    for kind, name, source in found:
        if kind == START:
            cutter.start(name, f"<{source}>")
        elif kind == END:
            cutter.end(name)
        else:
            cutter.add(f"<{source}>" if kind == BOTH else source)
    return cutter.found


def sections(markup: str | None, root: str = "fragment") -> list[tuple[str, str]]:
    """(title, text) of the sections of HTML; what is before the first heading counts if it has text."""
    out = []
    for title, body, first in _parts(markup or "", root):
        text = plain_text("".join(body))
        name = FIRST if first else " ".join(plain_text(title, "", frozenset(), False).split())
        if text.strip() or not first:
            out.append((name, text))
    return out


def split_sections(df: DataFrame, id_col: str, markup: str, root: str = "fragment") -> DataFrame:
    """id, pos, title, text of each section."""
    ship_package(df.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [(i, p, t, x) for i, m in zip(pdf["id"], pdf["markup"], strict=True) for p, (t, x) in enumerate(sections(m, root))]
            yield pd.DataFrame(rows, columns=["id", "pos", "title", "text"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(markup).alias("markup")).mapInPandas(run, "id string, pos int, title string, text string")


def merge_short(parts: DataFrame, least: int = MIN, drop_first: bool = False) -> DataFrame:
    """Sections shorter than least go to the one before; the first stays (or, dropped, goes) however short."""
    text = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    rows = parts.withColumn("text", text)
    opens = (F.char_length("text") >= least) if drop_first else (F.col("pos") == 0) | (F.char_length("text") >= least)
    rows = rows.withColumn("__g", F.sum(opens.cast("int")).over(Window.partitionBy("id").orderBy("pos"))).where("__g > 0")
    joined = rows.groupBy("id", "__g").agg(F.array_sort(F.collect_list(F.struct("pos", "title", "text"))).alias("all"))
    rest = F.transform(F.slice("all", F.lit(2), F.size("all")), lambda x: F.concat(F.lit("\n\n"), x["title"], F.lit("\n"), x["text"]))
    return joined.select("id", F.col("all")[0]["pos"].alias("pos"), F.col("all")[0]["title"].alias("title"), F.concat(F.col("all")[0]["text"], F.array_join(rest, "")).alias("text"))


#: White space of any script, as (?U)\\s has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def packed(pieces: list[tuple[str, str]], most: int) -> list[str]:
    """(joiner, text) pieces in parts, each of as many as keep it within most characters; a longer piece is alone.

    A piece is over if the part so far and its text, without its joiner, have more than most characters. Those lengths
    grow with the piece, so the end of a part that begins anywhere is found by bisection in their running sums.
    """
    joiners, texts = np.array([len(j) for j, _ in pieces], np.int64), np.array([len(t) for _, t in pieces], np.int64)
    upto = np.cumsum(joiners + texts)
    without, out, first = upto - joiners, [], 0
    while first < len(pieces):
        end = max(first + 1, int(np.searchsorted(without, most + upto[first] - texts[first], "right")))
        out.append(pieces[first][1] + "".join(j + t for j, t in pieces[first + 1 : end]))
        first = end
    return out


def long_parts(text: str, most: int, sentences_only: bool) -> list[str]:
    """A text by lines (long ones by sentences), or without line breaks by sentences, packed; sentences end with a full stop."""
    ended = lambda s: s if s.endswith("。") else s + "。"
    if sentences_only or "\n" not in text:
        pieces = [("\n", ended(s)) for s in text.split("。") if s.strip(SPACE)]
    else:
        pieces = []
        for line in filter(None, (x.strip(SPACE) for x in text.split("\n"))):
            pieces += [(" ", ended(s)) for s in line.split("。") if s] if len(line) > most else [("\n", line)]
    return packed(pieces, most)


def split_long(parts: DataFrame, most: int = MAX, sentences_only: bool = False) -> DataFrame:
    """Sections of more than most characters in parts: by lines (long ones by sentences), else by sentences; packed greedily. One over-long sentence stays whole."""
    ship_package(parts.sparkSession)

    @F.pandas_udf("array<string>")
    def cut_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: long_parts(t, most, sentences_only))

    long = F.char_length("text") > most
    whole = parts.where(~F.coalesce(long, F.lit(False))).select("id", "pos", F.lit(0).alias("part"), "title", "text")
    cut = parts.where(long).select("id", "pos", F.posexplode(cut_up("text")).alias("part", "t"), "title")
    cut = cut.select("id", "pos", "part", F.concat("title", F.lit(" (パート"), F.col("part") + 1, F.lit(")")).alias("title"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("text"))
    both = whole.unionByName(cut)
    return both.withColumn("chunk_index", F.row_number().over(Window.partitionBy("id").orderBy("pos", "part")) - 1).select("id", "chunk_index", "title", "text")


def overlapped(chunks: DataFrame, overlap: int = OVERLAP, next_only: bool = False) -> DataFrame:
    """Chunks with the last sentences of the one before and the first of the next, by their own texts."""
    w = Window.partitionBy("id").orderBy("chunk_index")
    before, after = F.lag("text").over(w), F.lead("text").over(w)
    out = chunks.withColumns({"__b": before, "__a": after})
    s = F.split("__b", "。")
    last = F.when(F.size(s) >= 3, F.slice(s, -3, 3)).otherwise(s)
    joined = F.concat(F.array_join(F.filter(last, lambda x: F.regexp_replace(x, r"(?U)\s", "") != ""), "。"), F.lit("。"))
    tail = F.right("__b", F.lit(overlap))
    head = F.when((F.size(s) > 1) & (F.char_length(joined) <= overlap), joined).otherwise(tail)
    first = F.split("__a", "。")[0]
    first = F.when(first != "", F.concat(first, F.lit("。"))).otherwise(first)
    follow = F.when(F.char_length(first) <= overlap // 2, first).otherwise(F.left("__a", F.lit(overlap // 2)))
    text = F.col("text") if next_only else F.when(F.col("__b").isNotNull(), F.concat(head, F.lit(" "), "text")).otherwise(F.col("text"))
    return out.select("id", "chunk_index", "title", F.concat(text, F.when(F.col("__a").isNotNull(), F.concat(F.lit(" "), follow)).otherwise("")).alias("text"))


def chunks(articles: DataFrame, id_col: str = "id", markup: str = "full_content_html", text: str = "full_content", root: str = "fragment", variant: str = "v2") -> DataFrame:
    """Chunks of articles: HTML if there is any, else the text. variant v1: 300 to 1500 characters, sentences only, the next one's beginning only, a short first section left out."""
    source = articles.select(F.col(id_col).alias("id"), F.coalesce(F.nullif(F.col(markup), F.lit("")), F.col(text)).alias("m"))
    old = variant == "v1"
    merged = merge_short(split_sections(source, "id", "m", root), 300 if old else MIN, old)
    cut = split_long(merged, 1500 if old else MAX, old)
    return overlapped(cut, 50 if old else OVERLAP, old).where(collapse(F.col("text")) != "")


def chunk_rows(parts: DataFrame) -> DataFrame:
    """Chunk ids from article and index."""
    return parts.select(F.concat("id", F.lit("_"), F.col("chunk_index").cast("string")).alias("chunk_id"), F.col("id").alias("article_id"), "chunk_index", F.col("title").alias("chunk_title"), F.col("text").alias("chunk_text"))
