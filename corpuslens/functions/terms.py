"""Lists of terms in texts, in one pass: an Aho-Corasick automaton finds every place of every term at once.

Marking is defined term by term: each term in turn is put into marks wherever it stands, in what the terms before it
have made of the text. A term can then stand inside the marks of an earlier one, but not across them. That rule is kept
on the places that the automaton finds in the original text, so no text is copied once a term.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslens.runtime import ship_to_active

OPEN, CLOSE = "【", "】"


class Finder:
    """Places of words in texts. words may repeat; a word's numbers are its places in the list."""

    def __init__(self, words: Iterable[str]):
        import ahocorasick

        self.words = tuple(words)
        if any(not w or OPEN in w or CLOSE in w for w in self.words):
            raise ValueError("a term may be neither empty nor contain a mark")
        self.numbers: dict[str, list[int]] = {}
        for i, w in enumerate(self.words):
            self.numbers.setdefault(w, []).append(i)
        self.automaton = ahocorasick.Automaton()
        for w in self.numbers:
            self.automaton.add_word(w, w)
        if self.words:
            self.automaton.make_automaton()
        # most texts of another script needn't be scanned
        self.ascii = any(w.isascii() for w in self.words)

    def places(self, text: str) -> dict[str, list[int]]:
        """The ends of all places of each word that the text has, in order, overlapping ones too."""
        out: dict[str, list[int]] = {}
        if self.words and (self.ascii or not text.isascii()):
            for last, w in self.automaton.iter(text):
                out.setdefault(w, []).append(last + 1)
        return out

    def marked(self, text: str) -> str:
        """The text after each word in turn has been put into marks, from the left, without overlaps."""
        found = self.places(text)
        if not found:
            return text
        opened: dict[int, int] = {}
        closed: dict[int, int] = {}
        cut: set[int] = set()
        for w in sorted((i, w) for w in found for i in self.numbers[w]):
            size, after = len(w[1]), 0
            for end in found[w[1]]:
                start = end - size
                # a mark inside the place parts it: no place any more
                if start >= after and cut.isdisjoint(range(start + 1, end)):
                    opened[start] = opened.get(start, 0) + 1
                    closed[end] = closed.get(end, 0) + 1
                    after = end
            cut.update(opened, closed)
        out, at = [], 0
        for p in sorted(cut):
            out += [text[at:p], CLOSE * closed.get(p, 0), OPEN * opened.get(p, 0)]
            at = p
        out.append(text[at:])
        return "".join(out)


def _own(convert) -> Callable[..., Column]:
    """A function in a projection of its own: were it inlined into expressions around it, it couldn't be run there."""
    ship_to_active()
    return convert.asNondeterministic()


_FINDERS: dict[tuple[str, ...], Finder] = {}


def finder(words: Iterable[str]) -> Finder:
    """The finder of these words; a worker makes it once."""
    key = tuple(words)
    if key not in _FINDERS:
        _FINDERS[key] = Finder(key)
    return _FINDERS[key]


def marked(text: Column, words: list[str]) -> Column:
    """Each word in turn put into marks wherever it stands; null stays null."""

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        found = finder(words)
        return texts.map(found.marked, na_action="ignore")

    return _own(convert)(text)


def marked_by(text: Column, key: Column, words: Mapping[str, list[str]], more: list[str] = ()) -> Column:
    """The words of each row's key, if it has any, then more, in marks; null stays null."""

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series, keys: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else finder([*words.get(k, ()), *more]).marked(t) for t, k in zip(texts, keys, strict=True)], dtype=object)

    return _own(convert)(text, key)


def most_named(text: Column, words: Mapping[str, list[str]], otherwise: str) -> Column:
    """The key of which a text has the most of its words (each counts once; the first of the keys wins ties), or another value if it has none."""

    @F.pandas_udf(T.StringType())
    def convert(texts: pd.Series) -> pd.Series:
        found, of = finder(w for ws in words.values() for w in ws), {}
        for k, ws in words.items():
            for w in ws:
                of.setdefault(w, []).append(k)
        order = {k: -i for i, k in enumerate(words)}

        def best(x: str | None) -> str:
            counts: dict[str, int] = {}
            for w in found.places(x or ""):
                for k in of[w]:
                    counts[k] = counts.get(k, 0) + 1
            return max(counts, key=lambda k: (counts[k], order[k])) if counts else otherwise

        return texts.map(best)

    return _own(convert)(text)
