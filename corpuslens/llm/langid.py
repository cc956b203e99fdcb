"""Languages of documents as mixtures.

A language's likelihood of a word is that of its byte trigrams (with the word's ends), counted over the training
documents into CELLS cells. For each document, expectation-maximisation estimates in what proportions languages make up
its words. Of the nested sets of its most frequent languages, the one with the largest likelihood less a penalty for
each further language is selected and its proportions are estimated anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import textarrays as ta
from corpuslens.llm.arrowmap import in_tasks, with_columns, without
from corpuslens.runtime import ship_package

#: Cells of trigrams a language; this bounds its part of the model.
CELLS = 1 << 16
SMOOTHING = 0.5
ROUNDS, PENALTY = 12, 3.0
UNKNOWN = "und"

PARTS = "array<struct<lang:string,share:double>>"


@dataclass
class Model:
    languages: list[str]
    #: log-likelihoods, a row per cell and a column per language
    table: np.ndarray


def trigrams(column: pa.Array, limit: int = ta.SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, cells, row of each cell, first cell of each word, row of each word) of parts of a column."""
    for first, end, data, offsets in ta.pieces(ta.lowered(column), limit):
        starts, ends, doc = ta.words(data, offsets, ta.LETTERS)
        inside = ta.LETTERS[data]
        plain = np.where(inside, data, np.uint8(32)).astype(np.uint32)
        before, after = np.full(len(data), 32, np.uint32), np.full(len(data), 32, np.uint32)
        before[1:], after[:-1] = plain[:-1], plain[1:]
        before[starts] = 32
        after[ends - 1] = 32
        code = (before << 16 | plain << 8 | after) * np.uint32(2654435761)
        cells = (code >> 16)[inside].astype(np.int64)
        lengths = ends - starts
        yield first, end, cells, np.repeat(doc, lengths), np.cumsum(lengths) - lengths, doc


def fit(docs: DataFrame, train: Column | None = None) -> Model:
    """A model of every language that lang names, from all rows of docs (text, lang) where train holds and neither is null."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = (docs.where(train) if train is not None else docs).where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            for first, _, cells, row, _, _ in trigrams(batch.column("text")):
                found = np.bincount(number[first + row] * CELLS + cells, minlength=len(names) * CELLS).reshape(len(names), CELLS)
                for name, n in zip(names, found, strict=True):
                    counts[name] = counts[name] + n if name in counts else n
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "cell", "n"])
            if not len(at):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([0]), pa.array([0])], names=["lang", "cell", "n"])

    # at most CELLS rows a language
    counts = rows.mapInArrow(in_tasks(run), "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(set(counts["lang"]))
    table = np.full((CELLS, len(languages)), SMOOTHING)
    table[counts["cell"].to_numpy(int), [languages.index(x) for x in counts["lang"]]] += counts["n"].to_numpy(float)
    return Model(languages, np.log(table / table.sum(0)).astype(np.float32))


def mixtures(likelihood: np.ndarray, first: np.ndarray, shares: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over the words of several documents (rows of likelihood, from first on): shares, log-likelihoods.

    shares: where to start, a row per document; a share of 0 stays 0. Documents have words.
    """
    n = np.diff(np.append(first, len(likelihood)))
    for number in range(rounds + 1):
        with np.errstate(divide="ignore"):
            joint = np.repeat(np.log(shares), n, axis=0) + likelihood
        top = joint.max(1)
        weight = np.exp(joint - top[:, None])
        total = weight.sum(1)
        value = np.add.reduceat(top + np.log(total), first)
        if number == rounds:
            return shares, value
        shares = np.add.reduceat(weight / total[:, None], first, axis=0) / n[:, None]


def select(likelihood: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Shares of the languages of the selected set, a row per document."""
    docs, languages = len(first), likelihood.shape[1]
    n = np.diff(np.append(first, len(likelihood)))
    cost = penalty * np.log(n + 1)
    full, upper = mixtures(likelihood, first, np.full((docs, languages), 1 / languages))
    alone = np.add.reduceat(likelihood, first, axis=0)
    best, value = np.zeros((docs, languages)), alone.max(1).astype(float)
    best[np.arange(docs), alone.argmax(1)] = 1
    order = np.argsort(-full, axis=1, kind="stable")
    for k in range(2, languages + 1):
        # all languages together bound what any set can reach
        todo = np.flatnonzero(upper - (k - 1) * cost > value)
        if not len(todo):
            break
        words = np.repeat(np.isin(np.arange(docs), todo), n)
        start = np.zeros((len(todo), languages))
        np.put_along_axis(start, order[todo, :k], np.maximum(np.take_along_axis(full[todo], order[todo, :k], 1), 1e-6), 1)
        shares, reached = mixtures(likelihood[words], np.cumsum(n[todo]) - n[todo], start / start.sum(1, keepdims=True))
        better = reached - (k - 1) * cost[todo] > value[todo]
        best[todo[better]], value[todo[better]] = shares[better], (reached - (k - 1) * cost[todo])[better]
    return best


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred (the language with the largest share), lang_score (its share) and lang_parts (all shares, largest first).

    Only the text is looked at. Null texts, texts without a letter, and all texts if the model knows no language, are
    `und` with score 0 and no parts. Columns of docs stay, but for earlier ones of these names; ties go to the first
    name.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        m, column = held.value, batch.column("text")
        names, scores, parts = [UNKNOWN] * len(column), [0.0] * len(column), [[] for _ in range(len(column))]
        letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_pylist()
        for first, _, cells, _, word, doc in trigrams(column, ta.SLICE_BYTES * 4 // max(4, len(m.languages))):
            if not len(doc) or not m.languages:
                continue
            likelihood = np.add.reduceat(m.table[cells], word, axis=0).astype(np.float64)
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            for d, share in zip((first + doc[heads]).tolist(), select(likelihood, heads), strict=True):
                if letters[d]:
                    order = np.argsort(-share, kind="stable")
                    names[d], scores[d] = m.languages[order[0]], min(1.0, float(share[order[0]]))
                    parts[d] = [{"lang": m.languages[i], "share": float(share[i])} for i in order if share[i] > 0]
        return [names, scores, parts]

    return with_columns(without(docs, "lang_pred", "lang_score", "lang_parts"), f"lang_pred string, lang_score double, lang_parts {PARTS}", make)
