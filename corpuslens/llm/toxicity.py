"""Toxic passages by maximum-scoring segments.

Fitting: over a bounded sample of labelled documents, words and word beginnings are counted by class, by token and by
distinct neighbours (a 64-bit linear-counting sketch, so that copies of a text count once). A token's score is the lower
confidence bound of the log-odds of its best feature under a Dirichlet prior, less a drift that makes other tokens
negative. Scoring: one linear scan over a document's token scores finds all maximal scoring segments. Best segments of
non-toxic documents follow an extreme-value law; its parameters are fitted on sampled documents that the counts haven't
seen, give each segment a p-value, and the significant segments of a document are turned into a probability that is
calibrated on the same documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import textarrays as ta
from corpuslens.llm.arrowmap import in_tasks, with_columns
from corpuslens.runtime import materialise, ship_package

#: At most so many labelled documents of each class are used for fitting (those with the least hash of their doc_id).
TRAIN_ROWS = 20_000
#: Features are counted in so many cells; this bounds the model.
CELLS = 1 << 20
PREFIXES = (3, 4, 5, 6)
PRIOR, Z, DRIFT, SIGNIFICANT, THRESHOLD = 0.5, 1.96, 0.5, 0.05, 0.7
EULER = 0.5772156649015329

SEGMENTS = "array<struct<first_word:bigint,last_word:bigint,score:double,p_value:double>>"


@dataclass
class Model:
    cells: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: of non-toxic documents: a best segment of score s among n tokens has the variate rate * s - log(size * n)
    rate: float = 1.0
    size: float = 1.0
    #: log-odds that a document with evidence e is toxic: base + slope * log(1 + e)
    base: float = -math.inf
    slope: float = 1.0

    def dense(self) -> np.ndarray:
        out = np.full(CELLS, -DRIFT, np.float32)
        out[self.cells] = self.scores
        return out


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, cells of the features of each token (-1: none), row of each token) of parts of a column."""
    for first, end, data, offsets in ta.pieces(ta.lowered(column)):
        starts, ends, doc = ta.words(data, offsets, ta.LETTERS)
        hashes = ta.word_hashes(data, starts, ends, PREFIXES)
        yield first, end, np.where(hashes == 0, -1, (hashes >> np.uint64(44)).astype(np.int64)), doc


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, end, score) of a sequence, in time linear in its length (Ruzzo and Tompa)."""
    found: list[list] = []  # start, end, sum before, sum through
    link: list[int] = []  # the last earlier candidate whose sum before is less
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        item = [i, i + 1, total, total + s]
        total += s
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= item[2]:
                j = link[j]
            if j < 0 or found[j][3] >= item[3]:
                break
            item[0], item[2] = found[j][0], found[j][2]
            del found[j:], link[j:]
            j -= 1
        found.append(item)
        link.append(j)
    return [(a, b, r - before) for a, b, before, r in found]


def document_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments of token scores; runs of one sign are taken as one item, which leaves the result the same."""
    up = score > 0
    if not up.any():
        return []
    heads = np.flatnonzero(np.diff(up, prepend=~up[0]))
    bounds = [*heads.tolist(), len(score)]
    sums = np.add.reduceat(score.astype(float), heads).tolist()
    return [(bounds[a], bounds[b], s) for a, b, s in segments(sums)]


def _scan(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, list]]:
    """Of each row its number of tokens and its segments."""
    for first, end, cells, doc in tokens(column):
        score = np.where(cells < 0, np.float32(-DRIFT), table[np.maximum(cells, 0)]).max(0, initial=np.float32(-np.inf)) if len(doc) else np.zeros(0)
        # a token that only repeats the one before is no further evidence
        again = np.flatnonzero((cells[0][1:] == cells[0][:-1]) & (doc[1:] == doc[:-1])) + 1
        score[again] = np.minimum(score[again], 0)
        at = np.searchsorted(doc, np.arange(end - first + 1))
        some = set(doc[score > 0].tolist())
        for d in range(end - first):
            yield int(at[d + 1] - at[d]), document_segments(score[at[d] : at[d + 1]]) if d in some else []


def _evidence(n: int, found: list, model: Model) -> tuple[float, list]:
    """The best segment's variate plus those of other significant ones; the segments that are significant."""
    least = math.log(max(model.size * max(n, 1), 1e-9))
    variates = sorted(((model.rate * s - least, a, b, s) for a, b, s in found), reverse=True)
    if not variates:
        return -math.inf, []
    kept = [(a, b - 1, s, -math.expm1(-math.exp(-v))) for v, a, b, s in variates if -math.expm1(-math.exp(min(-v, 50.0))) < SIGNIFICANT]
    return variates[0][0] + sum(v for v, *_ in variates[1 : len(kept)] if v > 0), sorted(kept)


def probability(evidence: float, model: Model) -> float:
    """That a document with this evidence is toxic; it grows with the evidence."""
    if evidence == -math.inf or model.base == -math.inf:
        return 0.0
    return 1 / (1 + math.exp(-min(max(model.base + model.slope * math.log1p(max(evidence, 0.0)), -50.0), 50.0)))


def _count(docs: DataFrame) -> DataFrame:
    """cell, tokens and distinct neighbours by class of the rows text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, CELLS), np.uint64)
        number = np.zeros((2, CELLS), np.int64)
        for batch in batches:
            label = np.array(batch.column("toxic").to_pylist(), np.int64)
            for first, _, cells, doc in tokens(batch.column("text")):
                if not len(doc):
                    continue
                word = cells[0].astype(np.uint64)
                before, after = np.concatenate([[0], word[:-1]]).astype(np.uint64), np.concatenate([word[1:], [0]]).astype(np.uint64)
                before[np.flatnonzero(np.diff(doc, prepend=-1))] = CELLS
                after[np.flatnonzero(np.diff(doc, append=-1))] = CELLS
                bit = np.uint64(1) << (ta.mix(before * np.uint64(3 * CELLS) + after + np.uint64(1)) >> np.uint64(58))
                which = label[first + doc]
                for c in (0, 1):
                    for row in cells:
                        use = (which == c) & (row >= 0)
                        np.bitwise_or.at(seen[c], row[use], bit[use])
                        number[c] += np.bincount(row[use], minlength=CELLS)
        at = np.flatnonzero(number.any(0))
        for a in range(0, len(at), 50_000):
            x = at[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(number[0, x]), pa.array(number[1, x]), pa.array(seen[0, x].view(np.int64)), pa.array(seen[1, x].view(np.int64))], names=["cell", "n0", "n1", "b0", "b1"])

    parts = docs.mapInArrow(in_tasks(run), "cell bigint, n0 bigint, n1 bigint, b0 bigint, b1 bigint")
    return parts.groupBy("cell").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.bit_or("b0").alias("b0"), F.bit_or("b1").alias("b1"))


def telling(counts: DataFrame) -> tuple[float, DataFrame]:
    """Log of the classes' ratio of tokens, and the cells whose token counts alone leave them a positive score: few go to the driver."""
    counts = materialise(counts, "counts")
    n0, n1 = counts.agg(F.coalesce(F.sum("n0"), F.lit(0)), F.coalesce(F.sum("n1"), F.lit(0))).first()
    if not n0 or not n1:
        return 0.0, counts.limit(0)
    total = math.log((n0 + PRIOR) / (n1 + PRIOR))
    bound = F.log((F.col("n1") + PRIOR) / (F.col("n0") + PRIOR)) + total - Z * F.sqrt(1 / (F.col("n1") + PRIOR) + 1 / (F.col("n0") + PRIOR)) - DRIFT
    return total, counts.where(bound > 0)


def token_scores(cell: np.ndarray, n0: np.ndarray, n1: np.ndarray, b0: np.ndarray, b1: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells whose score is above that of other tokens, and the scores. total: log of the classes' ratio of tokens."""

    def distinct(bits: np.ndarray) -> np.ndarray:
        empty = 64 - np.bitwise_count(bits.view(np.uint64)).astype(float)
        return -64 * np.log(np.maximum(empty, 0.5) / 64)

    def bound(x0: np.ndarray, x1: np.ndarray, total: float) -> np.ndarray:
        return np.log((x1 + PRIOR) / (x0 + PRIOR)) + total - Z * np.sqrt(1 / (x1 + PRIOR) + 1 / (x0 + PRIOR))

    score = np.minimum(bound(n0.astype(float), n1.astype(float), total), bound(distinct(b0), distinct(b1), total)) - DRIFT
    keep = score > 0
    return cell[keep], score[keep]


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None, rows: int = TRAIN_ROWS) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0 or 1) where train holds for doc_id (all if None).

    At most rows labelled documents of each class are used; three quarters are counted, the rest calibrate. Null labels,
    ids and texts are no training rows. With no toxic or no other document, every score will be 0.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.xxhash64("doc_id").alias("h"))
    own = own.where(train) if train is not None else own
    picked = [own.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(rows) for c in (0, 1)]
    # at most 2 * rows ids go to every task
    sample = F.broadcast(picked[0].union(picked[1]))
    texts = docs.where("text IS NOT NULL").select("doc_id", "text").join(sample, "doc_id")
    fresh = F.pmod("h", F.lit(4)) == 0
    total, kept = telling(_count(texts.where(~fresh).select("text", "toxic")))
    rows_kept = np.array([tuple(r) for r in kept.select("cell", "n0", "n1", "b0", "b1").collect()], np.int64).reshape(-1, 5)
    model = Model()
    if len(rows_kept):
        model.cells, model.scores = token_scores(*np.ascontiguousarray(rows_kept.T), total)
    table = spark.sparkContext.broadcast(model)
    seen = with_columns(texts.where(fresh).select("toxic", "text"), "n bigint, scores array<double>", lambda b: list(zip(*((n, [s for *_, s in x]) for n, x in _scan(b.column("text"), table.value.dense())), strict=True)) or [[], []])
    calibrate(model, [(r.toxic, r.n, r.scores) for r in seen.select("toxic", "n", "scores").collect()])
    table.destroy()
    return model


def calibrate(model: Model, rows: list[tuple[int, int, list[float]]]) -> None:
    """Fit the laws on (toxic, tokens, segment scores) of documents that the counts haven't seen.

    The best segments of non-toxic documents that have one exceed 0 by an exponential tail; their share gives its size.
    The log-odds of toxic against the logarithm of the evidence is fitted by Newton steps with a weak ridge.
    """
    clean = [(n, max(s, default=0.0)) for t, n, s in rows if t == 0 and n]
    if not clean or not any(t == 1 and n for t, n, _ in rows):
        return
    over = [s for _, s in clean if s > 0]
    model.rate = min(max((len(over) + 1) / (sum(over) + 1), 0.2), 5.0)
    model.size = -math.log1p(-(len(over) + 0.5) / (len(clean) + 1)) / (sum(n for n, _ in clean) / len(clean))
    x = np.array([math.log1p(max(_evidence(n, [(0, 1, v) for v in s], model)[0], 0.0)) for _, n, s in rows])
    y = np.array([t for t, *_ in rows], float)
    features, weight, ridge = np.stack([np.ones(len(x)), x], 1), np.zeros(2), np.array([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(features @ weight, -30, 30)))
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + np.diag(ridge), features.T @ (y - p) - ridge * weight)
        weight = weight + np.clip(step, -3, 3)
    model.base, model.slope = float(weight[0]), max(float(weight[1]), 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with toxic_score (0 to 1), toxic (score at least THRESHOLD) and toxic_segments (words from 0, the last included).

    The columns of docs stay, but for earlier ones of these names. Null texts and texts without words have score 0 and no
    segment; repeated rows are each scored.
    """
    from corpuslens.llm.arrowmap import without

    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        m = held.value
        if not hasattr(m, "table"):
            m.table = m.dense()
        scores, found = [], []
        for n, x in _scan(batch.column("text"), m.table):
            evidence, kept = _evidence(n, x, m)
            scores.append(probability(evidence, m))
            found.append([{"first_word": a, "last_word": b, "score": s, "p_value": p} for a, b, s, p in kept])
        return [scores, [p >= THRESHOLD for p in scores], found]

    return with_columns(without(docs, "toxic_score", "toxic", "toxic_segments"), f"toxic_score double, toxic boolean, toxic_segments {SEGMENTS}", make)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that aren't toxic, with their own columns, whatever their names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make(batch: pa.RecordBatch) -> list:
        m = held.value
        if not hasattr(m, "table"):
            m.table = m.dense()
        return [[probability(_evidence(n, x, m)[0], m) >= THRESHOLD for n, x in _scan(batch.column("text"), m.table)]]

    return with_columns(docs, "__toxic boolean", make).where("NOT __toxic").drop("__toxic")
