"""Importance resampling towards a target: documents drawn by how much more likely their word features are in the target.

An Aho-Corasick automaton holds the corpus's most frequent words, each between two delimiters, with its CRC-32 and length
as payload. A scan of a text gives the payloads of its words; those of two adjacent words compose to the CRC-32 of both
with a space between them, so buckets of features follow without a feature ever being written out. Words that the
dictionary lacks get their payload from their own bytes. The dictionary is bounded and only saves time: it changes no
result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import textarrays as ta
from corpuslens.llm.arrowmap import in_tasks, with_columns
from corpuslens.runtime import materialise, ship_package

BUCKETS = 10_000
#: Words of the dictionary at most, and their bytes at most.
DICTIONARY, WORD_BYTES = 1 << 17, 48
#: Steps of frequency for each doubling.
STEPS = 16
#: Distinct words that a task counts before it hands them on, and bytes that are scanned at once.
COUNTED, WINDOW = 1 << 18, 1 << 20

#: Bytes as they are compared: A-Z as a-z, delimiters as spaces.
FOLDED = np.array([b + 32 if 65 <= b <= 90 else b if ta.ALNUM[b] else 32 for b in range(256)], np.uint8)

# CRC-32


def _byte_steps() -> np.ndarray:
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> np.uint32(1)) ^ np.uint32(0xEDB88320), step >> np.uint32(1))
    return step


_STEP = _byte_steps()
_BYTES = [np.uint32(8 * i) for i in range(4)]


def zero_byte(crc: np.ndarray) -> np.ndarray:
    """The remainder after another byte of zeros."""
    return _STEP[crc & np.uint32(0xFF)] ^ (crc >> np.uint32(8))


def and_space(crc: np.ndarray) -> np.ndarray:
    """CRC-32 of strings with a space appended, from those of the strings."""
    inner = ~crc
    return ~(_STEP[(inner ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (inner >> np.uint32(8)))


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """crc through a linear map given by its values at each byte in each place (4 x 256)."""
    out = table[0][crc & np.uint32(0xFF)]
    for i in range(1, 4):
        out = out ^ table[i][(crc >> _BYTES[i]) & np.uint32(0xFF)]
    return out


def _tables(most: int) -> np.ndarray:
    """Of appending 0 to most bytes of zeros, the map as values at each byte in each place."""
    out = np.zeros((most + 1, 4, 256), np.uint32)
    for i in range(4):
        out[0, i] = np.arange(256, dtype=np.uint32) << _BYTES[i]
    for n in range(most):
        out[n + 1] = zero_byte(out[n])
    return out


_SHIFTS = _tables(64)


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The remainders after so many bytes of zeros each."""
    short = np.minimum(lengths, len(_SHIFTS) - 1)
    out = _SHIFTS[short, 0, crc & np.uint32(0xFF)]
    for i in range(1, 4):
        out = out ^ _SHIFTS[short, i, (crc >> _BYTES[i]) & np.uint32(0xFF)]
    for n in np.unique(lengths[lengths > short]).tolist():
        at, left, power = lengths == n, n, _SHIFTS[1]
        value = crc[at]
        while left:
            if left & 1:
                value = _through(power, value)
            left >>= 1
            power = _through(power, power)
        out[at] = value
    return out


def followed(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of strings one after another, from theirs and the lengths of the second ones."""
    return shifted(first, lengths) ^ second


# words


def payload(word: bytes) -> int:
    """CRC-32 and, above its 32 bits, the length in bytes."""
    return zlib.crc32(word) | len(word) << 32


_AUTOMATA: dict[bytes, object] = {}


def automaton(words: bytes):
    """Of the words in a string, parted by spaces; a worker keeps the last one. Bytes stand as characters of the same numbers."""
    import ahocorasick

    if words not in _AUTOMATA:
        _AUTOMATA.clear()
        made = ahocorasick.Automaton()
        for w in words.split():
            made.add_word(f" {w.decode('latin-1')} ", payload(w))
        if words:
            made.make_automaton()
        _AUTOMATA[words] = made
    return _AUTOMATA[words]


def scanned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: bytes) -> np.ndarray:
    """The payload of each word of a text (given its bytes, folded), by scans of the automaton."""
    out = np.zeros(len(starts), np.int64)
    if words and len(starts):
        found = automaton(words)
        first = 0
        while first < len(starts):
            # whole words of about a window; one delimiter before and one after
            end = max(first + 1, int(np.searchsorted(ends, starts[first] + WINDOW, "right")))
            a, b = int(starts[first]), int(ends[end - 1])
            met = np.fromiter(chain.from_iterable(found.iter(f" {data[a:b].tobytes().decode('latin-1')} ")), np.int64).reshape(-1, 2)
            out[first + np.searchsorted(ends[first:end], met[:, 0] - 1 + a)] = met[:, 1]
            first = end
    raw, own = None, {}
    for i in np.flatnonzero(out == 0).tolist():
        raw = raw or data.tobytes()
        w = raw[starts[i] : ends[i]]
        if (value := own.get(w)) is None:
            value = own[w] = payload(w)
        out[i] = value
    return out


def features(column: pa.Array, words: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, buckets of the words, their texts, buckets of the pairs, their texts) of parts of a column."""
    for first, end, data, offsets in ta.pieces(column):
        starts, ends, doc = ta.words(data, offsets, ta.ALNUM)
        # words of two texts that touch are parted by a scan of each text's own
        folded, value = FOLDED[data], np.zeros(len(starts), np.int64)
        touching = np.flatnonzero(np.isin(ends[:-1], offsets) & (starts[1:] == ends[:-1])) + 1 if len(starts) else []
        bounds = [0, *np.asarray(touching).tolist(), len(starts)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            value[a:b] = scanned(folded, starts[a:b], ends[a:b], words)
        crc, length = (value & 0xFFFFFFFF).astype(np.uint32), value >> 32
        pair = np.flatnonzero(doc[1:] == doc[:-1])
        both = followed(and_space(crc[pair]), crc[pair + 1], length[pair + 1])
        yield end - first, crc % np.uint32(BUCKETS), doc, both % np.uint32(BUCKETS), doc[pair]


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> bytes:
    """The most frequent words of the texts, those of at most WORD_BYTES bytes, parted by spaces.

    All words are counted, in tasks first. How often a word must be there follows from the numbers of words in steps of
    frequency (some hundreds at most), so tasks send no other words than these to the driver, no more than most in all.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for _, _, data, _ in ta.pieces(batch.column(0)):
                # where texts touch, two words count as one: a word the less or the more is no matter here
                seen.update(w for w in FOLDED[data].tobytes().split() if len(w) <= WORD_BYTES)
                if len(seen) > COUNTED:
                    yield told()
        yield told()

    counted = docs.select("text").mapInArrow(in_tasks(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted.where("n > 1").withColumn("step", F.floor(STEPS * F.log2("n")).cast("int")), "words")
    room, least = most, None
    for r in sorted(counted.groupBy("step").agg(F.count("*").alias("c")).collect(), key=lambda r: -r.step):
        room -= r.c
        if room < 0:
            break
        least = r.step
    return b"" if least is None else b" ".join(sorted(bytes(r.word) for r in counted.where(F.col("step") >= least).select("word").collect()))


def bucket_counts(docs: DataFrame, words: bytes) -> np.ndarray:
    """How many features of all texts are in each bucket."""
    spark = docs.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, one, _, two, _ in features(batch.column(0), sent.value):
                total += np.bincount(one, minlength=BUCKETS) + np.bincount(two, minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in docs.select("text").mapInArrow(in_tasks(run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of a bucket's share in the target to that in the source, with one added to each bucket."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log(float(y + 1) * s / (float(x + 1) * t))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int) -> Column:
    """floor(1000 x) of a Gumbel variable of doc_id and seed."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def weighed(docs: DataFrame, gain: np.ndarray, words: bytes) -> DataFrame:
    """docs with n_words, n_features and weight (the floored mean of the gains of the features; 0 without any)."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def make(batch: pa.RecordBatch) -> list:
        n_words, weight = [], []
        for n, one, doc, two, of in features(batch.column("text"), sent.value):
            count = np.bincount(doc, minlength=n)
            total = np.zeros(n, np.int64)
            np.add.at(total, doc, gain[one])
            np.add.at(total, of, gain[two])
            n_words.append(count)
            weight.append(total // np.maximum(2 * count - 1, 1))
        if not n_words:
            return [[], [], []]
        n_words = np.concatenate(n_words)
        return [n_words, np.maximum(2 * n_words - 1, 0), np.concatenate(weight)]

    return with_columns(docs, "n_words bigint, n_features bigint, weight bigint", make)


def ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """scored (written: it is read several times) with rank: 1, 2, ... of the draws, null for the others.

    Drawn are percent of a hundred of the documents with enough words, by score, ties to the smaller doc_id (null last).
    Rows are ranged by score, sorted within ranges, and numbered by the sizes of the ranges before theirs.
    """
    enough = F.col("n_words") >= least_words
    n = scored.where(enough).count()
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    lines = materialise(scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "lines")
    # the upper bits of at number the range, the lower 33 the row in it
    sizes = {r.range: r.n for r in lines.groupBy(F.shiftright("at", 33).alias("range")).agg(F.count("*").alias("n")).collect()}
    before, offsets = 0, []
    for k in sorted(sizes):
        offsets.append((k, before))
        before += sizes[k]
    starts = scored.sparkSession.createDataFrame(offsets, "range bigint, before bigint")
    numbered = lines.withColumn("range", F.shiftright("at", 33)).join(F.broadcast(starts), "range", "left")
    numbered = numbered.withColumn("rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    numbered = numbered.withColumn("rank", F.when(F.col("rank") <= percent * n // 100, F.col("rank")))
    return numbered.select(*scored.columns, "rank").union(scored.where(~enough).select(*scored.columns, F.lit(None).cast("bigint").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, most: int = DICTIONARY) -> DataFrame:
    """Row of docs -> doc_id, n_words, n_features, weight, score, rank (1, 2, ... of the documents drawn, null for the others).

    docs: doc_id, text; target: text; other columns are ignored. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ once A-Z
    are a-z; features are words and pairs of adjacent words, repeats counted. A null text has no word, weight 0, and
    isn't drawn; it still has its score. A null doc_id draws its noise from the empty string and is the last of a tie.
    Rows that repeat a doc_id are scored and drawn each by itself (their noise is the same). An empty table gives no row;
    an empty target is a uniform one.
    """
    docs = docs.select("doc_id", "text")
    words = dictionary(docs, most)
    gain = gains(bucket_counts(docs, words), bucket_counts(target, words))
    scored = weighed(docs, gain, words).drop("text").withColumn("score", F.col("weight") + noise(seed))
    return ranked(materialise(scored, "scored"), percent, least_words)
