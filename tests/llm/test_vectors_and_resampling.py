"""Vector near-duplicates, vector codes and importance resampling: against plain loops, and on odd rows."""

import hashlib
import math
import os
import random
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from oracle import SF  # noqa: E402

from corpuslens.llm import codes, hnsw, queries, resample, vectordup  # noqa: E402
from corpuslens.llm.textarrays import mix  # noqa: E402

VECTORS = "vec_id bigint, embedding array<float>, label int, key string, n int, error double, code int"

# graphs


def unit_rows(n, d, seed, spread=0.0, groups=1):
    """Random rows of length 1; with spread, around so many centres."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) if not spread else rng.standard_normal((groups, d))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1)[:, None]


def numbers(n):
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def test_levels_shrink():
    counts = np.bincount(hnsw.drawn_levels(numbers(100_000)))
    assert 0.9 < counts[0] / 100_000 * hnsw.DEGREE / (hnsw.DEGREE - 1) < 1.1 and (np.diff(counts) < 0).all()


@pytest.mark.parametrize("spread, groups", [(0.0, 1), (0.1, 40), (0.02, 3), (0.3, 1)])
def test_balls_and_recall(spread, groups):
    """Members are linked with one another; a beam that its audit has passed finds what an exact comparison finds."""
    x = unit_rows(3000, 24, 3, spread, groups)
    graph, leader = hnsw.build(x, numbers(len(x)), 0.9)
    assert leader.min() >= 0 and set(leader.tolist()) == set(range(graph.size))
    for k in np.unique(leader)[:200]:
        mine = x[leader == k]
        assert (mine @ mine.T >= 0.9).all()
    least = hnsw.plus_half(0.9)
    tried = graph.audit(0.9, least, numbers(graph.size))
    assert tried[-1][1] >= hnsw.AUDIT_RECALL or 4 * tried[-1][0] >= graph.size
    q = unit_rows(500, 24, 4, spread, groups).astype(np.float32)
    got = set(zip(*(a.tolist() for a in graph.within(q, least)), strict=True))
    want = set(map(tuple, np.argwhere(q @ graph.vectors.T >= least).tolist()))
    assert got <= want and len(got) >= 0.99 * len(want)


def test_beam_widens():
    """A start with a beam of one is widened until the audit passes, and a group wider than any beam is found whole."""
    x = unit_rows(2500, 32, 9)
    graph, _ = hnsw.build(x, numbers(len(x)), 0.9)
    graph.beam = 1
    tried = graph.audit(0.9, 0.9, numbers(graph.size))
    assert len(tried) > 1 and tried[0][1] < hnsw.AUDIT_RECALL <= tried[-1][1] and graph.beam == tried[-1][0]
    centre = x[:1].astype(np.float32)
    exact = np.flatnonzero(centre @ graph.vectors.T >= -0.05)
    assert len(exact) > 8 * graph.beam
    assert len(graph.within(centre, -0.05)[1]) == len(exact)


def by_loops(rows, threshold=0.9):
    """n_links and component of each row."""
    good = [v is not None and len(v) > 0 and all(y is not None and math.isfinite(y) for y in v) and any(v) for _, v in rows]
    n, up = [0] * len(rows), {}

    def find(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for i, (a, v) in enumerate(rows):
        for j, (b, w) in enumerate(rows):
            if i != j and good[i] and good[j] and a is not None and b is not None and len(v) == len(w):
                cosine = math.fsum(x * y for x, y in zip(v, w, strict=True)) / math.sqrt(math.fsum(x * x for x in v)) / math.sqrt(math.fsum(y * y for y in w))
                if cosine >= threshold:
                    n[i] += 1
                    up[max(find(a), find(b))] = min(find(a), find(b))
    return sorted((a, c, None if a is None else find(a), a is None or find(a) == a) for (a, _), c in zip(rows, n, strict=True)) if all(a is not None for a, _ in rows) else sorted(((a, c, None if a is None else find(a), a is None or find(a) == a) for (a, _), c in zip(rows, n, strict=True)), key=str)


def vector_rows(seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    rows = [[x + rng.choice([0, 0.01, 0.2, 0.4]) * rng.gauss(0, 1) for x in rng.choice(centres)] for _ in range(150)]
    rows += rows[:20] + [rows[0]] * 30 + [[2.0 * x for x in rows[1]]] * 3
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_links(spark, seed):
    rows = vector_rows(seed)
    got = vectordup.near_duplicates(spark.createDataFrame([(i, v, 0, "k", 1, 1.0, 1) for i, v in rows], VECTORS), shard_rows=40)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect())) == by_loops(rows)


def test_vector_links_of_odd_rows(spark):
    rows = vector_rows(3)[:60]
    rows += [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0, None] * 4), (1004, [float("nan")] * 8), (1005, [float("inf")] * 8), (1006, [1.0, 2.0]), (1007, [1.0, 2.0]), (1008, [1e-38] * 8), (1009, [3e38] * 8)]
    rows += [rows[0], rows[0], (5, rows[40][1]), (5, None), (1000, rows[1][1])]
    got = vectordup.near_duplicates(spark.createDataFrame([(i, v, 0, "k", 1, 1.0, 1) for i, v in rows], VECTORS), shard_rows=20)
    assert sorted(map(tuple, got.collect())) == by_loops(rows)
    nulls = [*vector_rows(4)[:20], (None, vector_rows(4)[0][1]), (None, None)]
    got = vectordup.near_duplicates(spark.createDataFrame([(i, v, 0, "k", 1, 1.0, 1) for i, v in nulls], VECTORS))
    assert sorted(map(tuple, got.collect()), key=str) == by_loops(nulls)
    assert vectordup.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_audits_of_shards(spark):
    x = unit_rows(2000, 16, 5, 0.2, 60).astype(np.float32)
    rows = vectordup.keyed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>"))
    built = vectordup.index(vectordup.classes_of(rows).drop("least"), 0.9, shard_rows=300)
    audits = built.audits.collect()
    assert built.shards == 7 and {r.shard for r in audits} == set(range(7)) and sum(r.classes for r in audits) == 2000
    assert all(r.leaders < r.classes and (r.recall >= hnsw.AUDIT_RECALL or 4 * r.beam >= r.leaders) for r in audits)


# codes


def test_nearest_by_bounds():
    """LAESA gives the entry that all distances give, ties to the lower index, with fewer evaluations."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (40, 6))
    x, entries = centres[rng.integers(0, 40, 3000)] + rng.integers(-20, 20, (3000, 6)), centres[rng.integers(0, 40, 200)]
    fixed = codes.pivots(entries)
    assert len(fixed) == codes.PIVOTS and len(codes.pivots(entries[:1])) == 1 and len(codes.pivots(np.zeros((5, 2), int))) == 1
    index, best, count = codes.nearest(x, codes.distances(x, fixed), entries, codes.distances(entries, fixed))
    every = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (best == every.min(1)).all() and (index == every.argmin(1)).all() and count < 0.2 * every.size


def codes_by_loops(rows, parts=4, entries=256, rounds=4):
    kept = [(i, k, v) for i, v, k in rows if v and all(y is not None and math.isfinite(y) for y in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * y) for y in r[2]]))
    length = len(kept[0][2])
    kept = [r for r in kept if len(r[2]) == length]
    width = -(-length // parts)
    most = codes.limit(width)
    cut = [[[max(-most, min(most, math.floor(1024 * y))) for y in [*v, *[0.0] * (parts * width - length)]][p * width : (p + 1) * width] for p in range(parts)] for _, _, v in kept]
    books = [[x[p] for x in cut[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            mine: dict = {}
            for x in cut:
                mine.setdefault(near(x[p], books[p])[1], []).append(x[p])
            books[p] = [[sum(c) // len(mine[i]) for c in zip(*mine[i], strict=True)] if i in mine else e for i, e in enumerate(books[p])]
    out, by_label = [], {}
    for (i, k, _), x in zip(kept, cut, strict=True):
        found = [near(x[p], books[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[k] = by_label.get(k, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in found), error, k))
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[k], digest) for i, c, e, k in out), key=str)


def test_codes(spark):
    rng = random.Random(4)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(12)], rng.choice([None, 0, 1, 2])) for i in rng.sample(range(-50, 400), 320)]
    odd = [(7000, None, 1), (7001, [], 1), (7002, [1.0, None] * 6, 1), (7003, [float("nan")] * 12, None), (7004, [float("-inf")] * 12, 2), (7005, [1.0] * 3, 2), (None, [0.5] * 12, None), rows[0], rows[1], (rows[2][0], [0.25] * 12, 0), (7006, [0.0] * 12, None)]
    for some in (rows, rows + odd, rows[:40] + odd):
        got = codes.compressed(spark.createDataFrame([(i, v, k, "k", 1, 1.0, 1) for i, v, k in some], VECTORS))
        assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(map(tuple, got.collect()), key=str) == codes_by_loops([(i, v, k) for i, v, k in some])


def test_codes_of_odd_lengths_and_sizes(spark):
    """A length that parts don't divide, components beyond all bounds, and no vector at all."""
    rows = [(i, [float(np.float32(x)) for x in v], 0) for i, v in enumerate([[1, 2, 3, 4, 5, 6], [3e38, -3e38, 1, 1, 1, 1], [1, 2, 3, 4, 5, 7], [0.1, -0.1, 1e-9, -1e-9, 0, 1]])]
    got = codes.compressed(spark.createDataFrame([(i, v, k, "k", 1, 1.0, 1) for i, v, k in rows], VECTORS))
    assert sorted(map(tuple, got.collect()), key=str) == codes_by_loops(rows)
    assert codes.compressed(spark.createDataFrame([], VECTORS)).collect() == []
    assert codes.compressed(spark.createDataFrame([(1, None, 2, "k", 1, 1.0, 1)], VECTORS)).collect() == []


def test_codes_prune(spark):
    coded, books = codes.quantise(spark.read.parquet(f"{SF}/embeddings.parquet"))
    assert books.entries.shape == (4, 256, 16) and all(0 < r.n_evaluated < 4 * 256 for r in coded.collect())


# resampling


def test_crc_of_pairs():
    rng = random.Random(2)
    words = [bytes(rng.randrange(256) for _ in range(rng.choice([1, 2, 7, 63, 64, 65, 300, 70_000]))) for _ in range(200)]
    first, second = words[:100], words[100:]
    crc = lambda x: np.array([zlib.crc32(w) for w in x], np.uint32)
    got = resample.followed(resample.and_space(crc(first)), crc(second), np.array([len(w) for w in second]))
    assert got.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(first, second, strict=True)]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def drawn_by_loops(docs, target, percent=25, least=20, seed=7):
    def buckets(text):
        w = words_of(text)
        return [zlib.crc32(f.encode()) % 10_000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))]]

    found, s, t = [(d, len(words_of(x)), buckets(x)) for d, x in docs], [0] * 10_000, [0] * 10_000
    for _, _, b in found:
        for x in b:
            s[x] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    total, other = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((y + 1) * (total + 10_000) / ((x + 1) * (other + 10_000)))) for x, y in zip(s, t, strict=True)]
    rows = []
    for d, n, b in found:
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(b), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = enough[: percent * len(enough) // 100]
    out = [(*r[:1], *r[2:], k + 1) for k, r in enumerate(drawn)] + [(*r[:1], *r[2:], None) for r in enough[len(drawn) :] + [r for r in rows if r[1] < least]]
    return sorted(out, key=str)


def test_resampling_by_loops(spark):
    """op12 over all documents, and the same rows with a dictionary of a few words only."""
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = drawn_by_loops([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    got = queries.QUERIES["op12_importance_resampling"](spark, SF)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and sorted(map(tuple, got.collect()), key=str) == want
    assert sum(r[4] is not None for r in want) > 40
    few = resample.resample(docs, bench, most=7).drop("n_words")
    assert sorted(map(tuple, few.collect()), key=str) == want


ODD = [None, "", " \n\t ", "a", "Ünï çödé 漢字", "x" * 50_000, "y" * 300 + " z", "the cat sat on the mat " * 400, "end", "start", " no\u0085break ", "THE CAT sat. On_the-mat [ok]", "a\u0000b"]


def test_resampling_of_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD * 3)] + [(2, "again " * 30), (7, ODD[7]), (7, ODD[7]), (None, "null " * 25), (None, None)]
    schema = "doc_id bigint, text string, n_words string, score double, rank int"
    frame = lambda some: spark.createDataFrame([(i, t, "k", 1.0, 1) for i, t in some], schema)
    target = [(0, "the cat"), (1, None), (2, "漢字 again")]
    got = resample.resample(frame(rows), frame(target), percent=50, least_words=1)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.drop("n_words").collect()), key=str) == drawn_by_loops(rows, [t for _, t in target], 50, 1)
    assert sorted(map(tuple, resample.resample(frame(rows), frame([]), most=0).drop("n_words").collect()), key=str) == drawn_by_loops(rows, [])
    assert resample.resample(frame([]), frame(target)).collect() == []


def test_windows_of_a_scan():
    """Words are met alike whatever the windows; those that no dictionary has, too."""
    text = " ".join(random.Random(1).choices(["alpha", "beta", "ß", "x" * 70, "漢字", "7"], k=3000))
    column = pa.array([text, "beta", None, "beta ß"])
    kept = resample.WINDOW
    try:
        want = [tuple(x.tolist() for x in part[1:]) for part in resample.features(column, b"")]
        for resample.WINDOW in (1, 50, 1 << 20):
            got = [tuple(x.tolist() for x in part[1:]) for part in resample.features(column, "alpha beta ß 漢字".encode())]
            assert got == want
    finally:
        resample.WINDOW = kept
