"""The operators on nulls, empty and odd texts, ties, repeated rows, empty tables and clashing names, and against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from corpuslens.llm import bpe, decontam, dedup, langid, neardup, secrets, textarrays, token_counts, toxicity, warc, wavelet

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ODD = [None, "", " \n\t ", "a", "Ünï çödé 漢字", "x" * 50_000, "the cat sat on the mat " * 400, "the cat sat", "THE CAT SAT"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, one row twice, with columns whose names clash with what operators add."""
    rows = [(i, t, i, "k", 1.0) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1]], "doc_id bigint, text string, n_tokens int, ids string, score double")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(PATH, PATTERN).ranks, special_tokens={})


# words as arrays


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["Ab c,D", "", None, "é9-é9", "a" * 300, "AB"]
    (first, end, data, offsets), = textarrays.pieces(pa.array(texts))
    starts, ends, doc = textarrays.words(data, offsets, textarrays.ALNUM)
    raw = bytes(data)
    assert [(int(d), raw[a:b].decode()) for a, b, d in zip(starts, ends, doc)] == [(0, "Ab"), (0, "c"), (0, "D"), (3, "é9"), (3, "é9"), (4, "a" * 300), (5, "AB")]
    h = textarrays.word_hashes(data, starts, ends)
    assert h[0] == h[6] and h[3] == h[4] and len(set(h.tolist())) == 5
    assert [(a, b) for a, b, *_ in textarrays.pieces(pa.array(texts), 5)] == [(0, 1), (1, 3), (3, 4), (4, 5), (5, 6)]


# 1


def test_language_mixtures(spark, none):
    words = {"xx": ["lorem", "ipsum", "dolor", "amet"], "yy": ["zwölf", "boxer", "jagen", "über"]}
    rng = random.Random(0)
    text = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    train = spark.createDataFrame([(i, text(lang, 30), lang) for i in range(20) for lang in words] + [(99, None, "zz"), (98, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["xx", "yy"]
    docs = spark.createDataFrame([(0, text("xx", 20)), (1, text("yy", 20)), (2, text("xx", 60) + " " + text("yy", 40)), (3, None), (4, ""), (5, "123 !"), (6, text("xx", 90_000))], "doc_id bigint, text string")
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("lang_pred", F.lit("old")), model).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["xx", "yy", "xx", "und", "und", "und", "xx"]
    assert [len(got[i].lang_parts) for i in range(6)] == [1, 1, 2, 0, 0, 0]
    assert abs(got[2].lang_score - 0.6) < 0.08 and got[0].lang_score == 1.0 and got[3].lang_score == 0.0
    assert langid.identify(none, model).count() == 0
    empty = langid.fit(train.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, empty).collect()} == {"und"}


def test_mixtures_by_plain_loops():
    """Expectation-maximisation and the choice among nested sets, word by word."""
    import math

    def plain(words, share):
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(share)
            for w in words:
                joint = [s * math.exp(x) for s, x in zip(share, w)]
                new = [n + j / sum(joint) for n, j in zip(new, joint)]
            share = [n / len(words) for n in new]
        return share, sum(math.log(sum(s * math.exp(x) for s, x in zip(share, w))) for w in words)

    rng = np.random.default_rng(3)
    for seed in range(20):
        sizes = rng.integers(1, 40, 3)
        likelihood = -5 * rng.random((sizes.sum(), 4)) * rng.choice([0.2, 1.0], 4)
        first = np.cumsum(sizes) - sizes
        shares, value = langid.mixtures(likelihood, first, np.full((3, 4), 0.25))
        chosen = langid.select(likelihood, first)
        for d, (a, n) in enumerate(zip(first, sizes)):
            words = likelihood[a : a + n].tolist()
            want, reached = plain(words, [0.25] * 4)
            assert np.allclose(shares[d], want) and math.isclose(value[d], reached)
            order = np.argsort(-np.array(want), kind="stable")
            alone = likelihood[a : a + n].sum(0)
            options = [(alone.max(), np.eye(4)[alone.argmax()])]
            for k in (2, 3, 4):
                start = [max(want[i], 1e-6) if i in order[:k] else 0.0 for i in range(4)]
                share, reached = plain(words, [x / sum(start) for x in start])
                options.append((reached - (k - 1) * langid.PENALTY * math.log(n + 1), share))
            assert np.allclose(chosen[d], max(options, key=lambda x: x[0])[1], atol=1e-6)


# 2


def archive(n=40, seed=0):
    rng = random.Random(seed)
    pages = [(i, f"http://x/{i}\r\nX", bytes(rng.choices(b"abc <p>\n", k=rng.randrange(0, 3000))), i - 1 if i % 3 == 0 and i else None) for i in range(n)]
    return [warc.record(*p) for p in pages]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_covers_all_bytes(packed):
    records = [warc.member(r) if packed else r for r in archive()]
    whole = b"".join(records)
    assert [x["record_id"] for x in warc.salvage(whole)] == [warc.record_id(i) for i in range(40)]
    for seed in range(25):
        rng, data = random.Random(seed), bytearray(whole)
        for _ in range(rng.randrange(1, 5)):
            i, k = rng.randrange(len(data)), rng.randrange(1, 200)
            if rng.random() < 0.5:
                data[i : i + k] = bytes(rng.randrange(256) for _ in range(k))
            else:
                del data[i : i + k]
        out, at = list(warc.salvage(bytes(data))), 0
        for x in out:
            assert x["offset"] == at
            at += x["length"]
        assert at == len(data) and sum(x["reason"] is None for x in out) >= 28
    cut = list(warc.salvage(whole[:-3]))
    assert cut[-1]["reason"] and len(cut) == 40
    damaged = bytearray(records[0])
    damaged[-6] ^= 1
    assert all(x["reason"] for x in warc.salvage(bytes(damaged)))


def test_archives_round_trip(spark):
    big = "<p>" + "y" * 2000
    rows = [(1, "u", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "é", "漢" * 400), (2, None, big), (None, "u", "z" * 1500)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    want = sorted([(p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), 2 if p == 1 else None) for p, _, h in rows], key=str)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got], key=str) == want
    assert {r.page_id: bytes(r.payload) for r in got if r.page_id == 7} == {7: ("漢" * 400).encode()}
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_long_headers_are_read(spark):
    url = "http://a.test/" + " " * 30_000
    rows = warc.round_trip(spark.createDataFrame([(1, url, "<p>x</p>"), (2, "u", "y")], "page_id bigint, url string, html string")).collect()
    assert {r.page_id: (r.reason, r.target, bytes(r.payload)) for r in rows} == {1: (None, url.replace(" ", "%20"), b"<p>x</p>"), 2: (None, "u", b"y")}


# 3


def brute_segments(s):
    """Maximal scoring segments by their definition: the best segment, then those of what is left on either side."""
    if not s or max(s) <= 0:
        return []
    best = max(((sum(s[a:b]), -(b - a), -a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1)))
    a, b = -best[2], best[3]
    return [*brute_segments(s[:a]), (a, b, best[0]), *[(x + b, y + b, v) for x, y, v in brute_segments(s[b:])]]


def test_segments_against_definition():
    for seed in range(200):
        rng = random.Random(seed)
        # distinct powers of two, so that no two segments tie
        s = [rng.choice((1, -1)) * float(2 ** k) for k in rng.sample(range(20), 9)]
        assert toxicity.segments(s) == brute_segments(s)
        assert toxicity.document_segments(np.array(s)) == brute_segments(s)
    assert toxicity.segments([]) == [] and toxicity.segments([-1.0, -2.0]) == []


def test_toxic_documents(spark, odd, none):
    rng = random.Random(0)
    plain = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    doc = lambda bad: " ".join(rng.choices(plain, k=60) + (["vile", "scum", "rotten"] if bad else []) + rng.choices(plain, k=60))
    rows = [(i, doc(i % 4 == 0), int(i % 4 == 0)) for i in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(7000, 1), (3, None), (None, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") < 400)
    got = {r.doc_id: r for r in toxicity.score(docs.where("doc_id >= 400"), model).collect()}
    right = sum(got[i].toxic == bool(y) for i, _, y in rows[400:])
    assert right >= 195
    one = got[400]
    assert any(s.first_word <= 60 and s.last_word >= 62 for s in one.toxic_segments)
    table = model.dense()
    for r in [*got.values()][:40]:  # score and segments anew, word by word
        s = []
        for word in rows[r.doc_id][1].split():
            (_, _, cells, _), = toxicity.tokens(pa.array([word]))
            s.append(float(max(table[c] if c >= 0 else -toxicity.DRIFT for c in cells[:, 0])))
        segments = brute_segments(s)
        least = np.log(model.size * len(s))
        variates = {(a, b): model.rate * v - least for a, b, v in segments}
        significant = [x for x in sorted(variates) if 1 - np.exp(-np.exp(-variates[x])) < toxicity.SIGNIFICANT]
        assert [(x.first_word, x.last_word + 1) for x in r.toxic_segments] == significant
        if variates:
            best = max(variates.values())
            evidence = best + sum(max(variates[x], 0) for x in significant if variates[x] != best)
            assert r.toxic_score == pytest.approx(1 / (1 + np.exp(-(model.base + model.slope * np.log1p(max(evidence, 0))))), abs=1e-6)
        else:
            assert r.toxic_score == 0
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.toxic_score <= 1 for r in scored) and scored[0].score == 1.0
    assert toxicity.score(none, model).count() == 0 and toxicity.reject(odd, model).columns == odd.columns
    assert {r.toxic_score for r in toxicity.score(docs.limit(5), toxicity.fit(docs, labels.limit(0))).collect()} == {0.0}


# 4


def brute_components(docs, k, percent):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = {}
    for d, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {d: d for d in sets}
    find = lambda d: d if root[d] == d else find(root[d])
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


def copies(seed, groups=12, wide=None):
    rng, out = random.Random(seed), []
    for g in range(groups):
        base = [f"{g}w{rng.randrange(200)}" for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(wide if wide and g == 0 else rng.randrange(1, 6)):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 12)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(text))
    rng.shuffle(out)
    return [*enumerate(out)]


@pytest.mark.parametrize("wide", [None, 90])
def test_near_duplicates(spark, wide, monkeypatch):
    if wide:  # small nodes and blocks, so that pivots, blocks and descents are all used
        monkeypatch.setattr(neardup, "SMALL", 4)
        monkeypatch.setattr(neardup, "BLOCK", 16)
        monkeypatch.setattr(neardup, "WIDE", 2)
    rows = [*copies(1, wide=wide), (1000, None), (1001, ""), (1002, "Same words"), (1003, "same WORDS"), (1004, "　")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_shingles", F.lit("clash"))
    for k in (2, 5) if not wide else (2,):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, k, 80).collect()}
        assert got == brute_components(rows, k, 80)
    if not wide:
        assert neardup.deduplicate(df, 2).columns == df.columns
        assert neardup.near_duplicates(df.limit(0)).count() == 0
        twice = neardup.near_duplicates(spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id bigint, text string"), 2).collect()
        assert sorted([(r.doc_id, r.component_id, r.kept) for r in twice], key=str) == [(1, 1, True), (1, 1, True), (2, 1, False), (None, None, True)]


def test_a_large_component_is_not_dealt_to_itself(spark, monkeypatch):
    """What a node hands on grows with the members outside of its largest component, not with the square of all; each other pair of components meets."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    handed = []
    for size in (100, 400):
        members = spark.createDataFrame([(7, i, 9, 0 if i >= 3 else i + 10_000) for i in range(size)], "node bigint, id bigint, n bigint, comp bigint")
        rows = neardup._open(members).collect()
        handed.append(sum(r.meets for r in rows))
        met = lambda a, b: max(a.i, b.i) < (a if a.i < b.i else b).meets
        assert len(rows) == size and all(met(a, b) for a in rows for b in rows if a.comp != b.comp)
    assert handed[1] <= 4 * handed[0]


def test_rows_of_a_document_are_one_vertex(spark):
    for rows in ([(1, "p q r"), (1, "u v w"), (2, "u v w x")], [(1, "u v w"), (1, "p q r"), (2, "u v w x")]):
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2, 60).collect())
        assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 3, 1, False)]
    rows = [(5, "a b c"), (5, ""), (3, "a b c"), (7, "a b c"), (7, "k l m"), (9, "k l m"), (None, "k l m"), (8, None)]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == {(5, 3), (3, 3), (7, 3), (9, 3), (None, None), (8, 8)}


def test_regular_words_differ():
    """Words over two letters whose polynomial hashes modulo 2 ** 64 are equal for every base."""
    import pyarrow as pa

    one = "".join("ab"[i.bit_count() % 2] for i in range(2048))
    (_, _, data, offsets), = textarrays.pieces(pa.array([one, one.translate(str.maketrans("ab", "ba"))]))
    h = textarrays.word_hashes(data, *textarrays.words(data, offsets, textarrays.NOT_SPACE)[:2])
    assert h[0] != h[1]


def test_recall_at_the_threshold():
    """Pairs at a similarity of exactly 0.8 that share a node of the first levels; sets of few shingles pass whatever their sketches say."""
    rng = np.random.default_rng(0)
    for half, other in ((4, 1), (80, 20), (400, 100)):
        pairs = 400
        both = rng.integers(0, 2**63, (pairs, half), dtype=np.uint64)
        sides = [np.sort(np.concatenate([both, rng.integers(0, 2**63, (pairs, k), dtype=np.uint64)], 1), 1) for k in (other, 0)]
        shared = np.zeros(pairs, bool)
        met = []
        for x in sides:
            at = np.arange(pairs + 1) * x.shape[1]
            nodes = []
            for root in neardup.roots(neardup.trees_for(0.8)):
                nodes += neardup.walk(x.reshape(-1), at, [np.full(pairs, root)], [np.ones(pairs, bool)], neardup.BRANCH)[0]
            met.append(np.stack(nodes, 1))
        shared = np.array([len(np.intersect1d(a, b)) > 0 for a, b in zip(*met)])
        assert shared.all()
        if min(half, half + other) > neardup.FEW:
            drawn = [neardup.sketches(x.reshape(-1), np.arange(pairs + 1) * x.shape[1]) for x in sides]
            assert (neardup.estimates(*drawn) >= 0.8 - neardup.MARGIN).all()


def test_trees_reach_recall():
    one = neardup.shared_picks(0.8, 2)
    assert abs(sum(one) - 1) < 1e-9 and abs(sum(k * p for k, p in enumerate(one)) - 1.6) < 0.1
    assert neardup.shared_picks(0.8, 1) == pytest.approx([0.2, 0.8]) and 6 <= neardup.trees_for(0.8) <= 14 and neardup.trees_for(0.8) >= neardup.trees_for(0.8, branch=neardup.BRANCH)


# 5


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n, m in ((0, 2), (1, 1), (700, 7), (5000, 49408), (300, 2), (64, 70_000)):
        x = rng.integers(0, m, n)
        wm = wavelet.WaveletMatrix.build(x)
        assert (wm.all() == x).all() and (not n or (wm.access(np.arange(n)) == x).all())
        for t in set(x[:10].tolist()) | {m + 5}:
            assert wm.count(t) == (x == t).sum() and wm.occurrences(t) == np.flatnonzero(x == t).tolist() and wm.rank(t, n // 2) == (x[: n // 2] == t).sum()
    data = wavelet.pack([None, 4], [1, 2], np.array([5, 6, 7]))
    assert wavelet.unpack(data)[0] == [None, 4]
    for bad in (data[:-1], data[:30] + b"x" + data[31:], data[:-9] + bytes([data[-9] ^ 1]) + data[-8:], b""):
        with pytest.raises(ValueError):
            wavelet.unpack(bad)[2].all()


def test_parts_of_a_shard_are_read(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 1 << 10)
    x = np.random.default_rng(1).integers(0, 900, 40_000)
    data, read = wavelet.pack([1], [len(x)], x), []

    def part(at, n):
        read.append(n)
        return data[at : at + n]

    wm = wavelet.Shard(part, len(data)).matrix
    head = sum(read)
    assert wm.access([0, 17_000, 39_999]).tolist() == x[[0, 17_000, 39_999]].tolist()
    assert sum(read) - head < len(data) / 8
    assert wm.count(7) == (x == 7).sum() and wm.occurrences(7) == np.flatnonzero(x == 7).tolist() and (wm.all() == x).all()
    assert wm.rank(7, 40_000) == wm.count(7) and wm.rank(7, 0) == 0


def test_tokens_are_found_in_files(spark, odd):
    from corpuslens.runtime import new_path

    path, folder = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "tokens")
    shards = wavelet.write_shards(odd, folder, path, 2, True, 3000)
    assert shards.count() > 2
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4") for r in wavelet.read_shards(spark, folder, shards).collect()}
    cat = wavelet.encoder(path).whole(["cat"])[0]
    token = int(np.frombuffer(cat, "<u4")[0])
    got = wavelet.find_tokens(spark, folder, shards, [token, 49_000, 2], positions=True).collect()
    want = lambda t: sum(int((ids[r.doc_id] == t).sum()) for r in odd.collect())
    assert {t: sum(r.n for r in got if r.token == t) for t in (token, 49_000, 2)} == {t: want(t) for t in (token, 49_000, 2)}
    assert all(r.n == len(r.places) for r in got)


@pytest.mark.parametrize("apart", [True, False])
def test_shards_round_trip(spark, odd, none, apart):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(odd.collect(), key=lambda r: r.doc_id)
    got = sorted(wavelet.round_trip(odd, path, 2, apart, 5000).collect(), key=lambda r: r.start)
    start = 0
    for r, q in zip(rows, got, strict=True):
        ids = np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (q.doc_id, q.start, q.n_tokens, q.ids_crc32, bytes(q.ids)) == (r.doc_id, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4


def test_words_of_letters_are_encoded_without_marks(monkeypatch):
    """A word of letters is one piece with an end of its own."""
    import public_tokenizers

    w = wavelet.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["straße", "zzqxj", "a", "ñandú", "the", "ÿ"]
    assert w.pieces(words) == [w.whole([x])[0] for x in words] == w.apart(words)
    texts = ["", " ", "Ein Über-Maß, ŒUVRE Été. été\nÑANDÚ", "İx ŉ Σας ΣΑΣ x\u0301 É", "a1 b2c it's &&& straße&&&", "Été"]
    kept = []
    monkeypatch.setattr(w, "apart", lambda words: kept.extend(words) or w.whole(words))
    for _ in range(2):
        assert w.encode(texts) == w.whole(texts)
    assert "été" in w.kept.young and kept and not any(map(wavelet.LETTERS.fullmatch, kept))


def test_words_encode_apart():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(0)
    t, w = Tokenizer.from_file(path), wavelet.WordEncoder(path)
    pieces = ["a", "B", "'s", ",", ".", "..", " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "é", "É", "e\u0301", "_", "!", "3", ".5", "\u0301", "Straße", "word,", "\u3000", "\u0130", "ı", "Ω", "ς", "Σ", "й", "и\u0306", "漢", "ª", "½", "\u212a", "가", "\ufb01", "\u037e", "<|endoftext|>"]
    texts = ["BELED\u0130YES\u0130, x", "Z.\u0130. geldi", "a\x1c,b", "a\x1f.b", "x <|endoftext|> y", *("".join(rng.choices(pieces, k=rng.randrange(0, 40))) for _ in range(3000))]
    assert w.encode(texts) == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert w.words("Am Tag, été.") == ["Am", "Tag", ",", "été", "."] and w.words("BELED\u0130, x") == ["BELED\u0130,", "x"]


def test_added_tokens_encode_as_in_the_library():
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(1)
    t, w = Tokenizer.from_file(path), wavelet.WordEncoder(path)
    pieces = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|StartOfText|>", "<|endof", "text|>", "<|", "|>", "a", "B", ",", ".", " ", "\n", "É"]
    texts = ["a <|endoftext|> b", "A<|ENDOFTEXT|>B", "<|endoftext|>", "", *("".join(rng.choices(pieces, k=rng.randrange(0, 12))) for _ in range(600))]
    want = [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert np.frombuffer(want[0], "<u4").tolist() == [320, 49407, 321]
    assert w.whole(texts) == want and w.encode(texts) == want


# 6 and 7


def test_bpe_is_tiktoken(spark, odd):
    rng, enc = random.Random(0), tiktoken_encoding()
    v = bpe.vocabulary(PATH, PATTERN)
    pieces = ["a", "b", " ", "  ", "\n", "'", "s", "re", "1", ".", "é", "word ", "the ", "　", "\x1c", "́", "漢"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 999, "ab" * 2000, "".join(rng.choice("abcde") for _ in range(9000)), "<|endoftext|>"]
    for t, ids in zip(texts, v.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t)
        assert v.decode([ids]) == [t.encode()]
    df = odd.drop("ids")
    for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode() and len(r.ids) == 4 * len(enc.encode_ordinary(r.text or ""))
    with pytest.raises(ValueError):
        bpe.encode(odd, PATH, PATTERN)
    with pytest.raises(ValueError):
        bpe.round_trip(odd.drop("ids").withColumn("Decoded", F.lit(1)), PATH, PATTERN)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("wide", [1, 3, 10**9])
def test_buckets_of_any_size(wide, monkeypatch):
    """Merges by array operations and place by place give the same ids, with a small cache and slices too."""
    monkeypatch.setattr(bpe, "WIDE", wide)
    monkeypatch.setattr(bpe, "SLICE", 300)
    monkeypatch.setattr(bpe, "MANY", 7)
    rng, enc, v = random.Random(wide), tiktoken_encoding(), bpe.Vocabulary(PATH, PATTERN)
    v.kept = bpe.Recent(20_000)
    texts = ["".join(rng.choices(["an", "on", "th", "the", "ing", " ", "A", "é", "aa"], k=rng.randrange(0, 200))) for _ in range(200)] + ["an" * 2000]
    assert [np.frombuffer(x, "<u4").tolist() for x in v.encode(texts)] == [enc.encode_ordinary(t) for t in texts]
    assert v.kept.size <= 20_000 + 300 * (200 + 6)


def test_counts_follow_edits(spark, odd, none):
    rng, enc, c = random.Random(0), tiktoken_encoding(), token_counts.counter(PATH, PATTERN)
    pieces = ["a", "b", " ", "  ", "\n", "'", "s", "re", "ll", "1", "23", ".", "é", "word ", "the "]
    for _ in range(300):
        t = "".join(rng.choices(pieces, k=rng.randrange(0, 300)))
        (a, b), = c.split([t])
        tree = token_counts.Tree(a, b)
        for _ in range(rng.randrange(1, 4)):
            i = rng.randrange(len(t) + 1)
            j, new = min(len(t), i + rng.randrange(0, 9)), "".join(rng.choices(pieces, k=rng.randrange(0, 5)))
            want = t[:i] + new + t[j:]
            t, _ = tree.edit(t, i, j, new, c)
            assert t == want and tree.leaves() == c.split([t])[0] and tree.total == len(enc.encode_ordinary(t))
            assert token_counts.Tree.load(tree.dump()).leaves() == tree.leaves()
    df = odd.withColumn("edits", token_counts.replacements("text", "cat", "dog dog"))
    for r in token_counts.edit(token_counts.build(df, PATH, PATTERN), PATH, PATTERN).collect():
        want = (ODD[r.doc_id] or "").replace("cat", "dog dog")
        assert (r.text or "") == want and r.n_tokens == len(enc.encode_ordinary(want))
    few = token_counts.edit(token_counts.build(df.where("doc_id = 5"), PATH, PATTERN).withColumn("edits", F.expr("array(struct(10L AS skip, 1L AS remove, 'y' AS insert), struct(10000000L AS skip, 5L AS remove, cast(null as string) AS insert))")), PATH, PATTERN).first()
    assert few.text == "x" * 10 + "y" + "x" * 49_989
    assert token_counts.build(none, PATH, PATTERN).count() == 0


# 8


def test_contamination(spark, odd, none):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(6)]
    items = [(f"i{i}", " ".join(rng.choices(vocab, k=n))) for i, n in enumerate([3, 3, 5, 8, 20, 1])] + [("empty", ""), ("null", None), ("same", None)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randrange(0, 120)))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(300, "X, " + items[4][1].upper() + "!")]
    test = spark.createDataFrame(items, "item_id string, text string")
    windows = {}
    for i, t in items:
        w = (t or "").split()
        k = min(4, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in decontam.contamination(df, test, 4).collect()}
    for d, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower() if (t or "").isascii() else t)
        hit, found = set(), set()
        for k in {len(x) for x in windows}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in windows:
                    hit.update(range(j, j + k))
                    found |= windows[tuple(w[j : j + k])]
        r = got[d]
        assert (r.n_words, r.n_hit, list(r["items"]), r.contaminated) == (len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)), d
    assert max(m.n_words for m in got[300].matches) == 20
    blocks = {r.doc_id: sorted(map(tuple, r.spans)) for r in decontam.find_matches(df, test, 4, block_bytes=20).collect()}
    assert blocks == {r.doc_id: sorted(map(tuple, r.spans)) for r in decontam.find_matches(df, test, 4).collect()}
    assert decontam.contamination(none, test).count() == 0
    assert {r.contaminated for r in decontam.contamination(odd, test.limit(0)).collect()} == {False}
    assert decontam.decontaminate(odd, test, 4).columns == odd.columns


def test_items_without_id_and_clashing_columns(spark):
    test = spark.createDataFrame([(None, "a b c"), ("None", "d e f")], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x"), (2, "a b c", 6, "y"), (3, "z", 7, None)], "doc_id bigint, text string, n_hit int, n_words string")
    got = {r.doc_id: list(r["items"]) for r in decontam.contamination(docs, test, 3).collect()}
    assert got == {1: ["None", None], 2: [None], 3: []}
    left = decontam.decontaminate(docs.withColumns({"items": F.lit(1), "spans": F.lit(2), "contaminated": F.lit(True), "matches": F.lit("m"), "a.b": F.lit(3)}), test, 3).collect()
    assert [tuple(r) for r in left] == [(3, "z", 7, None, 1, 2, True, "m", 3)]
    with pytest.raises(ValueError):
        decontam.contamination(docs, test, 3, keep=("n_hit",))


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 5, 200):
        s = rng.integers(0, 3, n)
        key = lambda i: tuple(np.concatenate([s + 1, np.zeros(16, int)])[i : i + 16])
        assert [key(i) for i in decontam.suffix_array(s + 1)] == sorted(key(i) for i in range(n))


# 9


def test_secrets(spark, odd, none):
    key = "aB3" + "xY9" * 12
    texts = ["password = hunter22, Token:'abc'", "AKIA" + "A" * 16 + " x " + "f" * 24 + " AKIAB", f"AKIA{'B' * 16} {key}", key, f"see https://a.b/c then {key}", f"username: bob {'z' * 900} {key}", "😀 secret=abcdef😀", f"https://a.b/{key}", "password=secret=tokens"]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id bigint, text string").withColumn("kind", F.lit("clash"))
    got, links = {}, {}
    for r in secrets.scan(docs).collect():
        got[r.doc_id] = [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans]
        links[r.doc_id] = [[(x.kind, texts[r.doc_id][x.start : x.end]) for x in s.links] for s in r.spans]
    assert links[1] == [[], []] and links[2] == [[], [("access", "AKIA" + "B" * 16)]]
    assert links[4] == [[("secret", key)], [("endpoint", "https://a.b/c")]]
    assert got[0] == [("assign", "password = hunter22")]
    assert got[1] == [("access", "AKIA" + "A" * 16), ("hex", "f" * 24)]
    assert got[2] == [("access", "AKIA" + "B" * 16), ("secret", key)]
    assert got[3] == [] and got[5] == [] and got[7] == []
    assert got[4] == [("endpoint", "https://a.b/c"), ("secret", key)]
    assert got[6] == [("assign", "secret=abcdef")] and got[8] == [("assign", texts[8])]
    assert secrets.scan(docs).count() == 10 and secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0


def test_base_spans_by_brute_force(spark):
    rng = random.Random(0)
    pieces = ["password", "TOKEN", "api_key", " = ", ":", "'", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", " ", "x", "=", "\n", "deadbeefdeadbeef"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(0, 60))) for _ in range(150)]
    for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        want = []
        for rank, kind in enumerate(secrets.BASE):
            for m in re.finditer(secrets.PATTERNS[kind], texts[r.doc_id], re.ASCII):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                    want.append((m.start(), rank, kind, m.end()))
        assert [tuple(s)[:4] for s in r.spans if s.kind in secrets.BASE] == sorted(want)


# 10


def test_exact_duplicates(spark, none):
    texts = ["a b", "ab", "a  b", "A b", None, "", " \n", "long" * 20_000, "l ong" + "long" * 19_999, "é e", "é e"]
    rows = [*enumerate(texts), (1, "ab"), (50, "a  b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("sha256", F.lit("clash"))
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    want = []
    for d, t in rows:
        same = [(-len(x or ""), i) for i, x in rows if norm(x) == norm(t)]
        keep = min(same)[1]
        want.append((d, keep, len(same), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    for files in (10_000, 1):
        got = dedup.exact_duplicates(df.repartition(3), files).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)
    assert dedup.exact_duplicates(none).count() == 0
    kept = dedup.deduplicate(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, _, _, k, _ in want if k}


def test_repeated_ids_stay_apart(spark):
    """Rows that share a doc_id but not the text belong to groups of their own, also without doc_id."""
    rows = [(1, "ab"), (2, "ab"), (1, "zz"), (3, "zz"), (0, "ab "), (None, "q"), (None, "q"), (None, "ab")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup.exact_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 4, False), (2, 0, 4, False), (1, 1, 2, True), (3, 1, 2, False), (0, 0, 4, True), (None, None, 2, True), (None, None, 2, True), (None, 0, 4, False)], key=str)
    assert sorted(((r.doc_id, r.text) for r in dedup.deduplicate(df).collect()), key=str) == sorted([(0, "ab "), (1, "zz"), (None, "q"), (None, "q")], key=str)


def test_differing_bytes_are_parted(spark, monkeypatch):
    """With a digest under which all texts of a length are equal, the bytes decide."""
    monkeypatch.setattr(dedup.F, "sha2", lambda c, n: F.lpad(F.octet_length(c).cast("string"), 64, "0"))
    rows = [(1, "aa"), (2, "bb"), (3, "b b"), (4, "c"), (1, "dd"), (5, "dd"), (6, None), (7, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.keep_id, r.group_size) for r in dedup.exact_duplicates(df).collect())
    assert got == [(1, 1, 1), (1, 1, 2), (2, 3, 2), (3, 3, 2), (4, 4, 1), (5, 1, 2), (6, 7, 2), (7, 7, 2)]


def test_locators(spark, tmp_path):
    path = f"file://{tmp_path}/docs"
    spark.createDataFrame([(1, "a"), (2, "a "), (3, "b")], "doc_id bigint, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: r.locator.rpartition("#") for r in dedup.exact_duplicates(spark.read.parquet(path)).collect()}
    assert [got[i][2] for i in (1, 2, 3)] == ["1", "1", "2"] and all(x[0].startswith("file:") for x in got.values())
