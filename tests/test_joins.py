"""The pruned and the approximate join, statistics beside products, marking of terms, packing, paging, greedy groups and late data."""

import datetime
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.functions import terms
from corpuslens.functions import text as tx
from corpuslens.operators import chunking, grouping, lsh, paging, pruned, search, stats, vectors
from corpuslens.streaming import incremental

SCHEMA = "id string, owner string, koza_id string, content_embedding array<double>"


def points(n, d, seed, spread=None, groups=12):
    """Rows of ids, owners, courses (some null) and vectors; with spread, around so many centres."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) if spread is None else rng.standard_normal((groups, d))[rng.integers(0, groups, n)] + spread * rng.standard_normal((n, d))
    return [(str(i), str(i // 3), None if i % 11 == 0 else f"c{i % 4}", v) for i, v in enumerate(x.tolist())]


def cosines(rows):
    x = np.zeros((len(rows), max(len(r[3]) for r in rows)))
    for i, r in enumerate(rows):
        x[i, : len(r[3])] = r[3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x @ x.T


def by_loops(rows, threshold, top=None, owner=True, bases=None, same=False):
    c, out = cosines(rows), {}
    for i, a in enumerate(rows):
        if bases is None or a[0] in bases:
            near = [(-c[i, j], b[0]) for j, b in enumerate(rows) if (a[1] != b[1] if owner else i != j) and c[i, j] >= threshold and (not same or (a[2] is not None and a[2] == b[2]))]
            out |= {(a[0], b): -s for s, b in sorted(near)[:top]}
    return out


def pairs_of(found):
    return {(r.base_id, r.similar_id): r.similarity for r in found.collect()}


@pytest.mark.parametrize("spread", [None, 0.15, 0.01])
@pytest.mark.parametrize("top", [None, 4])
def test_pruned_join(spark, spread, top):
    rows = points(260, 12, 5, spread)
    # copies of one vector in several blocks, shorter vectors, and rows without any
    rows += [(f"x{i}", f"x{i}", "c1", rows[7][3]) for i in range(25)] + [("s1", "s1", "c1", rows[3][3][:9]), ("s2", "s2", "c2", rows[3][3][:9])]
    df = spark.createDataFrame([*rows, ("z", "z", "c1", [0.0] * 12), ("e", "e", "c1", []), ("n", "n", "c1", None)], SCHEMA)
    for bases in (None, {"3", "50", "x4", "s1"}):
        for same in (False, True):
            base = None if bases is None else df.where(F.col("id").isin(list(bases)))
            got = pairs_of(vectors.similarity_join(df, 0.35, top, owner="owner", block_rows=40, base=base, same="koza_id" if same else None))
            want = by_loops(rows, 0.35, top, True, bases, same)
            if top is None:
                assert got.keys() == want.keys()
            else:
                # copies are equal up to rounding, so ties among them may be broken either way
                assert sorted((a, round(s, 9)) for (a, _), s in got.items()) == sorted((a, round(s, 9)) for (a, _), s in want.items())
            assert all(abs(v - want[k]) < 1e-9 for k, v in got.items() if k in want)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(f"{i:03}", f"{i:03}", "c", [1.0, 0.0]) for i in range(40)] + [("q", "q", "c", [1.0, 0.0])]
    got = pairs_of(vectors.similarity_join(spark.createDataFrame(rows, SCHEMA), 0.5, 3, block_rows=7))
    assert {b for (a, b) in got if a == "q"} == {"000", "001", "002"} and len(got) == 41 * 3


def products(spark, rows, threshold, top=None):
    df = spark.createDataFrame(rows, SCHEMA)
    join = vectors.joined(df, threshold, block_rows=50, halves=top is None)
    return (join.pairs(counted=True) if top is None else join.best(top, counted=True)).agg(F.sum("products")).first()[0] / len(rows) ** 2


def test_share_of_products(spark):
    """Of clustered vectors a part of all products is made, and a lesser one the more clusters there are; of random ones nearly all."""
    share = [products(spark, points(n, 16, 1, 0.05, groups), 0.8) for n, groups in ((100, 4), (400, 16), (1600, 64))]
    print("share of products at 1x, 4x, 16x:", share)
    assert share[0] > share[1] > share[2] and share[2] < 0.2
    best = [products(spark, points(n, 16, 1, 0.05, groups), -1.0, 5) for n, groups in ((400, 16), (1600, 64))]
    print("for the best five:", best)
    assert best[1] < best[0] and best[1] < 0.5
    assert products(spark, points(400, 16, 1), 0.2) > 0.9


def test_moments(spark):
    rows = points(130, 8, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    bases = [r[0] for r in rows[::13]]
    moments = vectors.similarity_stats(df, "koza_id", base=df.where(F.col("id").isin(bases)))
    c = cosines(rows)
    others = {b: [(rows[j][2], c[int(b), j]) for j in range(len(rows)) if j != int(b)] for b in bases}
    for r in stats.neighbour_stats(moments).collect():
        x = np.array([s for _, s in others.pop(r.base_id)])
        assert (r.n, r.avg, r.stddev, r.min, r.max) == pytest.approx((len(x), x.mean(), x.std(ddof=1), x.min(), x.max()))
    assert not others
    for r in stats.similarity_by_course(moments).collect():
        x = np.array([c[int(r.base_id), j] for j in range(len(rows)) if j != int(r.base_id) and rows[j][2] == r.koza_id])
        assert (r.n, r.avg, r.max) == pytest.approx((len(x), x.mean(), x.max()))
    assert vectors.similarity_stats(df.limit(0), "koza_id").count() == 0


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_approximate_join(spark, threshold):
    """Recall at the threshold, a small share of candidates, large buckets in blocks, each pair once."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 48))
    x /= np.linalg.norm(x, axis=1)[:, None]
    aside = rng.standard_normal((200, 48))
    aside -= (aside * x[:200]).sum(1)[:, None] * x[:200]
    aside /= np.linalg.norm(aside, axis=1)[:, None]
    t = threshold + 0.002
    x = np.concatenate([x, t * x[:200] + math.sqrt(1 - t * t) * aside, x[:1] + 0.001 * rng.standard_normal((120, 48))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    units = spark.createDataFrame([(f"{i:04}", v) for i, v in enumerate(x.tolist())], "id string, unit array<double>")
    found, candidates = lsh.approximate_join(units, threshold, 0.9)
    rows = found.collect()
    got = {(int(r.a), int(r.b)) for r in rows}
    want = {(i, j) for i, j in np.argwhere(x @ x.T >= threshold).tolist() if i < j}
    assert len(rows) == len(got) and got <= want
    planted = {(i, 700 + i) for i in range(200)}
    assert len(got & planted) >= 0.85 * len(planted) and len(got) >= 0.95 * len(want)
    assert all((0, j) in got for j in range(900, 1020))
    share = candidates.count() / (len(x) * (len(x) - 1) / 2)
    print("candidates of all pairs:", share)
    assert share < (0.25 if threshold < 0.9 else 0.06)


def test_shape_of_bands():
    for t in (0.5, 0.8, 0.95):
        for n in (100, 10_000, 10**7):
            signs, bands = lsh.shape(t, 0.9, n)
            agree = 1 - math.acos(t) / math.pi
            assert 1 - (1 - agree**signs) ** bands >= 0.9
        assert lsh.shape(t, 0.9, 10**7)[0] > lsh.shape(t, 0.9, 100)[0]
    assert lsh.shape(1.0, 0.9, 1000)[1] == 1


def test_approximate_join_on_the_table(spark):
    from oracle import SF

    df = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("content_embedding"))
    rows = [(r.id, r.id, None, [float(v) for v in r.content_embedding]) for r in df.collect()]
    want = {k for k in by_loops(rows, 0.4) if k[0] < k[1]}
    got = {(r.a, r.b) for r in vectors.lsh_candidates(df, 0.4).collect()}
    print("pairs:", len(want), "found:", len(got & want))
    assert got <= want and len(got) >= 0.9 * len(want) > 30


# terms


def sequential(text, words):
    for w in words:
        text = text.replace(w, f"【{w}】")
    return text


@pytest.mark.parametrize("words", [tx.TERMS, tx.LAW_TERMS, tx.FIELD_KEYWORDS["finance"] + tx.TERMS, ["a", "aa", "ab", "ba", "aba", "b"], ["aa", "a"], ["abc", "bc", "ab", "b", "abc"]])
def test_marks_are_as_if_one_after_the_other(words):
    rng, found = random.Random(3), terms.Finder(words)
    letters = sorted(set("".join(words))) + ["x", "\n", "【", "】"]
    for _ in range(3000):
        text = "".join(rng.choice([rng.choice(words), rng.choice(letters)]) for _ in range(rng.randrange(16)))
        assert found.marked(text) == sequential(text, words)


def test_terms_of_columns(spark):
    rows = [("1", "行政書士法と代理、登録"), ("4", "重要事項説明と登録"), ("99", "登録"), (None, "登録"), ("1", None), ("1", "")]
    df = spark.createDataFrame(rows, "k string, t string")
    got = df.select(terms.marked_by(F.col("t"), F.col("k"), tx.COURSE_KEYWORDS, ["登録"]).alias("x"), terms.most_named(F.col("t"), tx.FIELD_KEYWORDS, "general").alias("f"), tx.keyword_marks(F.col("t"), tx.TERMS).alias("m")).collect()
    for (k, t), r in zip(rows, got, strict=True):
        assert r.x == (None if t is None else sequential(t, [*tx.COURSE_KEYWORDS.get(k, []), "登録"])) and r.m == (None if t is None else sequential(t, tx.TERMS))
        counts = [(sum(w in (t or "") for w in ws), -i, f) for i, (f, ws) in enumerate(tx.FIELD_KEYWORDS.items())]
        assert r.f == (max(counts)[2] if max(counts)[0] else "general")
    with pytest.raises(ValueError):
        terms.Finder(["a", ""])


# packing


def folded(pieces, most):
    done, now = [], ""
    for joiner, text in pieces:
        if now and len(now) + len(text) > most:
            done, now = [*done, now], ""
        now = text if not now else now + joiner + text
    return [*done, now] if now else done


def test_packing_is_that_of_a_fold():
    rng = random.Random(5)
    for _ in range(2000):
        pieces = [(rng.choice([" ", "\n", "", "-----"]), "x" * rng.choice([1, 2, 5, 9, 30])) for _ in range(rng.randrange(12))]
        assert chunking.packed(pieces, 20) == folded(pieces, 20)


def test_packing_takes_linear_time():
    import time

    def taken(n):
        text = "\n".join(["文" * 50 + "。"] * n)
        began = time.perf_counter()
        parts = chunking.long_parts(text, 800, False)
        assert len(parts) == -(-n // 15) and sum(map(len, parts)) == len(text) - len(parts) + 1
        return time.perf_counter() - began

    taken(100)
    # a section of ten million characters: ten times the work of one of a million, with room for a busy machine
    assert taken(196_000) < 30 * max(min(taken(19_600) for _ in range(3)), 0.02)


# pages


def test_pages(spark):
    rng = random.Random(1)
    rows = [(str(i), rng.choice([None, 0, 1, 1, 5]), f"t{i % 7}") for i in range(503)]
    df = spark.createDataFrame(rows, "id string, pageviews bigint, title string")
    order = search.sort_columns("pageviews_desc")
    want = [r.id for r in df.orderBy(*order).collect()]
    for ranges in (1, 5, 40):
        pages = paging.paged(df, order, ranges)
        assert pages.total == 503 and pages.page(1, 20).columns == df.columns
        for number in (1, 2, 13, 25, 26, 27):
            assert [r.id for r in pages.page(number, 20).collect()] == want[20 * (number - 1) : 20 * number]
        assert [r.id for r in pages.page(2, 300).collect()] == want[300:]
    # as many files are read for a page in the depth as for the first
    plans = [pages.page(n, 5)._jdf.queryExecution().executedPlan().toString() for n in (1, 90)]
    assert all("__range" in re.search(r"PartitionFilters: \[(.*?)\]", p)[1] for p in plans)
    assert paging.paged(df.limit(0), order).page(1, 10).collect() == []


# groups


def groups_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.group, []).append((r.a, r.b))
    return {k: sorted(v) for k, v in out.items()}


def test_groups_by_component_and_in_rounds(spark):
    from test_rules import greedy

    for seed in range(2):
        rng = random.Random(seed)
        pairs = {(a, b): rng.choice([0.8, 0.85, 0.9, 0.95]) for a, b in (sorted(rng.sample(range(100, 300), 2)) for _ in range(150))}
        rows = [(str(a), str(b), s) for (a, b), s in pairs.items()]
        df = spark.createDataFrame([*rows, rows[0], (None, "7", 0.9)], "a string, b string, similarity double")
        for solved in (0, 20, 10_000):
            assert groups_of(grouping.one_hop(df, solved).collect()) == greedy(rows)


def test_a_falling_chain(spark):
    """Each pair waits for the one before: by itself in one task it takes no rounds."""
    n = 100_000
    df = spark.range(n).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 6, "0").alias("b"), (1 - F.col("id") / n).alias("similarity"))
    found = grouping.one_hop(df)
    # the pairs 0, 3, 6, ... seed groups, each with the pairs on both sides that are left
    assert found.select("group").distinct().count() == -(-n // 3) and found.count() == n


# late data


def events(n, parts, spark):
    """Events of 40 days whose times are in no order, some without any."""
    at = F.when(F.col("id") % 50 == 49, None).otherwise(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7919 % n * (40 * 86400 // n)))
    rows = spark.range(0, n, 1, parts)
    return rows.select(at.alias("ts"), F.when(F.col("id") % 3 == 0, "page_view").otherwise("scroll").alias("event_name"), F.concat(F.lit("p"), F.col("id") % 4).alias("page_location"), (F.col("id") % 9).cast("string").alias("user_pseudo_id"), F.lit("g").alias("ga_session_id"))


def expected(rows):
    out = {}
    for r in rows:
        if r.ts is not None:
            key = (r.ts.date(), r.page_location)
            views, sessions = out.setdefault(key, (0, set()))
            out[key] = (views + (r.event_name == "page_view"), sessions | {f"{r.user_pseudo_id}-{r.ga_session_id}"})
    return {k: (v, len(s)) for k, (v, s) in out.items()}


def run_in_pieces(spark, rows, kept, path, stops):
    """A file a batch; the run is broken off and begun again after some of them."""
    stream = lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def each(batch, number):
        kept.take(batch, number)
        if number in stops:
            stops.remove(number)
            raise RuntimeError("broken off after its tables were written")

    while True:
        try:
            incremental.run_available(stream(), path + "-progress", each)
            return
        except Exception as e:
            if "broken off" not in str(e):
                raise


def test_late_data_is_exact(spark, tmp_path):
    """Shuffled files, one a batch, with restarts that run a batch again: views and sessions are those of all rows at once."""
    rows = events(600, 6, spark)
    rows.write.parquet(f"{tmp_path}/in")
    kept = incremental.daily_page_metrics(f"{tmp_path}/totals")
    run_in_pieces(spark, rows, kept, f"{tmp_path}/in", {1, 4})
    got = {(r.span.date(), r.page_location): (r.pageviews, r.sessions) for r in kept.totals(rows).collect()}
    assert got == expected(rows.collect())
    late = kept.late(rows)
    assert late.count() == 12 and late.where("ts IS NOT NULL").isEmpty()
    last = kept.revisions(rows, 5).collect()
    assert last and all(got[r.span.date(), r.page_location] == (r.pageviews, r.sessions) for r in last)


def test_rows_beyond_the_horizon_are_kept_aside(spark, tmp_path):
    rows = events(600, 5, spark)
    rows.write.parquet(f"{tmp_path}/in")
    kept = incremental.daily_page_metrics(f"{tmp_path}/totals", "10 days")
    run_in_pieces(spark, rows, kept, f"{tmp_path}/in", {2})
    late = kept.late(rows).collect()
    assert len([r for r in late if r.ts is not None]) > 100 and {r.batch for r in late} <= set(range(5))
    asides = [tuple(r)[:5] for r in late]
    taken = [r for r in rows.collect() if not (tuple(r) in asides and asides.remove(tuple(r)) is None)]
    assert not asides and {(r.span.date(), r.page_location): (r.pageviews, r.sessions) for r in kept.totals(rows).collect()} == expected(taken)
    # what is aside is older than the newest of the batches before, less the horizon
    newest = max(r.ts for r in taken)
    assert all(r.ts is None or r.ts < newest - datetime.timedelta(days=10) for r in late)


def test_late_usage(spark, tmp_path):
    n = 240
    rows = spark.range(0, n, 1, 4).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7919 % n * 900).alias("log_ts"), F.lit("local").alias("provider"), F.when(F.col("id") % 5 > 0, F.col("id")).alias("response_time_ms"), F.lit(1.5).alias("cost_estimate"), (F.col("id") % 2 == 0).alias("success"))
    rows.write.parquet(f"{tmp_path}/in")
    kept = incremental.hourly_usage(f"{tmp_path}/totals")
    run_in_pieces(spark, rows, kept, f"{tmp_path}/in", {0})
    got = kept.totals(rows)
    assert got.count() == n // 4 and tuple(got.agg(*[F.sum(c) for c in ("requests", "timed", "total_ms", "cost", "successes")]).first()) == (n, n * 4 // 5, sum(i for i in range(n) if i % 5), 1.5 * n, n // 2)
