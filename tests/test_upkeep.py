"""Lists kept up to date, the trigram index, and session sketches."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import engagement, search, textindex, toplists

SCHEMA = "id string, content_embedding array<double>, wanted boolean"


def frame(spark, state):
    return spark.createDataFrame([(i, v, w) for i, (v, w) in state.items()] or [], SCHEMA)


def listed(df):
    return sorted((r.base_id, r.similar_id, round(r.similarity, 9)) for r in df.collect())


@pytest.mark.parametrize("seed, threshold, some", [(1, -1.0, False), (2, 0.2, False), (3, 0.2, True)])
def test_refreshed_lists_are_those_of_a_full_build(spark, seed, threshold, some):
    rng = np.random.default_rng(seed)
    vector = lambda: [round(x, 6) for x in rng.standard_normal(6).tolist()]
    state = {str(i): (vector(), bool(rng.random() < 0.5)) for i in range(80)}
    only = lambda df: df.where("wanted") if some else None
    now = frame(spark, state)
    lists = toplists.build(now, 4, threshold, only(now))
    for step in range(2):
        changed = []
        for i in rng.choice(list(state), 6, replace=False).tolist():
            changed.append(i)
            kind = rng.integers(0, 4)
            if kind == 0:
                del state[i]
            elif kind == 1:
                state[i] = (vector(), state[i][1])
            elif kind == 2:
                state[i] = (None, state[i][1])
            else:
                state[i] = (state[i][0], not state[i][1])
        for k in range(3):
            state[f"n{step}{k}"] = (vector(), True)
            changed.append(f"n{step}{k}")
        now = frame(spark, state)
        told = spark.createDataFrame([(i,) for i in [*changed, changed[0], "unknown"]], "id string")
        lists = toplists.materialise(toplists.refresh(lists, now, told, 4, threshold, only(now)), "lists")
        assert listed(lists) == listed(toplists.build(now, 4, threshold, only(now)))
    nothing = toplists.refresh(lists, now, told.limit(0), 4, threshold, only(now))
    assert listed(nothing) == listed(lists)


def test_only_touched_lists_are_built_again(spark):
    rng = np.random.default_rng(8)
    state = {str(i): (rng.standard_normal(6).tolist(), True) for i in range(200)}
    now = frame(spark, state)
    lists = toplists.materialise(toplists.build(now, 3, -1.0), "lists")
    changed = spark.createDataFrame([("7",), ("new",)], "id string")
    again = {r.id for r in toplists.touched(lists, now, changed, 3).collect()}
    # article 7 itself, and those that list it
    assert again == {"7"} | {r.base_id for r in lists.where("similar_id = '7'").collect()} and len(again) < 20


WORDS = ["alpha", "Beta", "gamma", "ÜBER", "naïve", "漢字", "x", "delta-9", "The", "100%", "a_b"]


def test_indexed_search_gives_the_rows_of_a_scan(spark):
    rng = random.Random(2)
    rows = [(str(i), rng.choice([None, "", " ".join(rng.choices(WORDS, k=rng.randrange(1, 9)))]), " ".join(rng.choices(WORDS, k=30)), i % 7 or None) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, title string, full_content string, pageviews bigint")
    built = textindex.build(df, ["title", "full_content"], parts=8, block_rows=10)
    for query in ("alpha", "ALPHA beta", "über", "naïve 漢", "漢字", "x", "", "%", "a_b", "delta-9 the 100%", "no such", "gamma alpha gamma alpha gamma", "lph"):
        for fields in (["title"], ["title", "full_content"]):
            got = built.search(query, fields)
            assert got.columns == df.columns
            assert sorted(r.id for r in got.collect()) == sorted(r.id for r in search.text_search(df, query, fields).collect()), query
    weights, order = {"title": 3, "full_content": 2}, [F.desc_nulls_last("pageviews"), F.col("id").asc()]
    low = lambda x: (x or "").lower()
    for query in ("alpha", "naïve 漢", "no such", "e"):
        weight = lambda r: 3 if query in low(r[1]) else 2 if query in low(r[2]) else 0  # noqa: B023, E731
        want = [r[0] for r in sorted(rows, key=lambda r: (-weight(r), r[3] is None, -(r[3] or 0), r[0]))][:40]
        assert [r.id for r in built.ranked(query, weights, order, 40).orderBy("place").collect()] == want
    with pytest.raises(ValueError):
        built.search("alpha", ["id"])
    assert textindex.build(df.limit(0), ["title"]).search("alpha", ["title"]).count() == 0


def test_a_rare_query_reads_a_small_share(spark):
    """Of the files of rows and postings, a query with few hits reads those of its blocks and trigrams."""
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrst"
    rows = [(str(i), "".join(rng.choices(letters, k=60))) for i in range(3000)]
    rows[1234] = ("1234", rows[1234][1] + " wxyz")
    built = textindex.build(spark.createDataFrame(rows, "id string, title string").repartition(6), ["title"], parts=16, block_rows=50)
    found = built.search("wxyz", ["title"])
    assert [r.id for r in found.collect()] == ["1234"]
    all_files = len(built.rows.inputFiles())
    read = re.findall(r"__block#\d+L? (?:=|IN) [^\]]*", found._jdf.queryExecution().optimizedPlan().toString())
    assert read and built.candidates("wxyz", ["title"]).count() == 1 and all_files > 50
    postings = re.search(r"PartitionFilters: \[([^\]]*)\]", built.candidates("wxyz", ["title"])._jdf.queryExecution().executedPlan().toString())[1]
    assert "__part" in postings


def test_sketches_are_within_their_bound(spark):
    """Sessions of windows of days, united from sketches of days: their error is that of one sketch, and views are exact."""
    n, host = 60_000, "h.test"
    rows = spark.range(n).select(
        F.concat(F.lit(f"https://{host}/c/column/p"), F.col("id") % 3, F.when(F.col("id") % 2 == 0, "/").otherwise("?x")).alias("page_location"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 10).cast("int")).alias("event_date"),
        F.when(F.col("id") % 4 > 0, "page_view").otherwise("scroll").alias("event_name"), (F.col("id") * 7919 % 9001).cast("string").alias("user_pseudo_id"), F.when(F.col("id") % 97 > 0, F.lit("1")).alias("ga_session_id"),
        F.when(F.col("id") % 5 == 0, "organic").otherwise("referral").alias("traffic_medium"), (F.col("id") % 3).alias("engagement_time_msec"),
    )
    kept = engagement.page_day_sketches(rows, host)
    # three standard errors
    bound = 3 * 0.83 / math.sqrt(2**engagement.SKETCH)
    for first, last in ((None, None), ("2024-01-03", "2024-01-05"), ("2024-01-10", None)):
        some = rows.where(F.col("event_date").between(first or "2024-01-01", last or "2024-01-31"))
        exact = {r.path: r for r in engagement.exact_by_path(some, host).collect()}
        got = engagement.from_sketches(kept, first, last).collect()
        assert len(got) == len(exact) == 3
        for r in got:
            want = exact[r.path]
            assert (r.pageviews, r.engagement_msec) == (want.pageviews, want.engagement_msec)
            assert all(abs(r[m] - want[m]) <= bound * want[m] + 1 for m in ("sessions", "organic_sessions", "engaged_sessions"))
    whole = engagement.from_sketches(kept, keys=()).first()
    exact = rows.agg(F.count_distinct(engagement.session_id())).first()[0]
    assert abs(whole.sessions - exact) <= bound * exact


def test_any_model_can_embed(spark):
    """A model is a pandas function of texts; what it fails on has no vector, is in no list and on the work list."""
    import pandas as pd

    from corpuslens.operators import vectors

    @F.pandas_udf("array<double>")
    def model(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None or t.startswith("bad") else [float(len(t)), float(t.count("a")), 1.0])

    texts = ["aaa", "aab", "bad one", None, "", "a long text"]
    rows = vectors.embed(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, full_content string"), "full_content", model=model)
    got = {r.id: r.content_embedding for r in rows.collect()}
    assert got == {"0": [3.0, 3.0, 1.0], "1": [3.0, 2.0, 1.0], "2": None, "3": None, "4": [0.0, 0.0, 1.0], "5": [11.0, 1.0, 1.0]}
    lists = toplists.build(rows, 2, -1.0).collect()
    assert {r.base_id for r in lists} == {"0", "1", "4", "5"} and {r.similar_id for r in lists} == {"0", "1", "5"}
    assert {r.id for r in search.embedding_worklist(rows, least=3).collect()} == {"2"}
