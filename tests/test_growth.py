"""What a step holds, sends and shuffles doesn't grow out of proportion."""

import os
import re
import sys

import numpy as np
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, __file__.rsplit("/", 1)[0])

from corpuslens.operators import lsh, pruned, vectors  # noqa: E402


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def near(spark):
    rng = np.random.default_rng(5)
    rows = [(str(i), "t", v) for i, v in enumerate(rng.standard_normal((60, 8)).tolist())]
    return spark.createDataFrame(rows, "id string, title string, content_embedding array<double>")


def test_similarities_are_not_sent_to_the_driver(near):
    """They look as small as the list of blocks, and would be broadcast."""
    base = near.where("id IN ('0', '50')")
    assert "Join" not in plan(vectors.nearest_to(base, near, columns=[])).split("MapInArrow")[0]
    for columns in (None, ["title"]):
        found = vectors.nearest_to(base, near, columns=columns)
        assert re.search(r"\w+Join", plan(found))[0] == "SortMergeJoin" and found.count() == 2 * 59
    assert vectors.nearest_to(base, near, columns=[]).columns == ["base_id", "id", "similarity"]


def test_best_lists_hold_what_is_found():
    """Room for a thousand million best a row isn't taken beforehand; lists are those of a sort."""
    rng = np.random.default_rng(6)
    products = np.round(rng.standard_normal((40, 300)), 1)
    ids = np.array([str(k) for k in range(300)], object)
    for n in (1, 7, 10**9):
        best = pruned._Best(40, n, 0.3)
        for s in range(0, 300, 50):
            best.meet(np.arange(40), products[:, s : s + 50].copy(), ids[s : s + 50])
        rows, values, names = best.found()
        for i in range(40):
            want = sorted((-products[i, k], ids[k]) for k in range(300) if products[i, k] >= 0.3)[:n]
            assert sorted(zip((-values[rows == i]).tolist(), names[rows == i].tolist(), strict=True)) == want


def test_texts_are_moved_once(spark):
    """The joins of v_articles meet the ids; what needs no text doesn't move it."""
    from oracle import SF

    from corpuslens.fixtures import view

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        articles = view(spark, SF, "v_articles")
        moved = lambda df: [x for x in re.findall(r"Exchange hashpartitioning[^\n]*\n[^\n]*", plan(df)) if re.search(r"\btext#", x)]
        assert len(moved(articles.select("id", "full_content", "pageviews"))) == 1
        assert not moved(articles.select("id", "pageviews"))
        assert plan(articles.select("id", "full_content")).count("ShuffledHashJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_few_bands_for_low_thresholds():
    """A row is shuffled for each band, with its signs: thousands of bands (5,778 of 17 signs before) don't fit."""
    for n in (10_000, 100_000, 600_000):
        signs, bands = lsh.shape(0.4, 0.9, n)
        agree = 1 - np.arccos(0.4) / np.pi
        assert bands <= 100 and 1 - (1 - agree**signs) ** bands >= 0.9


def test_matches_are_ranked_once(spark):
    """Chunk matches come ranked from the join; they aren't moved and sorted once more, nor moved with articles."""
    from oracle import SF

    from corpuslens import queries

    queries.load()
    assert len(re.findall(r"\bWindow \[row_number", plan(queries.QUERIES["w01_ranked_matches"](spark, SF)))) == 1


def rows_moved(spark, df):
    """Rows that are written to shuffles while df is computed."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm

    def total():
        sc.listenerBus().waitUntilEmpty()
        none = jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def grown(spark, folder, times):
    """The tables, with orders and events repeated with shifted keys."""
    from oracle import SF

    from corpuslens.fixtures import TABLES

    folder.mkdir()
    for t in TABLES:
        key = {"orders": "o_orderkey", "events": "event_id"}.get(t)
        if key is None:
            os.symlink(f"{SF}/{t}.parquet", folder / f"{t}.parquet")
            continue
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        n = rows.agg({key: "max"}).first()[0] + 1
        rows.crossJoin(spark.range(times).withColumnRenamed("id", "copy")).selectExpr(*[f"{c} + copy * {n} AS {c}" if c == key else c for c in rows.columns]).coalesce(1).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


def test_orders_and_events_of_no_document_are_not_moved(spark, tmp_path):
    """Where orders and events are too large to be broadcast, only those move whose keys articles and the cache can have (all of them before)."""
    from oracle import duck, same

    from corpuslens import queries
    from corpuslens.fixtures import view

    queries.load()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, large = grown(spark, tmp_path / "20", 20), grown(spark, tmp_path / "40", 40)
        dates = lambda sf: rows_moved(spark, view(spark, sf, "v_articles").select("id", "created_at", "updated_at"))
        assert 0 < dates(large) <= dates(small)
        times = lambda sf: rows_moved(spark, view(spark, sf, "v_cache"))
        assert 0 < times(large) <= times(small)
        con = duck(large)
        for name in ("z08_compare", "t33_cache_prompts", "a12_one_course", "d02_merge_articles"):
            assert same(queries.QUERIES[name](spark, large), con, queries.ORACLE_SQL[name]) > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_metrics_that_nobody_asks_for_are_not_made(spark):
    """One row a document, joined by the key that it is grouped by: without its columns the join is dropped, and events aren't read for it."""
    from oracle import SF

    from corpuslens import queries

    queries.load()
    assert "events.parquet" in plan(queries.QUERIES["a12_one_course"](spark, SF))
    for name in ("p20_highlight", "p18_search_excerpt"):
        assert "events.parquet" not in plan(queries.QUERIES[name](spark, SF))


def cloud(spark, n):
    rng = np.random.default_rng(8)
    rows = [(f"{i:05}", str(i // 10), v) for i, v in enumerate(rng.standard_normal((n, 16)).tolist())]
    return spark.createDataFrame(rows, "id string, article string, content_embedding array<double>")


def stored(found, folder):
    """Similarities of each file that is written, in their order."""
    found.write.parquet(str(folder))
    files = [pq.read_table(f)["similarity"].to_numpy() for f in sorted(folder.glob("*.parquet"))]
    return [x for x in files if len(x)]


def test_pairs_are_stored_in_order(spark, tmp_path):
    """Equal similarities lie beside each other (about every second pair was out of order before), pairs beside their reverse."""
    df = cloud(spark, 1200)
    files = stored(vectors.similarity_join(df, 0.2, None, owner="article", block_rows=400), tmp_path / "pairs")
    assert sum(map(len, files)) == vectors.similarity_join(df, 0.2, None, owner="article").count() > 300_000
    # a task's pairs within a block and with others are in order on their own
    assert sum((np.diff(x) < 0).sum() for x in files) <= 3 * len(files)


def test_every_pair_in_full_blocks(spark, tmp_path):
    """Where no pair can be skipped, blocks are of one cell and full, so that a task has many pairs of few ids to put in order."""
    df = cloud(spark, 4000)
    base = df.where("CAST(id AS INT) % 50 = 0")
    files = stored(vectors.nearest_to(base, df, columns=[]), tmp_path / "all")
    assert sum(map(len, files)) == 80 * 3999
    assert sum((np.diff(x) < 0).sum() for x in files) <= 3 * len(files)
    table = vectors.joined(df, -2.0, block_rows=100, whole=True).first.table
    assert table.select("cell").distinct().count() == 1 and table.count() <= 60


def test_sizes_of_blocks_make_no_lists(spark):
    """Numbers and least ids of similar articles and of courses, those of the lists, without a row for each similar article."""
    from pyspark.sql import functions as F

    from corpuslens.plans import jobs

    n = F.col("id").cast("int")
    df = cloud(spark, 2400).select("id", F.when(n % 5 != 1, F.concat(F.lit("c"), n % 5)).alias("koza_id"), F.lit("t").alias("title"), "content_embedding")
    df = df.union(df.where("id < '00200'").selectExpr("concat('z', id)", "koza_id", "title", "content_embedding")).union(df.selectExpr("concat('y', id)", "koza_id", "title", "CAST(NULL AS array<double>)"))
    base = df.where("try_cast(id AS INT) % 50 = 0")
    got = {(r.base_id, r.type): (r.n, r.first) for r in jobs.neighbour_sizes(df, base, 0.2).collect()}
    lists = jobs.neighbour_blocks(df, base, 0.2, 10**6).withColumn("of", F.from_json("data", "array<struct<id:string,koza_id:string>>")).collect()
    known = lambda r: [x.koza_id for x in r.of if x.koza_id is not None]
    want = {(r.base_id, r.type): (1, None) if r.type == "stats" else (len(r.of), min(x.id for x in r.of)) if r.type == "high_similarity" else (len(known(r)), min(known(r))) for r in lists}
    assert got == want and len(got) == 3 * 48
    assert {r.type for r in jobs.neighbour_sizes(df, base, 1.1).collect()} == {"stats", "course_similarities"}
    # of more than 10,000 similar ones, before each was moved several times
    assert sum(n for (_, kind), (n, _) in got.items() if kind == "high_similarity") > 10_000
    assert rows_moved(spark, jobs.neighbour_sizes(df, base, 0.2)) < 1_000


def test_courses_that_nobody_knows_are_not_counted(spark):
    """As count(DISTINCT ...) and min(...) of SQL do."""
    from corpuslens.plans import jobs

    df = spark.createDataFrame([("0", "x", [1.0, 0.0]), ("1", None, [1.0, 0.1]), ("2", "b", [0.0, 1.0]), ("50", None, [1.0, 0.2])], "id string, koza_id string, content_embedding array<double>")
    got = {(r.base_id, r.type): (r.n, r.first) for r in jobs.neighbour_sizes(df, df.where("id IN ('0', '50')"), 0.9).collect()}
    assert got == {("0", "stats"): (1, None), ("0", "high_similarity"): (2, "1"), ("0", "course_similarities"): (1, "b"), ("50", "stats"): (1, None), ("50", "high_similarity"): (2, "0"), ("50", "course_similarities"): (2, "b")}
