"""Ladders at their thresholds, runs, similarity paths, grouping, chunking and merging against hand-written expectations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions import text as tx
from corpuslens.operators import chunking, components, grouping, merge, recommend, scoring, vectors

LADDER = [
    (0.95, 0.5, False, "MERGE_CONTENT", 100), (0.95, 0.49, False, "REDIRECT_301", 85), (0.92, 0.3, True, "MERGE_CONTENT", 90), (0.92, 0.3, False, "REDIRECT_301", 85), (0.9, 0.0, None, "REDIRECT_301", 85),
    (0.89, 0.2, True, "REDIRECT_301", 80), (0.88, 0.19, True, "REDIRECT_301", 70), (0.85, None, True, "REDIRECT_301", 70), (0.85, 0.9, False, "CROSS_LINK", 60), (0.75, 0.0, True, "CROSS_LINK", 60), (0.749, 0.15, True, "CROSS_LINK", 60),
    (0.7, 0.14, True, "MONITOR", 40), (0.65, 0.1, True, "REVIEW", 50), (0.65, 0.11, True, "MONITOR", 40), (0.65, 0.15, False, "REVIEW", 45), (0.65, 0.0, True, "MONITOR", 40), (0.6, None, None, "MONITOR", 40), (0.599, 1.0, True, "MONITOR", 0),
]


def test_unified_ladder(spark):
    df = spark.createDataFrame([(i, *x[:3]) for i, x in enumerate(LADDER)], "i int, score double, matching_ratio double, same_course boolean")
    got = {r.i: (r.recommendation_type, r.priority) for r in recommend.unified(df).collect()}
    assert [got[i] for i in range(len(LADDER))] == [x[3:] for x in LADDER]


def test_other_ladders(spark):
    s = F.col("s")
    df = spark.createDataFrame([(0.94,), (0.8,), (0.7,), (0.6,), (0.4,), (0.39,)], "s double").select(recommend.realtime(s), recommend.cached(s), vectors.confidence(s))
    assert [tuple(r) for r in df.collect()] == [("MERGE_CONTENT", "MERGE_CONTENT", 0.95), ("REDIRECT_301", "MERGE_CONTENT", 0.95), ("CROSS_LINK", "REDIRECT_301", 0.85), ("MONITOR", "REDIRECT_301", 0.85), ("MONITOR", "CROSS_LINK", 0.75), ("MONITOR", "MONITOR", 0.65)]


@pytest.mark.parametrize("indexes,run", [([0, 1, 2, 3, 4], 5), ([1, 1, 2, 3], 3), ([1, 2, 2, 3], 2), ([5], 1), ([], 0), ([9, 3, 4], 2)])
def test_longest_run(spark, indexes, run):
    df = spark.createDataFrame([(indexes,)], "x array<bigint>")
    assert df.select(scoring.longest_run(F.col("x"))).first()[0] == run


def test_planted_cosines(spark):
    cosines = [0.95, 0.92, 0.9, 0.88, 0.85, 0.75, 0.7, 0.65, 0.6]
    rows = [("q", [1.0, 0.0])] + [(f"c{i}", [c, math.sqrt(1 - c * c)]) for i, c in enumerate(cosines)] + [("zero", [0.0, 0.0]), ("empty", []), ("null", None)]
    df = spark.createDataFrame(rows, "id string, content_embedding array<double>")
    got = {r.id: r.similarity for r in vectors.nearest_to(df.where("id = 'q'"), df).collect()}
    assert got == pytest.approx({f"c{i}": c for i, c in enumerate(cosines)})
    joined = {(r.base_id, r.similar_id): r.similarity for r in vectors.similarity_join(df, 0.0, block_rows=3).collect()}
    assert {k[1]: v for k, v in joined.items() if k[0] == "q"} == pytest.approx(got)
    assert all(joined[b, a] == pytest.approx(v) for (a, b), v in joined.items())
    pairs = spark.createDataFrame([("q", "c1"), ("q", "zero"), ("q", "none")], "a string, b string")
    assert [(r.b, round(r.similarity, 6)) for r in vectors.pair_similarity(pairs, df, "a", "b").collect()] == [("c1", 0.92)]


def test_lsh_finds_close_pairs(spark):
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(f"{i}", v) for i, v in enumerate(base)] + [(f"{i}x", [a + rng.gauss(0, 0.02) for a in v]) for i, v in enumerate(base)]
    df = spark.createDataFrame(rows, "id string, content_embedding array<double>")
    got = {(r.a, r.b) for r in vectors.lsh_candidates(df, 0.95).collect()}
    assert len(got & {(f"{i}", f"{i}x") for i in range(30)}) >= 27


def greedy(pairs):
    done, groups = set(), {}
    for s, a, b in sorted(((-s, a, b) for a, b, s in pairs)):
        if a in done or b in done:
            continue
        members = [(x, y) for x, y, _ in pairs if {x, y} & {a, b}]
        groups[f"{a}-{b}"] = sorted(members)
        done |= {v for p in members for v in p}
    return groups


def test_one_hop_groups(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(a, b): rng.choice([0.8, 0.85, 0.9, 0.95]) for a, b in (sorted(rng.sample(range(100, 140), 2)) for _ in range(60))}
        rows = [(str(a), str(b), s) for (a, b), s in pairs.items()]
        found: dict = {}
        for r in grouping.one_hop(spark.createDataFrame(rows, "a string, b string, similarity double")).collect():
            found.setdefault(r.group, []).append((r.a, r.b))
        assert {k: sorted(v) for k, v in found.items()} == greedy(rows)
    chain = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.9), ("c", "d", 0.85)], "a string, b string, similarity double")
    assert {r.group for r in grouping.one_hop(chain).collect()} == {"a-b"}
    assert {r.component for r in grouping.transitive(chain).collect()} == {"a"}
    assert grouping.one_hop(chain.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1200)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {j: 1000 for j in range(1000, 1200)} | {7000: 7000, 7001: 7000}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_sections():
    page = '<p>before</p><h2>A &amp; B</h2><p>one<br>two<img alt="pic"></p><div><h3>inner</h3>x</div><script>no()</script><h3>C</h3>'
    assert chunking.sections(page) == [("冒頭", "before"), ("A & B", "one two pic inner x"), ("C", "")]
    assert chunking.sections(f"<html><body><article>{page}</article></body></html>", "article") == chunking.sections(page)
    assert chunking.sections(None) == [] and chunking.sections("") == []
    assert chunking.sections("<h1>１２</h1>ＡＢ") == [("１２", "AB")]


def test_chunk_lengths(spark):
    rows = [("a", 0, "s0", "x" * 10), ("a", 1, "s1", "y" * 300), ("a", 2, "s2", "z" * 50), ("a", 3, "s3", "あ" * 500 + "。" + "い" * 500 + "。")]
    merged = chunking.merge_short(spark.createDataFrame(rows, "id string, pos int, title string, text string"))
    assert [(r.title, len(r.text)) for r in merged.orderBy("pos").collect()] == [("s0", 10), ("s1", 300 + 2 + 2 + 1 + 50), ("s3", 1002)]
    cut = chunking.split_long(merged).orderBy("chunk_index").collect()
    assert [(r.title, len(r.text)) for r in cut] == [("s0", 10), ("s1", 355), ("s3 (パート1)", 501), ("s3 (パート2)", 501)]
    over = chunking.overlapped(chunking.split_long(merged)).orderBy("chunk_index").collect()
    assert over[0].text == "x" * 10 + " " + "y" * 50 and over[3].text.startswith("あ" * 99 + "。 ")


def test_one_long_sentence_stays(spark):
    rows = [("a", 0, "t", "あ" * 2000)]
    got = chunking.split_long(spark.createDataFrame(rows, "id string, pos int, title string, text string")).collect()
    assert [len(r.text) for r in got] == [2001]


def test_html_text():
    assert tx.plain_text("<p>a&nbsp;b<style>x</style></p><nav>n</nav>ｃ") == "a b c"
    assert tx.plain_text("<b>a</b><i>b</i>", "") == "ab" and tx.plain_text(None) == ""


def test_priority_cut(spark):
    parts = ["タイトル: t", "x" * 400, "Q: a", "y" * 900, "講座: c"]
    got = spark.createDataFrame([("\n\n".join(parts),)], "t string").select(tx.priority_cut(F.col("t"), 600)).first()[0]
    assert got.startswith("タイトル: t\n\n講座: c\n\nQ: a\n\n" + "y" * 100) and got.endswith("...") and len(got) <= 600
    short = spark.createDataFrame([("abc",)], "t string").select(tx.priority_cut(F.col("t"), 600)).first()[0]
    assert short == "abc"


def test_questions(spark):
    got = spark.createDataFrame([("Q: one?\nA: yes\nQ：two\nA：no",), ("none",)], "t string").select(tx.structured_qa(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Q1: one?\nA1: yes\nQ2: two\nA2: no", "none"]


def test_merge_rules(spark):
    old = spark.createDataFrame([("1", "a", 5, [1.0]), ("2", "b", 6, [2.0])], "id string, title string, pageviews bigint, content_embedding array<double>")
    new = spark.createDataFrame([("2", "c", None, []), ("3", "d", 1, None)], "id string, title string, pageviews bigint, content_embedding array<double>")
    got = {r.id: tuple(r)[1:] for r in merge.merge(old, new, "id", merge.ARTICLE_RULES).collect()}
    assert got == {"1": ("a", 5, [1.0]), "2": ("c", 6, [2.0]), "3": ("d", 1, None)}
    with pytest.raises(Exception, match="occurs twice"):
        merge.unique(new.union(new), "id").collect()


def test_quarantine(spark, tmp_path):
    from corpuslens.operators.articles import assembled
    from corpuslens.sources import tables as src

    (tmp_path / "a.json").write_text('{"id": 1, "attributes": {"POST_TITLE": "T", "LINK": "l", "KOZA_ID": "k", "description": "<b>d</b>", "article": [{"title": "s", "text": "x", "paragraph": [{"subtitle": "p", "text": "y"}]}], "QandA": [{"Question": "q", "Answer": "a"}]}}\n{"id": 2, "attributes": {"POST_TITLE": "only"}}\nnot json\n{"id": 3, "attributes": null}\n')
    good, bad = src.quarantine(src.read_documents(spark, str(tmp_path), src.ARTICLE))
    assert bad.count() == 1
    rows = {r.id: r for r in assembled(good).collect()}
    assert rows["1"].full_content_html == "<h1>T</h1>\n<div><b>d</b></div>\n<h2>s</h2>\nx\n<h3>p</h3>\ny\n<dl><dt>q</dt><dd>a</dd></dl>"
    assert rows["1"].full_content == "T\nd\ns\nx\np\ny\nq\na" and rows["1"].qanda_content == "Q: q\nA: a"
    assert rows["2"].full_content == "only" and rows["2"].koza_id == "" and rows["3"].title == ""


def test_streams_count_rows_of_all_files(spark):
    """Files whose times are in no order, in several batches, as the queries replay them."""
    from corpuslens.queries_text import replayed
    from corpuslens.streaming.incremental import daily_page_metrics, hourly_usage

    n = 600
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 7919 % n * 4000)
    rows = spark.range(0, n, 1, 6).withColumns({"ts": at, "log_ts": at, "event_name": F.lit("page_view"), "page_location": F.lit("p"), "user_pseudo_id": F.lit("u"), "ga_session_id": F.lit("g"), "provider": F.lit("local"), "response_time_ms": F.col("id"), "cost_estimate": F.lit(1.0), "success": F.lit(True)})
    days = replayed(rows, "events", daily_page_metrics)
    assert tuple(days.agg(F.sum("pageviews"), F.max("sessions"), F.count("*")).first()) == (n, 1, 28)
    hours = replayed(rows, "usage", hourly_usage)
    assert tuple(hours.agg(F.sum("requests"), F.sum("cost"), F.sum("successes")).first()) == (n, n, n)


@pytest.fixture
def long_texts(spark, tmp_path):
    """A folder of tables whose documents have what matters at the end of a long text."""
    text = "first\nline two\n\n" + "filler " * 200 + "\n\n・last マンション\nQ: late\nA: answer\n\nend"
    spark.createDataFrame([(i, text, "en", "web", len(text)) for i in range(4)], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), text


def test_cms_articles_and_questions_have_whole_texts(spark, long_texts):
    from corpuslens import queries

    queries.load()
    folder, text = long_texts
    got = {q: queries.QUERIES[q](spark, folder).collect() for q in ("s02_article_documents", "t06_assembled", "t16_questions")}
    assert [r.sections for r in got["s02_article_documents"]] == [4] * 4
    for r in got["t06_assembled"]:
        lines = [x for x in r.full_content_html.split("\n") if x not in ("<h2>s</h2>", "<h3>p</h3>")]
        assert "\n".join(x for x in text.split("\n") if x) in "\n".join(lines) and r.full_content.split("\n")[-3 if r.qanda_content else -1] == "end"
    assert all("Q3: late\nA3: answer" in r.text for r in got["t16_questions"])


def test_structure_is_found_in_whole_texts(spark, long_texts):
    from corpuslens import queries

    queries.load()
    folder, _ = long_texts
    for q, last in (("t14_structured", "- last マンション"), ("t15_structured_by_course", "- last マンション")):
        rows = queries.QUERIES[q](spark, folder).collect()
        assert len(rows) == 4 and all(last in r.text and r.text.endswith("end") for r in rows)
        assert sum("簿記と税務の決算" in r.text for r in rows) == 1


def test_plans(spark):
    from oracle import SF

    from corpuslens import queries

    queries.load()
    plan = queries.QUERIES["w01_ranked_matches"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "CartesianProduct" not in plan
    for name in ("z06_metric_sync", "a11_course_list", "j12_vector_counts", "z04_recommendations"):
        plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_law_variant(spark):
    from corpuslens.functions import text as tx

    text = "供託とは？\n・甲 民法第90条の2 乙\n1.年金\n重要：相続\nまとめ：税関"
    row = spark.createDataFrame([("2", text), ("27", text), ("99", text), (None, None)], "course string, text string").withColumn("s", tx.law_structured(F.col("text"))).withColumn("m", tx.course_marks(F.col("s"), F.col("course"))).collect()
    plain = "\n【供託とは？】\n- 甲 《民法第90条の2》 乙\n1. 年金\n★重要: 相続\nまとめ：税関"
    assert [r.m for r in row] == [plain.replace("年金", "【年金】"), plain.replace("税関", "【税関】"), plain, None]
    names = spark.createDataFrame([("2", None), ("2", "社労"), ("99", None)], "course string, known string").withColumn("name", tx.course_name(F.col("course"), F.col("known")))
    got = names.withColumn("t", tx.law_terms(F.lit("免許取消 社会保険労務士 社労 講座99"), F.col("course"), F.col("name"))).orderBy("course", "known").collect()
    assert [r.name for r in got] == ["社会保険労務士", "社労", "講座99"]
    assert [r.t for r in got] == ["【免許】取消 【【社会保険労務士】】 社労 講座99", "【免許】取消 【社会保険労務士】 【社労】 講座99", "【免許】取消 【社会保険労務士】 社労 講座99"]


def test_words_are_embedded(spark):
    """Counts of hashed words, against the hash of each word."""
    from collections import Counter

    from pyspark.ml.feature import HashingTF

    from corpuslens.operators import vectors

    texts = ["The cat  the dog", "one\u3000two ONE", "", None, " \n", "x " * 5000]
    rows = vectors.embed(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", dims=16).orderBy("id").collect()
    of = HashingTF(numFeatures=16).indexOf
    for r, text in zip(rows, texts):
        counts = Counter(of(w) for w in (text or "").lower().split())
        length = sum(n * n for n in counts.values()) ** 0.5
        assert r.content_embedding == (pytest.approx([counts[i] / length for i in range(16)]) if counts else None)


def test_base_side_of_the_similarity_join(spark):
    from corpuslens.operators import vectors

    rows = [(str(i), str(i % 3), [float((i * k) % 7 - 3) for k in range(1, 6)]) for i in range(40)]
    df = spark.createDataFrame(rows, "id string, owner string, content_embedding array<double>")
    base = df.where("id IN ('3', '8', '39')")
    for top in (None, 4):
        pick = lambda d: sorted((r.base_id, r.similar_id, round(r.similarity, 9)) for r in d.collect())
        whole = vectors.similarity_join(df, 0.1, top, owner="owner", block_rows=7)
        assert pick(vectors.similarity_join(df, 0.1, top, owner="owner", block_rows=7, base=base)) == pick(whole.where("base_id IN ('3', '8', '39')"))
    assert vectors.similarity_join(df.limit(0), 0.1).count() == 0


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from corpuslens.runtime import shared_dir

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: d), sparkContext=SimpleNamespace(master="spark://a:7077", applicationId="x"))
    with pytest.raises(ValueError):
        shared_dir(session)


def test_what_jobs_leave_can_be_removed(spark, tmp_path):
    import os
    from types import SimpleNamespace

    from corpuslens import runtime

    of = lambda app: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: f"file://{tmp_path}"), sparkContext=SimpleNamespace(master="local", applicationId=app))
    for app in ("one", "two"):
        os.makedirs(runtime.new_path(of(app), "x").removeprefix("file://"))
    runtime.clear(of("one"))
    assert os.listdir(f"{tmp_path}/corpuslens") == ["two"]
    runtime.clear(of("one"))
