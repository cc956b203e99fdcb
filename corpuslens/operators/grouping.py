"""Groups of similar articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.operators.components import connected_components
from corpuslens.operators.vectors import similarity_join
from corpuslens.runtime import materialise


def pairs_of(ids: DataFrame, articles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a < b) of a chosen list of ids at or above a threshold."""
    chosen = articles.join(ids.select("id").distinct(), "id", "left_semi")
    found = similarity_join(chosen, threshold).where("base_id < similar_id")
    return found.withColumnsRenamed({"base_id": "a", "similar_id": "b"})


#: Pairs of a component that one task groups by itself; larger ones are grouped in rounds.
SOLVED = 1_000_000


def greedy(pairs: list[tuple[str, str, float]]) -> list[tuple[str, int]]:
    """(group, number of the pair) of pairs in their order: plain loops over one component's pairs."""
    touching: dict[str, list[int]] = {}
    for i, (a, b, _) in enumerate(pairs):
        touching.setdefault(a, []).append(i)
        touching.setdefault(b, []).append(i)
    taken, out = set(), []
    for a, b, _ in pairs:
        if a not in taken and b not in taken:
            for i in sorted({*touching[a], *touching[b]}):
                out.append((f"{a}-{b}", i))
                taken.update(pairs[i][:2])
    return out


GROUPED = "group string, a string, b string, similarity double"


def _solved(pairs: DataFrame) -> DataFrame:
    """Groups of pairs (component, a, b, similarity, k) whose components are small: each is in one task, one after the other."""
    dealt = pairs.repartition("component").sortWithinPartitions("component", "k").select("component", "a", "b", "similarity")

    def run(frames):
        import pandas as pd

        now, held = None, []

        def solved():
            return pd.DataFrame([(g, *held[i]) for g, i in greedy(held)], columns=["group", "a", "b", "similarity"])

        for pdf in frames:
            for component, *pair in pdf.itertuples(index=False, name=None):
                if component != now:
                    if held:
                        yield solved()
                    now, held = component, []
                held.append(tuple(pair))
        if held:
            yield solved()

    return dealt.mapInPandas(run, GROUPED)


def one_hop(pairs: DataFrame, solved: int = SOLVED) -> DataFrame:
    """group (of the seed pair), a, b, similarity: greedy groups around seed pairs.

    In order of similarity (ties by ids), a pair whose ends are both free seeds a group; all pairs that touch an end of it
    join it, and their ends are free no more. Components are independent of one another: those of up to so many pairs are
    grouped by themselves, in one task each. Of larger ones, per round all pairs of free ends that come first among those
    that touch them, or touch a pair that does, are seeds at once, which gives the same groups.
    """
    key = F.struct((-F.col("similarity")).alias("m"), F.col("a").alias("x"), F.col("b").alias("y"))
    ordered = materialise(pairs.where("a IS NOT NULL AND b IS NOT NULL").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("similarity").cast("double").alias("similarity")).withColumn("k", key).distinct(), "pairs")
    comps = connected_components(ordered)
    # a pair of an end with itself is a component, too
    placed = ordered.join(comps.withColumnRenamed("id", "a"), "a", "left").withColumn("component", F.coalesce("component", "a"))
    large = materialise(placed.groupBy("component").agg(F.count("*").alias("c")).where(F.col("c") > solved).select("component"), "large")
    out = _solved(placed.join(large, "component", "left_anti"))
    if large.isEmpty():
        return out
    return out.unionByName(_in_rounds(materialise(placed.join(large, "component", "left_semi").drop("component"), "rest")))


def _in_rounds(everything: DataFrame) -> DataFrame:
    left, out = everything, None
    while not left.isEmpty():
        ends = left.select(F.explode(F.array("a", "b")).alias("v"), "k")
        near = ends.groupBy("v").agg(F.min("k").alias("n1"))
        # least key at distance one from each pair, and at distance two
        wide = left.join(near.withColumnRenamed("v", "a").withColumnRenamed("n1", "na"), "a").join(near.withColumnRenamed("v", "b").withColumnRenamed("n1", "nb"), "b").withColumn("first", F.least("na", "nb"))
        reach = wide.select(F.explode(F.array("a", "b")).alias("v"), "first").groupBy("v").agg(F.min("first").alias("n2"))
        full = wide.join(reach.withColumnRenamed("v", "a").withColumnRenamed("n2", "fa"), "a").join(reach.withColumnRenamed("v", "b").withColumnRenamed("n2", "fb"), "b")
        seeds = materialise(full.where(F.col("k") == F.least("fa", "fb")).select("a", "b", "k"), "seeds")
        owner = seeds.select(F.explode(F.array("a", "b")).alias("v"), F.concat_ws("-", "a", "b").alias("group"))
        held = everything.join(owner.select(F.col("v").alias("a"), F.col("group").alias("ga")), "a", "left").join(owner.select(F.col("v").alias("b"), F.col("group").alias("gb")), "b", "left")
        held = held.withColumn("group", F.coalesce("ga", "gb")).where("group IS NOT NULL")
        taken = materialise(held.select("group", "a", "b", "similarity"), "taken")
        out = taken if out is None else out.unionByName(taken)
        gone = taken.select(F.explode(F.array("a", "b")).alias("v")).distinct()
        left = materialise(left.join(gone.withColumnRenamed("v", "a"), "a", "left_anti").join(gone.withColumnRenamed("v", "b"), "b", "left_anti").select("a", "b", "similarity", "k"), "left")
    return out


def transitive(pairs: DataFrame) -> DataFrame:
    """id, component of all articles that pairs link."""
    return connected_components(pairs)


def strategy(courses: Column) -> Column:
    return F.when(courses == 1, "same_course").otherwise("cross_course")


# Benefits of very similar members, of several courses, of three members or more
BENEFITS = ("非常に高い類似度による重複コンテンツの削減", "講座横断での一貫性向上", "複数記事の統合による包括的なコンテンツ作成")


def benefits(similarity: Column, courses: Column, members: Column) -> Column:
    """The benefits that apply."""
    return F.filter(F.array(F.when(similarity > 0.9, BENEFITS[0]), F.when(courses > 1, BENEFITS[1]), F.when(members >= 3, BENEFITS[2])), lambda x: x.isNotNull())


def summary(groups: DataFrame, articles: DataFrame) -> DataFrame:
    """Of each group (group, a, b, similarity): stable id, members, their number and courses, mean similarity, strategy, benefits, priority."""
    mean = groups.groupBy("group").agg(F.avg("similarity").alias("mean_similarity"))
    members = groups.select("group", F.explode(F.array("a", "b")).alias("id")).distinct().join(articles.select("id", "koza_id"), "id", "left")
    out = members.groupBy("group").agg(F.array_sort(F.collect_set("id")).alias("members"), F.count_distinct("koza_id").alias("courses")).join(mean, "group")
    level = F.when(F.col("mean_similarity") > 0.9, "high").when(F.col("mean_similarity") > 0.8, "medium").otherwise("low")
    return out.select(F.xxhash64("members").alias("group_id"), "group", "members", F.size("members").alias("n"), "courses", "mean_similarity", strategy(F.col("courses")).alias("strategy"), benefits(F.col("mean_similarity"), F.col("courses"), F.size("members")).alias("benefits"), level.alias("priority"))
