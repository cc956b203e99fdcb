"""Connected components of an edge list, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.runtime import materialise

#: Each round merges every vertex into a neighbour, so the edges left shrink by a constant factor on average.
MAX_ROUNDS = 60


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, component (smallest id of its component) for every vertex of an undirected edge list.

    Each round, a vertex goes over to the neighbour (or itself) whose hash under that round's seed is least, edges are
    carried along, and what has become a loop or a copy falls away. A seed serves two rounds: in the second, all that has
    gathered around the least vertex of a star goes over to it. The labels are joined and aggregated by key, with
    partial sums, and written to the shared folder after each round, so neither long chains nor vertices with very many
    edges gather in one task. Null ends, loops and repeated edges are ignored; no edge gives no row.
    """
    left = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    left = materialise(left.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = left.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", F.col("id").alias("at"))
    for number in range(MAX_ROUNDS):
        if left.isEmpty():
            break
        order = lambda c: F.xxhash64(F.lit(number // 2), c)  # noqa: B023, E731
        both = left.union(left.select("v", "u")).select("u", "v", order(F.col("v")).alias("h"))
        least = both.groupBy("u").agg(F.min("h").alias("h"), F.min_by("v", "h").alias("v"))
        moves = materialise(least.where(F.col("h") < order(F.col("u"))).select(F.col("u").alias("at"), F.col("v").alias("to")), "moves")
        labels = materialise(labels.join(moves, "at", "left").select("id", F.coalesce("to", "at").alias("at")), "labels")
        carried = left.join(moves.withColumnRenamed("at", "u"), "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
        carried = carried.join(moves.withColumnRenamed("at", "v"), "v", "left").select("u", F.coalesce("to", "v").alias("v"))
        left = materialise(carried.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    else:
        raise RuntimeError(f"edges left after {MAX_ROUNDS} rounds")
    return labels.join(labels.groupBy("at").agg(F.min("id").alias("component")), "at").select("id", "component")
