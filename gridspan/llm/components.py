"""Connected components of a graph given by its edges, by alternating large-star and small-star rounds.

Each round moves edges only: the least neighbour of a node is a pre-aggregated minimum, joined back by a join
that adaptive execution can split at a hub. Rounds end in written tables, so no lineage grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import join_on, written


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour or only larger ones; then each smaller end is the least of its component."""
    roles = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    Edges with a null end and loops are ignored. Repeated edges count once. An empty input gives an empty result."""
    u, v = F.greatest(a, b), F.least(a, b)
    now = written(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = join_on(both, least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = written(large, "large_star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_on(large, least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "small_star")
    else:
        raise RuntimeError("connected_components: no fixed point within max_rounds")
    root = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(root)
