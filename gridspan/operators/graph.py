"""Graph building blocks: degrees, transition probabilities, symmetry, neighbour sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keys import join_on


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))


def transition_matrix(edges: DataFrame) -> DataFrame:
    """(src, dst, p): p = 1 / out-degree of src; duplicate edges count each. Degrees are partial sums joined back, and a join's hot
    partition can be split, so a hub is no task of its own."""
    return join_on(edges.select("src", "dst"), out_degree(edges), "src").select("src", "dst", (F.lit(1.0) / F.col("deg")).alias("p"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Edges and their reverses; a self-loop has none."""
    back = edges.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").unionByName(back)


def neighbour_sets(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, other), distinct: the in-neighbours of each node and the node itself."""
    own = nodes.select("node", F.col("node").alias("other"))
    return edges.select(F.col("dst").alias("node"), F.col("src").alias("other")).unionByName(own).distinct()


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.col("src").alias("node")), "node", "left_anti")
