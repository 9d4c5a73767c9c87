"""Graphs and other derived inputs over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import table, tasks_for

#: Line items that a task sorts.
LINES = 1 << 20


def co_purchase(spark: SparkSession, sf_dir: str, over: float = 45.0) -> DataFrame:
    """(src, dst), distinct: a part and the next line item's part of the same order, where more than `over` were bought. The tasks that
    sort the orders follow the number of line items."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    parts = tasks_for(spark, line.count(), LINES)
    if parts > tasks_for(spark, 0, LINES):
        line = line.repartition(parts, "l_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pairs = line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"), F.col("l_quantity").alias("q"))
    return pairs.filter(F.col("dst").isNotNull() & (F.col("q") > over)).select("src", "dst").distinct()


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, path, off, len): byte ranges derived from orders."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).cast("string").alias("path"), (F.col("o_orderkey") * 37 % 5000).alias("off"), (1 + F.col("o_orderkey") * 13 % 97).alias("len"))
