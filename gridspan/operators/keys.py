"""Keys at scale: joins that adaptive execution can split, prefix sums and ranks without a window over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def join_on(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right (one row a key) on `key`, where a key of left may be hot.

    A second, derived key keeps Spark from reusing the partitioning of an aggregate below the join,
    so both inputs are plain exchanges and adaptive execution can split a hot partition."""
    salt = F.xxhash64(F.col(key))
    return left.withColumn("_kh", salt).join(right.withColumn("_kh", salt), [key, "_kh"], how).drop("_kh")


def running_start(counts: DataFrame, key: str, n: str, start: str, fan: int = 4096) -> DataFrame:
    """counts (key, n) with `start`, the sum of n over all smaller keys. Two levels: no window holds more than
    max(fan, groups of fan keys) rows, whatever the number of keys."""
    part = F.floor(F.col(key) / F.lit(fan))
    low = counts.withColumn("_g", part)
    high = low.groupBy("_g").agg(F.sum(n).alias("_n"))
    w = Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    high = high.select("_g", F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("_base"))
    w = Window.partitionBy("_g").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    low = low.withColumn(start, F.coalesce(F.sum(n).over(w), F.lit(0)).cast("long"))
    return low.join(high, "_g").withColumn(start, F.col(start) + F.col("_base")).drop("_g", "_base")


def ranked(rows: DataFrame, order: list[Column], rank: str, parts: int | None = None) -> DataFrame:
    """rows with `rank`, their place from 0 on in the given order. Rows are ranged and written with the number of their range; ranks are places
    within a range, and ranges start where the counts before them end, so no window sees more than a range."""
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("r"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    keys = [F.col(f"o{i}") for i in range(len(order))]
    dealt = written(keyed.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), "ranges")
    starts = running_start(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part", "n", "start").select("part", "start")
    place = F.row_number().over(Window.partitionBy("part").orderBy(*keys)) - 1
    out = dealt.withColumn("place", place).join(F.broadcast(starts), "part")  # a row for each range
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in rows.columns if c != rank], (F.col("start") + F.col("place")).alias(rank))
