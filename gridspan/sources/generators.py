"""Data generators. Random ones draw from md5 of their coordinates, so a rerun and any other engine give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def draw(*parts: Column) -> Column:
    """A 32-bit draw: the first eight hex digits of md5 of the parts joined by '-'."""
    return F.conv(F.substr(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("bigint")


def sparse_matrix(spark: SparkSession, rows: int, cols: int, density: float, seed: str = "m") -> DataFrame:
    """(row, col): each cell with probability `density`; a row that would be empty gets one random cell, so none dangles.

    Rows are dealt over the cluster and each makes its own cells; nothing is joined or shuffled but the repair of empty rows,
    which is a count within the row's array."""
    limit = int(density * 2**32)
    kept = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(cols - 1).cast("bigint")), lambda c: draw(F.lit(seed), F.col("row"), c) < limit)
    one = F.array(F.pmod(draw(F.lit(seed + "r"), F.col("row")), F.lit(cols)))
    cells = spark.range(rows).withColumnRenamed("id", "row").withColumn("cells", kept)
    return cells.select("row", F.explode(F.when(F.size("cells") > 0, F.col("cells")).otherwise(one)).alias("col"))


def expand_adjacency(edges: DataFrame, src_shift: int, dst_shift: int, n: int) -> DataFrame:
    """Edges between shifted copies of the node range."""
    return edges.select((F.col("src") + src_shift * n).alias("src"), (F.col("dst") + dst_shift * n).alias("dst"))


def counter_lines(spark: SparkSession, lines: int, width: int = 15) -> DataFrame:
    """(line): the running byte count before each line, zero-padded, one a line."""
    return spark.range(lines).select(F.lpad((F.col("id") * (width + 1)).cast("string"), width, "0").alias("line"))


def counter_errors(lines: DataFrame, width: int = 15) -> DataFrame:
    """Rows of a counter text that should not be there, and those that are missing."""
    spark = lines.sparkSession
    right = counter_lines(spark, lines.count(), width)
    return lines.select("line").exceptAll(right).withColumn("fault", F.lit("extra")).unionByName(right.exceptAll(lines.select("line")).withColumn("fault", F.lit("missing")))


def dense_blocks(spark: SparkSession, side: str, blocks: int, rows: int, cols: int) -> DataFrame:
    """(side, blk, r, vec): block i is filled with i / cols."""
    ids = spark.range(blocks * rows)
    blk = F.floor(F.col("id") / rows)
    return ids.select(F.lit(side).alias("side"), blk.alias("blk"), (F.col("id") % rows).alias("r"), F.array_repeat(blk.cast("double") / F.lit(float(cols)), cols).alias("vec"))


def initial_ranks(nodes: DataFrame, n: int) -> DataFrame:
    return nodes.select("node", F.lit(1.0 / n).alias("rank"))


def random_bytes(spark: SparkSession, n: int, seed: str = "b") -> DataFrame:
    """(pos, val): signed bytes."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.pmod(draw(F.lit(seed), F.col("id")), F.lit(256)) - 128).cast("int").alias("val"))


def splits(spark: SparkSession, path: str, length: int, split: int, jitter: float, seed: str = "s") -> DataFrame:
    """(path, off, len): a range cut into length // split pieces whose sizes vary by the jitter; the last takes the rest. Sizes are
    drawn by hash; offsets are their running sum, one row a piece."""
    from pyspark.sql import Window

    n = max(1, length // split)
    wide = max(1, int(split * jitter))
    size = F.lit(split - wide) + 2 * F.pmod(draw(F.lit(seed), F.col("id")), F.lit(wide))
    before = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    rows = spark.range(n).withColumn("size", size).withColumn("off", F.coalesce(F.sum("size").over(before), F.lit(0)))
    end = F.when(F.col("id") == n - 1, F.lit(length)).otherwise(F.least(F.col("off") + F.col("size"), F.lit(length)))
    return rows.filter(F.col("off") < length).select(F.lit(path).alias("path"), F.col("off").cast("bigint").alias("off"), (end - F.col("off")).cast("bigint").alias("len"))


#: By name, for a program that picks its generator.
REGISTRY = {f.__name__: f for f in (sparse_matrix, expand_adjacency, counter_lines, dense_blocks, random_bytes, splits)}
