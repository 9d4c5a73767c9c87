"""Block layouts of vectors and sparse matrices: modulo (id % B) and range (id / w)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mod_block(col: Column, blocks: int) -> Column:
    return F.pmod(col, F.lit(blocks)).cast("int")


def mod_index(col: Column, blocks: int) -> Column:
    return F.floor(col / F.lit(blocks)).cast("int")


def range_block(col: Column, width: int) -> Column:
    return F.floor(col / F.lit(width)).cast("int")


def range_index(col: Column, width: int) -> Column:
    return (col % F.lit(width)).cast("int")


def block_size(n: Column, blocks: int, block: Column) -> Column:
    """Ids of 0 .. n - 1 in a block of the modulo layout, which is ragged."""
    return F.floor(n / F.lit(blocks)) + F.when(block < n % F.lit(blocks), 1).otherwise(0)


def mod_matrix(mat: DataFrame, row_blocks: int, col_blocks: int) -> DataFrame:
    """(row, col, val) with (brow, bcol, r, c)."""
    return mat.withColumns({"brow": mod_block(F.col("row"), row_blocks), "bcol": mod_block(F.col("col"), col_blocks), "r": mod_index(F.col("row"), row_blocks), "c": mod_index(F.col("col"), col_blocks)})


def range_matrix(mat: DataFrame, width: int) -> DataFrame:
    return mat.withColumns({"brow": range_block(F.col("row"), width), "bcol": range_block(F.col("col"), width), "r": range_index(F.col("row"), width), "c": range_index(F.col("col"), width)})


def packed(blocks: DataFrame) -> DataFrame:
    """One row a block: (brow, bcol, entries), sorted by column, then row."""
    item = F.struct(F.col("c").alias("col"), F.col("r").alias("row"), F.col("val"))
    sort = F.array_sort(F.collect_list(item))
    return blocks.groupBy("brow", "bcol").agg(F.transform(sort, lambda x: F.struct(x["row"].alias("row"), x["col"].alias("col"), x["val"].alias("val"))).alias("entries"))


def unpacked(blocks: DataFrame) -> DataFrame:
    return blocks.select("brow", "bcol", F.explode("entries").alias("e")).select("brow", "bcol", F.col("e.row").alias("r"), F.col("e.col").alias("c"), F.col("e.val").alias("val"))


def vector_blocks(vec: DataFrame, width: int) -> DataFrame:
    """(node, v) -> (b, items) in the range layout."""
    return vec.groupBy(range_block(F.col("node"), width).alias("b")).agg(F.array_sort(F.collect_list(F.struct(range_index(F.col("node"), width).alias("i"), F.col("v")))).alias("items"))


def unfold(blocks: DataFrame, width: int) -> DataFrame:
    """(b, items) -> (node, v): node = width * b + i."""
    return blocks.select("b", F.explode("items").alias("x")).select((F.col("b").cast("bigint") * width + F.col("x.i")).alias("node"), F.col("x.v").alias("v"))


def mod_vector_blocks(vec: DataFrame, blocks: int) -> DataFrame:
    """(node, v) -> (b, items) in the modulo layout."""
    return vec.groupBy(mod_block(F.col("node"), blocks).alias("b")).agg(F.array_sort(F.collect_list(F.struct(mod_index(F.col("node"), blocks).alias("i"), F.col("v")))).alias("items"))


def unfold_mod(vec: DataFrame, blocks: int) -> DataFrame:
    """(b, items) -> (node, v): node = blocks * i + b."""
    return vec.select("b", F.explode("items").alias("x")).select((F.col("x.i").cast("bigint") * blocks + F.col("b")).alias("node"), F.col("x.v").alias("v"))


def sub_grid(blocks: DataFrame, rows: int, cols: int) -> DataFrame:
    """The blocks of the first rows x cols of the grid; a filter on partition columns prunes the files."""
    return blocks.filter((F.col("brow") < rows) & (F.col("bcol") < cols))


def by_grid(blocks: DataFrame, parts: int, col_blocks: int, column_major: bool = False) -> DataFrame:
    """Deal blocks to partitions by their place in the grid: block (brow, bcol) lies in partition place mod parts."""
    place = F.col("bcol") * col_blocks + F.col("brow") if column_major else F.col("brow") * col_blocks + F.col("bcol")
    return blocks.repartitionById(parts, F.pmod(place, F.lit(parts)).cast("int"))


def by_column(rows: DataFrame, parts: int, col: str = "col") -> DataFrame:
    """Deal rows to partitions by their column: partition col mod parts."""
    return rows.repartitionById(parts, F.pmod(F.col(col), F.lit(parts)).cast("int"))
