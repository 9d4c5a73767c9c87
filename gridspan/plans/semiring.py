"""Generalised matrix-vector products: combine an entry with a vector value, reduce per row, assign."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.keys import join_on
from ..session import written


def product(mat: DataFrame, vec: DataFrame, combine: Callable[[Column, Column], Column], reduce: Callable[[Column], Column], hint: str | None = None) -> DataFrame:
    """mat (row, col, val), vec (node, v) -> (node, v): reduce over the row of combine(val, v)."""
    v = vec.select(F.col("node").alias("col"), F.col("v").alias("x"))
    joined = mat.join(v.hint(hint) if hint else v, "col")
    return joined.groupBy(F.col("row").alias("node")).agg(reduce(combine(F.col("val"), F.col("x"))).alias("v"))


def gimv_sum(mat: DataFrame, vec: DataFrame, hint: str | None = None) -> DataFrame:
    return product(mat, vec, lambda m, x: m * x, F.sum, hint)


def gimv_min(mat: DataFrame, vec: DataFrame, include_self: bool = False, hint: str | None = None) -> DataFrame:
    """The least vector value among a row's columns; include_self: and the row's own."""
    out = product(mat, vec, lambda m, x: x, F.min, hint)
    if not include_self:
        return out
    return out.unionByName(vec.select("node", "v")).groupBy("node").agg(F.min("v").alias("v"))


def gimv_or(mat: DataFrame, vec: DataFrame, masks: list[str]) -> DataFrame:
    """Bitwise OR of the masks of a row's columns and its own."""
    moved = mat.join(vec.withColumnRenamed("node", "col"), "col").select(F.col("row").alias("node"), *masks)
    return moved.unionByName(vec.select("node", *masks)).groupBy("node").agg(*[F.bit_or(m).alias(m) for m in masks])


def gimv_bits(blocks: DataFrame, vec: DataFrame, width: int) -> DataFrame:
    """blocks (brow, bcol, bits binary), 0/1 matrices of width x width cells: cell (r, c) is bit c % 8 of byte (r * width + c) / 8.
    vec (b, i, v) -> (b, i, v), non-zero sums only.

    The bytes are read as 32-bit words, one conversion each; cells are opened where their bit is set, then summed like any other
    sparse matrix."""
    words = -(-width * width // 32)
    padded = F.concat("bits", F.unhex(F.lit("000000")))
    word = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.conv(F.hex(F.substr(padded, w * 4 + 1, F.lit(4))), 16, 10).cast("bigint"))
    opened = blocks.select("brow", "bcol", F.posexplode(word).alias("w", "word")).filter("word <> 0")
    bit = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.getbit("word", F.lit(24) - F.floor(k / 8).cast("int") * 8 + k % 8) == 1)
    cells = opened.select("brow", F.col("bcol").alias("b"), F.explode(F.transform(bit, lambda k: F.col("w") * 32 + k)).alias("k")).filter(F.col("k") < width * width)
    cells = cells.select("brow", "b", F.floor(F.col("k") / width).cast("int").alias("r"), (F.col("k") % width).cast("int").alias("i"))
    return cells.join(vec, ["b", "i"]).groupBy(F.col("brow").alias("b"), F.col("r").alias("i")).agg(F.sum("v").alias("v")).filter("v <> 0")


def diag_scale(diag: DataFrame, vec: DataFrame) -> DataFrame:
    """(node, d), (node, v) -> v / d where the result is not zero."""
    return diag.join(vec, "node").filter((F.col("v") != 0) & (F.col("d") != 0)).select("node", (F.col("v") * (F.lit(1.0) / F.col("d"))).alias("v"))


def min_labels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, v): the least node that each node reaches over the symmetric graph: component labels, the fixed point of the min product.

    A round is the min product over the matrix, then two shortcuts: a label takes what its holders have found, and every node takes
    the label of its label. Labels only fall, and they travel along ever longer paths, so the rounds grow with the logarithm of
    the diameter; they end when no label has moved, however many that takes. Ends of edges that are not among the nodes count as
    nodes, too. All joins are merge joins, which the driver has no part in: below Catalyst's threshold every round would send it
    the labels, several times their size on disk."""
    mat = written(edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1).alias("val")).unionByName(edges.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(1).alias("val"))).distinct(), "symmetric")
    every = nodes.select("node").unionByName(mat.select(F.col("row").alias("node"))).distinct()
    vec = written(every.select("node", F.col("node").alias("v")), "labels")
    total = None
    while True:
        found = gimv_min(mat, vec, include_self=True, hint="merge").withColumnRenamed("v", "m")
        both = written(join_on(vec, found.hint("merge"), "node"), "found")
        hooks = both.groupBy(F.col("v").alias("node")).agg(F.min("m").alias("v"))
        now = written(both.select("node", F.col("m").alias("v")).unionByName(hooks).groupBy("node").agg(F.min("v").alias("v")), "hooked")
        labels = now.select(F.col("node").alias("v"), F.col("v").alias("up"))
        vec = written(join_on(now, labels.hint("merge"), "v", "left").select("node", F.coalesce("up", "v").alias("v")), "labels")
        before, total = total, vec.agg(F.sum(F.col("v").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return vec
