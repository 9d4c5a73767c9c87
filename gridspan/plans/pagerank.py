"""PageRank by five formulations of one definition: next = (1 - alpha) * sum(p * rank) + alpha / N, with alpha the teleport
probability; mass of nodes without out-edges is lost.

All strategies keep the matrix in place, partitioned by the vector's side of the join, so an iteration moves the vector and the
partial sums only. Catalyst joins by hash or merge as sizes allow; `secondary_sort` asks for the merge join."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators.graph import transition_matrix
from ..session import written

STRATEGIES = ("naive", "range_block", "mod_block", "rect_block", "secondary_sort")


def pagerank_step(mat: DataFrame, ranks: DataFrame, nodes: DataFrame, n: int, alpha: float = 0.15, hint: str | None = None) -> DataFrame:
    """mat (src, dst, p), ranks (node, rank) -> (node, rank) for all nodes."""
    r = ranks.select(F.col("node").alias("src"), "rank")
    parts = mat.join(r.hint(hint) if hint else r, "src").select(F.col("dst").alias("node"), (F.col("p") * F.col("rank")).alias("s"))
    return _damped(parts, nodes.select("node"), ["node"], n, alpha)


def _damped(parts: DataFrame, own: DataFrame, keys: list[str], n: int, alpha: float) -> DataFrame:
    """parts (keys, s) summed for the nodes of `own` (keys) -> (keys, rank).

    The nodes join the sum as rows of 0 rather than by a join, so an iteration has one exchange, and its result is already
    partitioned as the next product needs it."""
    every = parts.withColumn("known", F.lit(False)).unionByName(own.withColumns({"s": F.lit(0.0), "known": F.lit(True)}))
    sums = every.groupBy(*keys).agg(F.sum("s").alias("s"), F.max("known").alias("known")).filter("known")
    return sums.select(*keys, ((1.0 - alpha) * F.col("s") + F.lit(alpha / n)).alias("rank"))


def _blocked(mat: DataFrame, nodes: DataFrame, n: int, alpha: float, layout: str, rows: int, cols: int, width: int, grid: tuple[int, int] | None):
    """The matrix in blocks, and a step that joins vector block with matrix block, then in-block index with index.

    The matrix is kept partitioned by the keys of that join, so an iteration moves the vector and the partial sums alone. The modulo
    layout has few rows of blocks: each gets its copy of the vector, and a hub's entries lie in as many partitions."""
    coo = mat.select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("p").alias("val"))
    if layout == "range":
        blocks = B.range_matrix(coo, width)
        block, index = (lambda c: B.range_block(c, width)), (lambda c: B.range_index(c, width))
        node = F.col("brow").cast("bigint") * width + F.col("r")
        own = nodes.select(block(F.col("node")).alias("brow"), index(F.col("node")).alias("r"))
        keys = ["bcol", "c"]
    else:
        blocks = B.mod_matrix(coo, rows, cols)
        block, index = (lambda c: B.mod_block(c, cols)), (lambda c: B.mod_index(c, cols))
        node = F.col("r").cast("bigint") * rows + F.col("brow")
        own = nodes.select(B.mod_block(F.col("node"), rows).alias("brow"), B.mod_index(F.col("node"), rows).alias("r"))
        keys = ["brow", "bcol", "c"]
    if grid:
        blocks = B.sub_grid(blocks, *grid)
    blocks = in_place(blocks.select("brow", "bcol", "r", "c", "val"), keys)
    band = F.explode(F.sequence(F.lit(0), F.lit(min(rows, grid[0] if grid else rows) - 1)))

    def step(ranks: DataFrame) -> DataFrame:
        vec = ranks.select(block(F.col("node")).alias("bcol"), index(F.col("node")).alias("c"), "rank")
        if "brow" in keys:
            vec = vec.withColumn("brow", band)
        parts = blocks.join(vec, keys).select("brow", "r", (F.col("val") * F.col("rank")).alias("s"))
        return _damped(parts, own, ["brow", "r"], n, alpha).select(node.alias("node"), "rank")

    return blocks, step


def in_place(mat: DataFrame, keys: list[str], sort: bool = False) -> DataFrame:
    """mat kept by the executors, partitioned by the keys it will be joined on, and sorted by them if asked. A lost part is made again
    from its lineage."""
    dealt = mat.repartition(int(mat.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    return (dealt.sortWithinPartitions(*keys) if sort else dealt).persist()


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = 0.15, tol: float = 1e-6, max_iterations: int = 100, strategy: str = "naive", fixed_iterations: int | None = None, row_blocks: int = 4, col_blocks: int = 4, width: int = 16, grid: tuple[int, int] | None = None, cut_every: int = 10, resume: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """(node, rank). With fixed_iterations nothing runs until the result is used, and the matrix stays with the executors until the
    session's cache is cleared; else iterate until no rank moves by more than tol. max_iterations ends a run that does not get
    there, with a warning; report, if given, gets the number of iterations, the last move and whether it converged.

    grid: use only the first rows x cols of the block grid. resume: start from these ranks. Lineage is cut by a written table
    every cut_every iterations, and in every one of the convergence mode, whose test reads it."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    n = nodes.count()
    mat = transition_matrix(edges)
    if strategy in ("naive", "secondary_sort"):
        kept = in_place(mat, ["src"])
        hint = "merge" if strategy == "secondary_sort" else None

        def step(ranks: DataFrame) -> DataFrame:
            return pagerank_step(kept, ranks, nodes, n, alpha, hint)

    else:
        layout = "range" if strategy == "range_block" else "mod"
        cols = col_blocks if strategy == "rect_block" else row_blocks
        kept, step = _blocked(mat, nodes, n, alpha, layout, row_blocks, cols, width, grid)
    ranks = resume if resume is not None else nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    if fixed_iterations is not None:
        for i in range(fixed_iterations):
            ranks = step(ranks)
            if (i + 1) % cut_every == 0 and i + 1 < fixed_iterations:
                ranks = written(ranks, "ranks")
        return ranks
    moved, i = float("inf"), 0
    while moved > tol and i < max_iterations:
        after = written(step(ranks), "ranks")
        moved, ranks, i = max_change(ranks, after), after, i + 1
    kept.unpersist()
    if report is not None:
        report |= {"iterations": i, "moved": moved, "converged": moved <= tol}
    if moved > tol:
        warnings.warn(f"pagerank: no convergence in {i} iterations, the last moved a rank by {moved}", stacklevel=2)
    return ranks


def max_change(before: DataFrame, after: DataFrame) -> float:
    """The largest move of a rank: one scalar for the convergence test."""
    both = before.select("node", F.col("rank").alias("old")).join(after, "node")
    return both.agg(F.max(F.abs(F.col("old") - F.col("rank")))).first()[0] or 0.0


def rank_min_max(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.min("rank").alias("min_rank"), F.max("rank").alias("max_rank"))


def rank_histogram(ranks: DataFrame, bins: int = 1000) -> DataFrame:
    """(bin, n): equal widths between the least and the largest rank; the top edge belongs to the last bin, and equal ranks
    are all in bin 1."""
    ranks = written(ranks, "ranks")
    ends = rank_min_max(ranks)
    gap = F.col("max_rank") - F.col("min_rank")
    place = F.when(gap > 0, F.least(F.floor(bins * (F.col("rank") - F.col("min_rank")) / gap) + 1, F.lit(bins))).otherwise(F.lit(1))
    return ranks.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
