"""The two-input operator: pairs of index entries that a predicate accepts.

Equality predicates become hash or merge joins; others are nested loops over index entries (blocks), never over records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.generators import draw
from .keys import ranked

Predicate = Callable[[DataFrame, DataFrame], Column]


def pair_join(left: DataFrame, right: DataFrame | None = None, on: Predicate | None = None, mode: str = "bipartite", order: str = "id") -> DataFrame:
    """Pairs as columns l_* and r_*. mode `bipartite`: a row of left with one of right; `half`: rows of left among themselves,
    each unordered pair once, the earlier by `order` first, a row also with itself. `on` narrows the pairs."""
    other = left if right is None else right
    a = left.select([F.col(c).alias(f"l_{c}") for c in left.columns])
    b = other.select([F.col(c).alias(f"r_{c}") for c in other.columns])
    conditions = []
    if mode == "half":
        conditions.append(a[f"l_{order}"] <= b[f"r_{order}"])
    elif mode != "bipartite":
        raise ValueError(mode)
    if on is not None:
        conditions.append(on(a, b))
    if not conditions:
        return a.crossJoin(b)
    condition = conditions[0]
    for c in conditions[1:]:
        condition = condition & c
    return a.join(b, condition)


def same(left: str, right: str) -> Predicate:
    return lambda a, b: a[f"l_{left}"] == b[f"r_{right}"]


def at_random(density: float, seed: str = "p", left: str = "id", right: str = "id") -> Predicate:
    """Each pair with probability `density`, by hash of the two ids."""
    return lambda a, b: draw(F.lit(seed), a[f"l_{left}"], b[f"r_{right}"]) < int(density * 2**32)


def assign_blocks(rows: DataFrame, blocks: int, how: str = "contiguous", order: str = "id", seed: str = "b") -> DataFrame:
    """rows with `grp`: contiguous (equal runs, larger ones first), circular (rank mod blocks) or shuffled (runs of a hash order)."""
    key = [F.md5(F.concat(F.lit(seed + "-"), F.col(order).cast("string")).cast("binary")), F.col(order)] if how == "shuffled" else [F.col(order)]
    placed = ranked(rows, key, "grp")
    if how == "circular":
        return placed.withColumn("grp", F.pmod("grp", F.lit(blocks)))
    low, extra = divmod(rows.count(), blocks)
    long = F.lit(extra * (low + 1))
    run = F.when(F.col("grp") < long, F.floor(F.col("grp") / (low + 1))).otherwise(extra + F.floor((F.col("grp") - long) / max(low, 1)))
    return placed.withColumn("grp", run.cast("long"))


def join_table(pairs: DataFrame, left: str = "l_id", right: str = "r_id") -> DataFrame:
    """(seg, partner), distinct: each entry with all it meets, seen from both sides."""
    there = pairs.select(F.col(left).alias("seg"), F.col(right).alias("partner"))
    return there.unionByName(pairs.select(F.col(right).alias("seg"), F.col(left).alias("partner"))).distinct()


def task_count(partners: DataFrame) -> DataFrame:
    """(n_tasks): unordered pairs of a join table; a pair is seen from both sides, a pair with itself once."""
    return partners.agg(F.sum(F.when(F.col("seg") == F.col("partner"), 2).otherwise(1)).alias("n")).select((F.col("n") / 2).cast("bigint").alias("n_tasks"))


def partner_overlap(partners: DataFrame) -> DataFrame:
    """(a, b, shared, ratio) for entries a < b that share a partner: shared partners over the larger set's size."""
    sizes = partners.groupBy("seg").agg(F.count(F.lit(1)).alias("size"))
    sized = partners.join(sizes, "seg")
    x, y = sized.alias("x"), sized.alias("y")
    both = x.join(y, (F.col("x.partner") == F.col("y.partner")) & (F.col("x.seg") < F.col("y.seg")))
    counted = both.groupBy(F.col("x.seg").alias("a"), F.col("y.seg").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.greatest("x.size", "y.size")).alias("larger"))
    return counted.select("a", "b", "shared", (F.col("shared") / F.col("larger")).alias("ratio"))


def partner_groups(partners: DataFrame, ratio: float = 0.8) -> DataFrame:
    """(seg, grp): entries grouped where their partner sets overlap by more than `ratio` of the larger one; grp is the least entry of a
    group. Overlaps chain, so the groups do not depend on an order."""
    from ..plans.semiring import min_labels

    near = partner_overlap(partners).filter(F.col("ratio") > ratio).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return min_labels(near, partners.select(F.col("seg").alias("node")).distinct()).select(F.col("node").alias("seg"), F.col("v").alias("grp"))
