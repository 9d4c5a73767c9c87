"""Neighbourhood function, radii and diameters with Flajolet-Martin bit strings.

State: (node, status, b0 .. bK-1). A hop ORs the masks of a node's out-neighbours and its own. status: `i` changed in this hop,
`c` unchanged for the first time, `f` unchanged before. A node's history has (0, 1) and, for each hop that changed it, the hop
and the estimate of the mask it had before."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sketch import fm_estimate, fm_mask
from ..operators.blocks import range_block, range_index, range_matrix
from ..operators.graph import symmetric
from ..session import tasks_for, written
from .pagerank import in_place

#: Pairs that a task of nh_exact makes distinct.
PAIRS = 1 << 20


def names(k: int) -> list[str]:
    return [f"b{i}" for i in range(k)]


def init_state(nodes: DataFrame, k: int) -> DataFrame:
    return nodes.select("node", F.lit("i").alias("status"), *[fm_mask(F.col("node"), i).alias(f"b{i}") for i in range(k)])


def hop(edges: DataFrame, state: DataFrame, k: int, moving: DataFrame | None = None) -> DataFrame:
    """State after one more hop over edges (src, dst), distinct. moving: the nodes whose masks travel, all by default; those that
    changed in the last hop are enough, as the masks of the others have arrived."""
    masks = names(k)
    vec = (state if moving is None else moving).select(F.col("node").alias("dst"), *masks)
    moved = edges.join(vec.hint("merge"), "dst").select(F.col("src").alias("node"), *masks)
    return _settled(moved.groupBy("node").agg(*[F.bit_or(m).alias(m) for m in masks]), state, masks)


def hop_blocks(blocks: DataFrame, state: DataFrame, k: int, width: int, moving: DataFrame | None = None) -> DataFrame:
    """State after one more hop over matrix blocks (brow, bcol, r, c) of `width` nodes a side: a vector block meets the matrix blocks of
    its column, an in-block index its entries; blocks without a vector block take no part. Masks are ORed by block row and index.
    moving as in hop."""
    masks = names(k)
    vec = (state if moving is None else moving).select(range_block(F.col("node"), width).alias("bcol"), range_index(F.col("node"), width).alias("c"), *masks)
    moved = blocks.join(vec.hint("merge"), ["bcol", "c"]).select("brow", "r", *masks)
    grown = moved.groupBy("brow", "r").agg(*[F.bit_or(m).alias(m) for m in masks])
    return _settled(grown.select((F.col("brow").cast("bigint") * width + F.col("r")).alias("node"), *masks), state, masks)


def _settled(arrived: DataFrame, state: DataFrame, masks: list[str]) -> DataFrame:
    """The state with what has arrived (node, masks). Where the state has `nh`, the estimate of its masks, it is brought along, and `was` is
    the one before. Merge joins: no side is sent through the driver, whatever its size."""
    got = arrived.select("node", *[F.col(m).alias(f"a{m}") for m in masks])
    told = [c for c in ["nh"] if c in state.columns]
    both = state.select("node", F.col("status").alias("before"), *masks, *told).filter("node is not null").join(got.hint("merge"), "node", "left")
    now = both.select("node", "before", *told, *[F.col(m).alias(f"o{m}") for m in masks], *[F.col(m).bitwiseOR(F.coalesce(f"a{m}", F.lit(0).cast("bigint"))).alias(m) for m in masks])
    changed = F.lit(False)
    for m in masks:
        changed = changed | (F.col(m) != F.col(f"o{m}"))
    now = now.withColumn("status", F.when(changed, "i").when(F.col("before") == "i", "c").otherwise("f"))
    if told:
        now = now.withColumn("was", F.col("nh")).withColumn("nh", F.when(F.col("status") == "i", fm_estimate([F.col(m) for m in masks])).otherwise(F.col("was")))
    return now.select("node", "status", *masks, *(["nh", "was"] if told else []))


def neighbourhood(state: DataFrame, k: int) -> DataFrame:
    """(nh, converged, changed): sum of the estimates; nodes that just converged; nodes that changed."""
    nh = F.col("nh") if "nh" in state.columns else fm_estimate([F.col(m) for m in names(k)])
    return state.agg(F.sum(nh).alias("nh"), F.sum((F.col("status") == "c").cast("bigint")).alias("converged"), F.sum((F.col("status") == "i").cast("bigint")).alias("changed"))


@dataclass
class Radii:
    curve: DataFrame  # (hop, nh, converged, changed); hop 0 has nh = number of nodes
    history: DataFrame  # (node, hop, nh)
    state: DataFrame
    hops: int


def radii(edges: DataFrame, nodes: DataFrame, k: int = 32, max_hops: int | None = None, make_symmetric: bool = False, resume: tuple[DataFrame, int] | None = None, width: int | None = None) -> Radii:
    """Hops until nothing changes, or max_hops if given; with width, over blocks of so many nodes a side. Each hop's state is a written
    table, which also is where a later run can resume (state, hop). The edges stay in place, partitioned and sorted as the hop joins them.

    Only masks that changed in the last hop travel in the next, and a hop's table has the estimates that the history needs, so each is
    computed once and the history is read without a join."""
    masks = names(k)
    edges = written((symmetric(edges) if make_symmetric else edges.select("src", "dst")).distinct(), "edges")
    if width is None:
        kept = in_place(edges, ["dst"], sort=True)
    else:
        kept = in_place(range_matrix(edges.select(F.col("src").alias("row"), F.col("dst").alias("col")), width).select("brow", "bcol", "r", "c"), ["bcol", "c"], sort=True)
    state, first = resume if resume else (init_state(nodes, k), 0)
    state = written(state.select("node", "status", *masks, fm_estimate([F.col(m) for m in masks]).alias("nh")), f"state{first}")
    spark = nodes.sparkSession
    history = nodes.select("node", F.lit(0).alias("hop"), F.lit(1.0).alias("nh"))
    rows = [(0, float(nodes.count()), 0, 0)]
    h = first
    while max_hops is None or h < max_hops:
        h += 1
        moving = None if h == first + 1 else state.filter("status = 'i'")
        after = written(hop(kept, state, k, moving) if width is None else hop_blocks(kept, state, k, width, moving), f"state{h}")
        history = history.unionByName(after.filter("status = 'i'").select("node", F.lit(h).alias("hop"), F.col("was").alias("nh")))
        r = neighbourhood(after, k).first()
        rows.append((h, r["nh"], r["converged"], r["changed"]))
        state = after
        if not r["changed"]:
            break
    kept.unpersist()
    curve = spark.createDataFrame(rows, "hop int, nh double, converged bigint, changed bigint")
    return Radii(curve, history, state.select("node", "status", *masks), h)


def node_radius(history: DataFrame) -> DataFrame:
    """(node, max_radius, eff_radius): the last hop of a node's history, and the hop, interpolated, at which its neighbourhood
    reaches nine tenths of the last estimate."""
    by = Window.partitionBy("node").orderBy("hop")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = history.withColumns({"top": F.last("nh").over(whole), "last": F.last("hop").over(whole), "next": F.lead("nh").over(by)})
    limit = F.col("top") * 0.9
    below = F.when(F.col("nh") < limit, F.struct("hop", (F.col("hop") + F.try_divide(limit - F.col("nh"), F.col("next") - F.col("nh"))).alias("eff")))
    out = rows.groupBy("node").agg(F.max("last").alias("max_radius"), F.max(below).alias("b"), F.min("hop").alias("low"))
    return out.select("node", "max_radius", F.round(F.coalesce("b.eff", F.col("low").cast("double")), 2).alias("eff_radius"))


def radius_histogram(radius: DataFrame) -> DataFrame:
    return radius.groupBy(F.floor(F.col("eff_radius") + 0.5).cast("int").alias("radius")).agg(F.count(F.lit(1)).alias("n"))


def effective_diameter(curve: DataFrame) -> DataFrame:
    """(diameter): the hop, interpolated, at which N(h) reaches nine tenths of its last value; -1 if none does."""
    order = Window.orderBy("hop")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = curve.withColumns({"limit": 0.9 * F.last("nh").over(whole), "prev": F.lag("nh").over(order)})
    at = F.col("hop") - 1 + F.try_divide(F.col("limit") - F.col("prev"), F.col("nh") - F.col("prev"))
    return rows.filter("hop > 0 and nh >= limit").agg(F.coalesce(F.min_by(at, "hop"), F.lit(-1.0)).alias("diameter"))


def average_diameter(curve: DataFrame) -> DataFrame:
    """(diameter): the mean of h, weighted by N(h) - N(h - 1)."""
    order = Window.orderBy("hop")
    rows = curve.withColumn("gain", F.col("nh") - F.lag("nh").over(order))
    return rows.agg((F.try_divide(F.sum(F.col("hop") * F.col("gain")), F.sum("gain"))).alias("diameter"))


def nh_exact(edges: DataFrame, nodes: DataFrame, hops: int) -> DataFrame:
    """(hop, n): exact pairs within h hops, each node counting itself. For small graphs: pairs are rows.

    A pair is kept with the hop that found it, and only the pairs that the last hop found go on. The pairs are counted before they are
    made distinct, and the tasks of that step follow their number, so that none has many more than PAIRS."""
    spark = nodes.sparkSession
    edges = written(edges.select(F.col("src").alias("via"), "dst").distinct(), "edges")
    reach = written(nodes.select("node", F.col("node").alias("far"), F.lit(0).alias("hop")), "reach0")
    rows = [(0, reach.count())]
    for h in range(1, hops + 1):
        last = reach.filter(F.col("hop") == h - 1).select("node", "far")
        more = written(last.join(edges, last["far"] == edges["via"]).select("node", F.col("dst").alias("far"), F.lit(h).alias("hop")), f"more{h}")
        parts = tasks_for(spark, rows[-1][1] + more.count(), PAIRS)
        reach = written(reach.unionByName(more).repartition(parts, "node", "far").groupBy("node", "far").agg(F.min("hop").alias("hop")), f"reach{h}")
        rows.append((h, reach.count()))
    return spark.createDataFrame(rows, "hop int, n bigint")
