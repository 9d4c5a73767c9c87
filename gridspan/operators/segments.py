"""Byte ranges (path, off, len): interval coverage and block hulls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _binned(rows: DataFrame, width: int) -> DataFrame:
    """(path, off, len, ...) laid into the bins of `width` bytes that it touches, clipped to each: (bin, lo, hi, ...)."""
    last = F.greatest(F.col("off") + F.col("len") - 1, F.col("off"))
    out = rows.withColumn("bin", F.explode(F.sequence(F.floor(F.col("off") / width), F.floor(last / width))))
    return out.withColumns({"lo": F.greatest(F.col("off"), F.col("bin") * width), "hi": F.least(F.col("off") + F.col("len"), (F.col("bin") + 1) * width)})


def islands(ranges: DataFrame, width: int) -> DataFrame:
    """(path, bin, s, e): the union of the ranges as disjoint stretches within each bin.

    A running maximum of ends marks where a stretch begins; the window sees one bin of one path at a time."""
    rows = _binned(ranges.select("path", "off", "len"), width).filter("lo < hi").select("path", "bin", "lo", "hi")
    by = Window.partitionBy("path", "bin").orderBy("lo", "hi")
    begins = (F.col("lo") > F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))).cast("int")
    rows = rows.withColumn("new", F.coalesce(begins, F.lit(1))).withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("path", "bin", "k").agg(F.min("lo").alias("s"), F.max("hi").alias("e")).drop("k")


def bin_width(targets: DataFrame, ranges: DataFrame, least: int = 1024) -> int:
    """The mean length of all targets and ranges, `least` at least: laid into bins as wide, they make about three rows each, however
    long the longest is."""
    mean = targets.select("len").unionByName(ranges.select("len")).agg(F.avg("len")).first()[0]
    return max(least, int(mean or 0))


def cover(targets: DataFrame, ranges: DataFrame, width: int | None = None) -> DataFrame:
    """targets (id, path, off, len) with `remaining`: bytes that no range of the same path covers. Bins are as wide as bin_width
    says.

    Targets meet the disjoint stretches of the ranges' union by equality on (path, bin), so however densely ranges overlap, a
    target meets few rows, and the covered length is a plain sum with partial sums before the shuffle."""
    width = width or bin_width(targets, ranges)
    t = _binned(targets.select("id", "path", "off", "len"), width).select("id", "path", "bin", "lo", "hi")
    met = t.join(islands(ranges, width), ["path", "bin"]).filter("s < hi and e > lo")
    covered = met.groupBy("id").agg(F.sum(F.least("hi", "e") - F.greatest("lo", "s")).alias("covered"))
    return targets.join(covered, "id", "left").select("id", "path", "off", "len", (F.col("len") - F.coalesce("covered", F.lit(0))).cast("bigint").alias("remaining"))


def cover_sorted(targets: DataFrame, ranges: DataFrame) -> DataFrame:
    """cover(), least remaining length first."""
    return cover(targets, ranges).orderBy("remaining", "path", "off", "len")


def cover_lists(targets: DataFrame, ranges: DataFrame) -> DataFrame:
    """(path, covered) for each path of either: the targets with their remaining bytes, least first. A path without targets has null, one
    without ranges an empty list."""
    item = F.struct("remaining", "off", "len", "id")
    lists = cover(targets, ranges).groupBy("path").agg(F.array_sort(F.collect_list(item)).alias("covered"))
    there = ranges.select("path").distinct().withColumn("any", F.lit(True))
    both = lists.join(there, "path", "full_outer")
    return both.select("path", F.when(F.col("covered").isNotNull() & F.col("any").isNull(), F.slice("covered", 1, 0)).otherwise(F.col("covered")).alias("covered"))


def choose_group(covered: DataFrame, capacity: int) -> DataFrame:
    """covered (grp, id, remaining) -> (grp, how, n), the group to run next: the one with most members that are covered whole (`perfect`); if
    none has any, the one of which most members, those that lack least first, fit half the capacity (`fit`). The least of equal
    groups; no row if nothing fits."""
    order = Window.partitionBy("grp").orderBy("remaining", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = covered.withColumn("used", F.sum("remaining").over(order))
    per = rows.groupBy("grp").agg(F.sum((F.col("remaining") == 0).cast("bigint")).alias("perfect"), F.sum((F.col("used") <= capacity // 2).cast("bigint")).alias("fit"))
    best = per.agg(*[F.min(F.struct((-F.col(how)).alias("n"), "grp")).alias(how) for how in ("perfect", "fit")])
    how = F.when(F.col("perfect.n") < 0, "perfect").when(F.col("fit.n") < 0, "fit")
    one = F.when(how == "perfect", F.col("perfect")).otherwise(F.col("fit"))
    return best.select(one["grp"].alias("grp"), how.alias("how"), (-one["n"]).alias("n")).filter("how is not null")


def lookup(segments: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (id, path, off, len) with `place`: how many segments of their path come before them by (off, len), the place that a search in
    the sorted list finds; and `found`: whether one is equal. Segments and probes are merged in order, bin by bin, and counts of the
    bins before are added, so no window sees a whole path."""
    seg = segments.select("path", "off", "len", F.lit(None).cast("bigint").alias("id"))
    ask = probes.select("path", "off", "len", F.col("id").cast("bigint").alias("id"))
    width = bin_width(probes, segments)
    both = seg.unionByName(ask).withColumn("bin", F.floor(F.col("off") / width))
    one = F.col("id").isNull().cast("bigint")
    bins = both.groupBy("path", "bin").agg(F.sum(one).alias("n"))
    before = bins.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = Window.partitionBy("path", "bin").orderBy("off", "len")
    same = Window.partitionBy("path", "bin", "off", "len")
    placed = both.withColumns({"upto": F.sum(one).over(at.rangeBetween(Window.unboundedPreceding, Window.currentRow)), "here": F.sum(one).over(same)})
    placed = placed.filter("id is not null").join(before.select("path", "bin", "base"), ["path", "bin"])
    return placed.select("id", "path", "off", "len", (F.col("base") + F.col("upto") - F.col("here")).cast("bigint").alias("place"), (F.col("here") > 0).alias("found"))


def host_lookup(segments: DataFrame, blocks: DataFrame, size: int) -> DataFrame:
    """segments (id, path, off, len), blocks (path, block, host) -> (id, host), distinct: the hosts of the blocks that hold a segment's first
    byte or its end; blocks between the two are not asked."""
    ends = F.array_distinct(F.array(F.floor(F.col("off") / size), F.floor((F.col("off") + F.col("len")) / size)))
    return segments.select("id", "path", F.explode(ends).alias("block")).join(blocks, ["path", "block"]).select("id", "host").distinct()


def cover_hull(segments: DataFrame, block: int) -> DataFrame:
    """(..., cover_off, cover_len): from the start of the block that holds the first byte to the end of the one that holds the end.

    Blocks touch, and both the block that ends at a position and the one that starts there hold it; the scan keeps the last
    block for the start and stops at the first for the end once a start is known."""
    off, end = F.col("off"), F.col("off") + F.col("len")
    start = F.floor(off / block) * block
    stop = F.when((end % block == 0) & (end > off) & (end > start), end).otherwise((F.floor(end / block) + 1) * block)
    return segments.withColumns({"cover_off": start.cast("bigint"), "cover_len": (stop - start).cast("bigint")})
