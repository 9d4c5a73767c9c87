"""Schedules of pairs over workers, and replays of their reads against caches: the hit rate of a given schedule."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.keys import ranked, running_start
from ..sources.generators import draw


def lru_hits(trace: DataFrame, capacity: int) -> DataFrame:
    """trace (worker, step, item), and where items have one, size -> (worker, hits, reads): least-recently-used caches of `capacity`
    items, or units of size. An item larger than the cache is read past it.

    A worker's accesses are replayed in order by one task, in one pass: a replay is sequential by nature. They stream through it
    in sorted batches, so it holds no more than the cache."""
    sized = trace.select(F.col("worker").cast("bigint").alias("worker"), "step", F.col("item").cast("string").alias("item"), (F.col("size") if "size" in trace.columns else F.lit(1)).cast("bigint").alias("size"))

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cache, used, hits, reads = None, OrderedDict(), 0, 0, 0

        def total() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([hits], pa.int64()), pa.array([reads], pa.int64())], ["worker", "hits", "reads"])

        for batch in batches:
            for worker, item, size in zip(*(batch.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if worker != now:
                    if reads:
                        yield total()
                    now, cache, used, hits, reads = worker, OrderedDict(), 0, 0, 0
                reads += 1
                if item in cache:
                    hits += 1
                    cache.move_to_end(item)
                elif size <= capacity:
                    cache[item] = size
                    used += size
                    while used > capacity:
                        used -= cache.popitem(last=False)[1]
        if reads:
            yield total()

    return sized.repartition("worker").sortWithinPartitions("worker", "step").mapInArrow(replay, "worker bigint, hits bigint, reads bigint")


def packs_by_side(row_side: int, col_side: int) -> tuple[Column, Column]:
    """Pack row and column of a pair of ids from 0 on: tiles of row_side x col_side."""
    return F.floor(F.col("l_id") / row_side), F.floor(F.col("r_id") / col_side)


def packs_by_capacity(items: DataFrame, capacity: int) -> DataFrame:
    """items (id, size) -> (id, pack): runs of neighbouring items, cut so that a pack of rows and one of columns fit a cache of `capacity`
    together: each side has half. An item belongs to the run that its first unit falls in."""
    placed = running_start(items, "id", "size", "start")
    return placed.select("id", F.floor(F.col("start") / F.lit(max(1, capacity // 2))).alias("pack"))


def pack_tasks(pairs: DataFrame, rows: Column, cols: Column, workers: int) -> DataFrame:
    """(task, worker, place, l_id, r_id): pairs as tasks of their packs. Packs are numbered by row, then column, and dealt to workers in
    turn; place is a pair's turn on its worker, from 1 on."""
    keyed = pairs.select("l_id", "r_id", F.struct(rows.alias("pr"), cols.alias("pc")).alias("pack"))
    packs = ranked(keyed.select("pack").distinct(), [F.col("pack")], "task")
    tasks = keyed.join(packs, "pack").withColumn("worker", (F.col("task") % workers).cast("bigint"))
    order = Window.partitionBy("worker").orderBy("task", "l_id", "r_id")
    return tasks.select("task", "worker", F.row_number().over(order).alias("place"), "l_id", "r_id")


def task_metadata(tasks: DataFrame, hosts: DataFrame) -> DataFrame:
    """(task, worker, pairs, items, hosts): what each task reads, and the hosts (item, host) that hold any of it."""
    items = tasks.select("task", "worker", F.explode(F.array("l_id", "r_id")).alias("item"))
    held = items.join(hosts, "item", "left").groupBy("task", "worker").agg(F.count_distinct("item").alias("items"), F.array_sort(F.collect_set("host")).alias("hosts"))
    return tasks.groupBy("task").agg(F.count(F.lit(1)).alias("pairs")).join(held, "task").select("task", "worker", "pairs", "items", "hosts")


def reads(tasks: DataFrame) -> DataFrame:
    """tasks (worker, place, l_id, r_id) -> a trace (worker, step, item): a task reads its left item, then its right one."""
    both = F.array(F.struct((F.col("place") * 2 - 1).alias("step"), F.concat(F.lit("l"), F.col("l_id").cast("string")).alias("item")), F.struct((F.col("place") * 2).alias("step"), F.concat(F.lit("r"), F.col("r_id").cast("string")).alias("item")))
    return tasks.select("worker", F.explode(both).alias("x")).select("worker", F.col("x.step").cast("bigint").alias("step"), F.col("x.item").alias("item"))


def packed_schedule(pairs: DataFrame, row_side: int, col_side: int, workers: int) -> DataFrame:
    """A trace (worker, step, item) of pairs grouped into packs of row_side x col_side."""
    return reads(pack_tasks(pairs, *packs_by_side(row_side, col_side), workers))


def replicas(items: DataFrame, workers: int, copies: int, seed: str = "h") -> DataFrame:
    """(item, host): each item on up to `copies` workers, drawn by hash; draws that meet count once."""
    host = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda k: F.pmod(draw(F.lit(seed), F.col("id"), k), F.lit(workers)))
    return items.select(F.col("id").alias("item"), F.explode(F.array_distinct(host)).alias("host"))


def scheduled(pairs: DataFrame, workers: int, how: str, hosts: DataFrame | None = None, seed: str = "w") -> DataFrame:
    """(worker, place, l_id, r_id) of pairs that are tasks by themselves. `random`: a worker drawn by hash. `local`: the worker that holds
    most of the pair's items, the lowest of equals; without any, one drawn."""
    drawn = F.pmod(draw(F.lit(seed), F.col("l_id"), F.col("r_id")), F.lit(workers)).cast("bigint")
    if how == "random":
        placed = pairs.select("l_id", "r_id", drawn.alias("worker"))
    elif how == "local":
        votes = pairs.select("l_id", "r_id", F.explode(F.array("l_id", "r_id")).alias("item")).join(hosts, "item").groupBy("l_id", "r_id", "host").agg(F.count(F.lit(1)).alias("n"))
        best = votes.groupBy("l_id", "r_id").agg(F.min_by("host", F.struct(-F.col("n"), "host")).alias("host"))
        placed = pairs.join(best, ["l_id", "r_id"], "left").select("l_id", "r_id", F.coalesce(F.col("host").cast("bigint"), drawn).alias("worker"))
    else:
        raise ValueError(how)
    return placed.select("worker", F.row_number().over(Window.partitionBy("worker").orderBy("l_id", "r_id")).alias("place"), "l_id", "r_id")


def local_reads(tasks: DataFrame, hosts: DataFrame) -> DataFrame:
    """(reads, local): item reads of tasks, and those whose worker holds the item."""
    items = tasks.select("worker", F.explode(F.array("l_id", "r_id")).alias("item"))
    held = items.join(hosts.select("item", F.col("host").cast("bigint").alias("worker"), F.lit(1).alias("one")), ["item", "worker"], "left")
    return held.agg(F.count(F.lit(1)).alias("reads"), F.count("one").alias("local"))
