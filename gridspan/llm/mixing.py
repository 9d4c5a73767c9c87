"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the expected number of copies of each of its documents; the whole part is taken for
sure, the fraction is a copy probability. Within a block of a source, two fractional documents meet at a time and one hands
mass (in words) to the other, at random in the direction that keeps both expectations, until one of them is integral; their
sum of words stays what it was. A block leaves one residual document; residuals meet in blocks of `fan`, level by level, until
one document of the source is left, which is rounded by itself. So a source misses its target by less than one document;
large documents go first, and the small ones after them settle what they leave, so the last one is mostly small.

Only ids, sizes and probabilities move. Blocks are dealt by a hash of the id, `block_rows` rows each, so a hot source is many
groups; the tree has log_fan(blocks) levels, and each level is a written table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
_EPS = 1e-9


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sized (source, size, and where rows stand for several, rows) -> (source, n_docs, source_size, target).

    Sources by code point, null last, weigh `weights`, repeating. They share `share` of all sizes by weight; a target stops at
    `most` times its source's size and the excess goes to the others: min(most * size, level * weight) at the level where
    the sum fits, found from prefix sums over the sources in the order of the levels at which they fill. Windows here see one
    row a source."""
    n = F.col("rows") if "rows" in sized.columns else F.lit(1)
    by = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("size") * n).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    by = by.withColumn("level", (share * F.sum("source_size").over(everything) - before) / left).withColumn("level", F.max("level").over(everything))
    return by.select("source", "n_docs", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def pivotal(p: np.ndarray, size: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """p rounded, in the order given: all integral but for one at most; with `last`, that one too. draw: a number for each row and one
    for the last."""
    out, sizes, draws = p.tolist(), size.tolist(), draw.tolist()
    held = -1
    for i, (q, n) in enumerate(zip(out, sizes, strict=True)):
        if q <= _EPS or q >= 1 - _EPS:
            out[i] = float(round(q))
            continue
        if held < 0:
            held = i
            continue
        h, m = out[held], sizes[held]
        up, down = min((1 - h) * m, q * n), min(h * m, (1 - q) * n)
        give = up if draws[i] * (up + down) < down else -down
        h, q = h + give / m, q - give / n
        out[held], out[i] = (float(round(x)) if x <= _EPS or x >= 1 - _EPS else x for x in (h, q))
        held = next((k for k in (held, i) if 0 < out[k] < 1), -1)
    if last and held >= 0:
        out[held] = float(draws[-1] < out[held])
    return np.array(out)


def _settler(seed: int, level: int, last: bool):
    def settle(items: pa.Table) -> pa.Table:
        size, o, o2, so, block = (items.column(c).to_numpy() for c in ("size", "o", "o2", "so", "block"))
        items = items.take(pa.array(np.lexsort((o2, o, -size))))
        draw = np.random.default_rng([seed, level, int(so[0]) & (2**63 - 1), int(block[0])]).random(len(size) + 1)
        p = pivotal(items.column("p").to_numpy(), items.column("size").to_numpy().astype(float), draw, last)
        return items.set_column(items.schema.get_field_index("p"), "p", pa.array(p)).drop_columns(["o", "o2", "so"])

    return settle


def copies(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, block_rows: int = 1024, fan: int = 64) -> DataFrame:
    """sized (id, source, size) -> (id, source, size, source_size, target, copies) for every row. Reruns agree: the draws
    depend on the seed, the ids, the sizes and the level.

    Rows of one id, source and size are one item of the rounding, so a hot id is one row of a block; its copies are dealt out
    again as evenly as they go, so that none of the rows has more than `most`, rounded up. Rows of size 0 take no words: they get the whole
    part of their source's copies. A null source is a source, a null id an id. Texts are not read here. An empty table gives an
    empty result."""
    sized = sized.select("id", "source", F.col("size").cast("long").alias("size"))
    sized = written(sized.groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "sized")
    targets = written(source_targets(sized, weights, share, most), "targets")
    kind = sized.schema["id"].dataType.simpleString()
    rows = sized.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.id", "s.source", "s.size", "s.rows", "t.source_size", "t.target", "t.n_docs")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) * F.col("rows")
    rate = F.when(F.col("size") == 0, F.floor(rate / F.col("rows")) * F.col("rows")).otherwise(rate)
    blocks = F.ceil(F.col("n_docs") / F.lit(block_rows))
    now = rows.select("id", "source", "size", "rows", "source_size", "target", F.floor(rate).cast("long").alias("whole"), (rate - F.floor(rate)).alias("p"), F.pmod(F.xxhash64(F.lit(seed).cast("long"), "id", "size"), blocks).alias("block"))
    schema = f"id {kind}, source string, size bigint, rows bigint, source_size bigint, target double, whole bigint, p double, block bigint"
    free = (F.col("size") == 0) | (F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)
    done = now.filter(free).select("id", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.when(F.col("p") >= 1 - _EPS, 1).otherwise(0)).alias("copies"))
    now = now.filter(~free)
    left = -(-(targets.agg(F.max("n_docs")).first()[0] or 0) // block_rows)
    level = 0
    while True:
        last = left <= 1
        keyed = now.withColumns({"o": F.xxhash64(F.lit(seed + 1).cast("long"), "id"), "o2": F.xxhash64(F.lit(seed + 2).cast("long"), "id"), "so": F.xxhash64(F.coalesce("source", F.lit("\x00")), F.col("source").isNull())})
        after = written(keyed.groupBy("source", "block").applyInArrow(_settler(seed, level, last), schema), f"level{level}")
        whole = (F.col("p") == 0) | (F.col("p") == 1)
        done = done.unionByName(after.filter(whole).select("id", "source", "size", "rows", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies")))
        if last:
            return _each_row(done)
        now = after.filter(~whole).withColumn("block", F.floor(F.col("block") / F.lit(fan)))
        left = -(-left // fan)
        level += 1


def _each_row(items: DataFrame, step: int = 4096) -> DataFrame:
    """Items (.., rows, copies) as their rows; the first of them get one copy more where they do not divide. An item of very many rows
    is opened in two steps with an exchange between them, so no task opens it alone."""
    single = items.filter("rows = 1").drop("rows")
    many = items.filter("rows > 1").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(step).cast("long"))))
    many = many.repartition(F.xxhash64("id", "source", "size", "first")).withColumn("k", F.explode(F.sequence("first", F.least(F.col("first") + F.lit(step), F.col("rows")) - 1)))
    share = F.floor(F.col("copies") / F.col("rows")) + F.when(F.col("k") < F.col("copies") % F.col("rows"), 1).otherwise(0)
    return single.unionByName(many.withColumn("copies", share.cast("long")).select(single.columns))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them (0, 1 or 2 times each). Columns are those of docs, whatever their names.

    A row is known by two hashes of all its columns, so rows of one doc_id, or of none, are each taken by themselves; equal rows are
    counted before they move and opened again by number. Whole texts travel once, to meet the number of their copies. Maps cannot
    be hashed and are refused by Spark. An empty table gives an empty result."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    key = F.concat(F.hex(F.xxhash64(*every)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *every)))
    sized = docs.select(key.alias("id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    took = copies(sized, **options).groupBy("id").agg(F.sum("copies").alias("n")).filter("n > 0")
    one = docs.select(key.alias("id"), F.struct(*every).alias("row")).groupBy("id").agg(F.first("row").alias("row"))
    # A row may be taken very often: its numbers are opened in two steps, so no array is long.
    out = one.join(took, "id").select("row", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(256).cast("long"))).alias("first"))
    out = out.select("row", F.explode(F.sequence("first", F.least(F.col("first") + 256, F.col("n")) - 1)).alias("k"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
