from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.llm import mixing as M


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "é": 7, "Z": 900, None: 40}, {"a": 5}, {"a": 0, "b": 9}, {"x": 1, "y": 1, "z": 1, "w": 1}])
def test_targets_match_resharing(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in M.source_targets(df).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_pivotal_keeps_the_mass():
    rng = np.random.default_rng(2)
    p, size = rng.random(500), rng.integers(1, 50, 500).astype(float)
    out = M.pivotal(p, size, rng.random(501), False)
    assert ((out == 0) | (out == 1)).sum() >= 499
    assert (out * size).sum() == pytest.approx((p * size).sum())
    one = M.pivotal(p, size, rng.random(501), True)
    assert set(one) <= {0.0, 1.0}


def test_pivotal_keeps_probabilities():
    p, size = np.array([0.2, 0.5, 0.7, 0.4]), np.array([3.0, 1.0, 2.0, 5.0])
    rng = np.random.default_rng(0)
    mean = np.mean([M.pivotal(p, size, rng.random(5), True) for _ in range(20_000)], axis=0)
    assert mean == pytest.approx(p, abs=0.02)


def test_mix_comes_near_its_targets_and_repeats(spark):
    rows = spark.range(6000).select(F.col("id"), F.concat(F.lit("s"), (F.least(F.col("id") % 7, F.lit(4))).cast("string")).alias("source"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("size"))
    one = M.copies(rows, block_rows=64, fan=4)
    got = one.collect()
    assert len(got) == 6000
    for s in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in mine) - mine[0]["target"]) <= 91
    assert max(r["copies"] for r in got) <= 2
    again = M.copies(rows.repartition(9), block_rows=64, fan=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_rows_of_every_kind(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (3, "", None), (None, "c", None), (4, "w " * 50_000, "t"), (5, "x", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("id", F.lit(1))
    df = df.withColumns({"_id": F.lit(1), "_copies": F.lit(2), "row": F.lit("r"), "n": F.lit(0), "first": F.lit(None).cast("int"), "k": F.lit(3)})
    out = M.mixed(df)
    assert out.columns == df.columns
    got = out.collect()
    assert {tuple(r) for r in got} <= {tuple(r) for r in df.collect()}
    assert max(Counter(map(tuple, got)).values()) <= 4
    assert M.mixed(df.limit(0)).collect() == []
    sized = df.select(F.col("doc_id").alias("id"), "source", M.n_words("text").alias("size"))
    assert [r["size"] for r in sized.orderBy("id").collect()] == [1, 2, 2, 0, 0, 50_000, 1]
    assert len(M.copies(sized).collect()) == len(rows)
    assert M.copies(sized.limit(0)).collect() == []


def test_every_row_counts_whatever_its_id(spark):
    """Two copies of everything: rows of one id or of none, equal rows, and ids beyond 53 bits all come out twice."""
    rows = [(1, "a b", "s"), (1, "c d", "s"), (1, "a b", "s"), (None, "e", "s"), (None, "f", "s"), (2**62 + 1, "g", "s"), (2**62 + 2, "h", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter(map(tuple, M.mixed(df, share=2.0).collect()))
    assert got == {r: 2 * n for r, n in Counter(rows).items()}
    sized = df.select(F.col("doc_id").alias("id"), "source", M.n_words("text").alias("size"))
    assert Counter(r["id"] for r in M.copies(sized).collect()) == Counter(r[0] for r in rows)


def test_a_hot_id_is_one_item(spark):
    """Half of all rows have one id and size: their copies are as even as they go, and the source meets its target."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id")).alias("id"), F.lit("s").alias("source"), F.when(F.col("id") % 2 == 0, F.lit(10)).otherwise(F.pmod(F.xxhash64("id"), F.lit(30)) + 1).alias("size"))
    got = M.copies(rows, share=1.3, block_rows=64, fan=4).toPandas()
    assert len(got) == 40_000 and got.copies.between(1, 2).all()
    assert abs((got["size"] * got.copies).sum() - got.target[0]) <= 30
    hot = got[(got.id == 7) & (got["size"] == 10)]
    assert len(hot) >= 20_000 and abs(hot.copies.mean() - 1.3) < 0.001


def test_mixed_against_the_copies(spark, sf_dir):
    """Every document comes out as often as the rounding took it, and the sources meet their targets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.toPandas()
    rows["size"] = [len((t or "").encode().split()) for t in rows.text]
    got = M.mixed(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    taken = rows.assign(n=rows.doc_id.map(got).fillna(0)).assign(words=lambda x: x["size"] * x.n)
    assert taken.n.max() <= 2
    want = brute_targets(rows.groupby("source")["size"].sum().to_dict())
    for s, g in taken.groupby("source"):
        assert abs(g.words.sum() - want[s]) <= g["size"].max()
