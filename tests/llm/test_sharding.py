import glob
import struct
from collections import Counter

import pyarrow.parquet as pq
import xxhash
from pyspark.sql import functions as F

from gridspan.llm import sharding as S


def h(seed, *values):
    """xxhash64 of SQL: each value hashed with the hash before it as the seed, 42 at first; nulls are passed over."""
    out = 42
    for kind, x in [("q", seed), *values]:
        if x is not None:
            out = xxhash.xxh64_intdigest(x.encode() if kind == "s" else struct.pack(f"<{kind}", x), out)
    return out - 2**64 if out >= 2**63 else out


def brute(rows, shards, seed, buckets):
    """rows (id, text), all different -> {row: (shard, slot)}."""
    n = len(rows)
    key = lambda s, r: h(s, ("q", r[0]), ("s", r[1]))
    groups = {}
    for r in rows:
        groups.setdefault(key(seed, r) % buckets, []).append(r)
    order = []
    for b in sorted(groups):
        done = []
        for k, r in enumerate(sorted(groups[b], key=lambda r: key(seed + 1, r))):
            j = h(seed + 2, ("q", b), ("i", k)) % (k + 1)
            if j == k:
                done.append(r)
            else:
                done.append(done[j])
                done[j] = r
        order += done
    low, extra = divmod(n, shards)
    out = {}
    for at, r in enumerate(order):
        s = at // (low + 1) if at < extra * (low + 1) else extra + (at - extra * (low + 1)) // low
        out[r] = (s, at - (s * low + min(s, extra)))
    return out


def buckets_of(rows, bucket_rows=256, bucket_bytes=4 << 20):
    size = sum(32 + len((t or "").encode()) for _, t in rows)
    return max(1, -(-len(rows) // bucket_rows), -(-size // bucket_bytes))


def test_matches_a_plain_shuffle(spark):
    for n, shards in ((1000, 24), (23, 24), (24, 24), (77, 5)):
        rows = spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
        got = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in S.shuffled(rows, shards=shards, bucket_rows=64).collect()}
        plain = [(i, str(i)) for i in range(n)]
        assert got == brute(plain, shards, 7, buckets_of(plain, 64))


def test_buckets_are_bounded_in_bytes(spark):
    report = {}
    rows = spark.range(64).select(F.col("id").alias("doc_id"), F.repeat(F.lit("long text "), 10_000).alias("text"))
    plain = [(i, "long text " * 10_000) for i in range(64)]
    got = {(r["doc_id"], r["text"]): (r["shard"], r["slot"]) for r in S.shuffled(rows, shards=4, bucket_bytes=500_000, part_bytes=1 << 20, report=report).collect()}
    assert report["buckets"] == 13 and report["partitions"] == 7 and got == brute(plain, 4, 7, 13)


def test_result_does_not_depend_on_partitions(spark):
    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    one = sorted(map(tuple, S.shuffled(rows).collect()))
    assert one == sorted(map(tuple, S.shuffled(rows.repartition(7)).collect()))
    assert [r[0] for r in sorted(one, key=lambda r: (r[1], r[2]))] != list(range(500))


def test_rows_of_every_kind(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "x"), (3, "y" * 200_000), (4, "same"), (5, "same"), (1, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"slot": F.lit("clash"), "shard": F.lit(1), "bucket": F.lit(2), "h": F.lit(3), "r": F.lit(4), "_r": F.lit(5), "start": F.lit(6)})
    out = S.shuffled(df, shards=3)
    assert out.columns == ["doc_id", "text", "bucket", "h", "r", "_r", "start", "shard", "slot"]
    got = out.collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in got) == sorted((str(a), str(b)) for a, b in rows)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and len(slots) in (2, 3)
    assert S.shuffled(df.limit(0)).collect() == []


def test_equal_rows_crowd_no_bucket(spark):
    """A third of all rows are one row: they are dealt over all buckets, and every row is there once."""
    rows = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    out = S.shuffled(rows, shards=4, bucket_rows=32)
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(None if i % 3 == 0 else i for i in range(9000))
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(2250))
        assert 600 < sum(r["doc_id"] is None for r in got if r["shard"] == s) < 900
    assert sorted(map(str, got)) == sorted(map(str, S.shuffled(rows.repartition(5), shards=4, bucket_rows=32).collect()))


def test_files_of_a_shard_are_in_slot_order(spark, tmp_path):
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    S.write_shards(rows, f"{tmp_path}/out", shards=3)
    files = 0
    for s in range(3):
        names = sorted(glob.glob(f"{tmp_path}/out/shard={s}/*.parquet"))
        files += len(names)
        slots = [x for f in names for x in pq.ParquetFile(f).read(columns=["slot"])["slot"].to_pylist()]
        assert slots == list(range(len(slots))) and len(slots) in (1666, 1667)
    assert files > 3


def test_one_exchange_moves_the_rows(spark):
    plan = S.shuffled(spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 1 and "Join" not in plan.split("shufflepartitionidpassthrough")[0]


def test_no_python_on_the_main_path(spark):
    plan = S.shuffled(spark.range(10).withColumnRenamed("id", "doc_id"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
