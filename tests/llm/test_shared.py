import pytest
from pyspark.sql import functions as F

from gridspan.llm import shared as S


def test_sizes_in_every_spelling():
    assert [S.byte_size(x) for x in ("4194304", "4194304b", "64m", "64MB", "1g", " 2kib ", "-1")] == [1 << 22, 1 << 22, 64 << 20, 64 << 20, 1 << 30, 2048, -1]
    with pytest.raises(ValueError, match="not a size"):
        S.byte_size("many")


@pytest.mark.parametrize(("before", "after"), [("64m", "4194304"), ("1m", "1m"), ("4194304b", "4194304b")])
def test_batches_are_lowered_only(spark, before, after):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, before)
        S.bounded_batches(spark)
        assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, old)


def test_what_is_remembered_is_bounded():
    class Doubled(S.Remembered):
        asked = 0

        def find(self, piece):
            self.asked += 1
            return piece * 2

    d = Doubled(20 * (S.Remembered.ENTRY + 30))
    assert [d[f"{i % 5:010d}"] for i in range(50)] == [f"{i % 5:010d}" * 2 for i in range(50)] and d.asked == 5
    for i in range(1000):
        assert d[f"{i:010d}"] == f"{i:010d}" * 2
        assert len(d) <= 10 and len(d.old) <= 10
    before = len(d)
    assert d["x" * 1000] == "x" * 2000 and len(d) == before


def test_a_running_start_over_many_keys(spark):
    counts = spark.range(10_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    got = {r["k"]: r["start"] for r in S.running_start(counts, "k", "n", "start", fan=100).collect()}
    at = 0
    for k in range(10_000):
        assert got[k] == at
        at += k % 7
