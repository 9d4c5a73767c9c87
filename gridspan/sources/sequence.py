"""Binary key-value files: a key of 4 bytes names a vector block, one of 8 bytes a matrix block."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codec import unpack_matrix, unpack_vector


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(key, value), both binary. Spark has no DataFrame reader for these files, so the pairs come through an RDD once."""
    pairs = spark.sparkContext.sequenceFile(path).map(lambda kv: (bytes(kv[0]), bytes(kv[1])))
    return spark.createDataFrame(pairs, "key binary, value binary")


def write_pairs(pairs: DataFrame, path: str) -> None:
    pairs.rdd.map(lambda r: (bytearray(r[0]), bytearray(r[1]))).saveAsSequenceFile(path)


def _int(start: int):
    """A big-endian signed 32-bit integer of the key."""
    raw = F.conv(F.hex(F.substr(F.col("key"), F.lit(start), F.lit(4))), 16, 10).cast("bigint")
    return F.when(raw >= 2**31, raw - 2**32).otherwise(raw).cast("int")


def _checked(pairs: DataFrame) -> DataFrame:
    size = F.octet_length("key")
    bad = F.raise_error(F.concat(F.lit("key of "), size.cast("string"), F.lit(" bytes")))
    return pairs.withColumn("key", F.when(size.isin(4, 8), F.col("key")).otherwise(bad))


def vector_blocks(pairs: DataFrame) -> DataFrame:
    """(b, items)."""
    return _checked(pairs).filter(F.octet_length("key") == 4).select(_int(1).alias("b"), unpack_vector(F.col("value")).alias("items"))


def matrix_blocks(pairs: DataFrame) -> DataFrame:
    """(brow, bcol, entries)."""
    return _checked(pairs).filter(F.octet_length("key") == 8).select(_int(1).alias("brow"), _int(5).alias("bcol"), unpack_matrix(F.col("value")).alias("entries"))
