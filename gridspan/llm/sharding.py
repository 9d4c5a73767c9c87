"""Two-pass external shuffle into shards, by DataFrame functions only.

Pass 1 scatters rows by a seeded hash of their content into buckets of about `bucket_rows` rows and `bucket_bytes` bytes at
most, so a bucket fits a task's memory whatever the sources or copies among the rows. A run of neighbouring buckets goes to one
partition, named by its number. Pass 2 puts each bucket into hash order, runs an inside-out Fisher-Yates shuffle over it, with
draws from the same seed, and writes it. The buckets one after another are the shuffled corpus; shards are its equal runs (law
`rows`: counts differ by one at most), so each shard is written from whole buckets, in order.

Only pass 1 moves the rows; counts per bucket move beside them and give each bucket its place. Results depend on the rows and the
seed alone, so a task that runs again after a lost executor gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import running_start, written

LAW = "rows"


def seeded(seed: int, *cols: Column) -> Column:
    return F.xxhash64(F.lit(seed).cast("long"), *cols)


def fisher_yates(rows: Column, seed: int, bucket: Column) -> Column:
    """The array shuffled inside-out: row i goes to place j = hash mod (i + 1), and what stood there moves to the end."""

    def place(done: Column, item: Column) -> Column:
        i = F.size(done)
        j = F.pmod(seeded(seed, bucket, i), i + F.lit(1)).cast("int")
        put = F.concat(F.slice(done, F.lit(1), j), F.array(item), F.slice(done, j + F.lit(2), F.greatest(i - j - F.lit(1), F.lit(0))), F.slice(done, j + F.lit(1), F.lit(1)))
        return F.when(j == i, F.concat(done, F.array(item))).otherwise(put)

    order = F.transform(rows, lambda _, k: k)
    start = F.slice(order, F.lit(1), F.lit(0))
    picks = F.aggregate(order, start, place)
    return F.transform(picks, lambda k: F.get(rows, k))


def _bytes(rows: DataFrame) -> Column:
    """About how much memory a row takes."""
    long = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in rows.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = F.lit(16 * len(rows.columns)).cast("long")
    for c in long:
        total = total + c
    return total


def _opened(rows: DataFrame, crowded: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Rows of buckets that equal rows crowd: equal rows are counted before they move, opened again by number in two steps, and every copy
    but the first is scattered by its number, too."""
    merged = rows.join(crowded, "bucket", "left_semi").groupBy("h", "h2", "bucket").agg(F.first("r").alias("r"), F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    parts = merged.withColumn("first", F.explode(F.sequence(zero, F.col("n") - 1, F.lit(256).cast("long")))).repartition(F.xxhash64("h", "first"))
    copies = parts.withColumn("k", F.explode(F.sequence("first", F.least(F.col("first") + 256, F.col("n")) - 1)))
    return copies.withColumn("bucket", F.when(F.col("k") == 0, F.col("bucket")).otherwise(F.pmod(seeded(seed, F.col("h"), F.col("k")), F.lit(buckets)))).select("bucket", "h", "h2", "r")


def shuffled(rows: DataFrame, shards: int = 24, seed: int = 7, bucket_rows: int = 256, bucket_bytes: int = 4 << 20, part_bytes: int = 64 << 20, report: dict | None = None) -> DataFrame:
    """All columns of rows, with shard (int) and slot (long, gapless from 0 in each shard); columns of these names are replaced.

    Law `rows`: shard counts differ by at most one. Rows are scattered by all their columns, so rows of one id, or of none, share
    no bucket; where equal rows alone crowd a bucket (more than four times its rows), the copies are scattered by number. A row of
    very long text is a bucket's row like any other and must fit a task. Maps can neither be hashed nor ordered, and Spark refuses
    them. An empty table gives an empty result. report, if given, gets the numbers of rows, bytes, buckets and partitions."""
    spark = rows.sparkSession
    every = [F.col(f"`{c}`") for c in rows.columns]
    n, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(_bytes(rows)), F.lit(0))).first()
    buckets = max(1, -(-n // bucket_rows), -(-size // bucket_bytes))
    parts = min(buckets, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // part_bytes)))
    if report is not None:
        report |= {"rows": n, "bytes": size, "buckets": buckets, "partitions": parts}
    h = seeded(seed, *every)
    keyed = rows.select(F.pmod(h, F.lit(buckets)).cast("long").alias("bucket"), h.alias("h"), seeded(seed + 1, *every).alias("h2"), F.struct(*every).alias("r"))
    counts = written(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket_sizes")
    crowded = counts.filter(F.col("n") > 4 * bucket_rows).select("bucket")
    if not crowded.isEmpty():
        keyed = keyed.join(crowded, "bucket", "left_anti").unionByName(_opened(keyed, crowded, buckets, seed))
        counts = written(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket_sizes")
    # The places of the buckets travel with the rows, as rows of their own, so nothing is joined.
    record = F.struct(F.col("h2"), F.col("h"), F.col("r"))
    starts = running_start(counts, "bucket", "n", "start").select("bucket", F.lit(None).cast(keyed.select(record).schema[0].dataType).alias("x"), "start")
    run = F.floor(F.col("bucket") * parts / buckets).cast("int")
    dealt = keyed.select("bucket", record.alias("x"), F.lit(None).cast("long").alias("start")).unionByName(starts).withColumn("run", run).repartitionById(parts, F.col("run"))
    grouped = dealt.groupBy("run", "bucket").agg(F.array_sort(F.collect_list("x")).alias("rows"), F.max("start").alias("start"))
    mixed = grouped.select("start", F.posexplode(fisher_yates(F.col("rows"), seed + 2, F.col("bucket"))).alias("p", "x"))
    at = F.col("start") + F.col("p")
    low, extra = divmod(n, shards)
    long = F.lit(extra * (low + 1))
    first = at < long
    shard = F.when(first, F.floor(at / F.lit(low + 1))).otherwise(F.lit(extra) + F.floor((at - long) / F.lit(max(low, 1))))
    slot = F.when(first, at % F.lit(low + 1)).otherwise((at - long) % F.lit(max(low, 1)))
    return mixed.select(*[F.col(f"x.r.`{c}`").alias(c) for c in rows.columns if c not in ("shard", "slot")], shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(rows: DataFrame, path: str, **options) -> None:
    """Shards as folders shard=N of Parquet files. A task writes its run of buckets, in order, and the files of a shard are named in the
    order of the runs: one after another they hold the slots from 0 on."""
    shuffled(rows, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
