"""The registered queries over the driver tables; oracles.py has their SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codec, sketch
from .functions.words import PLACED, word_count
from .operators import blocks as B
from .operators import dense, graph, pairjoin, segments
from .plans import locality, pagerank, radius, semiring
from .session import new_path, table
from .sources import generators, manifest, sequence, text
from .sources.graph import co_purchase, order_segments, part_nodes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

K, HOPS, ITERATIONS, ALPHA = 8, 5, 10, 0.15


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, col: str = "rank", digits: int = 10) -> DataFrame:
    return df.withColumn(col, F.round(col, digits))


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return co_purchase(spark, sf_dir), part_nodes(spark, sf_dir)


def _ranks(spark: SparkSession, sf_dir: str, strategy: str = "naive", **options) -> DataFrame:
    edges, nodes = _graph(spark, sf_dir)
    return pagerank.pagerank(edges, nodes, ALPHA, strategy=strategy, fixed_iterations=options.pop("fixed_iterations", ITERATIONS), **options)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transition_matrix(co_purchase(spark, sf_dir)).select(F.col("dst").alias("row"), F.col("src").alias("col"), F.col("p").alias("val"))


def _vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_retailprice").alias("v"))


# Scans, generators and sinks


@query
def edges(spark, sf_dir):
    return co_purchase(spark, sf_dir)


@query
def edge_text_scan(spark, sf_dir):
    """Lines made from line items, some of them comments or of another arity, through the text scan."""
    line = table(spark, sf_dir, "lineitem")
    tab = F.lit("\t")
    value = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("# "), F.col("l_orderkey").cast("string"), tab, F.col("l_partkey").cast("string"))).when(F.col("l_linenumber") == 2, F.concat(F.col("l_orderkey").cast("string"), tab, F.col("l_partkey").cast("string"), tab, F.lit("vec"))).otherwise(F.concat(F.col("l_orderkey").cast("string"), tab, F.col("l_partkey").cast("string")))
    return text.edge_lines(line.select(value.alias("value"))).groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("dst").alias("sum_dst"))


@query
def vector_text_scan(spark, sf_dir):
    tab = F.lit("\t")
    lines = _vector(spark, sf_dir).select(F.explode(F.array(F.concat(F.col("node").cast("string"), tab, F.col("v").cast("string"), tab, F.lit("vec")), F.concat(F.col("node").cast("string"), tab, F.lit("7")))).alias("value"))
    return text.vector_lines(lines)


@query
def block_text_roundtrip(spark, sf_dir):
    """Range blocks of a vector to `i v i v` texts and back, unfolded to nodes."""
    blocks = B.vector_blocks(_vector(spark, sf_dir), 16)
    lines = blocks.select("b", text.format_vector_block(F.col("items")).alias("line"))
    return B.unfold(lines.select("b", text.parse_vector_block(F.col("line")).alias("items")), 16)


@query
def matrix_text_parse(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat_ws(" ", (F.col("l_partkey") % 16).cast("string"), (F.col("l_suppkey") % 16).cast("string"), F.col("l_quantity").cast("string")).alias("t"))
    return line.select("l_orderkey", F.explode(text.parse_matrix_block(F.col("t"))).alias("e")).groupBy(F.col("e.row").alias("row"), F.col("e.col").alias("col")).agg(F.sum("e.val").alias("val"))


@query
def block_edge_scan(spark, sf_dir):
    """Lines `brow TAB bcol TAB col row val ..` of the matrix's range blocks, among them comments and lines of another form, scanned."""
    blocks = B.packed(B.range_matrix(_matrix(spark, sf_dir), 64))
    entry = F.array_join(F.transform("entries", lambda e: F.concat_ws(" ", e["col"].cast("string"), e["row"].cast("string"), e["val"].cast("string"))), " ")
    line = F.concat_ws("\t", F.col("brow").cast("string"), F.col("bcol").cast("string"), entry)
    lines = blocks.select(F.explode(F.array(line, F.concat(F.lit("# "), line), F.concat(line, F.lit("\tmore")))).alias("value"))
    found = text.block_lines(lines).select("bcol", "brow", F.explode("entries").alias("e"))
    return rounded(found.groupBy("brow", "bcol").agg(F.count(F.lit(1)).alias("n"), F.sum("e.row").alias("rows"), F.sum("e.col").alias("cols"), F.sum("e.val").alias("total")), "total", 9)


@query
def state_text_scan(spark, sf_dir):
    """Edges, states after two hops with their history, and commands in one text, scanned as typed rows."""
    e, nodes = _graph(spark, sf_dir)
    found = radius.radii(e, nodes, k=2, max_hops=2)
    past = found.history.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("hop", "nh"))).alias("past"))
    states = found.state.join(past, "node").select(text.format_state(F.col("node"), F.col("status"), F.col("past"), F.array("b0", "b1")).alias("value"))
    lines = states.unionByName(e.select(F.concat_ws("\t", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value")))
    lines = lines.unionByName(nodes.select(F.concat(F.col("node").cast("string"), F.lit("\tc")).alias("value"))).unionByName(nodes.select(F.concat(F.lit("#"), F.col("node").cast("string")).alias("value")))
    rows = text.state_lines(lines, 2)
    zero = F.lit(0).cast("bigint")
    total = {"nodes": F.col("node"), "others": F.coalesce("other", zero), "masks": F.coalesce(F.aggregate("masks", zero, lambda a, m: a + m), zero), "hops": F.when(F.col("kind") == "state", F.size("history")).otherwise(zero)}
    return rows.groupBy("kind", F.coalesce("status", F.lit("")).alias("status")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in total.items()])


@query
def state_block_scan(spark, sf_dir):
    """Vector blocks of masks as `role row mask row mask ..` texts, parsed again."""
    state = radius.init_state(part_nodes(spark, sf_dir), 1)
    item = F.concat_ws(" ", B.range_index(F.col("node"), 32).cast("string"), F.lower(F.hex("b0")))
    lines = state.groupBy(B.range_block(F.col("node"), 32).alias("b")).agg(F.concat(F.lit("s"), F.array_join(F.array_sort(F.collect_list(item)), " ")).alias("line"))
    parsed = lines.select("b", text.parse_state_block(F.col("line")).alias("s")).select("b", "s.role", F.explode("s.items").alias("x"))
    return parsed.select("role", (F.col("b").cast("bigint") * 32 + F.col("x.row")).alias("node"), F.conv("x.mask", 16, 10).cast("bigint").alias("mask"))


@query
def grid_partition(spark, sf_dir):
    """Where the grid partitioners put the blocks of an 8 x 8 grid on 12 partitions, and the column partitioner the entries of each column."""
    m = B.mod_matrix(_matrix(spark, sf_dir), 8, 8)
    part = F.spark_partition_id().alias("part")
    ways = {"rows": B.by_grid(m, 12, 8), "columns": B.by_grid(m, 12, 8, column_major=True), "column": B.by_column(m, 12)}
    return functools.reduce(DataFrame.unionByName, [d.select(F.lit(w).alias("way"), "brow", "bcol", part).groupBy("way", "brow", "bcol", "part").agg(F.count(F.lit(1)).alias("n")) for w, d in ways.items()])


@query
def sparse_matrix_gen(spark, sf_dir):
    return generators.sparse_matrix(spark, 200, 100, 0.02)


@query
def expand_adjacency(spark, sf_dir):
    e, nodes = _graph(spark, sf_dir)
    return generators.expand_adjacency(e, 1, 2, nodes.count())


@query
def counter_text(spark, sf_dir):
    return generators.counter_lines(spark, 5000)


@query
def dense_matrix_gen(spark, sf_dir):
    d = generators.dense_blocks(spark, "A", 3, 10, 10).unionByName(generators.dense_blocks(spark, "B", 4, 10, 10))
    return d.select("side", "blk", "r", F.size("vec").alias("cols"), F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query
def initial_ranks(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    return generators.initial_ranks(nodes, nodes.count())


@query
def initial_rank_blocks(spark, sf_dir):
    """First ranks as blocks of 16 neighbours, and as 7 blocks by remainder: blocks, entries and ids of each form, unfolded again."""
    nodes = part_nodes(spark, sf_dir)
    ranks = generators.initial_ranks(nodes, nodes.count()).withColumnRenamed("rank", "v")
    forms = {"range": (B.vector_blocks(ranks, 16), lambda b: B.unfold(b, 16)), "mod": (B.mod_vector_blocks(ranks, 7), lambda b: B.unfold_mod(b, 7))}
    sums = [back(b).agg(F.count(F.lit(1)).alias("n"), F.sum("node").alias("ids"), F.round(F.sum("v"), 6).alias("total")).withColumns({"form": F.lit(f), "largest": F.lit(None).cast("bigint")}) for f, (b, back) in forms.items()]
    sizes = [b.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("ids"), F.max(F.size("items")).cast("bigint").alias("largest")).withColumns({"form": F.lit(f"{f} blocks"), "total": F.lit(0.0)}) for f, (b, _) in forms.items()]
    every = [d.select("form", "n", "ids", "total", F.coalesce("largest", F.lit(0)).cast("bigint").alias("largest")) for d in sums + sizes]
    return functools.reduce(DataFrame.unionByName, every)


@query
def random_byte_series(spark, sf_dir):
    return generators.random_bytes(spark, 4096)


@query
def split_generator(spark, sf_dir):
    return generators.splits(spark, "/data/input0", 10240, 128, 0.1)


@query
def index_manifest(spark, sf_dir):
    """Byte ranges of an indexed text file of customer names, filed under their nation, one file per segment."""
    c = table(spark, sf_dir, "customer")
    rows = manifest.text_manifest(c, F.col("c_nationkey").cast("string"), F.col("c_name"), F.col("c_mktsegment"), [F.col("c_custkey")])
    return rows.groupBy("index", "path").agg(F.count(F.lit(1)).alias("n_segments"), F.sum("len").alias("bytes"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


def _indexed(spark, sf_dir, **options):
    """Customer names filed under their nation: an indexed file of each of four partitions, in the shared folder."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("k"), F.col("c_name").alias("v"), "c_custkey")
    path = new_path(spark, "indexed")
    return path, manifest.write_indexed(c.repartition(4, "c_custkey"), "k", "v", path, **options)


def _read_back(read: DataFrame) -> DataFrame:
    """Segments and bytes of each index entry, and a sum over the digests of what was read."""
    digest = F.conv(F.substr(F.md5("data"), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return read.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("data")).alias("bytes"), F.sum(digest).alias("digests"))


@query
def indexed_text_roundtrip(spark, sf_dir):
    """Names written with newlines into indexed files, and every segment read back by its byte range."""
    return _read_back(manifest.read_segments(_indexed(spark, sf_dir)[1]))


@query
def indexed_bytes_roundtrip(spark, sf_dir):
    """The same as raw bytes, each record packed by itself."""
    return _read_back(manifest.read_segments(_indexed(spark, sf_dir, newline=False, codec="zstd")[1], codec="zstd"))


@query
def indexed_source(spark, sf_dir):
    """The same files through the registered data source."""
    path, _ = _indexed(spark, sf_dir)
    spark.dataSource.register(manifest.IndexedSource)
    return _read_back(spark.read.format("indexed").load(path).withColumnRenamed("value", "data"))


@query
def indexed_sink(spark, sf_dir):
    """Names written through the data source, and read again through it with a filter on the index."""
    spark.dataSource.register(manifest.IndexedSource)
    path = new_path(spark, "sink")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("index"), F.col("c_name").cast("binary").alias("value"))
    c.write.format("indexed").mode("append").save(path)
    return _read_back(spark.read.format("indexed").load(path).filter("index in ('3', '7', '11')").withColumnRenamed("value", "data"))


@query
def index_file_scan(spark, sf_dir):
    """Binary index files, an entry for each nation with a byte range for each of its customers, scanned as a manifest. The files are made of
    the fixed marks, a length byte and big-endian numbers."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", (F.col("c_custkey") * 10).alias("off"), F.octet_length("c_name").cast("bigint").alias("len"))
    eight = lambda x: F.lpad(F.hex(x), 16, "0")
    mark = lambda m: F.hex(F.lit(m).cast("binary"))
    name = F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))
    ranges = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("off", "len"))), lambda s: F.concat(mark("#SEG#"), eight(s["off"]), eight(s["len"]))), "")
    entry = c.groupBy("c_nationkey").agg(ranges.alias("ranges")).select(F.lit("/data/part.idx").alias("path"), F.unhex(F.concat(mark("#IDX#"), F.lpad(F.hex(F.octet_length(name)), 2, "0"), F.hex(name.cast("binary")), "ranges", mark("#IDX#"))).alias("content"))
    found = manifest.scan_index_files(entry, ".idx").select("index", F.explode("segments").alias("s"))
    return found.groupBy("index").agg(F.count(F.lit(1)).alias("n"), F.sum("s.off").alias("offs"), F.sum("s.len").alias("bytes"))


@query
def file_name_index(spark, sf_dir):
    """Each file as one index entry with one segment, the whole file."""
    path, _ = _indexed(spark, sf_dir)
    return manifest.file_index(spark, path, "part-*").select("index", F.explode("segments").alias("s")).agg(F.count_distinct("index").alias("files"), F.sum("s.off").alias("offs"), F.sum("s.len").alias("bytes"))


@query
def pair_plan(spark, sf_dir):
    """Pairs of nations' entries, planned from the manifest without reading data: one manifest with itself, each pair once."""
    one = _indexed(spark, sf_dir)[1].groupBy("index").agg(F.flatten(F.collect_list("segments")).alias("segments"), F.min("path").alias("path"))
    plan = manifest.plan_pairs(one, mode="half", on=lambda a, b: a["l_index"].cast("int") % 5 == b["r_index"].cast("int") % 5)
    return plan.select("l_index", "r_index", "l_bytes", "r_bytes", (F.size("l_segments") + F.size("r_segments")).cast("bigint").alias("segments"))


@query
def pair_index_strings(spark, sf_dir):
    """Index strings of matrix blocks meet those of vector blocks; malformed ones among them meet nothing."""
    n = table(spark, sf_dir, "nation")
    key, reg = F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")
    forms = [F.concat_ws("\t", F.lit("edge"), key, reg), F.concat_ws("\t", F.lit("edge"), key), F.concat_ws("\t", F.lit("edge"), F.lit("x"), reg), F.concat_ws("\t", F.lit("other"), key, reg)]
    left = n.select(F.explode(F.array(*forms)).alias("index"))
    right = n.select(F.explode(F.array(F.concat_ws("\t", F.lit("node"), reg), F.concat_ws("\t", F.lit("node"), reg, F.lit("1")), F.lit("node\tx"))).alias("index")).distinct()
    return pairjoin.pair_join(left, right, manifest.block_meets)


@query
def bandwidth_files(spark, sf_dir):
    """Bytes read from every file, and whether each reader's time was taken; the bandwidth itself differs from run to run."""
    found = manifest.bandwidth(manifest.read_segments(_indexed(spark, sf_dir)[1]))
    return found.select("segments", "bytes", (F.col("ms") > 0).alias("timed"), (F.col("mb_per_s") > 0).alias("rated"))


@query
def bandwidth_pairs(spark, sf_dir):
    """Two segments for each pair of entries of one nation residue, read and counted without any other output."""
    one = _indexed(spark, sf_dir)[1]
    plan = manifest.plan_pairs(one.filter("index = '0' or index = '5'"), mode="half")
    sides = plan.select(F.explode(F.array(*[F.struct(F.col(f"{x}_index").alias("index"), F.col(f"{x}_path").alias("path"), F.col(f"{x}_segments").alias("segments")) for x in "lr"])).alias("x")).select("x.*")
    return manifest.bandwidth(manifest.read_segments(sides), ["index"]).select("index", (F.col("bytes") > 0).alias("read"), (F.col("ms") > 0).alias("timed"))


@query
def plain_text_export(spark, sf_dir):
    """Vector blocks unfolded to `node TAB value` lines, written as text, and the lines scanned again."""
    path = new_path(spark, "plain")
    text.plain_text(B.unfold(B.vector_blocks(_vector(spark, sf_dir), 16), 16), path)
    parts = F.split("value", "\t", -1)
    return spark.read.text(path).select(parts[0].cast("bigint").alias("node"), parts[1].cast("double").alias("v"))


@query
def binary_pairs_roundtrip(spark, sf_dir):
    """Vector blocks and matrix blocks in one file of binary keys and values, told apart by the size of the key."""
    vec = B.vector_blocks(_vector(spark, sf_dir), 64)
    mat = B.packed(B.range_matrix(_matrix(spark, sf_dir), 256))
    four = lambda c: F.lpad(F.hex(F.col(c).cast("bigint")), 8, "0")
    pairs = vec.select(F.unhex(four("b")).alias("key"), codec.pack_vector(F.col("items")).alias("value")).unionByName(mat.select(F.unhex(F.concat(four("brow"), four("bcol"))).alias("key"), codec.pack_matrix(F.col("entries")).alias("value")))
    path = new_path(spark, "pairs")
    sequence.write_pairs(pairs, path)
    back = sequence.read_pairs(spark, path)
    v = sequence.vector_blocks(back).select(F.lit("vector").alias("kind"), "b", F.explode("items").alias("x")).groupBy("kind", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.v"), 6).alias("total"))
    m = sequence.matrix_blocks(back).select(F.lit("matrix").alias("kind"), F.col("brow").alias("b"), F.explode("entries").alias("x")).groupBy("kind", "b").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x.val"), 6).alias("total"))
    return v.unionByName(m)


@query
def generated_by_name(spark, sf_dir):
    """A generator picked from the registry by its name."""
    return generators.REGISTRY["splits"](spark, "/data/input1", 5000, 100, 0.2)


# Projections, degrees, counts


@query
def transition_matrix(spark, sf_dir):
    return rounded(graph.transition_matrix(co_purchase(spark, sf_dir)), "p", 12)


@query
def out_degree(spark, sf_dir):
    return graph.out_degree(co_purchase(spark, sf_dir))


@query
def symmetric_edges(spark, sf_dir):
    return graph.symmetric(co_purchase(spark, sf_dir))


@query
def neighbour_sets(spark, sf_dir):
    e, nodes = _graph(spark, sf_dir)
    return graph.neighbour_sets(e, nodes).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("sum_other"))


@query
def dangling_nodes(spark, sf_dir):
    return graph.dangling(*_graph(spark, sf_dir))


@query
def words_counted(spark, sf_dir):
    return word_count(table(spark, sf_dir, "documents"))


@query
def udtf_tokens(spark, sf_dir):
    """Tokens with their places, by a lateral table function, over conversation turns."""
    table(spark, sf_dir, "conversations").createOrReplaceTempView("gridspan_conversations")
    return spark.sql(f"select word, count(*) as n, sum(pos) as places from gridspan_conversations, {PLACED.format('text')} where word <> '' group by word")


@query
def collected_values(spark, sf_dir):
    """Values of a group as one sorted list."""
    return co_purchase(spark, sf_dir).groupBy("src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), ",").alias("dsts"))


# PageRank


@query
def pagerank_step(spark, sf_dir):
    return rounded(_ranks(spark, sf_dir, fixed_iterations=1))


@query
def pagerank_10(spark, sf_dir):
    return rounded(_ranks(spark, sf_dir))


@query
def pagerank_range_block(spark, sf_dir):
    return rounded(_ranks(spark, sf_dir, "range_block"))


@query
def pagerank_mod_block(spark, sf_dir):
    return rounded(_ranks(spark, sf_dir, "mod_block"))


@query
def pagerank_rect_block(spark, sf_dir):
    return rounded(_ranks(spark, sf_dir, "rect_block", row_blocks=4, col_blocks=3))


@query
def pagerank_sub_grid(spark, sf_dir):
    """Only the first 2 x 2 blocks of a 4 x 3 grid take part. Sevenths are never halfway between two roundings."""
    ranks = _ranks(spark, sf_dir, "rect_block", row_blocks=4, col_blocks=3, grid=(2, 2), fixed_iterations=5)
    return ranks.select("node", F.round(F.col("rank") / 7, 12).alias("rank_7th"))


@query
def pagerank_secondary_sort(spark, sf_dir):
    return rounded(_ranks(spark, sf_dir, "secondary_sort"))


@query
def pagerank_converged(spark, sf_dir):
    """Until no rank moves by more than 1e-4."""
    e, nodes = _graph(spark, sf_dir)
    return rounded(pagerank.pagerank(e, nodes, ALPHA, tol=1e-4))


@query
def convergence_test(spark, sf_dir):
    """(moved, converged): the largest move of the tenth iteration against the threshold 1e-6."""
    e, nodes = _graph(spark, sf_dir)
    before = pagerank.pagerank(e, nodes, ALPHA, fixed_iterations=9)
    after = pagerank.pagerank(e, nodes, ALPHA, fixed_iterations=1, resume=before)
    both = before.withColumnRenamed("rank", "old").join(after, "node")
    return both.agg(F.round(F.max(F.abs(F.col("old") - F.col("rank"))), 10).alias("moved")).withColumn("converged", F.col("moved") <= 1e-6)


@query
def rank_min_max(spark, sf_dir):
    r = pagerank.rank_min_max(_ranks(spark, sf_dir))
    return rounded(rounded(r, "min_rank"), "max_rank")


@query
def rank_histogram(spark, sf_dir):
    return pagerank.rank_histogram(rounded(_ranks(spark, sf_dir)), 1000)


@query
def rank_top(spark, sf_dir):
    """The ten nodes of the highest rank (a top-k report)."""
    return rounded(_ranks(spark, sf_dir)).orderBy(F.desc("rank"), "node").limit(10)


# Blocks and products


@query
def block_assign_mod(spark, sf_dir):
    return B.mod_matrix(_matrix(spark, sf_dir), 4, 4).groupBy("brow", "bcol").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


@query
def block_assign_range(spark, sf_dir):
    return B.range_matrix(_matrix(spark, sf_dir), 16).groupBy("brow", "bcol").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r"), F.sum("c").alias("sum_c"))


@query
def block_sizes(spark, sf_dir):
    n = part_nodes(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    return n.select("n", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("b")).select("b", B.block_size(F.col("n"), 7, F.col("b")).cast("bigint").alias("size"))


@query
def block_pack_roundtrip(spark, sf_dir):
    """Blocks packed to one row each, through the binary records and back, counted per block."""
    blocks = B.packed(B.range_matrix(_matrix(spark, sf_dir), 64))
    back = blocks.select("brow", "bcol", codec.unpack_matrix(codec.pack_matrix(F.col("entries"))).alias("entries"))
    return B.unpacked(back).groupBy("brow", "bcol").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("val"), 9).alias("total"))


@query
def vector_pack_roundtrip(spark, sf_dir):
    blocks = B.vector_blocks(_vector(spark, sf_dir), 32)
    return B.unfold(blocks.select("b", codec.unpack_vector(codec.pack_vector(F.col("items"))).alias("items")), 32)


@query
def gimv_sum(spark, sf_dir):
    return rounded(semiring.gimv_sum(_matrix(spark, sf_dir), _vector(spark, sf_dir)), "v", 6)


@query
def gimv_min(spark, sf_dir):
    nodes = part_nodes(spark, sf_dir)
    return semiring.gimv_min(_matrix(spark, sf_dir), nodes.withColumn("v", F.col("node")), include_self=True)


@query
def gimv_min_fixpoint(spark, sf_dir):
    return semiring.min_labels(*_graph(spark, sf_dir))


@query
def gimv_or(spark, sf_dir):
    e, nodes = _graph(spark, sf_dir)
    state = radius.init_state(nodes, 2)
    return semiring.gimv_or(e.select(F.col("src").alias("row"), F.col("dst").alias("col")), state, ["b0", "b1"])


@query
def gimv_bits(spark, sf_dir):
    """A 16 x 16 bit matrix from two md5 digests of each supplier, times the balances of its block of 16 suppliers."""
    s = table(spark, sf_dir, "supplier")
    bits = F.unhex(F.concat(*[F.md5(F.concat(F.col("s_suppkey").cast("string"), F.lit(f"-{i}")).cast("binary")) for i in (0, 1)]))
    blocks = s.select(F.col("s_suppkey").alias("brow"), B.range_block(F.col("s_suppkey"), 16).alias("bcol"), bits.alias("bits"))
    vec = s.select(B.range_block(F.col("s_suppkey"), 16).alias("b"), B.range_index(F.col("s_suppkey"), 16).alias("i"), F.col("s_acctbal").alias("v"))
    return rounded(semiring.gimv_bits(blocks, vec, 16), "v", 4)


@query
def diag_scale(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return rounded(semiring.diag_scale(p.select(F.col("p_partkey").alias("node"), (F.col("p_size") - 1).cast("double").alias("d")), _vector(spark, sf_dir)), "v", 8)


@query
def matmul_blocks(spark, sf_dir):
    return dense.matmul(*_vectors(spark, sf_dir), "pair", digits=6)


@query
def matmul_broadcast(spark, sf_dir):
    return dense.matmul(*_vectors(spark, sf_dir), "broadcast", digits=6)


@query
def matmul_folders(spark, sf_dir):
    """The products written in a folder for each pair of blocks, and read again."""
    path = new_path(spark, "products")
    dense.write_products(*_vectors(spark, sf_dir), path, digits=6)
    return spark.read.schema("r bigint, c bigint, v double, i int, j int").parquet(path).groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("v"), 3).alias("total"))


def _vectors(spark, sf_dir):
    """Vectors in blocks of 250 rows, to be multiplied by themselves."""
    e = table(spark, sf_dir, "embeddings")
    block = B.range_block(F.col("vec_id"), 250)
    a = e.select(block.alias("i"), F.col("vec_id").alias("r"), F.col("embedding").alias("vec"))
    b = e.select(block.alias("j"), F.col("vec_id").alias("c"), F.col("embedding").alias("vec"))
    return a, b


@query
def sliding_dot(spark, sf_dir):
    """Nations' keys as the query, events' values as the series."""
    q = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), (F.col("n_regionkey") * 7 - 13).alias("val"))
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("value").cast("int").alias("val"))
    return dense.sliding_dot(q, e, q.count(), e.count(), 16)


# Pairs


def _entries(spark, sf_dir):
    """(id, size, grp): the 200 modulo blocks of parts, as index entries."""
    blocks = table(spark, sf_dir, "part").groupBy(B.mod_block(F.col("p_partkey"), 200).cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("size"))
    return blocks.withColumn("grp", F.col("id") % 16)


def _counted(pairs: DataFrame, key: str | Column = "l_id") -> DataFrame:
    """Partners of each left entry, and the products of block sizes that its pairs stand for."""
    return pairs.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum("r_id").alias("sum_r"), F.sum(F.col("l_size") * F.col("r_size")).alias("work"))


@query
def pair_all(spark, sf_dir):
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("id"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return pairjoin.pair_join(n, r)


@query
def pair_half(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"))
    return pairjoin.pair_join(n, mode="half")


@query
def pair_block_equi(spark, sf_dir):
    """An edge block meets the vector block of its column: pairs of a 4 x 4 grid with the 4 vector blocks."""
    blocks = B.mod_matrix(_matrix(spark, sf_dir), 4, 4).select("brow", "bcol").distinct()
    vec = part_nodes(spark, sf_dir).select(B.mod_block(F.col("node"), 4).alias("b")).distinct()
    return pairjoin.pair_join(blocks, vec, pairjoin.same("bcol", "b"))


@query
def pair_sides(spark, sf_dir):
    """Left entries of side A with right entries of side B."""
    v = _entries(spark, sf_dir).withColumn("side", F.when(F.col("id") % 2 == 0, "A").otherwise("B"))
    return _counted(pairjoin.pair_join(v, v, lambda a, b: (a["l_side"] == "A") & (b["r_side"] == "B") & (a["l_grp"] < b["r_grp"])))


@query
def pair_diag_block(spark, sf_dir):
    v = pairjoin.assign_blocks(_entries(spark, sf_dir).select("id", "size"), 16, "contiguous")
    return _counted(pairjoin.pair_join(v, v, pairjoin.same("grp", "grp")))


@query
def pair_circular_block(spark, sf_dir):
    v = pairjoin.assign_blocks(_entries(spark, sf_dir).select("id", "size"), 16, "circular")
    return _counted(pairjoin.pair_join(v, v, pairjoin.same("grp", "grp")))


@query
def pair_shuffled_block(spark, sf_dir):
    v = pairjoin.assign_blocks(_entries(spark, sf_dir).select("id", "size"), 16, "shuffled")
    return _counted(pairjoin.pair_join(v, v, pairjoin.same("grp", "grp")))


@query
def pair_random(spark, sf_dir):
    v = _entries(spark, sf_dir).select("id", "size")
    return _counted(pairjoin.pair_join(v, v, pairjoin.at_random(0.2)))


def _partners(spark, sf_dir):
    v = _entries(spark, sf_dir).select("id", "size")
    return pairjoin.join_table(pairjoin.pair_join(v, on=pairjoin.at_random(0.2), mode="half"))


@query
def join_table(spark, sf_dir):
    return _partners(spark, sf_dir).groupBy("seg").agg(F.count(F.lit(1)).alias("partners"), F.sum("partner").alias("sum_partner"))


@query
def pair_task_count(spark, sf_dir):
    return pairjoin.task_count(_partners(spark, sf_dir))


@query
def partner_overlap(spark, sf_dir):
    return rounded(pairjoin.partner_overlap(_partners(spark, sf_dir)), "ratio", 9)


@query
def partner_groups(spark, sf_dir):
    """Entries grouped where their partner sets overlap by more than three tenths of the larger one."""
    return pairjoin.partner_groups(_partners(spark, sf_dir), 0.3)


@query
def largest_group(spark, sf_dir):
    """The entry of each group with most partners, the first of equals."""
    p = _partners(spark, sf_dir).groupBy("seg").agg(F.count(F.lit(1)).alias("partners"))
    w = Window.partitionBy(F.col("seg") % 8).orderBy(F.desc("partners"), "seg")
    return p.withColumn("k", F.row_number().over(w)).filter("k = 1").select((F.col("seg") % 8).alias("grp"), "seg", "partners")


# Segments and schedules


def _targets(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 20).cast("string").alias("path"), (F.col("o_orderkey") * 7919 % 1000000).alias("off"), ((1 + F.col("o_orderkey") * 13 % 97) * 5).alias("len"))


def _ranges(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    off = (F.col("l_orderkey") * 104729 + F.col("l_linenumber") * 1299709 + F.col("l_suppkey") * 31) % 1000000
    return x.select((F.col("l_partkey") % 20).cast("string").alias("path"), off.alias("off"), (1 + F.col("l_partkey") * 17 % 97).alias("len"))


@query
def segment_cover(spark, sf_dir):
    return segments.cover(_targets(spark, sf_dir), _ranges(spark, sf_dir))


@query
def segment_cover_batch(spark, sf_dir):
    """Covered bytes of each path's targets, by remaining length."""
    return segments.cover_sorted(_targets(spark, sf_dir), _ranges(spark, sf_dir)).groupBy("path", "remaining").agg(F.count(F.lit(1)).alias("n"))


@query
def cover_hull(spark, sf_dir):
    return segments.cover_hull(order_segments(spark, sf_dir), 64)


@query
def segment_names(spark, sf_dir):
    s = order_segments(spark, sf_dir).select("id", codec.format_segment(F.concat(F.lit("/d/"), F.col("path")), F.col("off"), F.col("len")).alias("name"))
    return s.withColumn("seg", codec.parse_segment(F.col("name"))).select("id", "name", F.col("seg.path").alias("path"), F.col("seg.off").alias("off"), F.col("seg.len").alias("len"))


@query
def segment_order(spark, sf_dir):
    """Rank of each segment within its path, by offset, then length, then id."""
    w = Window.partitionBy("path").orderBy(F.struct("off", "len", "id"))
    return order_segments(spark, sf_dir).select("id", "path", F.row_number().over(w).cast("bigint").alias("place"))


@query
def best_group(spark, sf_dir):
    """The group of targets to run next: by whole covers, and, where those are left out, by what fits half a cache of 4,000 bytes."""
    covered = segments.cover(_targets(spark, sf_dir), _ranges(spark, sf_dir)).withColumn("grp", F.col("id") % 50)
    return segments.choose_group(covered, 4000).unionByName(segments.choose_group(covered.filter("remaining > 0"), 4000))


@query
def segment_lookup(spark, sf_dir):
    """Where each order's shifted segment would stand in its path's sorted list, and whether it is in it."""
    segs = order_segments(spark, sf_dir)
    probes = segs.withColumn("len", F.col("len") + F.col("id") % 2)
    return segments.lookup(segs, probes).select("id", "path", "place", "found")


@query
def segment_cover_lists(spark, sf_dir):
    """For every path, its targets by remaining length: null without targets, empty without ranges."""
    targets = _targets(spark, sf_dir).filter("path <> '3'")
    lists = segments.cover_lists(targets, _ranges(spark, sf_dir).filter("path not in ('3', '4') or off < 500000").filter("path <> '4'"))
    first = F.try_element_at("covered", F.lit(1))
    return lists.select("path", F.coalesce(F.size("covered"), F.lit(-1)).cast("bigint").alias("n"), F.coalesce(first["remaining"], F.lit(-1)).alias("least"), F.col("covered").isNull().alias("none"))


@query
def segment_hosts(spark, sf_dir):
    """Hosts of the blocks that hold a segment's first byte or its end."""
    blocks = spark.range(20).select(F.col("id").alias("p")).crossJoin(spark.range(82).select(F.col("id").alias("block"))).select(F.col("p").cast("string").alias("path"), "block", ((F.col("p") * 7 + F.col("block") * 3) % 11).alias("host"))
    return segments.host_lookup(order_segments(spark, sf_dir), blocks, 64).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def _nation_pairs(spark, sf_dir):
    return pairjoin.pair_join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")), mode="half")


def _trace(spark, sf_dir, side: int):
    return locality.packed_schedule(_nation_pairs(spark, sf_dir), side, side, 3)


@query
def locality_hit_rate(spark, sf_dir):
    """Hits of caches of 8 items when pairs run in packs of 4 x 4."""
    return locality.lru_hits(_trace(spark, sf_dir, 4), 8)


@query
def locality_hit_rate_unpacked(spark, sf_dir):
    return locality.lru_hits(_trace(spark, sf_dir, 1), 8)


def _hosts(spark, sf_dir):
    return locality.replicas(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id")), 3, 2)


@query
def locality_random(spark, sf_dir):
    """Hits of caches of 512 bytes, items of 64, when each pair runs on a worker drawn by hash."""
    tasks = locality.scheduled(_nation_pairs(spark, sf_dir), 3, "random")
    return locality.lru_hits(locality.reads(tasks).withColumn("size", F.lit(64)), 512)


@query
def locality_first(spark, sf_dir):
    """The same when each pair runs where most of its items are, of two replicas each."""
    tasks = locality.scheduled(_nation_pairs(spark, sf_dir), 3, "local", _hosts(spark, sf_dir))
    return locality.lru_hits(locality.reads(tasks).withColumn("size", F.lit(64)), 512)


@query
def local_read_rate(spark, sf_dir):
    """Reads, and those of items that the worker holds, under either scheduler."""
    pairs, hosts = _nation_pairs(spark, sf_dir), _hosts(spark, sf_dir)
    rates = [locality.local_reads(locality.scheduled(pairs, 3, how, hosts), hosts).withColumn("scheduler", F.lit(how)) for how in ("random", "local")]
    return rates[0].unionByName(rates[1])


@query
def task_metadata(spark, sf_dir):
    """What each pack of 4 x 4 pairs reads, and the hosts that hold any of it."""
    tasks = locality.pack_tasks(_nation_pairs(spark, sf_dir), *locality.packs_by_side(4, 4), 3)
    return locality.task_metadata(tasks, _hosts(spark, sf_dir)).select("task", "worker", "pairs", "items", F.size("hosts").cast("bigint").alias("n_hosts"))


@query
def capacity_packs(spark, sf_dir):
    """Packs cut so that their rows and their columns fit half a cache each, over the pairs of the 200 entries."""
    entries = _entries(spark, sf_dir).select("id", "size")
    total = entries.agg(F.sum("size")).first()[0]
    side = locality.packs_by_capacity(entries, total // 4)
    pairs = pairjoin.pair_join(entries.join(side, "id"), mode="half")
    return pairs.groupBy(F.col("l_pack").alias("pr"), F.col("r_pack").alias("pc")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_size") + F.col("r_size")).alias("bytes"))


@query
def scan_bytes(spark, sf_dir):
    """A full read: rows and bytes of the texts."""
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))


# Bit strings, radii, diameters


@query
def fm_init(spark, sf_dir):
    return radius.init_state(part_nodes(spark, sf_dir), K).drop("status")


@query
def fm_hop1(spark, sf_dir):
    e, nodes = _graph(spark, sf_dir)
    return radius.hop(e, radius.init_state(nodes, K), K)


@query
def fm_functions(spark, sf_dir):
    """Least zero positions and hex forms of masks, and their estimate."""
    s = radius.hop(co_purchase(spark, sf_dir), radius.init_state(part_nodes(spark, sf_dir), 2), 2)
    back = sketch.mask_from_hex(sketch.mask_hex(F.col("b0")))
    return s.select("node", sketch.least_zero_pos(F.col("b0")).alias("z0"), sketch.least_zero_pos(F.col("b1")).alias("z1"), sketch.mask_hex(F.col("b0")).alias("hex0"), back.alias("back0"), F.round(sketch.fm_estimate([F.col("b0"), F.col("b1")]), 6).alias("nh"))


def _radii(spark, sf_dir, hops: int | None = HOPS):
    return radius.radii(*_graph(spark, sf_dir), k=K, max_hops=hops)


@query
def nh_curve(spark, sf_dir):
    return rounded(_radii(spark, sf_dir).curve, "nh", 6).select("hop", "nh")


@query
def status_counts(spark, sf_dir):
    return _radii(spark, sf_dir).curve.select("hop", "converged", "changed")


@query
def node_radius(spark, sf_dir):
    return radius.node_radius(_radii(spark, sf_dir).history)


@query
def radius_histogram(spark, sf_dir):
    return radius.radius_histogram(radius.node_radius(_radii(spark, sf_dir).history))


@query
def effective_diameter(spark, sf_dir):
    return rounded(radius.effective_diameter(_radii(spark, sf_dir).curve), "diameter", 6)


@query
def average_diameter(spark, sf_dir):
    return rounded(radius.average_diameter(_radii(spark, sf_dir).curve), "diameter", 6)


@query
def node_radius_block(spark, sf_dir):
    """Radii over matrix blocks of 16 nodes a side, hopping until nothing changes."""
    return radius.node_radius(radius.radii(*_graph(spark, sf_dir), k=K, width=16).history)


# The same, hopping until nothing changes


@query
def nh_curve_converged(spark, sf_dir):
    return rounded(_radii(spark, sf_dir, None).curve, "nh", 6).select("hop", "nh")


@query
def status_counts_converged(spark, sf_dir):
    return _radii(spark, sf_dir, None).curve.select("hop", "converged", "changed")


@query
def node_radius_converged(spark, sf_dir):
    return radius.node_radius(_radii(spark, sf_dir, None).history)


@query
def radius_histogram_converged(spark, sf_dir):
    return radius.radius_histogram(radius.node_radius(_radii(spark, sf_dir, None).history))


@query
def effective_diameter_converged(spark, sf_dir):
    return rounded(radius.effective_diameter(_radii(spark, sf_dir, None).curve), "diameter", 6)


@query
def average_diameter_converged(spark, sf_dir):
    return rounded(radius.average_diameter(_radii(spark, sf_dir, None).curve), "diameter", 6)


@query
def nh_exact(spark, sf_dir):
    return radius.nh_exact(*_graph(spark, sf_dir), hops=4)


@query
def bitshuffle_roundtrip(spark, sf_dir):
    """Masks after one hop, coded as run lengths over bit planes and decoded again."""
    s = radius.hop(co_purchase(spark, sf_dir), radius.init_state(part_nodes(spark, sf_dir), 4), 4)
    coded = s.select("node", codec.encode_masks(F.array("b0", "b1", "b2", "b3")).alias("code"))
    back = coded.withColumn("m", codec.decode_masks(F.col("code"), F.lit(4)))
    return back.select("node", *[F.get("m", i).alias(f"b{i}") for i in range(4)])
