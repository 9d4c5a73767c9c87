"""Hand-worked graphs, differential and round-trip tests."""

import math
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.functions import codec
from gridspan.functions.codec import decode_planes, encode_planes
from gridspan.functions.sketch import least_zero_pos
from gridspan.operators import blocks as B
from gridspan.operators import dense, keys, pairjoin, segments
from gridspan.plans import locality, radius, semiring
from gridspan.plans.pagerank import STRATEGIES, pagerank, rank_histogram
from gridspan.sources import generators, manifest, text

EDGES = [(0, 1), (0, 2), (1, 2), (2, 0), (3, 2)]


@pytest.fixture(scope="module")
def graph(spark):
    return spark.createDataFrame(EDGES, "src long, dst long"), spark.range(5).withColumnRenamed("id", "node")


def values(df, key, col):
    return {r[key]: r[col] for r in df.collect()}


@pytest.mark.parametrize("strategy", STRATEGIES)
def test_hand_worked_ranks(graph, strategy):
    want = [{0: 0.2, 1: 0.115, 2: 0.455, 3: 0.03, 4: 0.03}, {0: 0.41675, 1: 0.115, 2: 0.23825, 3: 0.03, 4: 0.03}, {0: 0.2325125, 1: 0.20711875, 2: 0.33036875, 3: 0.03, 4: 0.03}]
    for i, w in enumerate(want, 1):
        got = values(pagerank(*graph, strategy=strategy, fixed_iterations=i, row_blocks=2, col_blocks=3, width=2), "node", "rank")
        assert got == pytest.approx(w)


def test_converged_ranks_agree_and_resume(graph):
    full = values(pagerank(*graph, tol=1e-10), "node", "rank")
    half = pagerank(*graph, fixed_iterations=7)
    assert values(pagerank(*graph, tol=1e-10, resume=half), "node", "rank") == pytest.approx(full, abs=1e-9)


def test_mass_is_kept_without_dangling_nodes(spark):
    e = spark.createDataFrame([(i, (i * 3 + 1) % 7) for i in range(7)], "src long, dst long")
    total = pagerank(e, spark.range(7).withColumnRenamed("id", "node"), fixed_iterations=6).agg(F.sum("rank")).first()[0]
    assert total == pytest.approx(1.0)


def test_equal_ranks_fall_in_the_first_bin(spark):
    r = spark.range(4).select(F.col("id").alias("node"), F.lit(0.25).alias("rank"))
    assert [tuple(x) for x in rank_histogram(r).collect()] == [(1, 4)]


def test_exact_neighbourhood_and_diameters(spark, graph):
    assert [r["n"] for r in radius.nh_exact(*graph, hops=4).orderBy("hop").collect()] == [5, 10, 13, 14, 14]
    curve = spark.createDataFrame([(0, 5.0), (1, 10.0), (2, 13.0), (3, 14.0)], "hop int, nh double")
    assert radius.effective_diameter(curve).first()[0] == pytest.approx(1.8666667)
    assert radius.average_diameter(curve).first()[0] == pytest.approx(1.5555556)


def test_radii_converge_and_grow(graph):
    r = radius.radii(*graph, k=16, max_hops=20)
    rows = r.curve.orderBy("hop").collect()
    assert rows[-1]["changed"] == 0
    nh = [x["nh"] for x in rows[1:]]
    assert nh == sorted(nh)
    assert {x["status"] for x in r.state.collect()} <= {"c", "f"}
    found = {x["node"]: x for x in radius.node_radius(r.history).collect()}
    assert found[4]["max_radius"] == 0
    assert all(0 <= x["eff_radius"] <= x["max_radius"] for x in found.values())


def test_radii_resume(graph):
    whole = radius.radii(*graph, k=8, max_hops=3)
    one = radius.radii(*graph, k=8, max_hops=1)
    rest = radius.radii(*graph, k=8, max_hops=3, resume=(one.state, 1))
    assert sorted(map(tuple, rest.state.collect())) == sorted(map(tuple, whole.state.collect()))


def test_least_zero_positions(spark):
    df = spark.createDataFrame([(0,), (0x80000000,), (0xC0000000,), (0xFFFFFFFF,)], "m long")
    assert [r[0] for r in df.select(least_zero_pos(F.col("m"))).collect()] == [0, 1, 2, 32]


def test_plane_codec_by_hand():
    assert encode_planes([0x80000000, 0x40000000]) == "818281bc"
    assert decode_planes("818281bc", 2) == [0x80000000, 0x40000000]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=40))
def test_plane_codec_round_trip(masks):
    assert decode_planes(encode_planes(masks), len(masks)) == masks


def test_plane_codec_over_columns():
    """Whole columns, null and empty lists among them, against the coding of one list at a time."""
    rng = random.Random(1)
    words = [0, 2**32 - 1, 0x80000000, 0xFFF00000]
    lists = [None if rng.random() < 0.1 else [rng.choice([*words, rng.getrandbits(32)]) for _ in range(rng.choice([0, 1, 2, 8, 40]))] for _ in range(300)]
    coded = codec.encode_masks.func(pa.array(lists, pa.list_(pa.int64())))
    assert coded.to_pylist() == [None if m is None else encode_planes(m) if m else "" for m in lists]
    assert codec.decode_masks.func(coded, pa.array([len(m or []) for m in lists], pa.int32())).to_pylist() == lists
    assert codec.decode_masks.func(pa.array(["81"]), pa.array([2], pa.int32())).to_pylist() == [decode_planes("81", 2)]


def test_records_over_columns():
    kind = pa.list_(pa.struct([("i", pa.int32()), ("v", pa.float64())]))
    items = pa.array([None, [], [{"i": 1, "v": 0.5}, {"i": -3, "v": 2.0}]] * 3, kind)
    for column in (items, items.slice(2, 4)):
        raw = codec.pack_vector.func(column)
        assert [None if b is None else len(b) for b in raw.to_pylist()] == [None if x is None else 12 * len(x) for x in column.to_pylist()]
        assert codec.unpack_vector.func(raw).to_pylist() == column.to_pylist()


def test_a_cache_in_bytes_and_schedulers(spark):
    trace = spark.createDataFrame([(0, i, x, s) for i, (x, s) in enumerate([("a", 6), ("b", 4), ("a", 6), ("big", 11), ("c", 3), ("a", 6), ("b", 4)])], "worker long, step long, item string, size long")
    assert values(locality.lru_hits(trace, 10), "worker", "hits") == {0: 2}
    hosts = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "item long, host long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 1), (8, 9)], "l_id long, r_id long")
    tasks = {(r["l_id"], r["r_id"]): r["worker"] for r in locality.scheduled(pairs, 4, "local", hosts).collect()}
    assert (tasks[1, 2], tasks[2, 3], tasks[1, 1]) == (0, 1, 0) and 0 <= tasks[8, 9] < 4
    with pytest.raises(ValueError, match="other"):
        locality.scheduled(pairs, 4, "other")


def test_indexed_files_with_a_codec(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one " * 100), ("b", None), ("a", "two")], "k string, v string").coalesce(1)
    for name in ("zlib", "zstd"):
        m = manifest.write_indexed(rows, "k", "v", f"file://{tmp_path}/{name}", codec=name, flush=2)
        got = manifest.read_segments(m, name)
        assert sorted((r["index"], bytes(r["data"])) for r in got.collect()) == [("a", b"one " * 100 + b"\n"), ("a", b"two\n"), ("b", b"\n")]
        assert max(r["len"] for r in m.select(F.explode("segments").alias("s")).select("s.len").collect()) < 100
    with pytest.raises(ValueError, match="codec"):
        manifest.write_indexed(rows, "k", "v", f"file://{tmp_path}/no", codec="no")


def test_indexed_source_writes_and_takes_filters(spark, tmp_path):
    spark.dataSource.register(manifest.IndexedSource)
    path = f"file://{tmp_path}/sink"
    rows = spark.createDataFrame([(k, f"{k}{i}".encode()) for i in range(50) for k in ("a", "b", None)], "index string, value binary")
    for _ in range(2):
        rows.repartition(3).write.format("indexed").mode("append").save(path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = spark.read.format("indexed").option("filters", "true").load(path)
        assert read.count() == spark.read.format("indexed").load(path).count() == 300 and read.filter("index is null").count() == 100
        got = read.filter("index = 'b'").collect()
        assert sorted(bytes(r["value"]) for r in got) == sorted([f"b{i}".encode() for i in range(50)] * 2)
        assert read.filter("index in ('a', 'c') and off >= 0").count() == 100
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_group_choice(spark):
    kind = "grp long, id long, remaining long"
    rows = [(1, 1, 0), (1, 2, 0), (2, 3, 0), (3, 4, 4), (3, 5, 5), (3, 6, 90), (4, 7, 3), (4, 8, 4), (4, 9, 2)]
    assert [tuple(r) for r in segments.choose_group(spark.createDataFrame(rows, kind), 20).collect()] == [(1, "perfect", 2)]
    assert [tuple(r) for r in segments.choose_group(spark.createDataFrame([r for r in rows if r[2]], kind), 20).collect()] == [(4, "fit", 3)]
    assert segments.choose_group(spark.createDataFrame([(1, 1, 50)], kind), 20).collect() == []


def test_pair_counts(spark):
    v = spark.range(9)
    assert pairjoin.pair_join(v, mode="half").count() == 45
    assert pairjoin.pair_join(v, spark.range(4)).count() == 36
    with pytest.raises(ValueError):
        pairjoin.pair_join(v, mode="third")


def test_block_layouts_cover_all_ids(spark):
    n, blocks = 103, 7
    sizes = values(spark.range(n).groupBy(B.mod_block(F.col("id"), blocks).alias("b")).count(), "b", "count")
    want = spark.range(blocks).select(F.col("id").alias("b"), B.block_size(F.lit(n), blocks, F.col("id")).alias("n"))
    assert values(want, "b", "n") == sizes


def test_packed_blocks_round_trip(spark, graph):
    mat = B.range_matrix(graph[0].select(F.col("dst").alias("row"), F.col("src").alias("col"), F.lit(0.5).alias("val")), 2)
    back = B.unpacked(B.packed(mat))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, mat.select("brow", "bcol", "r", "c", "val").collect()))


def test_coverage_against_byte_sets(spark):
    rng = random.Random(4)
    ranges = [(str(rng.randrange(3)), rng.randrange(3000), rng.randrange(1, 900)) for _ in range(40)]
    targets = [(i, str(rng.randrange(4)), rng.randrange(3000), rng.randrange(0, 2500)) for i in range(60)]
    got = values(segments.cover(spark.createDataFrame(targets, "id long, path string, off long, len long"), spark.createDataFrame(ranges, "path string, off long, len long")), "id", "remaining")
    for i, path, off, size in targets:
        left = set(range(off, off + size))
        for p, o, n in ranges:
            if p == path:
                left -= set(range(o, o + n))
        assert got[i] == len(left)


def test_hulls(spark):
    df = spark.createDataFrame([("a", 5, 10), ("a", 64, 64), ("a", 60, 8)], "path string, off long, len long")
    assert [(r["cover_off"], r["cover_len"]) for r in segments.cover_hull(df, 64).collect()] == [(0, 64), (64, 64), (0, 128)]


def test_matmul_strategies_agree(spark):
    a = generators.dense_blocks(spark, "A", 3, 4, 5).select(F.col("blk").alias("i"), "r", "vec")
    b = generators.dense_blocks(spark, "B", 2, 4, 5).select(F.col("blk").alias("j"), F.col("r").alias("c"), "vec")
    one, two = (sorted(map(tuple, dense.matmul(a, b, s).collect())) for s in ("pair", "broadcast"))
    assert one == two and len(one) == 3 * 4 * 2 * 4


def test_sliding_dot_wraps(spark):
    s = spark.createDataFrame([(i, 100) for i in range(20)], "pos long, val int")
    got = dense.sliding_dot(s.filter("pos < 3"), s, 3, 20, 5).orderBy("step").collect()
    assert [tuple(r) for r in got] == [(i, (30000 + 128) % 256 - 128) for i in range(math.ceil(17 / 5))]


def test_sparse_rows_never_dangle(spark):
    m = generators.sparse_matrix(spark, 50, 20, 0.01)
    assert m.select("row").distinct().count() == 50


def test_counter_text_faults(spark):
    good = generators.counter_lines(spark, 20)
    assert generators.counter_errors(good).count() == 0
    assert generators.counter_errors(good.replace("000000000000016", "x")).count() == 2


def test_splits_fill_the_range(spark):
    rows = generators.splits(spark, "p", 1000, 64, 0.2).orderBy("off").collect()
    at = 0
    for r in rows:
        assert r["off"] == at and r["len"] > 0
        at += r["len"]
    assert at == 1000


def test_min_labels(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (5, 6)], "src long, dst long")
    got = values(semiring.min_labels(e, spark.range(8).withColumnRenamed("id", "node")), "node", "v")
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_min_labels_of_long_chains(spark):
    """Five hundred hops, and a star: one label each, in a number of rounds that has no limit."""
    e = spark.range(500).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.range(1, 300).select(F.lit(1000).cast("long").alias("src"), (F.col("id") + 1000).alias("dst")))
    got = values(semiring.min_labels(e, spark.range(1300).withColumnRenamed("id", "node")), "node", "v")
    assert all(got[i] == 0 for i in range(501)) and all(got[i] == i for i in range(501, 1000)) and all(got[i] == 1000 for i in range(1000, 1300))


def test_bit_blocks_against_plain_sums(spark):
    rng = random.Random(3)
    for width in (4, 8, 12, 16):
        size = -(-width * width // 8)
        raw = [(b, b % 3, bytes(rng.randrange(256) for _ in range(size))) for b in range(9)]
        vec = [(b, i, rng.randrange(-9, 10) * 1.0) for b in range(3) for i in range(width)]
        got = {(r["b"], r["i"]): r["v"] for r in semiring.gimv_bits(spark.createDataFrame([(b, c, bytearray(x)) for b, c, x in raw], "brow long, bcol long, bits binary"), spark.createDataFrame(vec, "b long, i int, v double"), width).collect()}
        value = {(b, i): v for b, i, v in vec}
        want = {(b, r): sum(value[c, k] for k in range(width) if x[(r * width + k) // 8] >> (r * width + k) % 8 & 1) for b, c, x in raw for r in range(width)}
        assert got == {k: v for k, v in want.items() if v}


def test_ranks_without_a_global_window(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(50), None if i % 9 == 0 else "x" * (i % 3)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a long, place string")
    got = keys.ranked(df, [F.col("a"), F.col("id")], "rank", 7).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert sorted(r["rank"] for r in got) == list(range(400)) and keys.ranked(df.limit(0), [F.col("a")], "rank").collect() == []
    for how, n in (("contiguous", 7), ("shuffled", 7), ("circular", 7), ("contiguous", 500)):
        size = sorted(values(pairjoin.assign_blocks(df.select("id"), n, how).groupBy("grp").count(), "grp", "count").values())
        assert sum(size) == 400 and size[-1] - size[0] <= 1


def test_bins_follow_the_lengths(spark):
    targets = spark.createDataFrame([(1, "p", 0, 10**12)], "id long, path string, off long, len long")
    ranges = spark.createDataFrame([("p", 5 * 10**11, 10**11), ("p", 0, 7)], "path string, off long, len long")
    assert values(segments.cover(targets, ranges), "id", "remaining") == {1: 9 * 10**11 - 7}


def test_lru_against_a_simulation(spark):
    from collections import OrderedDict

    rng = random.Random(2)
    trace = [(w, i, f"x{rng.randrange(9)}") for w in range(3) for i in range(80)]
    got = values(locality.lru_hits(spark.createDataFrame(trace, "worker long, step long, item string"), 4), "worker", "hits")
    for w in range(3):
        cache, hits = OrderedDict(), 0
        for _, _, x in [t for t in trace if t[0] == w]:
            hits += x in cache
            cache[x] = 1
            cache.move_to_end(x)
            if len(cache) > 4:
                cache.popitem(last=False)
        assert got[w] == hits


def test_text_forms(spark):
    lines = spark.createDataFrame([("# a\tb",), ("1\t2",), ("3\t4\tvec",), ("5",), ("7\t0.5\tvec",)], "value string")
    assert [tuple(r) for r in text.edge_lines(lines).collect()] == [(1, 2)]
    assert [tuple(r) for r in text.vector_lines(lines).collect()] == [(3, 4.0), (7, 0.5)]
    row = spark.range(1).select(text.parse_state_block(F.lit("s0 8f 2 1a")).alias("s"), text.parse_matrix_block(F.lit("1 2 3 4"), values=False).alias("m"), text.parse_vector_block(F.lit("")).alias("v")).first()
    assert row["s"]["role"] == "s" and [(x["row"], x["mask"]) for x in row["s"]["items"]] == [(0, "8f"), (2, "1a")]
    assert [(x["row"], x["col"], x["val"]) for x in row["m"]] == [(2, 1, 1.0), (4, 3, 1.0)] and row["v"] == []


def test_indexed_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("b", "two"), ("a", "three"), (None, None), ("c", None)], "k string, v string")
    path = f"file://{tmp_path}/indexed"
    m = manifest.write_indexed(rows.coalesce(2), "k", "v", path)
    got = sorted((r["index"], bytes(r["data"])) for r in manifest.read_segments(m).collect())
    assert got == [("a", b"one\n"), ("a", b"three\n"), ("b", b"two\n"), ("c", b"\n")]
    spark.dataSource.register(manifest.IndexedSource)
    again = sorted((r["index"], bytes(r["value"])) for r in spark.read.format("indexed").load(path).collect())
    assert again == got
    assert manifest.file_index(spark, path, "part-*").count() >= 1


def test_binary_index_files(spark, tmp_path):
    def entry(index, ranges):
        name = index.encode()
        size = bytes([len(name)]) if len(name) < 128 else bytes([0x8F, len(name)])
        return b"#IDX#" + size + name + b"".join(b"#SEG#" + o.to_bytes(8, "big") + n.to_bytes(8, "big") for o, n in ranges) + b"#IDX#"

    data = entry("edge\t0\t1", [(0, 32), (64, 16)]) + entry("n" * 200, [])
    assert manifest.parse_index(data) == [("edge\t0\t1", [(0, 32), (64, 16)]), ("n" * 200, [])]
    assert manifest.parse_index(data + b"#IDX#\x03ab") == manifest.parse_index(data)
    with pytest.raises(ValueError, match="no entry"):
        manifest.parse_index(b"#XXX#")
    (tmp_path / "a.idx").write_bytes(data)
    (tmp_path / "a").write_bytes(b"x")
    got = manifest.read_index_files(spark, str(tmp_path), ".idx").collect()
    assert sorted(len(r["segments"]) for r in got) == [0, 2] and all(r["path"].endswith("/a") for r in got)


def test_binary_pairs_round_trip(spark, tmp_path):
    from gridspan.sources import sequence

    items = spark.createDataFrame([(bytes(4), [(1, 0.5)]), (b"\xff" * 4, [(2, 1.5), (3, 2.5)])], "key binary, items array<struct<i:int,v:double>>")
    cells = spark.createDataFrame([(b"\0\0\0\1\0\0\0\2", [(1, 2, 0.25)])], "key binary, entries array<struct<row:int,col:int,val:double>>")
    pairs = items.select("key", codec.pack_vector("items").alias("value")).unionByName(cells.select("key", codec.pack_matrix("entries").alias("value")))
    sequence.write_pairs(pairs, f"{tmp_path}/pairs")
    back = sequence.read_pairs(spark, f"{tmp_path}/pairs")
    assert {r["b"]: [tuple(x) for x in r["items"]] for r in sequence.vector_blocks(back).collect()} == {0: [(1, 0.5)], -1: [(2, 1.5), (3, 2.5)]}
    assert [(r["brow"], r["bcol"], [tuple(x) for x in r["entries"]]) for r in sequence.matrix_blocks(back).collect()] == [(1, 2, [(1, 2, 0.25)])]


def test_streams(spark, tmp_path):
    from gridspan.streaming.words import streaming_word_count

    spark.createDataFrame([("a b a",), ("b\tc",)], "text string").write.parquet(f"{tmp_path}/in")
    stream = streaming_word_count(spark.readStream.schema("text string").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("gridspan_words").start()
    q.processAllAvailable()
    q.stop()
    assert values(spark.table("gridspan_words"), "word", "n") == {"a": 2, "b": 2, "c": 1}


def test_window_counts_over_a_stream(spark, tmp_path):
    from gridspan.streaming.words import windowed_counts

    rows = [(f"2024-01-01 00:0{m}:00", kind) for m, kind in ((1, "a"), (2, "a"), (2, "b"), (7, "a"))]
    spark.createDataFrame(rows, "ts string, event_type string").select(F.col("ts").cast("timestamp"), "event_type").write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("gridspan_windows").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["start"].minute, r["event_type"], r["n"]) for r in spark.table("gridspan_windows").collect()) == [(0, "a", 2), (0, "b", 1), (5, "a", 1)]


def test_shared_folder_and_its_removal(spark, tmp_path, monkeypatch):
    from gridspan import session

    df = session.written(spark.range(5), "five")
    assert df.count() == 5 and session.run_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    monkeypatch.setattr(session, "shared_dir", lambda _: f"file://{tmp_path}/other")
    spark.range(3).write.parquet(session.new_path(spark, "x"))
    folder = tmp_path / "other" / "gridspan"
    assert len(list(folder.iterdir())) == 1
    session.clean(spark)
    assert not list(folder.iterdir())


@pytest.mark.parametrize(("strategy", "moved"), [("naive", 2), ("secondary_sort", 2), ("range_block", 2), ("mod_block", 2), ("rect_block", 2)])
def test_iterations_shuffle_the_vector_and_sums_only(spark, strategy, moved):
    """Above the matrix that is kept, an iteration has an exchange of the vector and one of the partial sums, and none of the matrix."""
    e = spark.range(3000).select((F.col("id") % 500).alias("src"), (F.col("id") * 7 % 501).alias("dst"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = pagerank(e, spark.range(501).withColumnRenamed("id", "node"), fixed_iterations=1, strategy=strategy)
        two = pagerank(e, spark.range(501).withColumnRenamed("id", "node"), fixed_iterations=2, strategy=strategy, resume=one)
        one.collect(), two.collect()
        plans = [d._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0] for d in (one, two)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.catalog.clearCache()
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    above = [exchanges_above_cache(d) for d in (one, two)]
    assert above[0] == moved


def exchanges_above_cache(df):
    """Exchanges of the executed plan, without those that made the kept tables."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    n, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "InMemoryTableScanExec":
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        n += name == "ShuffleExchangeExec"
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def test_a_run_that_does_not_converge_says_so(graph):
    report = {}
    with pytest.warns(UserWarning, match="no convergence in 2 iterations"):
        pagerank(*graph, tol=1e-12, max_iterations=2, report=report)
    assert report["iterations"] == 2 and not report["converged"] and report["moved"] > 1e-12
    pagerank(*graph, tol=1e-6, report=report)
    assert report["converged"] and report["moved"] <= 1e-6


def test_block_radii_agree_with_plain_ones(spark):
    rng = random.Random(6)
    e = spark.createDataFrame(sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(90)}), "src long, dst long")
    nodes = spark.range(60).withColumnRenamed("id", "node")
    plain, blocks = (radius.radii(e, nodes, k=4, width=w) for w in (None, 7))
    for a, b in zip(plain.curve.orderBy("hop").collect(), blocks.curve.orderBy("hop").collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b))
    assert sorted(map(tuple, plain.history.collect())) == sorted(map(tuple, blocks.history.collect()))


def test_state_lines(spark):
    lines = spark.createDataFrame([("# x\ty",), ("7\tbsi2:0:1.0:2:3.5 80000000 1f",), ("7\tbsc0 0 ff",), ("8\tc",), ("3\t4",), ("5",)], "value string")
    got = [tuple(r) for r in text.state_lines(lines, 2).collect()]
    assert got[0] == ("state", 7, None, "i", [(0, 1.0), (2, 3.5)], [0x80000000, 0x1F])
    assert got[1:] == [("state", 7, None, "c", [], [0, 255]), ("command", 8, None, None, None, None), ("edge", 4, 3, None, None, None)]
    with pytest.raises(Exception, match="masks of node 9"):
        text.state_lines(spark.createDataFrame([("9\tbsi0 1",)], "value string"), 2).collect()


def test_radii_hop_until_nothing_changes(spark):
    n = 12
    e = spark.createDataFrame([(i, i + 1) for i in range(n)], "src long, dst long")
    nodes = spark.range(n + 1).withColumnRenamed("id", "node")
    masks = {r["node"]: r["b0"] for r in radius.init_state(nodes, 1).collect()}
    r = radius.radii(e, nodes, k=1)
    assert r.curve.orderBy("hop").collect()[-1]["changed"] == 0
    want = {i: 0 for i in masks}
    for i in masks:
        for j in range(i, n + 1):
            want[i] |= masks[j]
    assert {x["node"]: x["b0"] for x in r.state.collect()} == want


def test_converged_radii_go_beyond_five_hops(spark, sf_dir):
    from gridspan import queries

    last = queries.QUERIES["status_counts_converged"](spark, sf_dir.replace("sf0.001", "sf0.01")).orderBy("hop").collect()[-1]
    assert last["changed"] == 0 and last["hop"] > queries.HOPS


def test_products_copy_no_row_for_each_pair_of_blocks(spark):
    rows = 40
    a = spark.range(rows).select(F.col("id").alias("i"), F.col("id").alias("r"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vec"))
    b = a.select(F.col("i").alias("j"), F.col("r").alias("c"), "vec")
    got = dense.matmul(a, b, digits=6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" not in plan
    assert {(x["i"], x["j"], x["r"], x["c"]): x["v"] for x in got.collect()} == {(i, j, i, j): i * j + 1.0 for i in range(rows) for j in range(rows)}


@pytest.mark.parametrize("strategy", ["pair", "broadcast"])
def test_products_of_uneven_blocks_and_nulls(spark, strategy, monkeypatch):
    schema = "i int, r long, vec array<double>"
    a = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, None), (None, 2, [3.0, 0.5])], schema)
    b = spark.createDataFrame([(5, 7, [0.25, -2.0000005])], schema).toDF("j", "c", "vec")
    got = {(x["i"], x["r"]): x["v"] for x in dense.matmul(a, b, strategy, digits=6).collect()}
    assert got == {(0, 0): -3.750001, (0, 1): None, (None, 2): -0.25}
    assert dense.matmul(a.limit(0), b, strategy).count() == 0 == dense.matmul(a, b.limit(0), strategy).count()
    if strategy == "broadcast":
        assert "cross" not in dense.matmul(a, b, strategy)._jdf.queryExecution().optimizedPlan().toString().lower()


def test_products_are_rounded_as_sql_rounds():
    import duckdb
    import numpy as np

    v = np.array([0.5, -0.5, 2.5e-6, -2.5e-6, 0.49999999999999994e-6, 1e300, -1e-9, 0.1234565, 3.0000005])
    want = [duckdb.execute("select round(?::double, 6)", [float(x)]).fetchone()[0] for x in v]
    assert dense._rounded(v, 6).tolist() == want


def test_product_folders_are_written_unsorted(spark, tmp_path):
    a = generators.dense_blocks(spark, "A", 3, 4, 5).select(F.col("blk").alias("i"), "r", "vec")
    b = generators.dense_blocks(spark, "B", 2, 4, 5).select(F.col("blk").alias("j"), F.col("r").alias("c"), "vec")
    path = f"file://{tmp_path}/products"
    dense.write_products(a, b, path)
    assert {p.parent.parent.name + "/" + p.parent.name for p in (tmp_path / "products").rglob("*.parquet")} == {f"i={i}/j={j}" for i in range(3) for j in range(2)}
    back = spark.read.parquet(path).select("i", "j", "r", "c", "v").collect()
    assert sorted(map(tuple, back)) == sorted(map(tuple, dense.matmul(a, b).collect()))


def test_radii_history_is_read_without_joins(graph):
    r = radius.radii(*graph, k=8)
    assert "Join" not in r.history._jdf.queryExecution().optimizedPlan().toString()
    blocks = radius.radii(*graph, k=8, width=2)
    assert sorted(map(tuple, blocks.history.collect())) == sorted(map(tuple, r.history.collect()))
    assert blocks.curve.collect() == r.curve.collect()


def test_masks_that_stand_still_do_not_travel(spark, graph):
    one = radius.hop(graph[0], radius.init_state(graph[1], 8), 8)
    every, some = radius.hop(graph[0], one, 8), radius.hop(graph[0], one, 8, one.filter("status = 'i'"))
    assert 0 < one.filter("status = 'i'").count() < one.count()
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, every.collect()))


def test_labels_do_not_pass_through_the_driver(spark, graph, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    from gridspan.session import written

    monkeypatch.setattr(semiring, "written", kept)
    assert {x["node"]: x["v"] for x in semiring.min_labels(*graph).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_exact_pairs_are_dealt_by_their_number(spark, monkeypatch):
    from gridspan.session import written

    files = []

    def kept(df, name):
        out = written(df, name)
        if name.startswith("reach") and name != "reach0":
            files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(radius, "written", kept)
    monkeypatch.setattr(radius, "PAIRS", 100, raising=False)
    nodes = spark.range(100).withColumnRenamed("id", "node")
    edges = nodes.select(F.col("node").alias("src"), F.explode(F.array(*[(F.col("node") + i) % 100 for i in range(1, 11)])).alias("dst"))
    got = radius.nh_exact(edges, nodes, 3).orderBy("hop").collect()
    assert [tuple(x) for x in got] == [(0, 100), (1, 1100), (2, 2100), (3, 3100)]
    assert files[0] > 4 and files == sorted(files)


def test_orders_are_sorted_in_tasks_by_their_number(spark, sf_dir, monkeypatch):
    from gridspan.sources import graph as tables

    few = tables.co_purchase(spark, sf_dir)
    monkeypatch.setattr(tables, "LINES", 1000, raising=False)
    many = tables.co_purchase(spark, sf_dir)
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert f", {-(-lines // 1000)}), REPARTITION_BY_NUM" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_placed_tokens_need_no_join(spark, sf_dir):
    from gridspan import queries

    plan = queries.QUERIES["udtf_tokens"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode" in plan and "Join" not in plan
