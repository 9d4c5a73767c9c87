"""SimHash near-duplicate detection with vantage-point trees.

1. Every text becomes a sketch: words, shingles of `width` words, one XXH64 each, and for every bit whether over half of
   the shingles have it. `blocks64` > 1 extends the sketch by further 64-bit words from remixed hashes.
2. Equal sketches are merged first (partial aggregation), so copies never meet as pairs.
3. Each table looks at one slice of the sketch. Its slices are split by a vantage-point tree, built on the driver from a
   bounded sample: d(x, vantage point) <= mu goes left, the rest right. A sketch whose ball of the table's radius reaches over
   the boundary is also sent, as a query, to the other side (triangle bound), so a pair within the radius meets exactly once.
4. Inside a shard the same rule goes on in memory down to small leaves; survivors are verified on the whole sketch.
   A shard returns a spanning forest of its links, not all pairs: no link between classes is lost.
5. Classes are the connected components of these forests.

With slices that cover the sketch and radius = max_distance // tables, the search is exact (pigeonhole)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .components import connected_components
from .shared import bounded_batches, join_on, written

_GAP = re.compile(rb"[\x20\x09-\x0d]")
_PIECE = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def word_pieces(data: bytes, size: int = _PIECE) -> Iterator[list[bytes]]:
    """The words of data in pieces of about `size` bytes: memory stays bounded for very long texts."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if at + size < len(data) else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end + 1


def _bit_counts(h: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = len(bits) // 255 * 255
    out = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        out += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return out


def _remix(h: np.ndarray, k: int) -> np.ndarray:
    if k == 0:
        return h
    z = h + np.uint64(int(_GOLDEN) * k % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """One XXH64 for each shingle of `width` words, in order; of all words where there are fewer. No words: nothing."""
    digest = xxhash.xxh64_intdigest

    def take(words: list[bytes], m: int) -> Iterator[np.ndarray]:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[:m].tolist()
        ends = ends[len(words) - m :].tolist()
        for i in range(0, m, 16384):
            yield np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + 16384], ends[i : i + 16384], strict=True)], np.uint64)

    none, carry = True, []
    for words in word_pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        words = carry + words
        if len(words) >= width:
            none = False
            yield from take(words, len(words) - width + 1)
        carry = words[len(words) - width + 1 :] if len(words) >= width else words
        if width == 1:
            carry = []
    if none and carry:
        yield from take(carry, 1)


def _sketch(chunks: Iterable[np.ndarray], blocks64: int) -> tuple[int, bytes]:
    total, counts = 0, np.zeros((blocks64, 64), np.int64)
    for h in chunks:
        total += len(h)
        for k in range(blocks64):
            counts[k] += _bit_counts(_remix(h, k))
    bits = (counts * 2 > total).astype(np.uint8) if total else np.zeros((blocks64, 64), np.uint8)
    return total, np.packbits(bits, axis=1, bitorder="little").view("<u8").astype(">u8").tobytes()


def text_sketch(text: str | None, width: int, blocks64: int, seed: int = 42) -> tuple[int, bytes]:
    """(number of shingles, sketch as big-endian 64-bit words). No words: 0 and a zero sketch."""
    return _sketch(shingle_hashes(text, width, seed), blocks64)


def shingle_set(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """The distinct shingles of a text, as sorted hashes."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *shingle_hashes(text, width, seed)]))


def set_sketch(hashes: np.ndarray, blocks64: int) -> tuple[int, bytes]:
    """text_sketch where every distinct shingle counts once."""
    return _sketch((hashes[i : i + 16384] for i in range(0, len(hashes), 16384)), blocks64)


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, blocks64: int = 1, seed: int = 42) -> DataFrame:
    """(id, n_shingles, sketch) for every row. A null text has no words."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = [text_sketch(x.as_py(), width, blocks64, seed) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([s for _, s in got], pa.binary())], ["id", "n_shingles", "sketch"])

    return slim.mapInArrow(run, f"id {kind}, n_shingles bigint, sketch binary")


@dataclass(frozen=True)
class Slice:
    """A table: `bits` bits (64 at most), the first of them number `first`, each `step` after the one before; compared at distance `radius`."""

    first: int
    bits: int
    radius: int
    step: int = 1

    def codes(self, words: np.ndarray) -> np.ndarray:
        """words: (n, blocks64) uint64; the slice of each row. Bits are counted from the left and wrap at the end."""
        n = words.shape[1]
        if self.step != 1:
            out = np.zeros(len(words), np.uint64)
            for at in (np.arange(self.bits) * self.step + self.first) % (64 * n):
                out = out << np.uint64(1) | words[:, at // 64] >> np.uint64(63 - at % 64) & np.uint64(1)
            return out
        i, off = divmod(self.first % (64 * n), 64)
        high = words[:, i] << np.uint64(off)
        if off:
            high = high | (words[:, (i + 1) % n] >> np.uint64(64 - off))
        return high >> np.uint64(64 - self.bits)


def _words(column, blocks64: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, blocks64)


def _split(codes: np.ndarray, rows: np.ndarray) -> tuple[np.uint64, int, np.ndarray] | None:
    """Vantage point, mu and the distances of rows; None if all codes are equal."""
    point = codes[rows[len(rows) // 2]]
    d = np.bitwise_count(codes[rows] ^ point)
    mu, top = int(np.median(d)), int(d.max())
    if top == 0:
        return None
    return point, min(mu, top - 1), d


def build_tree(codes: np.ndarray, depth: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage point, mu, left, right) from a sample; a child below zero is the shard -child - 1."""
    nodes: list = []
    shards = 0

    def grow(rows: np.ndarray, left: int) -> int:
        nonlocal shards
        cut = _split(codes, rows) if left and len(rows) >= 2 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(None)
        point, mu, d = cut
        nodes[at] = (int(point), mu, grow(rows[d <= mu], left - 1), grow(rows[d > mu], left - 1))
        return at

    grow(np.arange(len(codes)), depth)
    return nodes


def route(nodes: list, codes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, rows that live there, rows that ask there)."""
    none = np.empty(0, np.int64)
    todo = [(0 if nodes else -1, np.arange(len(codes)), none)]
    while todo:
        at, own, ask = todo.pop()
        if at < 0:
            yield -at - 1, own, ask
            continue
        point, mu, left, right = nodes[at]
        d, q = (np.bitwise_count(codes[x] ^ np.uint64(point)).astype(np.int16) for x in (own, ask))
        todo.append((left, own[d <= mu], np.concatenate((own[(d > mu) & (d <= mu + radius)], ask[q <= mu + radius]))))
        todo.append((right, own[d > mu], ask[q > mu - radius]))


class _Forest:
    """Links of a shard, kept as the parents of a forest."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        p = self.parent
        while len(i):
            a, b = p[i], p[j]
            differ = a != b
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            if not len(i):
                break
            np.minimum.at(p, np.maximum(a, b), np.minimum(a, b))
            while True:
                q = p[p]
                if np.array_equal(p, q):
                    break
                p[:] = q


def join_shard(words: np.ndarray, asks: np.ndarray, cut: Slice, max_distance: int, cross: bool, leaf: int = 128, block: int = 1024) -> np.ndarray:
    """Parents of a forest that connects what the links among own rows, and between own and asking rows, connect.
    cross: own rows have met one another elsewhere."""
    codes = cut.codes(words)
    forest = _Forest(len(words))

    def meet(a: np.ndarray, b: np.ndarray, same: bool) -> None:
        near = np.bitwise_count(codes[a][:, None] ^ codes[b][None, :]) <= cut.radius
        if same:
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        i, j = a[i], b[j]
        new = forest.parent[i] != forest.parent[j]
        i, j = i[new], j[new]
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            close = np.bitwise_count(words[x] ^ words[y]).sum(axis=1, dtype=np.int64) <= max_distance
            forest.link(x[close], y[close])

    todo = [(np.flatnonzero(~asks), np.flatnonzero(asks))]
    r = cut.radius
    while todo:
        own, ask = todo.pop()
        if not len(own) or (len(own) < 2 and not len(ask)):
            continue
        split = _split(codes, own) if len(own) > leaf else None
        if split is None:
            for i in range(0, len(own), block):
                a = own[i : i + block]
                if not cross:
                    meet(a, a, True)
                    for j in range(i + block, len(own), block):
                        meet(a, own[j : j + block], False)
                for j in range(0, len(ask), block):
                    meet(a, ask[j : j + block], False)
            continue
        point, mu, d = split
        d, q = d.astype(np.int16), np.bitwise_count(codes[ask] ^ point).astype(np.int16)
        over = own[(d > mu) & (d <= mu + r)] if not cross else own[:0]
        todo.append((own[d <= mu], np.concatenate((over, ask[q <= mu + r]))))
        todo.append((own[d > mu], ask[q > mu - r]))
    return forest.parent


def near_edges(nodes: DataFrame, tables: list[Slice], max_distance: int, blocks64: int, shard_rows: int = 4096, sample_rows: int = 1 << 20, hot_factor: int = 16) -> DataFrame:
    """(a, b): edges that connect exactly the classes of sketches that the tables find linked. nodes: (sketch), distinct.

    The sample that the trees are built from has eight sketches for each leaf; sample_rows bounds it. A shard of more than
    hot_factor * shard_rows rows is dealt into blocks, and every pair of blocks is a task of its own: nothing is capped, and no
    task's rows grow with the input. Only such shards' counts reach the driver, one for so many rows."""
    spark = nodes.sparkSession
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_rows))))
    sample = nodes.select("sketch").orderBy(F.xxhash64("sketch"), "sketch").limit(min(sample_rows, max(2048, 8 << depth))).collect() if depth else []
    words = np.frombuffer(b"".join(bytes(r[0]) for r in sample), ">u8").astype(np.uint64).reshape(-1, blocks64)
    trees = [build_tree(t.codes(words), depth) if len(words) else [] for t in tables]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            w = _words(batch.column(0), blocks64)
            for t, cut in enumerate(tables):
                out: list = [[], [], []]
                for shard, own, ask in route(trees[t], cut.codes(w), cut.radius):
                    for rows, asking in ((own, False), (ask, True)):
                        out[0].append(rows)
                        out[1].append(np.full(len(rows), shard, np.int32))
                        out[2].append(np.full(len(rows), asking))
                rows, shard, asking = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(shard), pa.array(asking), batch.column(0).take(pa.array(rows))], ["t", "shard", "asks", "sketch"])

    dealt = nodes.select("sketch").mapInArrow(deal, "t int, shard int, asks boolean, sketch binary")
    limit = hot_factor * shard_rows
    blocks: list = []
    if n > limit:
        blocks = dealt.filter("not asks").groupBy("t", "shard").count().filter(F.col("count") > limit).collect()
    dealt = dealt.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if blocks:
        size = spark.createDataFrame([(r["t"], r["shard"], -(-r["count"] // limit)) for r in blocks], "t int, shard int, k int")
        hot = dealt.drop("i", "j").join(F.broadcast(size), ["t", "shard"]).withColumn("own", F.pmod(F.xxhash64("sketch"), F.col("k")).cast("int"))
        every = F.sequence(F.lit(0), F.col("k") - 1)
        asks = hot.filter("asks").withColumn("i", F.explode(every)).withColumn("j", F.col("i"))
        owns = hot.filter("not asks").withColumn("o", F.explode(every)).withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")}).withColumn("asks", F.col("own") > F.col("i"))
        dealt = dealt.join(F.broadcast(size), ["t", "shard"], "left_anti").unionByName(asks.select("t", "shard", "asks", "sketch", "i", "j")).unionByName(owns.select("t", "shard", "asks", "sketch", "i", "j"))

    def join(group: pa.Table) -> pa.Table:
        w = _words(group.column("sketch"), blocks64)
        cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        parent = join_shard(w, group.column("asks").to_numpy(zero_copy_only=False).astype(bool), tables[group.column("t")[0].as_py()], max_distance, cross)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        s = group.column("sketch")
        return pa.table({"a": s.take(pa.array(child)), "b": s.take(pa.array(parent[child]))})

    return dealt.groupBy("t", "shard", "i", "j").applyInArrow(join, "a binary, b binary")


def simhash_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, blocks64: int = 1, tables: list[Slice] | None = None, max_distance: int = 3, shard_rows: int = 4096, seed: int = 42) -> DataFrame:
    """(id, n_shingles, sketch, component): sketches at most max_distance bits apart are linked; component is the least id of
    the connected component. Every input row gives a row.

    Null and empty texts have a zero sketch and are linked like any other. Null ids take part in linking but never name a
    component (a class of null ids only has a null component). Repeated rows are copies of one another. Other columns are
    not read, so their names cannot clash. An empty table gives an empty result."""
    tables = tables or [Slice(0, 32, max_distance // 2), Slice(32, 32, max_distance // 2)]
    found = written(sketches(docs, id_col, text_col, width, blocks64, seed), "sketches")
    nodes = written(found.groupBy("sketch").agg(F.min("id").alias("first")), "nodes")
    parts = connected_components(near_edges(nodes, tables, max_distance, blocks64, shard_rows)).withColumnRenamed("node", "sketch")
    return join_on(found, _named(nodes, parts, "sketch"), "sketch", "left")


def _named(nodes: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, component): the least id of the class of each node (key, first); parts (key, component) has those with links."""
    linked = join_on(nodes, parts, key)
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = join_on(linked, least, "component").select(key, "least")
    return written(join_on(nodes, written(named, "named"), key, "left").select(key, F.coalesce("least", "first").alias("component")), "classes")


#: Near-duplicates by sets of five-word shingles: slices of 512 bits propose, exact similarities decide.
NEAR_WIDTH, NEAR_BLOCKS = 5, 8
#: Measured on sketches of random pairs, for up to 10^10 rows.
STRIDED = 0.65
#: Standard errors that a proposed pair may be further apart than its similarity implies.
NEAR_ERRORS = 6.0
#: A larger proposed group is dealt into blocks of about so many sets, or bytes of text.
BLOCK_SETS, BLOCK_BYTES = 512, 4 << 20


def _bit_differs(similarity: float) -> float:
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def distance_for(similarity: float, bits: int, errors: float = 1.0) -> int:
    """Differing bits that stand for a Jaccard similarity: cosine 2s/(1+s) of equally long texts, its angle, and so many
    standard errors on top."""
    p = _bit_differs(similarity)
    return int(bits * p + errors * np.sqrt(bits * p * (1 - p)))


def found_share(tables: list[Slice], similarity: float) -> float:
    """About the share of pairs of just this similarity that the tables propose. Strided tables share bits with those before them, and
    find about STRIDED as much that is new as tables over bits of their own would."""
    p = _bit_differs(similarity)
    lost = 1.0
    for t in tables:
        found = sum(math.comb(t.bits, k) * p**k * (1 - p) ** (t.bits - k) for k in range(t.radius + 1))
        lost *= 1 - found * (1 if t.step == 1 else STRIDED)
    return 1 - lost


def near_tables(n: int, similarity: float, bits: int = 64 * NEAR_BLOCKS, share: float = 0.988) -> list[Slice]:
    """Tables for n sketches. A slice has as many bits as n has, 20 at least, so that a sketch meets about as many others by chance at
    every size; there are as many slices as find `share` of the pairs of just this similarity. Slices of neighbouring bits come first,
    then, from other bits of the sketch, strided ones."""
    width = max(20, math.ceil(math.log2(max(n, 2))))
    out: list[Slice] = []
    per = max(1, bits // (width + 1))
    while found_share(out, similarity) < share:
        turn, k = divmod(len(out), per)
        step = 1 if turn == 0 else 2 * turn + 1
        out.append(Slice(k * (width + 1) if turn == 0 else k * (width + 1) * step + turn, width, 1, step))
    return out


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int, blocks64: int, seed: int = 42) -> DataFrame:
    """(row, id, text, rest, n_shingles, sketch, members) for every row: number and sketch of its distinct shingles, and a 128-bit
    digest of them. `row` is unique in the result as it is written; rest is a struct of the other columns."""
    bounded_batches(docs.sparkSession)
    rest = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)])
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), rest.alias("rest"))
    result = StructType([*slim.schema.fields, *StructType.fromDDL("n_shingles bigint, sketch binary, members binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                got = []
                for x in part.column(2):
                    h = shingle_set(x.as_py(), width, seed)
                    got.append((*set_sketch(h, blocks64), xxhash.xxh3_128_digest(h.tobytes())))
                n, sketch, members = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(members, pa.binary())], ["row", "id", "text", "rest", "n_shingles", "sketch", "members"])

    return slim.mapInArrow(run, result)


def join_sets(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links that connect what the pairs of Jaccard similarity `similarity` or more connect. Sets of one label are connected
    already. Only pairs that would connect nothing new are left out."""
    label, links = labels.copy(), []
    size = np.array([len(x) for x in sets], np.int64)
    at = np.concatenate(([0], np.cumsum(size)))
    found, code = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(found), bool)
    for i in range(1, len(sets)):
        least, most = np.minimum(size[:i], size[i]), np.maximum(size[:i], size[i])
        near = np.flatnonzero((label[:i] != label[i]) & (least / np.maximum(most, 1) >= similarity))
        mine = code[at[i] : at[i + 1]]
        mark[mine] = True
        while len(near):
            j, near = near[0], near[1:]
            shared = np.count_nonzero(mark[code[at[j] : at[j + 1]]])
            if shared / (size[i] + size[j] - shared) >= similarity:
                links.append((i, int(j)))
                label[label == label[j]] = label[i]
                near = near[label[near] != label[i]]
        mark[mine] = False
    return links


def _blocks(n, size):
    return F.greatest(F.ceil(n / F.lit(BLOCK_SETS)), F.ceil(size / F.lit(BLOCK_BYTES)), F.lit(1)).cast("int")


def exact_classes(groups: DataFrame, found: DataFrame, width: int, similarity: float, seed: int = 42) -> DataFrame:
    """(members, component) for every set with a link. groups (members, row, bytes, group): distinct sets, each with a row of
    found that has its text; every pair of a group is linked if its Jaccard similarity, from the shingles, is `similarity` or more.

    A group of many sets is dealt into blocks, each with one common set. Where that leaves the group in several classes, every
    pair of blocks is a task, except pairs within the largest class, which are connected already: nothing is capped."""

    def join(group: pa.Table) -> pa.Table:
        members = group.column("members")
        sets = [shingle_set(x.as_py(), width, seed) for x in group.column("text")]
        labels = np.unique(np.array([x.as_py().hex() for x in group.column("label")]), return_inverse=True)[1]
        links = np.array(join_sets(sets, labels, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": members.take(pa.array(links[:, 0])), "b": members.take(pa.array(links[:, 1]))})

    def joined(dealt: DataFrame, *keys: str) -> DataFrame:
        return dealt.select(*keys, "members", "label", "text").groupBy(*keys).applyInArrow(join, "a binary, b binary")

    share = F.xxhash64("members")
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"), F.min("members").alias("common"))
    sizes = sizes.filter("n > 1").select("group", "common", _blocks(F.col("n"), F.col("size")).alias("k"))
    texts = written(join_on(groups, sizes, "group").join(found.select("row", "text"), "row"), "texts")
    block = F.when(F.col("members") == F.col("common"), F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(share, F.col("k")).cast("int")))
    edges = written(joined(texts.withColumns({"label": F.col("members"), "i": F.explode(block)}), "group", "i"), "links")
    parts = connected_components(edges)
    many = texts.filter("k > 1")
    if many.isEmpty():
        return parts.withColumnRenamed("node", "members")

    label = join_on(many.drop("text"), parts.withColumnRenamed("node", "members"), "members", "left").select("group", "members", "row", "bytes", F.coalesce("component", "members").alias("label"))
    label = written(label, "labels")
    each = label.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    both = each.groupBy("group").agg(F.max_by(F.struct("label", "n", "size"), F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > main.n")
    both = both.select("group", F.col("main.label").alias("main"), _blocks(F.col("main.n"), F.col("main.size")).alias("k"), _blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("o"))
    left = join_on(label, both, "group").withColumn("own", F.when(F.col("label") == F.col("main"), F.pmod(share, F.col("k"))).otherwise(F.col("k") + F.pmod(share, F.col("o"))).cast("int"))
    other = F.sequence(F.when(F.col("own") < F.col("k"), F.col("k")).otherwise(F.lit(0)), F.col("k") + F.col("o") - 1)
    pairs = left.withColumn("with", F.explode(other)).select("group", "members", "row", "label", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
    more = written(joined(pairs.join(found.select("row", "text"), "row"), "group", "i", "j"), "links")
    return connected_components(edges.unionByName(more)).withColumnRenamed("node", "members")


def _near(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shingle sets of all rows; distinct sets (members, first, sketch, row, bytes) with their least id, null ids last, and
    its row; and (members, component) of the sets that have a link.

    Trees over the sketches of the sets only propose: the connected components of what they find within a generous distance
    are groups, in which every pair is decided by the shingles themselves. Equal sets are merged first."""
    found = written(shingle_sets(docs, id_col, text_col, NEAR_WIDTH, NEAR_BLOCKS), "sets")
    least = F.struct(F.col("id").isNull().alias("none"), "id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    nodes = written(found.groupBy("members").agg(F.min(least).alias("one"), F.min("sketch").alias("sketch")).select("members", F.col("one.id").alias("first"), "sketch", "one.row", "one.bytes"), "nodes")
    proposers = written(nodes.select("sketch").distinct(), "proposers")
    proposed = near_edges(proposers, near_tables(proposers.count(), similarity), distance_for(similarity, 64 * NEAR_BLOCKS, NEAR_ERRORS), NEAR_BLOCKS, shard_rows=16384)
    groups = connected_components(proposed).select(F.col("node").alias("sketch"), F.col("component").alias("group"))
    groups = written(join_on(nodes, groups, "sketch", "left").select("members", "row", "bytes", F.coalesce("group", "sketch").alias("group")), "groups")
    return found, nodes, exact_classes(groups, found, NEAR_WIDTH, similarity)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8) -> DataFrame:
    """(id, n_shingles, sketch, component): texts are linked if their sets of five-word shingles have a Jaccard similarity of
    `similarity` or more; component as in simhash_classes."""
    found, nodes, parts = _near(docs, id_col, text_col, similarity)
    return join_on(found.select("id", "n_shingles", "sketch", "members"), _named(nodes, parts, "members"), "members", "left").drop("members")


def keep_one(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row of each near-duplicate class: that of the smallest doc_id, then of the least digest of its shingles. A null doc_id
    is larger than any other, so such a row stays where nothing else of its class has an id. Columns are those of docs."""
    found, nodes, parts = _near(docs, "doc_id", "text", similarity)
    classes = join_on(nodes, parts, "members", "left").withColumn("component", F.coalesce("component", "members"))
    least = F.struct(F.col("first").isNull().alias("none"), "first", "members", "row")
    kept = classes.groupBy("component").agg(F.min(least).alias("one")).select("one.row")
    columns = {"doc_id": F.col("id"), "text": F.col("text").cast(docs.schema["text"].dataType)}
    return found.join(kept, "row", "left_semi").select(*[columns.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])
