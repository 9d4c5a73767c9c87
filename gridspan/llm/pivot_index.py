"""Embedding near-duplicates by a pivot-permutation index.

Equal vectors of a label are merged first. Every vector is described by its `prefix` nearest reference points (pivots). An
inverted list for each (label, two pivots) holds the vectors that name both, so two vectors meet only where they share `SHARED`
pivots: the count of shared pivots is in the key of the list, and no list of a single frequent pivot is ever walked. A pair is
handled in the list of its first shared pivots alone, and is verified by its cosine in double precision.

The number of pivots grows with the square root of the number of vectors, so that a vector meets about as many others by chance
at every size. The pivots are a bounded sample, no two of them within
twice the angle of a link; all vectors are indexed. Lists of one vector, and lists whose vectors
all share an earlier pivot (whose pairs are handled elsewhere), end as counts. The others fetch their vectors; a long list is dealt into
blocks and every pair of blocks is a unit of work of its own, so nothing is capped. Units are packed into shards of bounded size.

A shard returns, for each vector, the sum of the copies of its partners, and a forest of its links: never pairs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import join_on, written
from .simhash import _Forest

#: Pivots that a list is keyed by.
SHARED = 2
#: Lists up to this size are joined together, in one pass over their pairs.
_SMALL = 32


def usable_vector(vector) -> np.ndarray | None:
    """The vector in double precision; None if it is null, empty, zero or has null or non-finite parts."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return v if v.size and np.isfinite(v).all() and v.any() else None


def unit_rows(raw: list[bytes], code: str) -> np.ndarray:
    """Vectors of one length, stored as `code` numbers, scaled to length one in double precision."""
    x = np.frombuffer(b"".join(raw), code).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _usable(column: pa.ListArray, code: str) -> list[bytes | None]:
    """Each vector's numbers, or None; rows of one length without nulls go through in one piece."""
    length = column.value_lengths().to_pylist()
    if column.null_count or column.values.null_count or len(set(length)) != 1 or not length[0]:
        return [None if v is None else v.astype(code).tobytes() for v in (usable_vector(x.as_py()) for x in column)]
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    good = np.isfinite(x).all(axis=1) & x.any(axis=1)
    return [v.tobytes() if ok else None for v, ok in zip(x.astype(code), good.tolist(), strict=True)]


def _rows(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, code: str) -> DataFrame:
    slim = vectors.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _usable(batch.column(2), code)
            label = batch.column(1).to_pylist()
            key = [None if d is None or a is None else hashlib.blake2b(d + a.encode(), digest_size=16).digest() for d, a in zip(data, label, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(key, pa.binary()), pa.array(data, pa.binary())], ["id", "label", "vkey", "u"])

    return slim.mapInArrow(run, f"id {kind}, label string, vkey binary, u binary")


def spread(x: np.ndarray, most: int, limit: float) -> np.ndarray:
    """The first `most` rows, in order, of which no two have a cosine of more than `limit`: a dense group would else hold many pivots that
    are nearly as near to each of its vectors, in an order of chance."""
    kept = x[:0]
    for i in range(0, len(x), 512):
        part = x[i : i + 512]
        part = part[(part @ kept.T <= limit).all(axis=1)]
        close, free = part @ part.T > limit, np.ones(len(part), bool)
        for k in range(len(part)):
            if free[k]:
                free[k + 1 :] &= ~close[k, k + 1 :]
        kept = np.vstack([kept, part[free]])
        if len(kept) >= most:
            break
    return kept[:most]


def prefixes(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of the `prefix` pivots nearest to each row, ascending; -1 and -2 stand in where there are fewer than SHARED."""
    k = min(prefix, len(pivots))
    out = np.empty((len(x), k), np.int64)
    for i in range(0, len(x), 1024):
        near = x[i : i + 1024] @ pivots.T
        out[i : i + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(pivots) else np.arange(k)
    fill = np.tile(np.arange(-SHARED, -k, dtype=np.int64), (len(x), 1)) if k < SHARED else out[:, :0]
    return np.sort(np.hstack([fill, out]), axis=1).astype(np.int32)


def described(nodes: DataFrame, pivots: dict[int, np.ndarray], prefix: int, code: str) -> DataFrame:
    """nodes with the length of the vector and its pivots, ascending: the permutation prefix as a set."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("u")).to_pylist()
            dims, near = np.zeros(len(raw), np.int32), [None] * len(raw)
            for dim, own in _by_length(raw, int(code[-1])):
                dims[own] = dim
                p = prefixes(unit_rows([raw[i] for i in own], code), pivots.get(dim, np.empty((0, dim))), prefix)
                for i, row in zip(own.tolist(), p.tolist(), strict=True):
                    near[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dims), pa.array(near, pa.list_(pa.int32()))], [*batch.schema.names, "dim", "near"])

    return nodes.mapInArrow(index, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema.fields) + ", dim int, near array<int>")


def _postings(near: Column) -> Column:
    """The pairs of a vector's pivots, each with the first pivot before its second one that is not its own (null if none)."""

    def others(a: Column, i: Column) -> Column:
        rest = F.slice(near, i + F.lit(2), F.size(near))
        first = F.when(i > 0, F.get(near, F.lit(0)))
        return F.transform(rest, lambda b, j: F.struct(a.alias("a"), b.alias("b"), F.coalesce(first, F.when(j > 0, F.get(near, F.lit(1)))).alias("early")))

    return F.flatten(F.transform(near, others))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, prefix: int = 6, pivot_factor: float = 4.0, list_rows: int = 1024, shard_rows: int = 32768, seed: int = 5, report: dict | None = None) -> DataFrame:
    """(id, n_links, component) for every row: how many other rows are linked to it, and the least id it reaches.

    Rows are linked when their labels are equal and not null and their cosine is `threshold` or more. Null, empty or zero vectors, vectors
    with null or non-finite parts, and rows without id or label link with nothing; vectors of different lengths do not link.
    Repeated rows count as other vectors. The reference points are at most pivot_factor times the square root of the number
    of different vectors, or 64, from a sample of twice as many. Other columns are not read. An empty table gives an empty result. report, if given, gets the
    numbers of vectors and pivots, of rows in the lists that are walked, and of their pairs."""
    code = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = written(_rows(vectors, id_col, vec_col, label_col, code), "vectors")
    usable = rows.filter("vkey is not null and id is not null")
    nodes = written(usable.groupBy("vkey").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("u").alias("u")), "nodes")
    n = nodes.count()
    wanted = int(max(64, np.ceil(pivot_factor * np.sqrt(n))))
    sample = nodes.select("vkey", "u").orderBy(F.xxhash64(F.lit(seed).cast("long"), "vkey"), "vkey").limit(2 * wanted).collect()
    raw = [bytes(r["u"]) for r in sample]
    pivots = {dim: spread(unit_rows([raw[i] for i in own], code), -(-wanted * len(own) // len(raw)), 2 * threshold**2 - 1) for dim, own in _by_length(raw, int(code[-1]))}

    index = written(described(nodes, pivots, prefix, code), "index")
    posted = index.select("vkey", "label", "dim", F.explode(_postings(F.col("near"))).alias("p")).select("vkey", F.xxhash64("label", "dim", "p.a", "p.b").alias("list"), "p.a", "p.b", "p.early")
    sizes = posted.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.count("early").alias("m"), F.min("early").alias("low"), F.max("early").alias("high"))
    elsewhere = (F.col("m") == F.col("n")) & (F.col("low") == F.col("high"))
    sizes = written(sizes.filter((F.col("n") > 1) & ~elsewhere).select("list", "n", F.ceil(F.col("n") / F.lit(list_rows)).cast("int").alias("k")), "list_sizes")
    work, tests = sizes.agg(F.sum(F.col("n") * F.col("k")), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()
    work = work or 0
    if report is not None:
        report |= {"vectors": n, "pivots": sum(map(len, pivots.values())), "rows": work, "tests": tests or 0}
    shards = max(1, -(-work // shard_rows))
    kept = join_on(posted.drop("early"), sizes.drop("n"), "list").withColumn("own", F.pmod(F.xxhash64("vkey"), F.col("k")).cast("int"))
    kept = kept.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("own", "o"), "j": F.greatest("own", "o")})
    units = kept.select("vkey", "a", "b", F.xxhash64("list", "i", "j").alias("unit"), "own", (F.col("i") != F.col("j")).alias("cross"))
    fetched = units.join(index.select("vkey", "label", "dim", "copies", "u", "near"), "vkey").withColumn("shard", F.pmod("unit", F.lit(shards)))

    def verify(group: pa.Table) -> pa.Table:
        raw = group.column("u").to_pylist()
        links, root = np.zeros(len(raw), np.int64), np.arange(len(raw))
        for _, own in _by_length(raw, int(code[-1])):
            part = group.take(pa.array(own))
            count, parent = _links(part, unit_rows([raw[i] for i in own], code), threshold)
            links[own], root[own] = count, own[parent]
        keep = np.flatnonzero(links > 0)
        key = group.column("vkey")
        return pa.table({"vkey": key.take(pa.array(keep)), "n": pa.array(links[keep]), "root": key.take(pa.array(root[keep]))})

    found = written(fetched.groupBy("shard").applyInArrow(verify, "vkey binary, n bigint, root binary"), "links")
    count = found.groupBy("vkey").agg(F.sum("n").alias("n"))
    parts = connected_components(found, "vkey", "root").withColumnRenamed("node", "vkey")
    linked = join_on(nodes.select("vkey", "first"), parts, "vkey")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    named = written(join_on(linked, least, "component").select("vkey", "least"), "named")
    base = join_on(join_on(nodes.select("vkey", "first", "copies"), named, "vkey", "left"), count, "vkey", "left")
    base = written(base.select("vkey", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "first").alias("component")), "classes")
    in_index = join_on(usable.select("id", "vkey"), base, "vkey").select("id", "n_links", "component")
    alone = rows.filter("vkey is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return in_index.unionByName(alone)


def _links(rows: pa.Table, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows of units, with unit vectors x of one length: the copies linked to each row in its unit, and parents of a forest."""
    a, b, unit, own, copies = (rows.column(c).to_numpy() for c in ("a", "b", "unit", "own", "copies"))
    cross = rows.column("cross").to_numpy(zero_copy_only=False).astype(bool)
    label = np.unique(np.array(rows.column("label").to_pylist(), object), return_inverse=True)[1]
    near = np.array(rows.column("near").to_pylist(), np.int64).reshape(len(x), -1)
    # The pivots before the list's second one, but for its first: a pair that shares one of them is handled elsewhere.
    early = np.where((near < b[:, None]) & (near != a[:, None]), near, -10)
    links, forest = np.zeros(len(x), np.int64), _Forest(len(x))

    def meet(p: np.ndarray, q: np.ndarray) -> None:
        for z in range(0, len(p), 1 << 15):
            m, o = p[z : z + (1 << 15)], q[z : z + (1 << 15)]
            here = (a[m] == a[o]) & (b[m] == b[o]) & (label[m] == label[o]) & (~cross[m] | (own[m] != own[o]))
            here &= ~((early[m][:, :, None] == early[o][:, None, :]) & (early[m] != -10)[:, :, None]).any(axis=(1, 2))
            m, o = m[here], o[here]
            hit = np.einsum("ij,ij->i", x[m], x[o]) >= threshold
            m, o = m[hit], o[hit]
            np.add.at(links, m, copies[o])
            np.add.at(links, o, copies[m])
            forest.link(m, o)

    order = np.argsort(unit, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(unit[order]) != 0)) if len(x) else np.empty(0, np.int64)
    size = np.diff(np.append(starts, len(x)))
    of = np.repeat(np.arange(len(starts)), size)
    small = size[of] <= _SMALL
    for d in range(1, _SMALL):
        i = np.flatnonzero(small[:-d] & (of[:-d] == of[d:])) if d < len(x) else np.empty(0, np.int64)
        if not len(i):
            break
        meet(order[i], order[i + d])
    for s, n in zip(starts[size > _SMALL].tolist(), size[size > _SMALL].tolist(), strict=True):
        all_rows = order[s : s + n]
        kinds, kind = np.unique(early[all_rows], axis=0, return_inverse=True)
        apart = ~((kinds[:, None, :, None] == kinds[None, :, None, :]) & (kinds != -10)[:, None, :, None]).any(axis=(2, 3)) if len(kinds) <= 256 else None
        if apart is not None:
            all_rows = all_rows[apart.any(axis=1)[kind.ravel()]]
        for i in range(0, len(all_rows), 1024):
            r = all_rows[i : i + 1024]
            for j in range(i, len(all_rows), 1024):
                c = all_rows[j : j + 1024]
                close = x[r] @ x[c].T >= threshold - 1e-9
                p, q = np.nonzero(np.triu(close, 1) if i == j else close)
                meet(r[p], c[q])
    return links, forest.parent


def _by_length(raw: list[bytes], width: int) -> list[tuple[int, np.ndarray]]:
    size = np.array([len(x) // width for x in raw], np.int64)
    return [(int(d), np.flatnonzero(size == d)) for d in np.unique(size)]


def recall(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, of: int = 20, block: int = 2048, **options) -> DataFrame:
    """(queries, true_links, found_links) of near_vectors against brute force: the queries are the rows whose id is divisible by
    `of`, each compared with every row, in blocks. No link below the threshold is ever counted, so found / true is the recall."""
    code = "<f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = written(_rows(vectors, id_col, vec_col, label_col, code).filter("vkey is not null and id is not null"), "recall_rows")
    asked = rows.filter(F.col("id") % of == 0)
    parts = max(1, -(-rows.count() // block))
    groups = max(1, -(-asked.count() // block))
    left = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)))
    right = rows.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))).withColumn("h", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)))
    left = left.withColumn("h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, n = x.column("id").to_numpy(), np.zeros(x.num_rows, np.int64)
        xs, ys = x.column("u").to_pylist(), y.column("u").to_pylist()
        xl, yl = (np.array(t.column("label").to_pylist(), object) for t in (x, y))
        for dim, own in _by_length(xs, int(code[-1])):
            other = dict(_by_length(ys, int(code[-1]))).get(dim)
            if other is not None:
                close = unit_rows([xs[i] for i in own], code) @ unit_rows([ys[i] for i in other], code).T >= threshold
                n[own] += (close & (xl[own][:, None] == yl[other][None, :])).sum(axis=1)
        return pa.table({"id": ids, "n": n})

    kind = rows.schema["id"].dataType.simpleString()
    true = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInArrow(compare, f"id {kind}, n bigint").groupBy("id").agg((F.sum("n") - 1).alias("t"))
    found = near_vectors(vectors, id_col, vec_col, label_col, threshold, **options).select("id", "n_links")
    return true.join(found, "id").agg(F.count(F.lit(1)).alias("queries"), F.sum("t").alias("true_links"), F.sum("n_links").alias("found_links"))
