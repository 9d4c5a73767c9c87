import math

import numpy as np
from pyspark.sql import functions as F

from gridspan.llm import pivot_index as I
from gridspan.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import agree


def brute(rows, threshold=0.98):
    links = {i: set() for i in range(len(rows))}
    for i, (_, v, a) in enumerate(rows):
        for j in range(i):
            w, b = rows[j][1], rows[j][2]
            if a == b and len(v) == len(w) and np.dot(v, w) / math.sqrt(np.dot(v, v) * np.dot(w, w)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[rows[i][0]] = (len(links[i]), min(rows[j][0] for j in seen))
    return out


def clustered(n, seed=12, dims=64):
    """n vectors: a third alone, a third in small groups around a centre, a third in one large group; the links at about 0.98."""
    rng = np.random.default_rng(seed)
    spread = 0.9 * math.sqrt((1 / 0.985 - 1) / dims)
    out = [*rng.normal(size=(n // 3, dims))]
    while len(out) < 2 * n // 3:
        c = rng.normal(size=dims)
        out += [c + np.linalg.norm(c) * spread * rng.normal(size=dims) for _ in range(rng.integers(2, 8))]
    c = rng.normal(size=dims)
    out += [c + np.linalg.norm(c) * spread * rng.normal(size=dims) for _ in range(n - len(out))]
    return np.float32(out)[rng.permutation(len(out))]


def test_prunes_and_still_finds_the_links(spark):
    """5,000 vectors of one label: under 5 % of the pairs are looked at, 99 % of the links are found, and no other."""
    x = clustered(5000)
    alone = np.float32(np.random.default_rng(2).normal(size=(5000, 64)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)] + [(5000 + i, v.tolist(), 2) for i, v in enumerate(alone)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    report = {}
    got = {r["id"]: r["n_links"] for r in I.near_vectors(df, report=report).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(axis=1) - 1
    assert want.sum() > 500_000 and all(got[i] <= want[i] for i in range(5000))
    assert sum(got[i] for i in range(5000)) >= 0.99 * want.sum()
    alone = I.near_vectors(df.filter("label = 2"), report=report).collect()
    assert report["tests"] < 0.05 * 5000 * 4999 / 2 and len(alone) == 5000


def test_measured_recall(spark):
    x = clustered(3000, seed=3)
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    r = I.recall(df, block=500).first()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    near = (u @ u.T >= 0.98) & (np.arange(3000)[:, None] % 2 == np.arange(3000)[None, :] % 2)
    assert r["queries"] == 150 and r["true_links"] == near[::20].sum() - 150
    assert 0.99 * r["true_links"] <= r["found_links"] <= r["true_links"]


def test_prefixes_are_the_nearest_pivots():
    rng = np.random.default_rng(1)
    x, p = rng.normal(size=(50, 8)), rng.normal(size=(30, 8))
    want = np.sort(np.argsort(-(x @ p.T), axis=1)[:, :6], axis=1)
    assert (I.prefixes(x, p, 6) == want).all()
    assert I.prefixes(x, p[:1], 6).tolist() == [[-2, 0]] * 50 and I.prefixes(x, p[:0], 6).tolist() == [[-2, -1]] * 50


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 64))
    vectors = [b + rng.normal(size=64) * s for b in base for s in (0, 0.1, 0.12, 0.0, 0.3)] + [base[0] + rng.normal(size=64) * 0.05 for _ in range(300)]
    rows = [(i, np.float32(v).astype(float).tolist(), i % 2 if i < 300 else 0) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for options in ({}, {"list_rows": 40}):
        got = {r["id"]: (r["n_links"], r["component"]) for r in I.near_vectors(df, **options).collect()}
        want = brute(rows)
        found, true = sum(g[0] for g in got.values()), sum(w[0] for w in want.values())
        assert true > 10_000 and found >= 0.999 * true and all(got[i][0] <= want[i][0] for i in want)
        assert {i: g[1] for i, g in got.items()} == {i: w[1] for i, w in want.items()}


def test_rows_of_every_kind(spark):
    a, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(5, a, 1), (3, [2.0, 4.0, 6.0], 1), (9, a, 2), (1, a, None), (2, None, 1), (4, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 3.0], 1), (7, [nan, 1.0, 1.0], 1), (8, [inf, 1.0, 1.0], 1), (10, [], 1), (11, [1.0, 2.0], 1), (None, a, 1), (5, a, 1), (12, [1e300, 2e300, 3e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("component", F.lit("clash")).withColumn("u", F.lit(1))
    got = I.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r["id"]: (r["n_links"], r["component"]) for r in got}
    assert by[5] == by[3] == by[12] == (3, 3)
    assert by[None] == (0, None) and all(by[i] == (0, i) for i in (9, 1, 2, 4, 6, 7, 8, 10, 11))
    assert I.near_vectors(df.limit(0)).collect() == []


def test_query_agrees_with_sql(spark, sf_dir):
    agree(spark, sf_dir, QUERIES["op8_pivot_index"], ORACLE_SQL["op8_pivot_index"])
