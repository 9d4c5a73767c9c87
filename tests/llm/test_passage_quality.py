import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspan.llm import passage_quality as Q
from gridspan.llm.queries import QUERIES


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    sizes, y, weight = np.array([3, 1, 4]), np.array([1.0, 0.0, 1.0]), np.array([0.5, 1.0, 0.7])
    x = rng.normal(size=(8, 5))
    m = {"W": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "o": rng.normal(size=4), "c": np.zeros(1)}

    def loss():
        p = Q._forward(m, x, sizes)[-1]
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    grad = Q._gradients(m, x, sizes, y, weight)
    for k, v in m.items():
        flat = v.reshape(-1)
        for i in range(0, flat.size, 3):
            old = flat[i]
            flat[i] = old + 1e-6
            up = loss()
            flat[i] = old - 1e-6
            down = loss()
            flat[i] = old
            assert grad[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_passages_cover_the_whole_text(monkeypatch):
    text = ("word " * 64 + "AB!! " * 64) * 5
    x = Q.passages(text.encode())
    assert len(x) == 10 and np.allclose(x[0], x[2]) and not np.allclose(x[0], x[1])
    assert Q.passages(b"").shape == Q.passages(b" \n ").shape == (1, Q.N_FEATURES)
    monkeypatch.setattr(Q, "_STEP", 1000)
    assert len(Q.passages(text.encode())) >= 10


def test_held_out_rows(spark):
    got = spark.range(200).select("id", Q.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_learns_and_never_from_held_out_rows(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(Q.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = Q.train(docs.repartition(3), flipped)
    assert all(np.array_equal(model.params[k], again.params[k]) for k in model.params)
    got = Q.scored(docs, model).join(labels.withColumnRenamed("doc_id", "id"), "id").filter("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in got)
    assert len(got) > 50 and right / len(got) >= 0.95


def test_query_against_held_out_labels(spark):
    """The registered query: every document once, scores between 0 and 1, and held-out labels told right."""
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    ids = [r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op10_passage_quality"](spark, sf_dir).collect()}
    assert sorted(got) == sorted(ids)
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(r["predicted"], labels[i]) for i, r in got.items() if r["held_out"] and labels.get(i) in (0, 1)]
    assert len(held) > 50 and sum(a == b for a, b in held) / len(held) >= 0.95
    for quality in (0, 1):
        assert sum(a == b for a, b in held if b == quality) / sum(b == quality for _, b in held) >= 0.9


def test_scores_follow_the_passages_and_not_their_order(spark):
    """The document is an attention-weighted mean of its passages: a plain version of the formula gives the same score."""
    rng = np.random.default_rng(3)
    bags = [rng.normal(size=(n, Q.N_FEATURES)) for n in (1, 4, 9)]
    model = Q.fit([rng.normal(size=(3, Q.N_FEATURES)) + y for y in (0, 1) * 20], np.array([0.0, 1.0] * 20), epochs=3)
    got = model.scores(np.vstack(bags), np.array([len(b) for b in bags]))
    m = model.params
    for bag, score in zip(bags, got, strict=True):
        h = np.tanh((bag - model.mean) / model.scale @ m["W"] + m["b"])
        e = np.array([m["w"] @ (np.tanh(v @ m["V"]) / (1 + np.exp(-(v @ m["U"])))) for v in h])
        a = np.exp(e) / np.exp(e).sum()
        assert score == pytest.approx(1 / (1 + np.exp(-((a[:, None] * h).sum(axis=0) @ m["o"] + m["c"][0]))))
        assert model.scores(bag[::-1], np.array([len(bag)]))[0] == pytest.approx(score)


def test_the_sample_is_bounded_in_rows_and_bytes(spark, monkeypatch):
    rows = [(i, f"text {i} " + "w " * 500) for i in range(60)] + [(3, "again")] * 500 + [(7, "long " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "fit", lambda bags, y, **_: seen.append((len(bags), sum(b.nbytes for b in bags))))
    Q.train(df, labels)
    Q.train(df, labels, sample_bytes=10_000)
    assert 30 < seen[0][0] < 60 and 5 <= seen[1][0] <= 10 and seen[1][1] < 60_000


def test_rows_of_every_kind(spark):
    rows = [(1, "good text here " * 20, 0.5), (1, "good text here " * 20, 0.5), (2, None, 0.5), (3, "", 0.5), (None, "x", 0.5), (4, "BAD!! " * 50_000, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").withColumn("row", F.lit("clash"))
    labels = spark.createDataFrame([(1, 1), (4, 0), (3, None), (9, 1)], "doc_id long, quality int")
    for model in (Q.train(df, labels), Q.train(df, labels.limit(0)), Q.train(df, labels.filter("quality = 1"))):
        got = Q.scored(df, model).collect()
        assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
        for threshold, n in ((0.0, len(rows)), (1.1, 0)):
            whole = Q.accepted(df, model, threshold=threshold)
            assert whole.columns == df.columns and whole.count() == n
            assert {r["score"] for r in whole.collect()} <= {0.5}
    assert Q.scored(df.limit(0), Q.train(df.limit(0), labels)).collect() == []
