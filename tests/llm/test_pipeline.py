"""The pipeline against a plain version of each stage, on the smallest tables with rows of every kind added."""

import base64
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from gridspan.llm import passage_quality as Q
from gridspan.llm import pseudonyms as P
from tests.llm.test_mixing import brute_targets
from tests.llm.test_simhash import repeated_lines

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """documents with two columns of clashing names; null, empty, long, short and repeated texts; null and repeated ids; texts that
    share lines, and altered copies of a good text around the threshold."""
    path = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = [r["text"] for r in docs.orderBy("doc_id").collect()]
    long = max(base, key=len)
    words = next(t for t in base if 100 < len(t.split()) < 300).split()
    rows = [(5000, None, "src0"), (5001, "", "src0"), (5002, " \n ", None), (None, None, None), (5003, "x", "src1")]
    rows += [(None, base[3] + " own words one", "src2"), (None, base[4] + " other words two", "src2"), (5004, base[5], "src3"), (5004, base[6] + " and again", "src3"), (5004, base[6] + " and again", "src3")]
    rows += [(5005, " ".join([long] * 40), "src4"), (5006, "mail ann.b@mail3.example.com from 10.20.30.40 " + base[7], None)]
    for k, changes in enumerate((1, 2, 3, 4, 6, 8, 12)):
        altered = list(words)
        for at in np.linspace(7, len(words) - 7, changes).astype(int):
            altered[at] = f"changed{k}"
        rows.append((5100 + k, " ".join(altered), "src5"))
    rows += [(6000 + i, t, "src6") for i, t in repeated_lines(9).items()]
    more = spark.createDataFrame(rows, "doc_id long, text string, source string")
    both = docs.select("doc_id", "text", "lang", "source", "n_chars").unionByName(more, allowMissingColumns=True)
    both.withColumns({"score": F.lit(0.25), "predicted": F.lit("mine"), "row": F.lit(1), "id": F.lit("i")}).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def staged(spark, tables):
    """What every stage makes of the one before it, as rows; stages[0] is the input."""
    docs, out = spark.read.parquet(f"{tables}/documents.parquet"), {}
    out["documents"] = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, tables), name)
        out[name] = docs.collect()
    return out


def test_quality(spark, tables, staged):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = Q.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    score = {t: model.scores(x, np.array([len(x)]))[0] for t in {r["text"] for r in staged["documents"]} for x in [Q.passages((t or "").encode()).astype(float)]}
    assert Counter(staged["quality"]) == Counter(r for r in staged["documents"] if score[r["text"]] >= 0.7)
    assert 50 < len(staged["quality"]) < len(staged["documents"])
    assert {(r["score"], r["predicted"]) for r in staged["quality"]} == {(0.25, "mine")}


def classes(texts):
    sets = [frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset() for t in texts for w in [(t or "").encode().lower().split()]]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (a == b) or (a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b)):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("source", ["documents", "quality"])
def test_near_dedup(spark, staged, source):
    """One row of each class of exact Jaccard similarity stays: one of the least id."""
    rows = staged[source]
    if source == "quality":
        kept = staged["near_dedup"]
    else:
        schema = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, row int, id string"
        kept = STAGES["near_dedup"](spark, spark.createDataFrame(rows, schema), "").collect()
    of, least = {}, {}
    for r, c in zip(rows, classes([r["text"] for r in rows]), strict=True):
        of[r["text"]] = c
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        least[c] = min(least.get(c, key), key)
    assert not Counter(kept) - Counter(rows)
    assert sorted(of[r["text"]] for r in kept) == sorted(least)
    assert all((r["doc_id"] is None, r["doc_id"] or 0) == least[of[r["text"]]] for r in kept)
    assert len(kept) < len(rows)


def test_pii(spark, staged):
    key = P.derived_key(P.session_key(spark), "pii")
    want = Counter((r["doc_id"], P.pseudonymised(r["text"], key)[0], r["source"], r["score"]) for r in staged["near_dedup"])
    assert Counter((r["doc_id"], r["text"], r["source"], r["score"]) for r in staged["pii"]) == want


def test_mix(staged):
    before, after = Counter(staged["pii"]), Counter(staged["mix"])
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    size = lambda r: len((r["text"] or "").encode().split())
    total, taken, largest = Counter(), Counter(), Counter()
    for r, n in before.items():
        total[r["source"]] += n * size(r)
        taken[r["source"]] += after[r] * size(r)
        largest[r["source"]] = max(largest[r["source"]], size(r))
    want = brute_targets(dict(total))
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in want)


def test_encode(staged):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r, n in Counter((r["doc_id"], r["text"]) for r in staged["mix"]).items():
        ids = np.array(library.encode_ordinary(r[1] or ""), "<u4")
        want[r[0], len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()] += n
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in staged["encode"]) == want


def test_run_is_the_stages_one_after_another(spark, tables, staged):
    got = corpus_pipeline.run(spark, tables).collect()
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in got) == Counter((r["doc_id"], r["ids_sha256"]) for r in staged["encode"])


def test_columns_and_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        assert out.collect() == []
        assert name == "encode" or out.columns == docs.columns
