"""Queries over the smallest tables: those with SQL against it, the others against brute force."""

import zlib

import numpy as np
import pandas as pd

from gridspan.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.test_mixing import brute_targets
from tests.llm.test_pseudonyms import P
from tests.llm.test_sharding import brute as brute_shards
from tests.llm.test_sharding import buckets_of
from tests.llm.test_simhash import brute_classes, brute_fingerprint
from tests.llm.test_token_store import brute as brute_store
from tests.oracle import agree


def documents(sf_dir):
    return pd.read_parquet(f"{sf_dir}/documents.parquet")


def test_op1(spark, sf_dir):
    docs = documents(sf_dir)
    prints = [brute_fingerprint(t) for t in docs.text]
    want = brute_classes(docs.doc_id.tolist(), prints)
    got = {r["doc_id"]: r for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in zip(docs.doc_id, prints, strict=True)}


def test_op2(spark, sf_dir):
    agree(spark, sf_dir, QUERIES["op2_host_quality"], ORACLE_SQL["op2_host_quality"])


def test_op3(spark, sf_dir):
    docs = documents(sf_dir)
    plain = list(zip(docs.doc_id.tolist(), docs.text, strict=True))
    want = {i: x for (i, _), x in brute_shards(plain, 24, 7, buckets_of(plain)).items()}
    text = docs.set_index("doc_id").text
    for r in QUERIES["op3_sharding"](spark, sf_dir).collect():
        data = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 8, zlib.crc32(data), "rows", None)
        assert (r["shard"], r["slot"]) == want.pop(r["doc_id"])
    assert not want


def test_op4(spark, sf_dir):
    docs = documents(sf_dir)
    docs["size"] = [len(t.encode().split()) for t in docs.text]
    totals = docs.groupby("source")["size"].sum().to_dict()
    want = brute_targets(totals)
    got = QUERIES["op4_mixing"](spark, sf_dir).toPandas().merge(docs[["doc_id", "source", "size"]], on="doc_id", suffixes=("", "_"))
    assert len(got) == len(docs) and (got["size"] == got["size_"]).all() and (got.taken % got["size"].clip(lower=1) == 0).all()
    for s, g in got.groupby("source"):
        assert np.allclose(g.target, want[s]) and (g.source_size == totals[s]).all() and (g.taken <= 2 * g["size"]).all()
        assert abs(g.taken.sum() - want[s]) <= g["size"].max()


def test_op6(spark, sf_dir):
    docs = documents(sf_dir).set_index("doc_id").text
    key = P.derived_key(P.session_key(spark), "pii")
    got = {r["doc_id"]: r for r in QUERIES["op6_pseudonyms"](spark, sf_dir).collect()}
    assert set(got) == set(docs.index)
    for i, text in docs.items():
        assert P.pseudonymised(got[i]["text"], key, back=True)[0] == text
        for f in got[i]["pii"]:
            assert text[f["start"] : f["end"]] not in got[i]["text"] or f["value"] == text[f["start"] : f["end"]]


def test_op9(spark, sf_dir):
    docs = documents(sf_dir)
    want = brute_store(list(zip(docs.doc_id.tolist(), docs.text, strict=True)))
    assert sorted(map(tuple, QUERIES["op9_token_store"](spark, sf_dir).collect()), key=lambda r: r[1]) == want
