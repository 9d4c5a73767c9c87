import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F

from gridspan.llm import byte_bpe as B
from gridspan.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "ab cD'srel  \n\t\r\x0b\x1c" + "".join(map(chr, (0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0x200B, 0xE9, 0x301, 0x663, 0xB2, 0x1F600, 0x6F22))) + "1.,!?"


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(codec, text):
    raw = b"".join(codec.encode(text))
    assert codec.decode(raw) == text.encode()
    return np.frombuffer(raw, "<u4").tolist()


def test_perfect_hash_is_minimal_and_rejects_strangers(vocabulary):
    h = vocabulary.hash
    assert h.n == len(vocabulary.words) and None not in h.keys
    assert [h.find(w) for w in vocabulary.words] == list(range(h.n))
    assert {h.find(b"no such entry %d" % i) for i in range(500)} == {-1}
    assert B.PerfectHash([]).find(b"x") == -1


@pytest.mark.parametrize(("piece", "keep"), [(1 << 20, 160 << 20), (7, 160 << 20), (64, 2000)])
def test_random_texts_match_the_library(vocabulary, library, monkeypatch, piece, keep):
    monkeypatch.setattr(B, "_PIECE", piece)
    codec, rng = B.Codec(vocabulary, keep), random.Random(piece)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        assert ids(codec, text) == library.encode_ordinary(text)


def test_long_words_and_special_strings(vocabulary, library):
    codec = B.Codec(vocabulary)
    for text in ("z" * 3000, "<|endoftext|> a", "", " ", "don't WE'LL", "ab" * 700 + "\n" * 50):
        assert ids(codec, text) == library.encode_ordinary(text)


def test_rows_of_every_kind(spark, vocabulary, library):
    texts = [(1, "Hello  world\n"), (1, "Hello  world\n"), (2, None), (3, ""), (None, "x y"), (4, "word " * 50_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    got = B.encoded(df, vocabulary).collect()
    assert len(got) == len(texts)
    by = {r["id"]: r for r in got}
    for i, t in texts:
        want = library.encode_ordinary(t or "")
        assert by[i]["ids"] == want and by[i]["n_tokens"] == len(want)
        assert by[i]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert by[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = {r["id"]: bytes(r["bytes"]) for r in B.decoded(B.encoded(df, vocabulary), vocabulary).collect()}
    assert back[1] == b"Hello  world\n" and back[2] == b""
    assert B.encoded(df.limit(0), vocabulary).collect() == []


def test_every_code_point_is_of_the_librarys_class(vocabulary, library):
    """The library's classes, read off by patterns of one class and a vocabulary of bytes, against those of the expression used here;
    and whole encodings of the characters in which the two know another Unicode, and of every 61st."""
    every = list(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    codec = B.Codec(vocabulary)
    for kind in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s"):
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        want = bytes(probe.encode_ordinary("".join(every))).decode()
        assert "".join(regex.findall(B.Vocabulary({}, kind).exact, "".join(every))) == want
    assert codec.odd("\u088f")
    texts = [f"!{c}'s {c}9{c} a{c}" for i, c in enumerate(every) if i % 61 == 0 or codec.odd(c)]
    assert len(texts) > 30_000
    want = library.encode_ordinary_batch(texts, num_threads=4)
    assert all(b"".join(codec.encode(t)) == np.array(w, "<u4").tobytes() for t, w in zip(texts, want, strict=True))


def test_memory_is_bounded_in_bytes(vocabulary):
    codec = B.Codec(vocabulary, 1 << 20)
    for k in range(300):
        b"".join(codec.encode("x" * 4001 + f"{k}" + " ".join(f"w{k}n{i}" for i in range(100))))
    held = sum(codec.ENTRY + len(a) + len(b) for memory in (codec, codec.old) for a, b in memory.items())
    assert held <= 1 << 20 and max(map(len, codec)) <= codec.LONGEST


def test_query_matches_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op5_byte_bpe"](spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want, r = library.encode_ordinary(d["text"] or ""), got[d["doc_id"]]
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_a_text_without_spaces(vocabulary, library):
    text = "漢字かな交じり文。" * 30_000 + "z" * 20_000
    assert ids(B.Codec(vocabulary), text) == library.encode_ordinary(text)
