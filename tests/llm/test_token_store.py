import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridspan.llm import token_store as T

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return f.read()


def test_pieces_match_the_library(model):
    library, own, rng = Tokenizer.from_file(PATH), T.WordTokenizer(model, 400), random.Random(5)
    letters = "ab\u00c9\u00dfÿŁŉZ É'st.,!12 \n\t" + "".join(map(chr, (0x301, 0xA0, 0x3000, 0x130, 0x3A3, 0x1F600))) + "<|endoftext|>"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(800)] + ["<|endoftext|>", "<|ENDOFTEXT|> x<|endoftext|>y", "", "Hello, World. It's ok..."]
    for text in texts:
        got = np.frombuffer(b"".join(own.encode(text)), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text
        assert b"".join(own.encode(text, 3)) == b"".join(own.encode(text))


def test_plain_pieces_need_no_normalization_by_the_library(model):
    """ASCII and Latin pieces with marks, digits or contractions go to the model of merges alone, with the library's ids."""
    library, rng = Tokenizer.from_file(PATH), random.Random(7)
    visible = "".join(map(chr, (*range(0x21, 0x7F), *(x for x in range(0xC0, 0x180) if x not in (0xD7, 0xF7, 0x130)))))
    pieces = ["".join(rng.choice(rng.choice((visible, "aeST'''.,$19éÑŁŉſĸ"))) for _ in range(rng.randrange(1, 12))) for _ in range(4000)]
    pieces += [*visible, "theaan$$$", "Reñido.", "CIÓN,%%%", "don't", "WE'LL", "'sx", "$'s", "''d'rex've", "a.43@mail5.example.com", "x'"]
    pieces = [x for x in pieces if "<|" not in x]
    for keep in (400, 1 << 24):
        own = T.WordTokenizer(model, keep)
        own.model = None
        got = np.frombuffer(b"".join(own.encode(" ".join(pieces))), "<u4").tolist()
        assert got == [x for e in library.encode_batch_fast(pieces, add_special_tokens=False) for x in e.ids]
    own = T.WordTokenizer(model)
    for x in ("x<|endoftext|>y", "É<|startoftext|>", "<|ENDOFTEXT|>", "a<|b"):
        assert np.frombuffer(b"".join(own.encode(x)), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids


def text_order(text):
    """xxhash64 of SQL, by which texts of one id are ordered: a null leaves the seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - 2**64 if h >= 2**63 else h


def brute(rows):
    library, at, out = Tokenizer.from_file(PATH), 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_order(r[1]))):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_files_read_back(spark, model, files):
    rng = random.Random(1)
    rows = [(i * 7 % 211, " ".join(rng.choice(["the", "Word", "of", "été", "x1."]) for _ in range(rng.randrange(40)))) for i in range(211)] + [(None, "no id"), (-(2**63), "least id"), (3, None), (3, ""), (500, "long " * 40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash"))
    manifest, dictionary = T.write_store(df, model, 2, files=files)
    got = [tuple(r) for r in T.read_store(manifest, dictionary).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows)
    r = manifest.orderBy("file").first()
    reader = T.Reader(r["path"], dictionary)
    assert [x[0] for x in brute(rows)][1] == reader.entries["id"][1] and reader.entries["none"].tolist()[:2] == [1, 0]
    scanned = [raw for block in (1, 100, 1 << 20) for _, documents in reader.scan(block) for raw in documents]
    assert scanned == [reader.ids(k) for k in range(len(reader.entries))] * 3
    assert zlib.crc32(reader.ids(2)) == reader.entries["crc"][2]
    with pytest.raises(ValueError, match="another dictionary"):
        T.Reader(r["path"], b"other")


def test_a_hot_id_is_dealt_over_files_and_the_sample_is_bounded(spark, model):
    """Half of the rows have no id, others share one: several files hold them, and the dictionary learns from one row an id."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.lit(5)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("word "), F.col("id")).alias("text"))
    manifest, dictionary = T.write_store(df, model, 2, files=6)
    assert max(r["n_docs"] for r in manifest.collect()) < 1500
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert sorted(map(tuple, T.read_store(manifest, dictionary).collect()), key=lambda r: r[1]) == brute(rows)


def test_files_follow_the_bytes(spark, model, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 1000)
    df = spark.range(90).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x "), 50).alias("text"))
    manifest, _ = T.write_store(df, model, 2)
    assert 7 <= manifest.count() <= 9


def test_an_empty_table(spark, model):
    manifest, dictionary = T.write_store(spark.createDataFrame([], "doc_id long, text string"), model, 2)
    assert T.read_store(manifest, dictionary).collect() == []
