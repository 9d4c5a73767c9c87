import random

from pyspark.sql import functions as F

from gridspan.llm import host_quality as H


def brute_repeated(words, window=8):
    at = {}
    for i in range(len(words) - window + 1):
        at.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + k for where in at.values() if len(where) > 1 for i in where for k in range(window)})


def test_repeated_words_match_brute_force():
    rng = random.Random(5)
    for n in (0, 7, 8, 9, 16, 40, 300):
        for letters in ("ab", "abcdefgh"):
            words = [rng.choice(letters).encode() for _ in range(n)]
            assert H.repeated_words(words) == brute_repeated(words)


def test_stats_of_a_text():
    text = "a b\x1cc é\n#|\n\n#|\n \n#| x"
    assert H.text_stats(text) == (7, 12, 6, 1, 0)
    assert H.text_stats(None) == H.text_stats("") == (0,) * 5


def test_a_bad_host_loses_its_good_documents(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good, "fine") for i in range(40)] + [(100 + i, "too short", "bad") for i in range(38)] + [(200, good, "bad"), (201, good, None), (202, "too short", "fine"), (203, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("clash"))
    got = {r["id"]: r for r in H.judged(df).collect()}
    assert len(got) == len(rows)
    assert not got[200]["kept"] and not got[200]["base_failed"]
    assert got[201]["kept"] and not got[203]["kept"] and not got[202]["kept"]
    assert all(got[i]["kept"] for i in range(40))
    assert got[200]["host_rate"] > 0.5 > got[0]["host_rate"]


def test_one_host_and_no_rows(spark):
    df = spark.createDataFrame([(1, "w " * 30, "h"), (1, "w " * 30, "h")], "doc_id long, text string, source string")
    got = H.judged(df).collect()
    assert len(got) == 2 and all(r["base_failed"] for r in got)
    assert H.judged(df.limit(0)).collect() == []


def test_a_host_that_stands_out_loses_its_documents(spark):
    """Thirty hosts fail one document in twenty, one fails eight: below max_rate, but far above what the prior allows."""
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(100 * h + i, good if i >= (8 if h == 7 else 1 + h % 2) else "too short", f"h{h}") for h in range(30) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = H.judged(df).collect()
    assert {r["host"] for r in got if not r["kept"] and not r["base_failed"]} == {"h7"}
    assert all(r["kept"] for r in H.judged(df, spreads=100.0).collect() if not r["base_failed"])


def test_hosts_that_differ_by_chance_stay(spark):
    rng = random.Random(9)
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if rng.random() > 0.1 else "too short", f"h{i % 20}") for i in range(2000)]
    got = H.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)


def test_a_null_host_is_a_host_of_its_own(spark):
    rows = [(i, "too short", s) for i, s in enumerate([None, "\x00", "", "0", None, "1"])]
    got = H.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["id"] for r in got) == list(range(6))


def test_very_long_texts(spark):
    text = "same words come again here now " * 40_000 + "\n" + "x" * 500_000
    got = H.judged(spark.createDataFrame([(1, text, "h")], "doc_id long, text string, source string")).first()
    assert (got["n_words"], got["n_repeat_words"], got["base_failed"]) == (240_001, 240_000, True)
