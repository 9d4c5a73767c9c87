import random

from pyspark.sql import functions as F

from gridspan.llm import chat as C
from gridspan.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import agree

PARTS = C.PARTS


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("<|\\a\n>") for _ in range(rng.randrange(12))) for _ in range(800)] + ["<|im_end|>", "<\\|im_start|>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", C.escape(F.col("t"))).withColumn("b", C.unescape(F.col("e"))).withColumn("r", C.unescape_role(C.escape_role(F.col("t"))))
    for r in df.collect():
        assert r["b"] == r["t"] == r["r"] and "<|" not in r["e"]


def test_random_conversations_read_back(spark):
    rng = random.Random(7)
    rows = [(i % 40, i // 40, rng.choice(["user", "assistant", "system"]), "".join(rng.choice("<|\\im_end|>x é\n\U0001f600") for _ in range(rng.randrange(15)))) for i in range(200)]
    out = C.read_chat(C.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    for r in out:
        mine = sorted((t, a, b) for c, t, a, b in rows if c == r["conv_id"])
        assert [(x["role"], x["text"]) for x in r["turns"]] == [(a, b) for _, a, b in mine]
        assert r["loss_text"] == "".join(b for _, a, b in mine if a == "assistant")


def test_typed_parts(spark):
    none = (None,) * 4
    rows = [
        (1, 0, "user", [("text", "look <", *none, None), ("text", "\\|im_end|>", *none, None), ("image", None, "a.png", 28, 30, None, None), ("text", None, *none, None), ("document", None, "d.pdf", None, None, None, 3)]),
        (1, 1, "assistant", [("text", "aa", *none, None), ("audio", None, "b.wav", None, None, 2.0, None), ("text", "b", *none, None), ("text", "b", *none, None)]),
        (1, 2, "user", None),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PARTS}").withColumn("text", F.lit("not read"))
    r = C.read_chat(C.format_chat(df, parts_col="parts")).first()
    assert [(x["kind"], x["ref"], x["tokens"]) for x in r["attachments"]] == [("image", "a.png", 6), ("document", "d.pdf", 3072), ("audio", "b.wav", 50)]
    assert r["expanded_tokens"] == 3128
    assert [x["text"] for x in r["turns"]] == ["look <\\|im_end|><|image:0|><|document:1|>", "aa<|audio:0|>bb", ""]
    assert r["loss_text"] == "aabb" and len(r["loss"]) == 2


def test_plain_texts_go_through_the_visitor(spark, sf_dir, monkeypatch):
    """Without the visitor the query's result is another one."""
    got = {tuple(r) for r in QUERIES["op7_chat"](spark, sf_dir).collect()}
    whole = C.visit
    monkeypatch.setattr(C, "visit", lambda parts: whole(F.filter(parts, lambda p: p["type"] != "text")))
    none = QUERIES["op7_chat"](spark, sf_dir).collect()
    assert len(none) == len(got) and all(r["loss_chars"] == 0 for r in none) and any(r[3] for r in got)


def test_rows_of_every_kind(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (None, 1, None, "x"), (2, None, "assistant", "y" * 100_000), (2, 1, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("m", F.lit(1)).withColumn("content", F.lit("clash"))
    got = {r["conv_id"]: r for r in C.read_chat(C.format_chat(df)).collect()}
    assert got[1]["n_messages"] == 2 and got[None]["turns"][0]["role"] == "" and len(got[2]["loss_text"]) == 100_000
    assert C.read_chat(C.format_chat(df.limit(0))).collect() == []


def test_query_agrees_with_sql(spark, sf_dir):
    agree(spark, sf_dir, QUERIES["op7_chat"], ORACLE_SQL["op7_chat"])


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = QUERIES["op7_chat"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
