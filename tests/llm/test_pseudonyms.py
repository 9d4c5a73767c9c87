import datetime
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridspan.llm import pseudonyms as P
from gridspan.llm.queries import QUERIES

KEY = P.derived_key(b"k", "pii")


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 5000), st.data())
def test_the_network_is_a_permutation(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = P.feistel(x, size, KEY, "t")
    assert 0 <= y < size and P.feistel(y, size, KEY, "t", back=True) == x


def test_small_sets_are_permuted_whole():
    assert sorted(P.feistel(i, 300, KEY, "t") for i in range(300)) == list(range(300))


CASES = [
    ("email", "write to ann.b-7@mail3.example.com now", "ann.b-7@mail3.example.com"),
    ("card", "card 4111 1111 1111 1111.", "4111 1111 1111 1111"),
    ("card", "5555555555554444!!", "5555555555554444"),
    ("ipv4", "from 192.168.17.3, ok", "192.168.17.3"),
    ("date", "born 1984-02-29.", "1984-02-29"),
    ("date", "on 31.12.1999", "31.12.1999"),
    ("date", "on 12/31/1999", "12/31/1999"),
    ("ssn", "id 123-45-6789", "123-45-6789"),
    ("phone", "call +1 (974) 555-3436", "+1 (974) 555-3436"),
    ("phone", "call (212) 555-0100 or", "(212) 555-0100"),
    ("iban", "IBAN GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"),
    ("secret", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "04dbebab91ab85687d33eeaaf9ac699e1188f962"),
    ("secret", '"9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!', "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"),
]


@pytest.mark.parametrize(("kind", "text", "value"), CASES)
def test_values_change_within_their_format_and_come_back(kind, text, value):
    new, found = P.pseudonymised(text, KEY)
    assert [(f[0], text[f[1] : f[2]]) for f in found] == [(kind, value)]
    assert value not in new and len(new) == len(text)
    assert P.pseudonymised(new, KEY, back=True)[0] == text
    assert P.pseudonymised("again " + text, KEY)[1][0][3] == found[0][3]


def test_results_are_valid():
    cards = [P.card(f"{i:015d}" + P.luhn_digit(f"{i:015d}"), KEY) for i in range(50)]
    assert all(P.luhn_digit(c[:-1]) == c[-1] for c in cards) and len(set(cards)) == 50
    for i in range(50):
        datetime.date.fromisoformat(P.date((datetime.date(2000, 1, 1) + datetime.timedelta(i)).isoformat(), KEY))
        assert all(0 <= int(x) <= 255 for x in P.ipv4(f"10.0.{i}.255", KEY).split("."))


def test_one_date_in_several_formats_stays_one():
    days = [P.date(x, KEY) for x in ("1999-12-31", "31.12.1999", "12/31/1999")]
    y, m, d = days[0].split("-")
    assert days[1] == f"{d}.{m}.{y}" and days[2] == f"{m}/{d}/{y}"


@pytest.mark.parametrize("text", ["4111111111111112", "2021-02-30", "256.1.1.1", "1.2.3.4.5", "Version 2.0 of 3.", "666-12-1234", "a@b", "GB00 WEST 1234 5698 7654 32", "@home 1234567", "deadbeef" * 5, "12345"])
def test_what_is_not_valid_stays(text):
    assert P.pseudonymised(text, KEY) == (text, [])


def test_rows_of_every_kind(spark):
    rows = [(1, "x 1984-02-28", 1), (1, "x 1984-02-28", 1), (2, None, 1), (3, "", 1), (None, "ip 10.20.30.40", 1), (4, "w " * 60_000 + "a@b.example.com", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii int").withColumn("rest", F.lit("clash")).withColumn("found", F.lit(2))
    out = P.pseudonyms(df, b"k")
    got = out.collect()
    assert out.columns == ["doc_id", "text", "rest", "found", "pii"] and len(got) == len(rows)
    back = P.pseudonyms(out, b"k", back=True, found_col=None).select("doc_id", "text").collect()
    assert sorted(map(str, back)) == sorted(map(str, df.select("doc_id", "text").collect()))
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    assert len({r["text"] for r in got if r["doc_id"] == 1}) == 1
    assert P.pseudonyms(df.limit(0), b"k").collect() == []
    assert P.pseudonyms(df.select("text"), b"k", found_col=None).count() == len(rows)


@pytest.mark.parametrize("value", ["31/12/1999", "13/01/1900", "29/02/1984", "31/12/2099"])
def test_slash_dates_with_the_day_first(value):
    new, found = P.pseudonymised(f"le {value}, ok", KEY)
    assert [(f[0], f[1], f[2]) for f in found] == [("date", 3, 13)] and value not in new
    assert datetime.datetime.strptime(new[3:13], "%d/%m/%Y").day > 12
    assert P.pseudonymised(new, KEY, back=True)[0] == f"le {value}, ok"


@pytest.mark.parametrize("value", ["13/13/1999", "31/02/1999", "30/02/2000", "31/12/1899"])
def test_slash_dates_of_no_calendar_stay(value):
    assert P.date(value, KEY) is None


def luhn(digits):
    """The sum of the card industry's check, written out."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10


def planted(seed=4):
    """Texts, the personal value in each (None: none), and whether it is valid; made without the operator."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    out = []
    for i in range(400):
        kind = i % 8
        if kind == 0:
            value, valid = f"{word()}.{digits(2)}@{word()}.example.com", True
        elif kind == 1:
            head = "4" + digits(14)
            value = head + next(c for c in "0123456789" if luhn(head + c) == 0)
            valid = True
        elif kind == 2:
            head = "4" + digits(14)
            value = head + next(c for c in "0123456789" if luhn(head + c) == 1)
            valid = False
        elif kind == 3:
            value, valid = ".".join(str(rng.randrange(256)) for _ in range(4)), True
        elif kind == 4:
            value, valid = f"{rng.randrange(256, 999)}.{rng.randrange(256)}.1.7", False
        elif kind == 5:
            day = datetime.date(1950, 1, 1) + datetime.timedelta(rng.randrange(25_000))
            value, valid = rng.choice([day.isoformat(), day.strftime("%d.%m.%Y"), day.strftime("%d/%m/%Y")]), True
        elif kind == 6:
            value, valid = f"+1 ({rng.randrange(200, 999)}) 555-{digits(4)}", True
        else:
            value, valid = f"19{rng.randrange(50, 99)}-13-{rng.randrange(10, 28)}", False
        out.append((f"{word()} {word()} {value} {word()}, {word()}.", value, valid))
    return out


def test_planted_values_go_and_nothing_else_changes(spark):
    """The registered query on texts with values made by the test itself: valid ones are replaced by others of their shape, invalid
    ones and all that stands around stay, and equal values are equal in all documents."""
    cases = planted()
    rows = [(i, t) for i, (t, _, _) in enumerate(cases)] + [(1000 + i, "again: " + t) for i, (t, _, _) in enumerate(cases)]
    got = {r["doc_id"]: r for r in P.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), b"k").collect()}
    for i, (text, value, valid) in enumerate(cases):
        at, new = text.index(value), got[i]["text"]
        assert new[:at] == text[:at] and new[at + len(value) :] == text[at + len(value) :] and len(new) == len(text)
        assert (new[at : at + len(value)] != value) == valid == bool(got[i]["pii"])
        shape = lambda v: "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in v)
        assert shape(new) == shape(text)
        assert got[1000 + i]["text"] == "again: " + new


def test_query_hides_what_a_plain_search_finds(spark, sf_dir):
    """Over the whole table: no e-mail, address, phone number or valid card number of the old text is in the new one, and texts without digits
    or "@" are as they were."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r["doc_id"]: r["text"] for r in QUERIES["op6_pseudonyms"](spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    seen = 0
    for i, text in docs.items():
        if not text or not any(c in "0123456789@" for c in text):
            assert got[i] == text
            continue
        values = re.findall(r"[a-zA-Z0-9.]+@[a-zA-Z0-9.]+\.com", text) + re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text)
        values += [x for x in re.findall(r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.])", text) if all(int(o) < 256 for o in x.split("."))]
        values += [x for x in re.findall(r"(?<!\d)\d{16}(?!\d)", text) if luhn(x) == 0]
        seen += len(values)
        assert not any(v in got[i] for v in values)
    assert seen > 0


def test_the_key_comes_from_the_session(spark):
    with pytest.raises(ValueError, match="no key"):
        P.pseudonyms(spark.createDataFrame([(1, "x")], "doc_id long, text string"), b"")
    assert P.session_key(spark) == P.session_key(spark) and len(P.session_key(spark)) == 32
    spark.conf.set(P.KEY_SETTING, "00ff")
    try:
        assert P.session_key(spark) == b"\x00\xff"
    finally:
        spark.conf.unset(P.KEY_SETTING)
