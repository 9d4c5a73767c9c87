"""PII: format-preserving Feistel pseudonyms.

Personal values are found by patterns and validated (card numbers by the Luhn sum, addresses by their octets, dates by the calendar);
each is then permuted within the set of all values of its format by a keyed Feistel network, walking on until the
result is valid again. It is a permutation, so equal values keep equal pseudonyms in all documents, unequal ones stay apart, and
the holder of the key can reverse it. Formats (lengths, separators, letter case) stay. Nothing is shuffled."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches

ROUNDS = 10
#: The session's setting that holds the key, as hexadecimal digits.
KEY_SETTING = "spark.gridspan.pseudonymKey"
_drawn: dict[str, bytes] = {}


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's configuration names. Where it names none, a random key of this application, which ends with it: equal
    values are then linked within its results, and nobody can reverse them."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return bytes.fromhex(named)
    return _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))



def feistel(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """value permuted within 0 .. size - 1, by a balanced network over the next even number of bits and cycle walking."""
    if size < 2:
        return value
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            seen = left if back else right
            data = f"{tweak}|{size}|{r}|{seen}".encode()
            f = int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=(half + 7) // 8).digest(), "big") & mask
            left, right = (right ^ f, left) if back else (right, left ^ f)
        value = left << half | right
        if value < size:
            return value


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _put_digits(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c in "0123456789" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def _number(text: str, key: bytes, tweak: str, back: bool) -> str:
    d = _digits(text)
    return _put_digits(text, str(feistel(int(d), 10 ** len(d), key, f"{tweak}{len(d)}", back)).zfill(len(d)))


def card(text: str, key: bytes, back: bool = False) -> str | None:
    """13 to 19 digits with a valid Luhn sum; the check digit follows the others, so the result is valid, too."""
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    p = str(feistel(int(d[:-1]), 10 ** (len(d) - 1), key, f"card{len(d)}", back)).zfill(len(d) - 1)
    return _put_digits(text, p + luhn_digit(p))


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """The country code stays; the 7 to 14 digits after it are permuted."""
    m = re.match(r"\+\d{1,3}(?=[^\d])|\+\d", text)
    head = m.group() if m else ""
    rest = text[len(head) :]
    return head + _number(rest, key, "phone", back) if 7 <= len(_digits(rest)) <= 14 else None


def ssn(text: str, key: bytes, back: bool = False) -> str | None:
    """Area 001 to 899 but 666, group 01 to 99, serial 0001 to 9999."""

    def index(d: str) -> int | None:
        a, g, s = int(d[:3]), int(d[3:5]), int(d[5:])
        if not (0 < a < 900 and a != 666 and g and s):
            return None
        return ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1

    d = _digits(text)
    at = index(d)
    if at is None:
        return None
    at = feistel(at, 898 * 99 * 9999, key, "ssn", back)
    a, s = divmod(at, 9999)
    a, g = divmod(a, 99)
    return _put_digits(text, f"{a + 1 + (a + 1 >= 666):03d}{g + 1:02d}{s + 1:04d}")


def ipv4(text: str, key: bytes, back: bool = False) -> str | None:
    """Among the addresses whose octets have as many digits, so the length stays."""
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]
    size, value = 1, 0
    for p, (low, n) in zip(parts, ranges, strict=True):
        size, value = size * n, value * n + int(p) - low
    value = feistel(value, size, key, "ipv4" + ".".join(str(n) for _, n in ranges), back)
    out = []
    for low, n in reversed(ranges):
        value, d = divmod(value, n)
        out.append(str(low + d))
    return ".".join(reversed(out))


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    """Valid by mod 97; country and letters stay, account digits are permuted, check digits follow."""

    def check(country: str, account: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97

    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or f"{check(flat[:2], flat[4:]):02d}" != flat[2:4]:
        return None
    account = _number(flat[4:], key, f"iban{flat[:2]}", back) if _digits(flat[4:]) else flat[4:]
    it = iter(f"{flat[:2]}{check(flat[:2], account):02d}{account}")
    return "".join(" " if c == " " else next(it) for c in text)


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2099, 12, 31).toordinal() - _FIRST + 1
#: Days from _FIRST whose day/month/year cannot be read as month/day/year.
_DAY_FIRST = [i for i in range(_DAYS) if datetime.date.fromordinal(_FIRST + i).day > 12]


def _day_first(y: int, month: int, day: int, key: bytes, back: bool) -> str | None:
    try:
        at = datetime.date(y, month, day).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    at = _DAY_FIRST[feistel(bisect.bisect_left(_DAY_FIRST, at), len(_DAY_FIRST), key, "date day first", back)]
    return datetime.date.fromordinal(_FIRST + at).strftime("%d/%m/%Y")


def date(text: str, key: bytes, back: bool = False) -> str | None:
    """Calendar dates of 1900 to 2099, year first or last; one set for all formats, so a date keeps its pseudonym in each.
    With slashes the month comes first; where that is no date, the day, and such dates are a set of their own."""
    m = re.fullmatch(r"(\d{4})([-/.])(\d{2})\2(\d{2})", text)
    n = re.fullmatch(r"(\d{2})([-/.])(\d{2})\2(\d{4})", text)
    if m:
        y, month, day = int(m[1]), int(m[3]), int(m[4])
    elif n and n[2] == "/":
        y, month, day = int(n[4]), int(n[1]), int(n[3])
        if month > 12:
            return _day_first(y, day, month, key, back)
    elif n:
        y, month, day = int(n[4]), int(n[3]), int(n[1])
    else:
        return None
    try:
        at = datetime.date(y, month, day).toordinal() - _FIRST
    except ValueError:
        return None
    if not 0 <= at < _DAYS:
        return None
    d = datetime.date.fromordinal(_FIRST + feistel(at, _DAYS, key, "date", back))
    if m:
        return f"{d.year:04d}{m[2]}{d.month:02d}{m[2]}{d.day:02d}"
    return f"{d.month:02d}/{d.day:02d}/{d.year:04d}" if n[2] == "/" else f"{d.day:02d}{n[2]}{d.month:02d}{n[2]}{d.year:04d}"


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _letters(text: str, key: bytes, tweak: str, back: bool) -> str:
    """Letters and digits permuted within their classes, place by place in one mixed-radix number; the rest stays."""
    bases = [next((b for b in (_LOWER, _UPPER, "0123456789") if c in b), None) for c in text]
    size, value = 1, 0
    for c, b in zip(text, bases, strict=True):
        if b:
            value, size = value * len(b) + b.index(c), size * len(b)
    value = feistel(value, size, key, f"{tweak}{''.join('x' if b is None else b[0] for b in bases)}", back)
    out = []
    for c, b in zip(reversed(text), reversed(bases), strict=True):
        if b:
            value, d = divmod(value, len(b))
            c = b[d]
        out.append(c)
    return "".join(reversed(out))


def email(text: str, key: bytes, back: bool = False) -> str | None:
    """Letters and digits of the local part and of the domain but its last label; the shape stays."""
    local, _, domain = text.rpartition("@")
    name, dot, top = domain.rpartition(".")
    return f"{_letters(local, key, 'local', back)}@{_letters(name, key, 'domain', back)}{dot}{top}"


def secret(text: str, key: bytes, back: bool = False) -> str | None:
    """Hexadecimal strings stay hexadecimal, in their case, and keep both letters and digits; other tokens keep their prefix."""
    if not re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        head = "AKIA" if text.startswith("AKIA") else text[: text.index("_") + 1]
        return head + _letters(text[len(head) :], key, "secret", back)
    value, n = int(text, 16), len(text)
    while True:
        value = feistel(value, 16**n, key, "hex", back)
        out = f"{value:0{n}x}"
        if not out.isdigit() and not out.isalpha():
            return out.upper() if text == text.upper() else out


#: Kind, pattern, pseudonym; earlier kinds win where matches overlap.
KINDS: list[tuple[str, str, Callable[..., str | None]]] = [
    ("email", r"(?<![\w.+%-])(?=[\w.+%-]{1,64}@)[A-Za-z0-9](?:[\w.+%-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])", email),
    ("secret", r"(?<![A-Za-z0-9])(?=[A-Za-z]*[0-9])(?=[0-9]*[A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:ghp|gho|sk|pk)_[A-Za-z0-9]{20,64})(?![A-Za-z0-9])", secret),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", iban),
    ("ipv4", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", ipv4),
    ("date", r"(?<![\d/.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d/-])", date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("card", r"(?<![\d.-])(?:\d{13,19}|\d{4}([-/ ])\d{4}\1\d{4}\1\d{4}|\d{4}([-/ ])\d{6}\2\d{5})(?![\d-])", card),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[.-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])", phone),
]
_ANY = re.compile("(?<![A-Za-z0-9_])(?=[A-Za-z0-9+(])(?:" + "|".join(f"(?P<{k}>{re.sub(r'[\\]([12])', lambda m, k=k: f'(?P=_{k}{m[1]})', re.sub(r'[(](?=\[-/)', lambda m, c=iter('12'), k=k: f'(?P<_{k}{next(c)}>', p))})" for k, p, _ in KINDS) + ")", re.ASCII)
_MARK = re.compile(r"[0-9@]+")
_BY_KIND = {k: f for k, _, f in KINDS}


def _zones(text: str) -> Iterator[list[int]]:
    """Stretches around digits and "@": every value holds one, and none is longer than what is added on either side."""
    zone: list[int] = []
    for m in _MARK.finditer(text):
        if zone and m.start() - 140 <= zone[1]:
            zone[1] = m.end() + 320
        else:
            if zone:
                yield zone
            zone = [max(0, m.start() - 140), m.end() + 320]
    if zone:
        yield zone


def pseudonymised(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and (kind, start, end, pseudonym) of each value, in code points of the input."""
    if not text:
        return text, []
    out, found, at = [], [], 0
    for pos, stop in _zones(text):
        while m := _ANY.search(text, pos, stop):
            kind, end = next(k for k in _BY_KIND if m[k] is not None), m.end()
            new = _BY_KIND[kind](m[kind], key, back)
            if new is None:
                # Not valid as this kind: another kind may start at the same place.
                others = ((k, x.end(), f(x.group(), key, back)) for k, _, f in KINDS if k != kind and (x := _SINGLE[k].match(text, m.start())))
                kind, end, new = next((y for y in others if y[2] is not None), ("", 0, None))
            if new is None:
                pos = m.start() + 1
                continue
            out += [text[at : m.start()], new]
            found.append((kind, m.start(), end, new))
            at = pos = end
    return "".join([*out, text[at:]]), found


_SINGLE = {k: re.compile(p, re.ASCII) for k, p, _ in KINDS}


def derived_key(key: bytes, purpose: str) -> bytes:
    return hmac.new(key, purpose.encode(), hashlib.sha256).digest()


def pseudonyms(docs: DataFrame, key: bytes, text_col: str = "text", back: bool = False, found_col: str | None = "pii") -> DataFrame:
    """All columns of docs, with pseudonyms in the text column; with found_col also an array of (kind, start, end, value), the
    places in the old text and what stands there now. With back and the same key the values return.

    A null text stays null; every row is taken by itself, so repeated rows get equal results. An existing column named found_col
    is replaced. Texts are searched around their digits and "@" alone, so a very long one costs a pass and its own size a few
    times. An empty key is refused. An empty table gives an empty result."""
    if not key:
        raise ValueError("pseudonyms: no key")
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != found_col]
    own = derived_key(key, "pii")
    item = "array<struct<kind:string,start:int,end:int,value:string>>"
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept if c != text_col]).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text")) if len(kept) > 1 else docs.select(F.struct(F.lit(0).alias("_0")).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, found = [], []
            for x in batch.column(1):
                new, items = pseudonymised(x.as_py(), own, back)
                text.append(new)
                found.append([dict(zip(("kind", "start", "end", "value"), i, strict=True)) for i in items])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string()), pa.array(found, kind)], ["rest", "text", "found"])

    out = slim.mapInArrow(run, f"rest {slim.schema['rest'].dataType.simpleString()}, text string, found {item}")
    columns = [F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in kept]
    return out.select(*columns, *([F.col("found").alias(found_col)] if found_col else []))
