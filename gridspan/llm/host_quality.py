"""Quality rules per document, and verdicts per host.

Each document gets its statistics and a base verdict. Failures are summed by host (partial aggregation, so a hot host costs no
more than others), the rates are shrunk towards an empirical beta prior fitted to all hosts by moments, and a host whose
shrunk rate stands out from that prior loses all its documents when the verdicts are joined back."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, join_on, written

SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by windows of `window` (a power of two) words that occur twice or more; exact, by doubling ranks."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    size = 1
    while size < window:
        pairs = rank[: len(rank) - size] * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        size *= 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, the five statistics, base_failed): fewer than 20 words, or over 30 % of the words in repeated windows."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([text_stats(x.as_py()) for x in batch.column(2)], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, i]) for i in range(len(STATS)))], ["id", "host", *STATS])

    out = slim.mapInArrow(run, f"id {kind}, host string, " + ", ".join(f"{x} bigint" for x in STATS))
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def host_rates(rules: DataFrame) -> DataFrame:
    """(host, n_docs, n_failed): one row a host; a null host is a host of its own."""
    return rules.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """(a, b) by moments of the hosts' rates; a flat prior (1, 1) where they have no usable spread (one host, equal rates)."""
    rate = F.col("n_failed") / F.col("n_docs")
    row = rates.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v")).first()
    m, v = row["m"], row["v"]
    if m is None or not 0 < m < 1 or v < 1e-12 or v >= m * (1 - m):
        return 1.0, 1.0
    k = m * (1 - m) / v - 1
    return m * k, (1 - m) * k


def host_limit(a: float, b: float, spreads: float, max_rate: float) -> float:
    """The shrunk rate above which a host is bad: `spreads` standard deviations of the prior above its mean, max_rate at most. A host
    of chance failures is shrunk to well below it, so hosts that differ by chance alone all stay."""
    m = a / (a + b)
    return min(max_rate, m + spreads * math.sqrt(m * (1 - m) / (a + b + 1)))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", spreads: float = 2.0, max_rate: float = 0.5) -> DataFrame:
    """(id, host, statistics, base_failed, host_rate, kept) for every row.

    host_rate = (n_failed + a) / (n_docs + a + b); kept: the document passes and host_rate <= host_limit, which the prior sets. Null texts
    have no words; a null host counts as one host, apart from every other; repeated rows count each; other columns are not
    read. A very long text is held in one worker, with its words and lines, a few times its size. An empty table gives an
    empty result."""
    rules = written(document_rules(docs, id_col, text_col, host_col), "rules")
    rates = host_rates(rules)
    a, b = beta_prior(rates)
    # One string for each host, null included: a null host is "0", any other "1" and its name.
    key = F.coalesce(F.concat(F.lit("1"), F.col("host")), F.lit("0"))
    verdicts = rates.select(key.alias("hk"), ((F.col("n_failed") + a) / (F.col("n_docs") + a + b)).alias("host_rate"))
    out = join_on(rules.withColumn("hk", key), verdicts, "hk", "left").drop("hk")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= host_limit(a, b, spreads, max_rate)))
