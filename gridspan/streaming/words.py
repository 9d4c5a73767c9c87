"""An extension, not an operator of the surveyed engine: word counts and window counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.words import words


def streaming_word_count(lines: DataFrame, col: str = "text") -> DataFrame:
    return words(lines, col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n")
