"""Whitespace words and their counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "[ \\t\\n\\r\\f]+"


def words(text: DataFrame, col: str = "text") -> DataFrame:
    """(word): tokens between spaces, tabs, line ends and form feeds; none is empty."""
    return text.select(F.explode(F.split(F.col(col), BLANK)).alias("word")).filter("word <> ''")


def word_count(text: DataFrame, col: str = "text") -> DataFrame:
    return words(text, col).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


#: For SQL: a lateral table function with the tokens of a text and their places, to be filtered by word <> ''; every single blank ends a
#: place. A subquery with the filter in it would be planned as a join of the table with its distinct texts.
PLACED = r"lateral posexplode(split({0}, '[ \\t\\n\\r\\f]')) as placed(pos, word)"
