"""Text and block scans: edge lists, node vectors, packed block texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def edge_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(src, dst) from lines `src TAB dst`; comments (#) and lines without exactly two columns are skipped."""
    parts = F.split(F.col(col), "\t", -1)
    good = lines.filter(~F.col(col).startswith("#") & (F.size(parts) == 2))
    return good.select(parts[0].cast("bigint").alias("src"), parts[1].cast("bigint").alias("dst"))


def vector_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """(node, rank) from lines `node TAB value TAB vec`, the records of a node vector among the lines of a mixed file."""
    parts = F.split(F.col(col), "\t", -1)
    good = lines.filter(~F.col(col).startswith("#") & (F.size(parts) == 3) & (parts[2] == "vec"))
    return good.select(parts[0].cast("bigint").alias("node"), parts[1].cast("double").alias("rank"))


def block_lines(lines: DataFrame, col: str = "value", values: bool = True) -> DataFrame:
    """(brow, bcol, entries) from lines `brow TAB bcol TAB col row val ...`; comments and lines of another form are skipped."""
    parts = F.split(F.col(col), "\t", -1)
    good = lines.filter(~F.col(col).startswith("#") & (F.size(parts) == 3) & parts[0].rlike(r"\A\d+\z") & parts[1].rlike(r"\A\d+\z"))
    return good.select(parts[0].cast("int").alias("brow"), parts[1].cast("int").alias("bcol"), parse_matrix_block(parts[2], values).alias("entries"))


def state_lines(lines: DataFrame, masks: int, col: str = "value") -> DataFrame:
    """Mixed lines of a radius run as typed rows (kind, node, other, status, history, masks):

    `node TAB bs<status><r>[:hop:nh]* m m ...` is a node's `state`: its status, the estimates of its hops, its masks in hexadecimal;
    `node TAB c` is a `command` to make the node's masks; any other line of two columns or more is an `edge`, read inverted, so that
    node is its end and other its start. Comments and lines of one column are skipped; a state of another number of masks is
    an error."""
    parts = F.split(F.col(col), "\t", -1)
    good = lines.filter(~F.col(col).startswith("#") & (F.size(parts) >= 2)).select(parts[0].alias("a"), parts[1].alias("b"))
    kind = F.when(F.col("b").startswith("b"), "state").when(F.col("b").startswith("c"), "command").otherwise("edge")
    words = _numbers(F.col("b"))
    marks = F.split(F.get(words, F.lit(0)), ":", -1)
    hops = (F.size(marks) / 2).cast("int")
    history = F.when(hops > 0, F.transform(F.sequence(F.lit(1), hops), lambda i: F.struct(F.get(marks, i * 2 - 1).cast("int").alias("hop"), F.get(marks, i * 2).cast("double").alias("nh")))).otherwise(F.from_json(F.lit("[]"), "array<struct<hop:int,nh:double>>"))
    found = F.transform(F.slice(words, F.lit(2), F.size(words)), lambda m: F.conv(m, 16, 10).cast("bigint"))
    checked = F.when(F.size(found) == masks, found).otherwise(F.raise_error(F.concat(F.lit("masks of node "), F.col("a"))))
    state, edge = kind == "state", kind == "edge"
    return good.select(
        kind.alias("kind"),
        F.when(edge, F.col("b")).otherwise(F.col("a")).cast("bigint").alias("node"),
        F.when(edge, F.col("a")).cast("bigint").alias("other"),
        F.when(state, F.substr(F.col("b"), F.lit(3), F.lit(1))).alias("status"),
        F.when(state, history).alias("history"),
        F.when(state, checked).alias("masks"),
    )


def format_state(node: Column, status: Column, history: Column, masks: Column) -> Column:
    """A state line; history is an array of (hop, nh), masks an array of numbers."""
    past = F.array_join(F.transform(history, lambda h: F.concat(F.lit(":"), h["hop"].cast("string"), F.lit(":"), h["nh"].cast("string"))), "")
    radius = F.coalesce(F.try_element_at(history, F.lit(-1))["hop"], F.lit(0)).cast("string")
    return F.concat(node.cast("string"), F.lit("\tbs"), status, radius, past, F.lit(" "), F.array_join(F.transform(masks, lambda m: F.lower(F.hex(m))), " "))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return edge_lines(spark.read.text(path))


def read_vector(spark: SparkSession, path: str) -> DataFrame:
    return vector_lines(spark.read.text(path))


def _numbers(text: Column) -> Column:
    return F.filter(F.split(text, " ", -1), lambda x: x != "")


def parse_vector_block(text: Column) -> Column:
    """`i v i v ...` -> array of (i, v)."""
    t = _numbers(text)
    n = (F.size(t) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(t, k * 2).cast("int").alias("i"), F.get(t, k * 2 + 1).cast("double").alias("v")))).otherwise(F.from_json(F.lit("[]"), "array<struct<i:int,v:double>>"))


def parse_matrix_block(text: Column, values: bool = True) -> Column:
    """`col row val ...`, stored transposed -> array of (row, col, val); without values pairs `col row` of value 1."""
    t, width = _numbers(text), 3 if values else 2
    n = (F.size(t) / width).cast("int")

    def item(k: Column) -> Column:
        val = F.get(t, k * width + 2).cast("double") if values else F.lit(1.0)
        return F.struct(F.get(t, k * width + 1).cast("int").alias("row"), F.get(t, k * width).cast("int").alias("col"), val.alias("val"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), item)).otherwise(F.from_json(F.lit("[]"), "array<struct<row:int,col:int,val:double>>"))


def format_vector_block(items: Column) -> Column:
    """array of (i, v) -> `i v i v ...`."""
    return F.array_join(F.transform(items, lambda x: F.concat_ws(" ", x["i"].cast("string"), x["v"].cast("string"))), " ")


def parse_state_block(text: Column) -> Column:
    """A role character and `row mask row mask ...` -> (role, array of (row, mask))."""
    t = _numbers(F.substr(text, F.lit(2)))
    n = (F.size(t) / 2).cast("int")
    items = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.get(t, k * 2).cast("int").alias("row"), F.get(t, k * 2 + 1).alias("mask")))).otherwise(F.from_json(F.lit("[]"), "array<struct<row:int,mask:string>>"))
    return F.struct(F.substr(text, F.lit(1), F.lit(1)).alias("role"), items.alias("items"))


def plain_text(ranks: DataFrame, path: str) -> None:
    """key TAB value lines."""
    ranks.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in ranks.columns]).alias("value")).write.text(path)
