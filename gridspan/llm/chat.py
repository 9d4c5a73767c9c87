"""Chat formatting with typed content parts, by DataFrame functions only.

A visitor folds the parts of a message from left to right: text is escaped and appended; image, audio and document parts become
ordered placeholders, and their references and expanded token counts are recorded. A message becomes
<|im_start|>role, newline, content, <|im_end|>, newline; the messages of a conversation are joined in turn order, and the spans of
assistant text (code points, start and end) are the loss mask.

Escaping is reversible: every "<", any number of backslashes, "|" gets one more backslash, so no control string can come from a
text; unescaping takes one away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25.0, 1024
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def escape_role(c: Column) -> Column:
    return F.replace(F.replace(escape(c), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    line = F.regexp_replace(c, r"(?<!\\)((?:\\\\)*)\\n", "$1\n")
    return unescape(F.replace(line, F.lit("\\\\"), F.lit("\\")))


def expanded_tokens(p: Column) -> Column:
    """Tokens that an attachment stands for; unknown measures count as one token."""
    image = F.ceil(p["width"] / F.lit(PATCH)) * F.ceil(p["height"] / F.lit(PATCH))
    n = F.when(p["type"] == "image", image).when(p["type"] == "audio", F.ceil(p["seconds"] * F.lit(AUDIO_RATE))).when(p["type"] == "document", p["pages"] * F.lit(PAGE_TOKENS))
    return F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)).cast("long")


def text_part(c: Column) -> Column:
    """A plain text as the only part of its message."""
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), c.cast("string").alias("text"), *rest))


def visit(parts: Column) -> Column:
    """Content parts -> struct(out, spans, refs): the flattened text, the code point spans that are text, the attachments."""
    spans, refs = "array<struct<s:bigint,e:bigint>>", "array<struct<kind:string,ref:string,tokens:bigint>>"
    start = F.struct(F.lit("").alias("out"), F.from_json(F.lit("[]"), spans).alias("spans"), F.from_json(F.lit("[]"), refs).alias("refs"))

    def step(acc: Column, p: Column) -> Column:
        out = acc["out"]
        at = F.char_length(out).cast("long")
        kind = F.when(p["type"].isin("image", "audio", "document"), p["type"])
        raw = F.coalesce(p["text"], F.lit(""))
        seam = out.rlike(r"<\\*\z") & raw.rlike(r"\A\\*\|")
        text = F.concat(F.when(seam, F.lit("\\")).otherwise(F.lit("")), escape(raw))
        hole = F.concat(F.lit("<|"), kind, F.lit(":"), F.size(acc["refs"]).cast("string"), F.lit("|>"))
        end = at + F.char_length(text)
        tail = F.try_element_at(acc["spans"], F.lit(-1))
        joins = F.coalesce(tail["e"] == at, F.lit(False))
        base = F.when(joins, F.slice(acc["spans"], F.lit(1), F.greatest(F.size(acc["spans"]) - 1, F.lit(0)))).otherwise(acc["spans"])
        grown = F.concat(base, F.array(F.struct(F.when(joins, tail["s"]).otherwise(at).alias("s"), end.alias("e"))))
        more = F.concat(acc["refs"], F.array(F.struct(kind.alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))))
        return F.struct(
            F.concat(out, F.when(kind.isNull(), text).otherwise(hole)).alias("out"),
            F.when(kind.isNull(), grown).otherwise(acc["spans"]).cast(spans).alias("spans"),
            F.when(kind.isNull(), acc["refs"]).otherwise(more).cast(refs).alias("refs"),
        ).cast(f"struct<out:string,spans:{spans},refs:{refs}>")

    return F.aggregate(parts, start.cast(f"struct<out:string,spans:{spans},refs:{refs}>"), step)


def format_chat(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """(conv_id, n_messages, formatted, loss, attachments, expanded_tokens) for each conversation. Without parts_col, a message is one
    part, its text.

    loss: spans of assistant text in `formatted`. attachments: kind, ref and tokens in order of their placeholders; placeholder
    numbers count within a message. A null text, role or part is empty; null turns come first; repeated turns stay, ordered by
    role and text. Rows with a null conversation id are one conversation. Other columns are not read. An empty table gives an
    empty result. A conversation is one row, so its text must fit in one."""
    parts = text_part(F.col(text_col)) if parts_col is None else F.coalesce(F.col(parts_col), F.from_json(F.lit("[]"), PARTS))
    content = visit(F.filter(parts, lambda p: p.isNotNull()))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head = F.concat(F.lit(START), escape_role(role), F.lit("\n"))
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), head.alias("head"), content.alias("content"))
    piece = F.concat("head", F.col("content.out"), F.lit(END + "\n"))
    rows = rows.select("conv_id", F.struct("turn", "role", piece.alias("piece"), F.char_length("head").cast("long").alias("head"), F.char_length(piece).cast("long").alias("size"), F.col("content.spans").alias("spans"), F.col("content.refs").alias("refs")).alias("m"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m"))
    starts = F.aggregate("m", F.array(F.lit(0).cast("long")), lambda acc, m: F.concat(acc, F.array(F.element_at(acc, -1) + m["size"])))
    loss = F.flatten(F.transform("m", lambda m, i: F.when(m["role"] == "assistant", F.transform(m["spans"], lambda x: F.struct((x["s"] + m["head"] + F.get(F.col("starts"), i)).alias("s"), (x["e"] + m["head"] + F.get(F.col("starts"), i)).alias("e")))).otherwise(F.slice(F.transform(m["spans"], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))), F.lit(1), F.lit(0)))))
    refs = F.flatten(F.transform("m", lambda m: m["refs"]))
    out = grouped.withColumn("starts", starts).select("conv_id", F.size("m").cast("long").alias("n_messages"), F.array_join(F.transform("m", lambda m: m["piece"]), "").alias("formatted"), loss.alias("loss"), refs.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_chat(formatted: DataFrame) -> DataFrame:
    """formatted with what its text says: turns (role and unescaped text in order) and loss_text (all text under the mask)."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        return F.struct(unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"), unescape(F.substr(x, F.char_length(role) + 2)).alias("text"))

    spans = F.transform("loss", lambda x: unescape(F.substr(F.col("formatted"), (x["s"] + 1).cast("int"), (x["e"] - x["s"]).cast("int"))))
    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(spans, "")})
