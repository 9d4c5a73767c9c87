"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, host_quality, mixing, passage_quality, pivot_index, pseudonyms, sharding, simhash, token_store
from .shared import table

#: The end-of-document id that op9 appends.
END_ID = 2
CONTROL = "<|im_end|><|im_start|>assistant ok"


def vocabulary() -> byte_bpe.Vocabulary:
    return byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("sketch")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = host_quality.judged(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *host_quality.STATS, "base_failed", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    placed = sharding.shuffled(docs, shards=24)
    return placed.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", mixing.n_words("text").alias("size"))
    return mixing.copies(sized).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False).withColumnRenamed("id", "doc_id")


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"), pseudonyms.session_key(spark)).select("doc_id", "text", F.size("pii").cast("long").alias("n_found"), "pii")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    read = chat.read_chat(chat.format_chat(rows.unionByName(extra)))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_pivot_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pivot_index.near_vectors(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        model = f.read()
    manifest, dictionary = token_store.write_store(table(spark, sf_dir, "documents"), model, END_ID)
    return token_store.read_store(manifest, dictionary).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


def op10_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = passage_quality.train(docs, table(spark, sf_dir, "labels"))
    return passage_quality.scored(docs, model).withColumnRenamed("id", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_host_quality, op3_sharding, op4_mixing, op5_byte_bpe, op6_pseudonyms, op7_chat, op8_pivot_index, op9_token_store, op10_passage_quality)
}

ORACLE_SQL: dict[str, str] = {
    "op2_host_quality": r"""
with w as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
pos as (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8),
win as (select doc_id, i, array_to_string(words[i:i+7], ' ') as s from pos),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from win) t where n > 1),
cov as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest(range(i, i + 8)) as k from rep) t group by doc_id),
lines as (select doc_id, count(*) - count(distinct line) as n_dup_lines from (select doc_id, unnest(string_split(text, chr(10))) as line from w) t
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
base as (select w.doc_id, w.source, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from w left join lines using (doc_id) left join cov using (doc_id)),
judged as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from base),
hosts as (select source, count(*)::double as n, sum(base_failed::int)::double as f from judged group by source),
mom as (select avg(f / n) as m, var_pop(f / n) as v from hosts),
prior as (select case when m > 0 and m < 1 and v >= 1e-12 and v < m * (1 - m) then m * (m * (1 - m) / v - 1) else 1.0::double end as a,
  case when m > 0 and m < 1 and v >= 1e-12 and v < m * (1 - m) then (1 - m) * (m * (1 - m) / v - 1) else 1.0::double end as b from mom),
lim as (select a, b, least(0.5::double, a / (a + b) + 2.0::double * sqrt((a / (a + b)) * (1 - a / (a + b)) / (a + b + 1))) as top from prior),
verdict as (select source, (f + a) / (n + a + b) <= top as good from hosts, lim)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (not base_failed and good) as kept
from judged join verdict on judged.source is not distinct from verdict.source
""",
    "op7_chat": r"""
with rows as (select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'))
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role)) as loss_sha256,
  sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 11)::bigint as formatted_chars
from rows group by conv_id
""",
    "op8_pivot_index": r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
ok as (select vec_id, label, e from v where list_inner_product(e, e) > 0 and isfinite(list_inner_product(e, e))),
pair as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.vec_id <> b.vec_id
  where list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.98),
reach as (select a as x, b as y from pair union select r.x, p.b from reach r join pair p on r.y = p.a),
low as (select x, min(y) as m from reach group by x), deg as (select a, count(*) as n from pair group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, least(vec_id, coalesce(m, vec_id))::bigint as component_id, vec_id <= coalesce(m, vec_id) as kept
from embeddings left join low on vec_id = x left join deg on vec_id = a
""",
}
