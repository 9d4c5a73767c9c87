"""The corpus pipeline: documents in, token ids out, in five stages. Each stage's result is written as Parquet in the shared
folder and read again as the next one's documents.

All stages: rows are kept or dropped by themselves, whatever their doc_id, so null and repeated ids lose nothing; all but the last
return the columns of documents, extra ones included, whatever they are named; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspan.llm import byte_bpe, mixing, passage_quality, pseudonyms, simhash
from gridspan.llm.queries import vocabulary
from gridspan.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labels, score every document; those below the threshold go.

    Null and empty texts are scored as one empty passage; equal texts get equal scores; a very long text is scored whole. A table
    whose labels teach nothing is scored by their mean, and by 0.5 without any."""
    model = passage_quality.train(docs, table(spark, sf_dir, "labels"))
    return passage_quality.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest doc_id, null ids last.

    Texts are linked at a Jaccard similarity of 0.8 or more of their sets of five-word shingles. Null texts, empty ones and those of
    white space have no shingles, and are copies of one another; a text of fewer than five words is one shingle; of several
    rows of the smallest id the one with the least digest of its shingles stays."""
    return simhash.keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms of the same format; no row goes. Null texts stay null, empty ones empty."""
    return pseudonyms.pseudonyms(docs, pseudonyms.session_key(spark), found_col=None)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: 0, 1 or 2 times each, equal rows each by themselves.

    Null and empty texts have no words: they come the whole part of their source's rate times. A null source is one source."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids), a row for each copy. A null or empty text has no ids."""
    return byte_bpe.encoded(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("encode", encode)]

#: No SQL: the first stage is a trained model. tests/llm/test_pipeline.py holds run() against a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
