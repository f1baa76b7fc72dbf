"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sphygmo.llm import mixing, near_dup, packing, secret_scan, toxicity
from sphygmo.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic; the models learn from the labels of the documents at hand.

    Null and empty texts are judged by the score of no evidence; no labels: all stay. Repeated rows share their fate, rows
    that repeat a doc_id with another text are judged by their own text. No rows: no rows. Columns may have any names.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest doc_id; of rows that repeat it, one.

    Documents without words are in no group and all stay. Rows that repeat a doc_id with texts that are no near duplicates
    are in groups of their own, and each group keeps one. No rows: no rows. Columns may have any names.
    """
    return near_dup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by their kinds; null and empty texts stay as they are.

    Repeated rows: each. No rows: no rows. Columns may have any names.
    """
    return secret_scan.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each document as often as systematic sampling takes it.

    Null sources are a source; documents without words are sampled like others; rows that agree in doc_id, source and size
    share their copies evenly. No rows: no rows. Columns may have any names.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document of the mix stands in the training sequences.

    Null and empty texts are one closing id; repeated rows are packed each; no rows: no rows. Other columns are left out.
    """
    return packing.pack_documents(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Neither the models nor the packing are SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
