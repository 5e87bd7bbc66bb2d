"""Corpus pipeline: a documents table goes through the training-data operators, one stage after another.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's documents. Stages that change texts renew n_chars.

Whatever columns a table of documents has besides doc_id, text, lang, source and n_chars are kept as they
are, and an empty table gives an empty result. Null and empty texts end at the first stage, rows that
repeat at the second, which keeps one of them; a row with a null doc_id can't stand for a group and stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import byte_bpe, decontaminate, langid, ngram_join, secrets
from sparkloom.llm.shared import discard, materialise, prepare, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter go.

    The model learns from the documents outside the held-out fold. Repeated rows fare alike.
    """
    prepare(spark)
    return langid.identified(docs, langid.fit(docs, usable=~langid.held_out()))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; of rows that repeat it, one.

    Rows with a null doc_id and texts without words stay.
    """
    prepare(spark)
    return ngram_join.without_near_duplicates(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items; documents that consist of them mostly go.

    Null texts and documents without a passage stay as they are, repeated rows alike.
    """
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced, live ones and copied examples by different marks.

    Null texts stay null; a null source is an owner of its own; repeated rows count once.
    """
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id (null ones too), n_tokens and digests of the ids and of what they decode to; a null text counts as empty."""
    prepare(spark)
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language ID", known_language),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("secret scans", without_secrets),
    ("byte-level BPE", token_ids),
]

#: Language models, prefix trees and byte-pair merges have no SQL form; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        after: list[str] = []
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '_')}", after)
        discard(spark, before)  # the stage before is read no more
        before = after
    return docs
