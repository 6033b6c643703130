"""Corpus pipeline: language ID, near-duplicates, decontamination, mixing, token records.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``docs``.  The near-duplicate stage keeps one row of each SimHash component,
so rows that share a ``doc_id`` (or have none) stay apart where their texts differ.

Defined results of every stage: columns of ``docs`` may have any name, also those of the
operators' results (names that begin with two underscores are the stages' own); an empty
table gives an empty one; null ids, languages and sources are kept as they are; texts of
any length are read whole; of equal places in an order the smaller id, then the smaller
text digest goes first, so a stage gives the same rows on every run.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomic.llm import decontam, langid, mixing, simhash, tokens
from fathomic.llm.common import crc_bucket, scratch, spare_names


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; ``und`` ones (null, empty or without a letter) go, and
    all do where no row has a language to learn from. Repeated rows stay repeated."""
    model = langid.fit(docs, crc_bucket("doc_id", 4) != 2)
    names = spare_names(docs, "lang_pred", "score")
    return langid.predict(docs, model, names=names).where(F.col(names[0]) != "und").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one row: of the smallest id (nulls last), then the smallest text digest.
    Null and empty texts have one fingerprint, so one row of them stays."""
    return simhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, an empty benchmark drops none.
    Repeated rows go or stay together."""
    names = spare_names(docs, "item_ids", "matched_words")
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), names=names)
    return found.where(F.size(names[0]) == 0).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its leaf's budget takes it; rows of one id go together."""
    return mixing.mix(docs)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids written in the record format and read back, one row per document (a document taken twice
    has two); null texts are empty ones and have the end id only."""
    return tokens.encode_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("simhash_neardup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
    ("token_records", token_records),
]

#: SQL cannot express the stages; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
