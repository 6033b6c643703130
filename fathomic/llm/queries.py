"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, langid, lines, mixing, oracles, quality, simhash, tokens, warc
from .common import crc_bucket, table


def op1_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_posting_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_bucket("doc_id", 5) == 0
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = lines.line_decisions(table(spark, sf_dir, "documents"))
    return told.withColumn("dropped", F.array_join("dropped", ","))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", (F.size("item_ids") > 0).alias("contaminated"), "item_ids", "matched_words")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_bucket("doc_id", 4) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.decisions(table(spark, sf_dir, "documents"))
    return taken.select(F.col("id").cast("long").alias("doc_id"), "domain", "lang", "source", "tokens", "copies")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = chat.format_chats(table(spark, sf_dir, "conversations"), in_order=True)
    return items.withColumn("problems", F.array_join("problems", "\n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_neardup": op1_simhash_neardup,
    "op2_warc_archive": op2_warc_archive,
    "op3_posting_ann": op3_posting_ann,
    "op4_quality_gam": op4_quality_gam,
    "op5_token_records": op5_token_records,
    "op6_line_dedup": op6_line_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_chat_format": op10_chat_format,
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
