"""Queries of the text operators; the SQL is empty where SQL cannot express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waymesh.llm import mixing, pii, tokenize
from waymesh.session import table

VOCABULARY = f"{tokenize.TOKENIZERS}/byte_bpe_50k.tiktoken"
#: Only for the registered query; give your own secret to pii.redacted.
DEMO_KEY = b"waymesh demonstration key"


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"), VOCABULARY)


def p7_texts(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.texts_of(p7_ids(spark, d), VOCABULARY)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), VOCABULARY)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.personal_items(table(spark, d, "documents"))


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(table(spark, d, "documents"), DEMO_KEY)


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return pii.item_report(p9_found(spark, d))


QUERIES = {"p7_ids": p7_ids, "p7_texts": p7_texts, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_redacted": p9_redacted, "p9_report": p9_report}

SQL = {"p7_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}
