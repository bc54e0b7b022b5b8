"""Queries over documents and evaluation items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import leakage, spam, tokenize
from tidemark.sources.tables import table


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, decoded from their ids."""
    return tokenize.decode_corpus(p8_ids(spark, d), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of evaluation items, and the items."""
    return leakage.leaked_items(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of repeated keywords, links or tags."""
    return spam.stuffed_pages(table(spark, d, "documents"), "doc_id", "text", "lang").select("doc_id")


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p10_found": p10_found}
