"""Queries of problem 8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loupe.llm.tokens import encode_corpus
from loupe.session import table


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(table(spark, folder, "documents"))


QUERIES = {"p8_ids": p8_ids}
SQL: dict[str, str] = {}
