"""Queries of the library and their SQL, by operator id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.plans import base, finance_queries, index_queries, log_queries, store_queries, text_queries  # noqa: F401  registration

QUERIES = base.QUERIES
ORACLE = base.ORACLE


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents ranked for a question by their BM25 keywords."""
    return QUERIES["rnk_keyword"](spark, sf_dir)
