"""Registered queries of the reference's operators, by group, and the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import documents_queries, evidence_queries, replies_queries, retrieval_queries, stream_queries
from .base import ORACLES, QUERIES

GROUPS = (retrieval_queries, evidence_queries, replies_queries, documents_queries, stream_queries)

__all__ = ["GROUPS", "ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes for each of the query vectors, fused, gated and tiered."""
    return QUERIES["retrieval_pipeline"](spark, sf_dir)
