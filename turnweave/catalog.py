"""All queries over the reference's own operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import status, streams, transcripts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return transcripts.QUERIES | status.QUERIES | streams.QUERIES


def oracle_sql() -> dict[str, str]:
    return transcripts.SQL | status.SQL | streams.SQL
