"""The core queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import extraction, library, text_search

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return library.queries() | text_search.queries() | extraction.queries()


def oracle_sql() -> dict[str, str]:
    return library.oracle_sql() | text_search.oracle_sql() | extraction.oracle_sql()
