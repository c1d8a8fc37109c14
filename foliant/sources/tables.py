"""The library's tables as DataFrames, and the views that most operators start from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def current_items(metadata: DataFrame, *columns: str) -> DataFrame:
    """One row per item: its row with the greatest ``modificationTime`` (null counts as least).

    Partial aggregation keeps an item with very many versions off any single task.
    Rows without an id are no items; ties are identical rows. ``isDeleted`` is always kept, as not null.
    """
    names = [c for c in dict.fromkeys([*columns, "isDeleted"]) if c != "id"]
    newest = F.max_by(F.struct(*names), F.coalesce(F.col("modificationTime"), F.lit(-(1 << 63)))).alias("row")
    rows = metadata.filter(F.col("id").isNotNull()).groupBy("id").agg(newest)
    kept = [F.coalesce(F.col(f"row.{c}"), F.lit(False)).alias(c) if c == "isDeleted" else F.col(f"row.{c}").alias(c) for c in names]
    return rows.select("id", *kept)


def live_items(metadata: DataFrame, *columns: str) -> DataFrame:
    """The current rows of items that aren't deleted."""
    return current_items(metadata, *columns).filter(~F.col("isDeleted")).drop("isDeleted")


def array_values(column: str):
    """The distinct, non-empty elements of an array column; a null array has none."""
    return F.array_distinct(F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))
