"""Statistics and facets over all documents of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import format_bytes, format_count, group_of_ext, percent

TAGS, FOLDERS, WARNINGS = 18, 14, 40


def totals(docs: DataFrame) -> DataFrame:
    """One row: docs, with_text (text length above 0), bytes; zeros for an empty index."""
    return docs.agg(F.count("*").alias("docs"), F.count_if(F.col("cLen") > 0).alias("with_text"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"))


def by_group(docs: DataFrame) -> DataFrame:
    """(group, n), most first, then by name."""
    return docs.groupBy(group_of_ext("ext").alias("group")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "group")


def by_method(docs: DataFrame) -> DataFrame:
    """(method, n); a missing method is ``skip``."""
    method = F.when(F.coalesce("method", F.lit("")) == "", "skip").otherwise(F.col("method"))
    return docs.groupBy(method.alias("method")).agg(F.count("*").alias("n"))


def top_values(docs: DataFrame, column: str, size: int) -> DataFrame:
    """(value, n) of an array column's most frequent values; ties by value. An element repeated in a document counts each time, nulls never."""
    return docs.select(F.explode(column).alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(size)


def overview(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """One row of formatted figures: documents, with text, coverage, terms, size."""
    terms = postings.agg(F.countDistinct("term").alias("n")).scalar()
    return totals(docs).select(format_count("docs").alias("docs"), format_count("with_text").alias("with_text"), percent("with_text", "docs").alias("coverage"), format_count(terms).alias("terms"), format_bytes("bytes").alias("size"))


def grouped_warnings(docs: DataFrame, size: int = WARNINGS) -> DataFrame:
    """(kind, n, warn, example): warnings alike but for numbers, with the first of each in the order of (warning, name.ext).

    Ordered by that first warning; documents without a warning don't count.
    """
    warned = docs.filter(F.coalesce("warn", F.lit("")) != "").select("warn", F.concat(F.coalesce("name", F.lit("")), F.lit("."), F.coalesce("ext", F.lit(""))).alias("example"))
    first = F.min(F.struct("warn", "example")).alias("first")
    grouped = warned.groupBy(F.regexp_replace("warn", "[0-9]+", "N").alias("kind")).agg(F.count("*").alias("n"), first)
    return grouped.select("kind", "n", "first.warn", "first.example").orderBy("warn", "example").limit(size)
