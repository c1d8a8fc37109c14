"""How much a term tells a record apart from the whole collection, by residual inverse document frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.skew import salted_lookup


def least_ridf(n: Column, times: int, most: int) -> Column:
    """A bound that no term falls below which occurs ``times`` times or more in some record and in 2 to ``most`` records of ``n``.

    Such a term of df records occurs at least df + times - 1 times in all, and ridf grows
    with that number; the least over all df is taken, less a rounding error.
    """
    each = [F.log2(-F.expm1(F.lit(-(df + times - 1.0)) / n) * n / df) for df in range(2, most + 1)]
    return F.least(*each) - 1e-9


def residual_idf(rows: DataFrame, records: int | Column, least: Column | None = None) -> DataFrame:
    """``rows`` of (field, term, record, tf) with df, cf, ridf and score.

    The observed inverse document frequency is -log2(df / N); a Poisson process with the
    same collection frequency cf would give -log2(1 - exp(-cf / N)). Their difference is
    ridf, and score is tf * ridf: high for terms that pile up in few records, about zero
    for rare scattered ones, negative for terms spread evenly over the collection.
    (field, term, record) must be unique and not null; ``records`` is N, a number or a
    scalar column. Terms below ``least`` (a column of field, null for no bound) are dropped
    before their rows are looked at. A term that a third of all records hold is joined with salted keys.
    """
    n = records if not isinstance(records, int) else F.lit(records)
    counts = rows.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    expected = -F.expm1(-F.col("cf") / n)
    scored = counts.withColumn("ridf", F.log2(expected / (F.col("df") / n)))
    if least is not None:
        scored = scored.filter(F.coalesce(F.col("ridf") >= least, F.lit(True)))
    return salted_lookup(rows, scored, ["field", "term"], "df", spread=["record"]).withColumn("score", F.col("tf") * F.col("ridf"))
