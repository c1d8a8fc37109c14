"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is heavy from this share of all rows on, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 1000
#: No key with fewer rows is heavy: a task handles so many at once.
LEAST_HEAVY = 10_000
#: Share of the rows that is counted where no count is at hand; which keys count as heavy changes the plan, never the result.
SAMPLE = 1 / 16
#: A lookup side is broadcast up to this many bytes (rows counted, times their width).
BROADCAST_BYTES = 8 << 20


def heavy_keys(counts: DataFrame, weight: str, share: float = HEAVY_SHARE) -> DataFrame:
    """Rows of a per-key count table whose weight is at least ``share`` of the total.

    At most ``1 / share`` rows by construction, whatever the data: safe to broadcast.
    """
    total = counts.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).scalar()
    return counts.filter(F.col(weight) >= F.greatest(F.lit(1.0), total * F.lit(share)))


def _heavy(counts: DataFrame, on: list[str], weight: str, least: float = 0) -> DataFrame | None:
    """The heavy keys as a flag to be broadcast, None if there are none: one row with the total and the greatest weight decides."""
    total, most = counts.agg(F.sum(weight), F.max(weight)).first()
    limit = max(least or LEAST_HEAVY, (total or 0) * HEAVY_SHARE)
    if not most or most < limit:
        return None
    return F.broadcast(counts.filter(F.col(weight) >= limit).select(*on, F.lit(True).alias("_heavy")))


def _salted(left: DataFrame, right: DataFrame, on: list[str], flags: DataFrame, spread: list[str], salts: int, how: str) -> DataFrame:
    """The join with rows of flagged keys spread on the left and repeated once per salt on the right."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    left = left.join(flags, on, "left").withColumn("_salt", F.when(F.col("_heavy"), salt).otherwise(0)).drop("_heavy")
    each = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(flags, on, "left").withColumn("_salt", F.explode(each)).drop("_heavy")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def salted_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], weight: str | None = None, salts: int = 64, spread: list[str] | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) to the unique-keyed ``lookup``; heavy keys are spread over ``salts`` partitions.

    Keys are heavy by ``lookup``'s row count column ``weight``, or by counting a sample of
    ``rows`` where there is none; they hold at least 1/1000 of all rows, so at most 1000 are
    broadcast as a flag. Their rows on the left get a salt from ``spread`` (or all columns),
    and their single row on the right is repeated once per salt. Null keys match nothing.
    """
    counts = lookup.select(*on, F.col(weight).alias("_n")) if weight else rows.sample(SAMPLE, seed=1).groupBy(*on).agg(F.count("*").alias("_n"))
    flags = _heavy(counts, on, "_n", 0 if weight else LEAST_HEAVY * SAMPLE)
    return rows.join(lookup, on, how) if flags is None else _salted(rows, lookup, on, flags, spread or rows.columns, salts, how)


def salted_join(left: DataFrame, right: DataFrame, on: list[str], spread: list[str], salts: int = 64) -> DataFrame:
    """Inner join of two sides that may both hold a key many times; rows of heavy keys on the left are spread by ``spread``.

    Heavy keys are those that hold at least 1/1000 of the right side's rows, which are read
    for that; their rows on the right are repeated once per salt. For joins whose output is
    wanted whole, so that no task makes more than a share of a heavy key's output.
    """
    flags = _heavy(right.groupBy(*on).agg(F.count("*").alias("_n")), on, "_n")
    return left.join(right, on) if flags is None else _salted(left, right, on, flags, spread, salts, "inner")


def bounded_lookup(rows: DataFrame, lookup: DataFrame, on: list[str], row_bytes: int, how: str = "inner", n: int | None = None) -> DataFrame:
    """Join that broadcasts ``lookup`` only if its counted size is within bounds, and shuffles otherwise."""
    n = lookup.count() if n is None else n
    return rows.join(F.broadcast(lookup) if n * row_bytes <= BROADCAST_BYTES else lookup, on, how)


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the input has fewer partitions than there are cores; else as they are read.

    For work that costs far more than moving its input, on tables of few files. ``rows``
    must be a plain scan: asking a plan with shuffles for its partitions would run it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows._jdf.queryExecution().toRdd().getNumPartitions() >= cores else rows.repartition(cores)
