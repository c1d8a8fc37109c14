"""Items that appear together: an external sort of packed pair codes.

Every value gets a code, whose lower 31 bits go into pairs of one 64-bit number; the upper
bits, which are 0 up to 2^31 values, make the pair's tile. Tasks sort their pairs in
bounded runs and keep only (pair, count); the runs are shuffled by pair, Spark's external
sort merges them (spilling where memory ends), and equal neighbours are summed. A pair
that a third of all records hold arrives as one number per run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.textbuf import row_slices
from foliant.plans.skew import bounded_lookup, salted_lookup
from foliant.plans.stage import stage

RUN_PAIRS = 2_000_000
CODE_BITS = 31


def assign_codes(counts: DataFrame) -> DataFrame:
    """``counts`` of (field, value, n) with ``code``: its place in the order of (field, value), from 0."""
    spark = counts.sparkSession
    at = F.monotonically_increasing_id()
    placed = stage(counts.orderBy("field", "value").withColumn("_at", at), "codes")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect()  # a row for each task
    starts, total = [], 0
    for r in sizes:
        starts.append((r.part, total))
        total += r["count"]
    offsets = F.broadcast(spark.createDataFrame(starts, "_part long, _start long"))
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(offsets, "_part").withColumn("code", F.col("_start") + local).drop("_at", "_part", "_start")


def pair_runs(baskets: DataFrame) -> DataFrame:
    """(tile, pair, n): sorted runs of the packed pairs within each row's ``codes`` (distinct longs), counted per run."""
    mask = (1 << CODE_BITS) - 1

    def packed(lists: pa.Array):
        size = lists.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        codes = lists.flatten().to_numpy().astype(np.int64)
        codes = codes[np.lexsort((codes, row))]
        last = np.repeat(np.cumsum(size), size)
        later = last - np.arange(len(codes)) - 1  # partners of each element
        upper, lower = codes >> CODE_BITS, codes & mask
        for lo, hi in row_slices(later, RUN_PAIRS):
            n = later[lo:hi]
            first = np.repeat(np.arange(lo, hi), n)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)
            yield upper[first] << 32 | upper[second], lower[first] << 32 | lower[second]

    def counted(run: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        tile, pair = (np.concatenate(x) for x in zip(*run))
        order = np.argsort(pair, kind="stable") if not tile.any() else np.lexsort((pair, tile))
        tile, pair = tile[order], pair[order]
        at = np.flatnonzero(np.r_[np.ones(min(1, len(pair)), bool), (pair[1:] != pair[:-1]) | (tile[1:] != tile[:-1])])
        return pa.RecordBatch.from_arrays([pa.array(tile[at]), pa.array(pair[at]), pa.array(np.diff(np.r_[at, len(pair)]))], ["tile", "pair", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for tile, pairs in packed(batch.column(0)):
                held.append((tile, pairs))
                size += len(pairs)
                if size >= RUN_PAIRS:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    return baskets.select("codes").mapInArrow(run, "tile long, pair long, n long")


def merge_runs(runs: DataFrame) -> DataFrame:
    """(tile, pair, n) with each pair once: runs are merged by an external sort, then equal neighbours are summed."""

    def batch_of(tile, pair, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (tile, pair, n)], ["tile", "pair", "n"])

    def run(batches):
        left, amount = None, 0
        for batch in batches:
            tile, pair, n = (c.to_numpy() for c in batch.columns)
            if not len(pair):
                continue
            at = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (tile[1:] != tile[:-1])])
            tile, pair, n = tile[at], pair[at], np.add.reduceat(n, at)
            if left == (tile[0], pair[0]):
                n[0] += amount
            elif left is not None:
                yield batch_of([left[0]], [left[1]], [amount])
            left, amount = (int(tile[-1]), int(pair[-1])), int(n[-1])
            yield batch_of(tile[:-1], pair[:-1], n[:-1])
        if left is not None:
            yield batch_of([left[0]], [left[1]], [amount])

    return runs.repartition("tile", "pair").sortWithinPartitions("tile", "pair").mapInArrow(run, "tile long, pair long, n long")


def pairs_together(rows: DataFrame, records: int | object, least: int = 1) -> DataFrame:
    """(field, a, b, n, n_a, n_b, lift, odds_ratio, log_odds), a < b, of (field, record, value) rows.

    ``n`` counts the records that hold both values; pairs of fewer than ``least`` records
    are left out (a pair can't be found more often than either value, so rarer values are
    dropped before pairing). ``lift`` is n * N / (n_a * n_b); the odds ratio has 0.5 added
    to each of its four cells, so it is defined where a cell is empty. A value repeated in
    a record counts once; rows with a null record or a null or empty value are left out.
    A record of m values has m (m - 1) / 2 pairs, made in bounded pieces.
    """
    rows = stage(rows.filter(F.col("record").isNotNull() & F.col("field").isNotNull() & (F.col("value") != "")).select("field", "record", "value").distinct(), "values")
    counts = rows.groupBy("field", "value").agg(F.count("*").alias("held")).filter(F.col("held") >= least)
    codes = stage(assign_codes(counts), "dictionary")
    coded = salted_lookup(rows, codes, ["field", "value"], "held", spread=["record"])
    baskets = coded.groupBy("field", "record").agg(F.collect_list("code").alias("codes")).filter(F.size("codes") > 1)
    pairs = merge_runs(pair_runs(baskets)).filter(F.col("n") >= least)
    low = F.lit(0xFFFFFFFF)
    code = lambda upper, lower: F.shiftleft(upper, CODE_BITS) + lower
    pairs = pairs.select(code(F.shiftright("tile", 32), F.shiftright("pair", 32)).alias("ca"), code(F.col("tile").bitwiseAND(low), F.col("pair").bitwiseAND(low)).alias("cb"), "n")
    size = codes.count()
    named = bounded_lookup(pairs, codes.select(F.col("code").alias("ca"), "field", F.col("value").alias("a"), F.col("held").alias("n_a")), ["ca"], 64, n=size)
    named = bounded_lookup(named, codes.select(F.col("code").alias("cb"), F.col("value").alias("b"), F.col("held").alias("n_b")), ["cb"], 64, n=size)
    total = records if not isinstance(records, int) else F.lit(records)
    n, only_a, only_b = F.col("n"), F.col("n_a") - F.col("n"), F.col("n_b") - F.col("n")
    neither = total - F.col("n_a") - F.col("n_b") + n
    odds = ((n + 0.5) * (neither + 0.5)) / ((only_a + 0.5) * (only_b + 0.5))
    return named.select("field", "a", "b", "n", "n_a", "n_b", total.cast("long").alias("n_all"), (n.cast("double") * total / F.col("n_a") / F.col("n_b")).alias("lift"), odds.alias("odds_ratio"), F.log(odds).alias("log_odds"))
