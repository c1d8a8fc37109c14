"""How often every distinct term occurs, by heavy-light aggregation.

Terms that a sample shows to be heavy are broadcast, and every task counts them in local
arrays: one row for each task and heavy term is shuffled, or, where a (term, record) may be
stored again, one packed block for each task, heavy term and 65,536 records, which holds
what the task knows of them. All other terms are shuffled by term. Which terms count as
heavy changes the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.plans.skew import heavy_keys
from foliant.plans.stage import stage

#: share of the rows that is looked at to detect heavy terms; heavy is a share of 1/1000 of those
SAMPLE = 1 / 16
#: rows of heavy terms that a task holds before it packs them; bounds its memory, not the result
HELD_ROWS = 2_000_000
#: lowest bits of a record number, which a block covers
BLOCK_BITS = 16
#: slot of the rows that only say which records there are
EVERY = -1

_BLOCK = "slot int, block long, low binary, n binary"
_LIGHT = "field string, term string, record long, times long"


def _local_counts(rows: DataFrame, heavy: int) -> DataFrame:
    """(slot, n_occurrences, n_records) of (slot, n) rows, counted in one array per task."""

    def run(batches):
        records, occurrences = np.zeros(heavy, np.int64), np.zeros(heavy, np.int64)
        for batch in batches:
            slot = batch.column(0).to_numpy()
            records += np.bincount(slot, minlength=heavy)
            np.add.at(occurrences, slot, batch.column(1).to_numpy())
        met = np.flatnonzero(records)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(occurrences[met]), pa.array(records[met])], ["slot", "n_occurrences", "n_records"])

    return rows.select("slot", "n").mapInArrow(run, "slot int, n_occurrences long, n_records long").groupBy("slot").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def _packed(slot: np.ndarray, record: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes], list[bytes]]:
    """Blocks (slot, block, low bits of the records, their greatest n) of rows, each record once; no n where all are 1."""
    order = np.lexsort((n, record, slot))
    slot, record, n = slot[order], record[order], n[order]
    last = np.r_[(slot[1:] != slot[:-1]) | (record[1:] != record[:-1]), np.ones(min(1, len(slot)), bool)]
    slot, record, n = slot[last], record[last], n[last]
    block = record >> BLOCK_BITS
    low = (record & ((1 << BLOCK_BITS) - 1)).astype(np.uint16)
    at = np.flatnonzero(np.r_[np.ones(min(1, len(slot)), bool), (slot[1:] != slot[:-1]) | (block[1:] != block[:-1])])
    ends = np.r_[at[1:], len(slot)]
    small = ((n >= 0) & (n < 256)).all()
    lows, ns = [], []
    for a, b in zip(at.tolist(), ends.tolist()):
        lows.append(low[a:b].tobytes())
        own = n[a:b]
        ns.append(b"" if (own == 1).all() else (own.astype(np.uint8) if small or ((own >= 0) & (own < 256)).all() else own).tobytes())
    return slot[at], block[at], lows, ns


def _split(rows: DataFrame) -> DataFrame:
    """(field, term, slot, record, n) rows in one pass: those with a slot as blocks, and the rest as they are, besides a block list of all records."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        slot, block, low, n = _packed(*(np.concatenate(x) for x in zip(*held)))
        empty = pa.nulls(len(slot))
        return pa.RecordBatch.from_arrays([empty.cast(pa.string()), empty.cast(pa.string()), empty.cast(pa.int64()), empty.cast(pa.int64()), pa.array(slot.astype(np.int32)), pa.array(block), pa.array(low, pa.binary()), pa.array(n, pa.binary())], names)

    names = ["field", "term", "record", "times", "slot", "block", "low", "n"]

    def run(batches):
        held, size = [], 0
        for batch in batches:
            record, n = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            heavy = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            every = np.unique(record)
            held.append((np.full(len(every), EVERY, np.int32), every, np.ones(len(every), np.int64)))
            held.append((batch.column(2).fill_null(0).to_numpy()[heavy], record[heavy], n[heavy]))
            size += len(every) + int(heavy.sum())
            if not heavy.all():
                rest = batch.filter(pa.array(~heavy))
                none = pa.nulls(rest.num_rows)
                yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), rest.column(3), rest.column(4), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.binary())], names)
            if size >= HELD_ROWS:
                yield packed(held)
                held, size = [], 0
        if size:
            yield packed(held)

    return rows.select("field", "term", "slot", "record", "n").mapInArrow(run, f"{_LIGHT}, {_BLOCK}")


def _united(blocks: DataFrame) -> DataFrame:
    """(slot, n_occurrences, n_records) of blocks: those of one slot and block are united in one array, a record counts with its greatest n."""

    def run(batches: Iterator[pa.RecordBatch]):
        most = np.zeros(1 << BLOCK_BITS, np.int64)
        seen = np.zeros(1 << BLOCK_BITS, bool)
        now: tuple | None = None
        records: dict[int, int] = {}
        occurrences: dict[int, int] = {}

        def close() -> None:
            if now is not None:
                records[now[0]] = records.get(now[0], 0) + int(seen.sum())
                occurrences[now[0]] = occurrences.get(now[0], 0) + int(most[seen].sum())

        for batch in batches:
            for slot, block, low, n in zip(*(c.to_pylist() for c in batch.columns)):
                if (slot, block) != now:
                    close()
                    seen[:] = False
                    now = slot, block
                at = np.frombuffer(low, np.uint16)
                own = np.ones(len(at), np.int64) if not n else np.frombuffer(n, np.uint8 if len(n) == len(at) else np.int64).astype(np.int64)
                most[at] = np.where(seen[at], np.maximum(most[at], own), own)
                seen[at] = True
        close()
        slots = sorted(records)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array([occurrences[s] for s in slots], pa.int64()), pa.array([records[s] for s in slots], pa.int64())], ["slot", "n_occurrences", "n_records"])

    merged = blocks.select("slot", "block", "low", "n").repartition("slot", "block").sortWithinPartitions("slot", "block")
    return merged.mapInArrow(run, "slot int, n_occurrences long, n_records long").groupBy("slot").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records"))


def _heavy_slots(rows: DataFrame) -> list[tuple[str, str, int]]:
    """Heavy terms of a sample, numbered; at most 1000."""
    seen = rows.select("field", "term").sample(SAMPLE, seed=1).groupBy("field", "term").count()
    return [(r.field, r.term, k) for k, r in enumerate(heavy_keys(seen, "count").select("field", "term").collect())]


def _clean(rows: DataFrame) -> DataFrame:
    rows = rows.select("field", "term", "record", F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("n"))
    return rows.filter((F.col("term") != "") & F.col("record").isNotNull() & F.col("field").isNotNull())


def term_frequencies(rows: DataFrame, unique: bool = False) -> DataFrame:
    """(field, term, n_occurrences, n_records) of (field, term, record, n) rows.

    ``n`` is how often the term occurs in the record. A (term, record) that is stored again
    counts once, with its greatest ``n`` (null counts as 1); with ``unique`` the caller
    vouches that there are none. Records are whole numbers unless ``unique``. Rows with a
    null record or a null or empty term are left out; an empty table has no frequencies.
    """
    if not unique:
        return frequencies_and_records(rows)[0]
    spark = rows.sparkSession
    rows = _clean(rows)
    slots = _heavy_slots(rows)
    light, parts = rows, []
    if slots:
        heavy = F.broadcast(spark.createDataFrame(slots, "field string, term string, slot int"))
        parts.append(_local_counts(rows.join(heavy, ["field", "term"]).select("slot", "n"), len(slots)).join(heavy, "slot").select("field", "term", "n_occurrences", "n_records"))
        light = rows.join(heavy, ["field", "term"], "left_anti")
    counted = light.groupBy("field", "term").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_records"))
    return counted.unionByName(parts[0]) if parts else counted


def frequencies_and_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``term_frequencies`` of rows with repeats, and a row (size) with the number of different records, whatever their terms.

    Rows are read twice: a sample of their terms, then all of them once, in a pass that
    parts heavy from light.
    """
    spark = rows.sparkSession
    clean = _clean(rows)
    slots = _heavy_slots(clean)
    # rows without a term still name a record
    all_rows = rows.select("field", "term", F.col("record").cast("long").alias("record"), F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("n")).filter(F.col("record").isNotNull())
    heavy = F.broadcast(spark.createDataFrame(slots, "field string, term string, slot int"))
    parted = stage(_split(all_rows.join(heavy, ["field", "term"], "left")), "frequencies")
    united = stage(_united(parted.filter(F.col("slot").isNotNull())), "united")
    # one shuffle by term serves both aggregations
    light = parted.filter(F.col("slot").isNull() & (F.col("term") != "") & F.col("field").isNotNull())
    light = light.select("field", "term", "record", F.col("times").alias("n")).repartition("field", "term").groupBy("field", "term", "record").agg(F.max("n").alias("n"))
    counted = light.groupBy("field", "term").agg(F.sum("n").alias("n_occurrences"), F.count("*").alias("n_records"))
    both = counted.unionByName(united.join(heavy, "slot").select("field", "term", "n_occurrences", "n_records"))
    size = united.filter(F.col("slot") == EVERY).agg(F.coalesce(F.sum("n_records"), F.lit(0)).alias("size"))
    return both, size


def mark_useless(counts: DataFrame, sizes: DataFrame, least: int = 2, part: int = 5) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` below ``least`` records, ``common`` above a ``part``-th of the field's records, else null.

    ``sizes`` has (field, size), a row for each field. A term that is both is ``common``.
    """
    total = F.broadcast(sizes.select("field", F.col("size").alias("_size")))
    mark = F.when(F.col("n_records") * part > F.col("_size"), F.lit("common")).when(F.col("n_records") < least, F.lit("rare"))
    return counts.join(total, "field").withColumn("mark", mark).drop("_size")
