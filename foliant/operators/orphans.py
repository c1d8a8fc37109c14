"""References to records that don't exist, kept as incremental state.

The state lies in buckets by the record referred to, and once more by the record that
refers. A batch brings new references, records whose former references no longer count, and
parents whose lifetimes changed. New references probe the parent index; a parent that
arrives resolves the references that wait for it, and one that is deleted reopens them. Only
buckets that a batch touches are read and written again; all others stay as they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.commit import children, read_pointer, remove, write_pointer
from foliant.plans.skew import salted_lookup
from foliant.plans.stage import at_once, new_folder, scratch, stage
from foliant.sources.tables import array_values, current_items

KEY = ["kind", "ref"]
SOURCE = ["src", "src_key"]
REFERENCES = "src string, src_key string, kind string, ref string, at timestamp_ntz, period string"
PARENTS = "kind string, ref string, since timestamp_ntz, until timestamp_ntz"
TABLES = {"references": REFERENCES, "parents": PARENTS, "pending": REFERENCES, "sources": REFERENCES}


class State(NamedTuple):
    references: DataFrame
    parents: DataFrame
    pending: DataFrame


class PendingOrphans:
    """The state under a folder; the last committed version of each bucket counts."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _pointer(self) -> dict:
        """The version, and of each table the version that each bucket was last written in; the number of buckets is fixed by the first batch."""
        now = read_pointer(self.spark, f"{self.folder}/CURRENT.json")
        now = now or {"version": 0, "buckets": self.buckets, "parts": {name: {} for name in TABLES}, "before": {}}
        self.buckets = now["buckets"]
        return now

    def version(self) -> int:
        return self._pointer()["version"]

    def _read(self, now: dict, name: str, buckets: list[int] | None = None) -> DataFrame:
        parts = [f"{self.folder}/{name}/v{v}/bucket={b}" for b, v in now["parts"][name].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(TABLES[name]).parquet(*parts) if parts else self.spark.createDataFrame([], TABLES[name])

    def state(self) -> State:
        now = self._pointer()
        return State(*(self._read(now, name) for name in State._fields))

    def _bucket(self, columns: list[str]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    def _touched(self, columns: list[str], *frames: DataFrame) -> list[int]:
        """The buckets of the rows, at most all of them."""
        found = reduce(DataFrame.unionByName, [f.select(self._bucket(columns).alias("b")) for f in frames])
        return sorted(r.b for r in found.distinct().collect())

    def _write(self, now: dict, version: int, name: str, rows: DataFrame, buckets: list[int]) -> None:
        """Replace buckets of a table; one that holds a large share of the rows is written by several tasks."""
        columns = SOURCE if name == "sources" else KEY
        path = f"{self.folder}/{name}/v{version}"
        rows.withColumn("bucket", self._bucket(columns)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        held = {c.removeprefix("bucket=") for c in children(self.spark, path) if c.startswith("bucket=")}
        parts = now["parts"][name]
        for b in map(str, buckets):
            parts.pop(b, None)
            if b in held:
                parts[b] = version

    def apply(self, references: DataFrame, parents: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
        """Take in a batch and return the pending orphans after it.

        ``references`` has (src, src_key, kind, ref, at, period): ``at`` is the time at
        which the parent must exist, null for now. ``parents`` has (kind, ref, since,
        until), all lifetimes of each key that it names: since null means always, until
        null means still; a parent that never existed or is gone altogether is named with
        until <= since. ``replaced`` has (src, src_key) of records that are new, changed or
        gone: what they referred to before no longer counts. References with a null ref, src
        or src_key are none; repeated rows count once. A batch that fails leaves the state as it was.
        """
        with scratch():
            now = self._pointer()
            version = now["version"] + 1
            before = {name: dict(parts) for name, parts in now["parts"].items()}
            references = references.filter(F.col("ref").isNotNull() & F.col("src").isNotNull() & F.col("src_key").isNotNull())
            changed = parents.filter(F.col("ref").isNotNull())
            new, parents = at_once(lambda: stage(references.distinct(), "new"), lambda: stage(changed.distinct(), "changed"))
            replaced = new.select(*SOURCE).limit(0) if replaced is None else replaced.select(*SOURCE)
            touched = parents.select(*KEY).distinct()
            if now["version"]:
                here = self._touched(SOURCE, new, replaced)
                sources = self._read(now, "sources", here)
                former = stage(sources.join(replaced, SOURCE, "left_semi"), "former")
                there = self._touched(KEY, new, parents, former)
                each = [*SOURCE, *KEY]
                kept = sources.join(replaced, SOURCE, "left_anti").unionByName(new).distinct()
                index = self._read(now, "parents", there).join(touched, KEY, "left_anti").unionByName(parents)
                held = self._read(now, "references", there).join(former, each, "left_anti").unionByName(new).distinct()
                waiting = self._read(now, "pending", there).join(former, each, "left_anti").join(touched, KEY, "left_anti")
            else:  # nothing is known yet
                here = there = list(range(self.buckets))
                kept = held = new
                index, waiting = parents, None
            at_once(*(lambda a=a: self._write(now, version, *a) for a in (("sources", kept, here), ("parents", index, there), ("references", held, there))))
            # new references are probed, old ones only where their parent changed
            known = self._read(now, "parents", there)
            if waiting is None:
                pending = probe(new, known)
            else:
                old = self._read(now, "references", there).join(touched, KEY, "left_semi")
                pending = probe(old.unionByName(new).distinct(), known).unionByName(waiting).distinct()
            self._write(now, version, "pending", pending, there)
            write_pointer(self.spark, f"{self.folder}/CURRENT.json", {"version": version, "buckets": self.buckets, "parts": now["parts"], "before": before})
            self._sweep(now["parts"], before)
        return self.state().pending

    def _sweep(self, parts: dict, before: dict) -> None:
        """Remove what neither this version nor the one before it needs, also of batches that failed."""
        for name in TABLES:
            used: dict[int, set[str]] = {}
            for b, v in [*parts[name].items(), *before.get(name, {}).items()]:
                used.setdefault(v, set()).add(f"bucket={b}")
            for folder in children(self.spark, f"{self.folder}/{name}"):
                needed = used.get(int(folder[1:]), set())
                if not needed:
                    remove(self.spark, f"{self.folder}/{name}/{folder}")
                    continue
                for part in children(self.spark, f"{self.folder}/{name}/{folder}"):
                    if part.startswith("bucket=") and part not in needed:
                        remove(self.spark, f"{self.folder}/{name}/{folder}/{part}")

    def snapshot(self) -> DataFrame:
        """(src, period, n_references, n_orphans) of the present state."""
        s = self.state()
        keys = ["src", "src_key", "ref", "period"]
        mark = lambda frame, orphan: frame.select(*keys, F.lit(orphan).alias("orphan"))
        each = mark(s.references, 0).unionByName(mark(s.pending, 1)).groupBy(*keys).agg(F.max("orphan").alias("orphan"))
        return each.groupBy("src", "period").agg(F.count("*").alias("n_references"), F.sum("orphan").alias("n_orphans"))


def probe(references: DataFrame, parents: DataFrame) -> DataFrame:
    """The references whose parent doesn't exist at their time.

    Lifetimes are taken together per key, so each reference meets one row; references to a
    parent that a third of all rows name are spread by salt.
    """
    lives = parents.groupBy(*KEY).agg(F.collect_set(F.struct("since", "until")).alias("lives"))
    met = salted_lookup(references, lives, KEY, spread=["src_key"], how="left")
    exists = F.exists(
        "lives",
        lambda p: F.when(F.col("at").isNull(), p["until"].isNull()).otherwise((p["since"].isNull() | (p["since"] <= F.col("at"))) & (p["until"].isNull() | (p["until"] > F.col("at")))),
    )
    return met.filter(~F.coalesce(exists, F.lit(False))).select(*references.columns)


def _time(millis: str):
    """Epoch milliseconds as a time without zone, whatever the session's zone is."""
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST({millis} AS DECIMAL(18, 0)) / 1000)")


class Batch(NamedTuple):
    references: DataFrame
    parents: DataFrame
    replaced: DataFrame


#: so many last years come as batches of their own, all before them as the first
LAST_YEARS = 1


def library_batches(metadata: DataFrame, docs: DataFrame, documents: DataFrame, folders: DataFrame, years: int = LAST_YEARS) -> Iterator[Batch]:
    """The library's references and parents as they came, in batches by year.

    Item versions come at their modificationTime, index rows at addedAt, texts at added_at,
    folders when they are created and removed; what has no time comes first. The newest
    version of an item in a batch replaces the item's references and its state as a
    parent. Each table is read once and laid out by batch, without its wide columns.
    """
    spark = metadata.sparkSession
    month = lambda c: F.substring(c.cast("string"), 1, 7)
    now = F.lit(None).cast("timestamp_ntz")
    items = metadata.filter(F.col("id").isNotNull()).select("id", "folders", "isDeleted", "modificationTime", _time("modificationTime").alias("t"))
    rows = docs.select(F.lit("docs").alias("src"), F.col("idx").cast("string").alias("src_key"), F.col("id").alias("ref"), _time("addedAt").alias("t"))
    texts = documents.select(F.lit("documents").alias("src"), F.col("doc_id").cast("string").alias("src_key"), F.col("item_id").alias("ref"), F.col("added_at").cast("timestamp_ntz").alias("t"))
    held = rows.unionByName(texts).filter(F.col("ref").isNotNull())
    last = items.select("t").unionByName(held.select("t")).agg(F.max(F.year("t"))).first()[0] or 1970
    cuts = [last - k for k in reversed(range(years))]
    when = lambda t: F.when(t.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.year(t) - (cuts[0] - 1), F.lit(years)))).cast("int")

    def laid(frame: DataFrame, name: str) -> DataFrame:
        path, rows = new_folder(spark, name), frame.withColumn("batch", when(F.col("t")))
        rows.write.partitionBy("batch").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    items, held = at_once(lambda: laid(items, "items"), lambda: laid(held, "held"))
    lives = folders.filter(F.col("id").isNotNull() & F.col("created_at").isNotNull()).select("id", F.col("created_at").cast("timestamp_ntz").alias("since"), F.col("removed_at").cast("timestamp_ntz").alias("until"))
    for k in range(years + 1):
        versions = items.filter(F.col("batch") == k)
        newest = stage(current_items(versions, "folders", "modificationTime"), "newest")
        at = _time("modificationTime")
        # no folder exists at a time that isn't known
        at_or_never = F.coalesce(at, F.lit("0001-01-01").cast("timestamp_ntz"))
        inside = newest.select(F.lit("metadata").alias("src"), F.col("id").alias("src_key"), F.lit("folder").alias("kind"), F.explode(array_values("folders")).alias("ref"), at_or_never.alias("at"), month(at).alias("period"))
        outside = held.filter(F.col("batch") == k).select("src", "src_key", F.lit("item").alias("kind"), "ref", now.alias("at"), month(F.col("t")).alias("period"))
        gone = F.when(F.col("isDeleted"), F.lit("1970-01-01").cast("timestamp_ntz"))
        as_parents = newest.select(F.lit("item").alias("kind"), F.col("id").alias("ref"), now.alias("since"), gone.alias("until"))
        moved = lives.filter((when(F.col("since")) == k) | (F.col("until").isNotNull() & (when(F.col("until")) == k))).select("id").distinct()
        known = lives.filter(when(F.col("since")) <= k).join(moved, "id", "left_semi")
        as_folders = known.select(F.lit("folder").alias("kind"), F.col("id").alias("ref"), "since", F.when(when(F.col("until")) <= k, F.col("until")).alias("until"))
        yield Batch(inside.unionByName(outside), as_parents.unionByName(as_folders), newest.select(F.lit("metadata").alias("src"), F.col("id").alias("src_key")))
