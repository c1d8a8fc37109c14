"""Runs that process only what is new, changed or gone since the last successful run.

The manifest holds size and checksum of every processed file, as a base and the differences
of later batches, so a run writes no more than what has changed. It compares its listing
with the manifest, writes the differences under its batch id, and commits by replacing one
pointer file. A run that fails before the commit leaves the manifest as it was; run again, it
overwrites what it wrote, so nothing is skipped or repeated.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.commit import children, exists, read_pointer, remove, write_pointer
from foliant.plans.stage import new_folder

ENTRIES = "id string, size long, checksum string, change string"


def checksum(state: list[str]) -> Column:
    """A digest of the columns that make a file changed; a null differs from every value."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in state]
    return F.md5(F.concat(*parts))


class Manifest:
    """The processed files of a folder of runs; ``state`` names the columns that make a file changed, ``size`` among them.

    A listing tells no more of a file than these columns, so the checksum is theirs; with a
    column for a digest of the content in ``state`` it covers the content as well.
    """

    #: so many batches are read after a base before a new base is written
    MOST_DELTAS = 8

    def __init__(self, spark: SparkSession, folder: str, state: list[str]):
        self.spark, self.folder, self.state = spark, folder.rstrip("/"), state

    def _pointer(self) -> dict:
        """The base (or null) and the batches since; older batches have a mark each, so the pointer stays small."""
        return read_pointer(self.spark, f"{self.folder}/CURRENT.json") or {"base": None, "batches": []}

    def committed(self, batch: str) -> bool:
        return batch in self._pointer()["batches"] or exists(self.spark, f"{self.folder}/done/{quote(batch, safe='')}")

    def _entries(self, path: str) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.folder}/{path}")

    def files(self) -> DataFrame:
        """(id, size, checksum) of the processed files: of each the newest entry, if it isn't gone.

        The entries are taken together by id, so a comparison by id that follows needs no
        further shuffle of this side.
        """
        now = self._pointer()
        parts = [self._entries(path).withColumn("at", F.lit(k)) for k, path in enumerate([*([now["base"]] if now["base"] else []), *(f"changes/{quote(b, safe='')}" for b in now["batches"])])]
        rows = reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], f"{ENTRIES}, at int")
        newest = rows.groupBy("id").agg(*[F.max_by(c, "at").alias(c) for c in ("size", "checksum", "change")])
        return newest.filter(F.col("change") != "gone").drop("change")

    def changes(self, batch: str) -> DataFrame:
        """(id, change) of a committed batch; change is new, changed or gone."""
        return self._entries(f"changes/{quote(batch, safe='')}").select("id", "change")

    def prepare(self, listing: DataFrame, batch: str) -> None:
        """Write the batch's changes; repeating it overwrites them.

        Both anti-joins, listing against manifest and manifest against listing, are one
        full outer join by id: each side is shuffled once.
        """
        here = listing.select("id", F.struct(F.col("size").cast("long").alias("size"), checksum(self.state).alias("checksum")).alias("new"))
        there = self.files().select("id", F.struct("size", "checksum").alias("old"))
        both = here.join(there, "id", "full")
        change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").when(~F.col("new").eqNullSafe(F.col("old")), "changed")
        rows = both.select("id", "new.size", "new.checksum", change.alias("change")).filter(F.col("change").isNotNull())
        rows.write.mode("overwrite").parquet(f"{self.folder}/changes/{quote(batch, safe='')}")

    def commit(self, batch: str) -> None:
        """Make the prepared batch the last successful one. Committing it again changes nothing.

        After ``MOST_DELTAS`` batches a new base is written and the pointer begins afresh;
        the changes of all batches stay, bases that no pointer names go.
        """
        if self.committed(batch):
            return
        now = self._pointer()
        now["batches"].append(batch)
        write_pointer(self.spark, f"{self.folder}/CURRENT.json", now)
        if len(now["batches"]) < self.MOST_DELTAS:
            return
        base = f"base/{quote(batch, safe='')}"
        self.files().withColumn("change", F.lit("new")).write.mode("overwrite").parquet(f"{self.folder}/{base}")
        for b in now["batches"]:
            write_pointer(self.spark, f"{self.folder}/done/{quote(b, safe='')}", {})
        write_pointer(self.spark, f"{self.folder}/CURRENT.json", {"base": base, "batches": []})
        for other in children(self.spark, f"{self.folder}/base"):
            if f"base/{other}" != base:
                remove(self.spark, f"{self.folder}/base/{other}")

    def run(self, listing: DataFrame, batch: str) -> DataFrame:
        """Prepare and commit; a batch that is committed already is left alone."""
        if not self.committed(batch):
            self.prepare(listing, batch)
            self.commit(batch)
        return self.changes(batch)


def present_files(rows: DataFrame, key: str, order: str, deleted: str, state: list[str]) -> DataFrame:
    """(id, state) of the files that a run's rows show as present.

    Of several rows of a file the one with the greatest ``order`` counts (null least; among
    equals the greatest state); a file whose row is deleted is absent, null being not
    deleted. Rows without a key are left out. Partial aggregation takes repeated rows
    together before the shuffle.
    """
    last = F.max(F.struct(F.col(order).alias("_order"), *[F.col(c) for c in state], F.coalesce(F.col(deleted), F.lit(False)).alias("_deleted"))).alias("last")
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(last).filter(~F.col("last._deleted")).select("id", *[F.col(f"last.{c}") for c in state])


def replay_builds(scans: DataFrame, builds: DataFrame, folder: str) -> DataFrame:
    """(run_no, id, change) for each successful build after the first.

    Builds run in the order of their number; those that failed or were cancelled never
    commit, so they leave no trace in the manifest. A build without scans empties it. Scans
    are read once and laid out by build, and each run reads its own part.
    """
    spark = scans.sparkSession
    manifest = Manifest(spark, folder, ["mtime", "size", "ext"])
    numbers = sorted({r.run_no for r in builds.filter((F.col("status") == "ok") & F.col("run_no").isNotNull()).select("run_no").distinct().toLocalIterator()})
    rows = scans.select("run_no", "id", "mtime", "size", F.lower("ext").alias("ext"), "isDeleted", "seen_at").filter(F.col("run_no").isin(numbers) & F.col("id").isNotNull())
    laid = new_folder(spark, "scans")
    rows.write.partitionBy("run_no").parquet(laid)
    rows = spark.read.schema(rows.schema).parquet(laid)
    parts = []
    for k, number in enumerate(numbers):
        listing = present_files(rows.filter(F.col("run_no") == number), "id", "seen_at", "isDeleted", manifest.state)
        changes = manifest.run(listing, f"run={number}")
        if k:
            parts.append(changes.select(F.lit(number).cast("int").alias("run_no"), "id", "change"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "run_no int, id string, change string")
