"""Building, storing and incrementally updating the inverted index as flat tables.

An index is a list of segments, each with docs, postings and texts of the items that one
build took in, and the idx numbers that this build made void in older segments. A build
writes one segment and publishes it by replacing the manifest, so readers never see half an
index, and what a build reads, extracts and writes grows with what has changed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import INDEX_VERSION, MASK, Settings
from foliant.functions.termcount import term_counts
from foliant.functions.text import folded
from foliant.operators.facets import totals
from foliant.operators.search import Index
from foliant.plans.commit import children, read_pointer, remove, write_pointer
from foliant.plans.stage import scratch, stage

#: Columns of an item as the index takes it in; missing ones get the default.
ITEM = {"id": None, "name": "", "fileName": "", "ext": "", "rel": "", "tags": [], "folders": [], "folder_names": [], "star": 0, "url": "", "annotation": "", "mtime": 0, "addedAt": 0, "size": 0, "content": "", "method": "skip", "warn": ""}
DOC = ["idx", "id", "name", "fileName", "ext", "rel", "tags", "folders", "folder_names", "star", "url", "annotation", "mtime", "addedAt", "size", "method", "warn", "cLen", "len", "folded_name"]
FIELDS = {"name": "name", "annotation": "annotation", "tags": "tags", "folders": "folder_names", "content": "content", "url": "url"}
_TYPES = {str: "string", int: "long", list: "array<string>"}


def complete(items: DataFrame) -> DataFrame:
    """Items with all columns and no nulls; rows without an id are dropped."""
    out = []
    for name, default in ITEM.items():
        kind = _TYPES.get(type(default), "string")
        value = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        column = F.coalesce(items[name].cast(kind), value) if name in items.columns else value
        out.append(column.alias(name))
    rows = items.select(*out).filter(F.col("id").isNotNull())
    rows = rows.withColumn("folder_names", F.when(F.size("folder_names") == 0, F.col("folders")).otherwise(F.col("folder_names")))
    rows = rows.withColumn("name", F.when(F.col("name") == "", F.col("fileName")).otherwise(F.col("name")))
    return rows


def name_folders(items: DataFrame, folders: DataFrame) -> DataFrame:
    """``items`` with ``folder_names``: the newest name of each folder id, the id itself where there is none; order is kept."""
    names = folders.filter(F.col("id").isNotNull()).groupBy(F.col("id").alias("folder")).agg(F.max_by("name", F.struct("created_at", "name")).alias("label"))
    each = items.select("id", F.posexplode("folders").alias("at", "folder")).join(names, "folder", "left")
    lists = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("label", "folder").alias("label")))), lambda x: x["label"]).alias("folder_names"))
    return items.join(lists, "id", "left").withColumn("folder_names", F.coalesce("folder_names", F.array().cast("array<string>")))


def text_of(field: str):
    column = F.col(FIELDS[field])
    return F.concat_ws(" ", column) if field in ("tags", "folders") else column


def build_postings(items: DataFrame, key: str = "idx", normalise: bool = True) -> DataFrame:
    """(term, key, mask, tf): fields that hold the term and its occurrences in all of them.

    ``key`` must be unique. One pass over the items without a shuffle.
    """
    return term_counts(items, key, {name: (bit, text_of(name)) for name, bit in MASK.items()}, normalise).select("term", key, "mask", "tf")


def field_lengths() -> F.Column:
    return F.struct(*[F.length(text_of(name)).cast("long").alias(name) for name in FIELDS])


@dataclass
class Diff:
    """Ids to process (new or changed) and ids to remove."""

    changed: DataFrame
    removed: DataFrame


def diff(items: DataFrame, docs: DataFrame) -> Diff:
    """What differs between listed items and indexed docs: by id, modification time, extension or size.

    Edits of tags, annotation or rating alone don't count. Nulls equal each other.
    """
    old = docs.select("id", *[F.col(c).alias(f"old_{c}") for c in ("mtime", "ext", "size")], F.lit(True).alias("known"))
    same = F.coalesce(F.col("known"), F.lit(False))
    for c in ("mtime", "ext", "size"):
        same &= F.col(c).eqNullSafe(F.col(f"old_{c}"))
    changed = items.select("id", "mtime", "ext", "size").join(old, "id", "left").filter(~same).select("id").distinct()
    removed = docs.select("id").join(items.select("id"), "id", "left_anti").distinct()
    return Diff(changed, removed)


def allocate(ids: DataFrame, first: int) -> DataFrame:
    """(id, idx) with consecutive idx from ``first``, in the order of ids.

    Ids are range-partitioned and numbered within partitions; only one count per
    partition comes to the driver.
    """
    placed = stage(ids.orderBy("id").withColumn("_at", F.monotonically_increasing_id()), "ids")
    start, offsets = first, []
    for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).count().orderBy("part").collect():
        offsets.append((r.part, start))
        start += r["count"]
    table = placed.sparkSession.createDataFrame(offsets, "_part long, _start long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(table), "_part").select("id", (F.col("_start") + local).alias("idx"))


class BuildCancelled(RuntimeError):
    """The build was cancelled; the last version is as it was."""


class IndexStore:
    """An index under a folder: segments, and a manifest that names those in force."""

    #: so many segments are merged into one; a reader meets no more
    MOST_SEGMENTS = 8

    def __init__(self, spark: SparkSession, folder: str, library: str = "", settings: Settings | None = None):
        self.spark, self.folder, self.library = spark, folder.rstrip("/"), library
        self.settings = settings or Settings()
        self._tag = f"foliant-build-{uuid.uuid4().hex}"
        self._cancelled = False

    def manifest(self) -> dict | None:
        return read_pointer(self.spark, f"{self.folder}/manifest.json")

    def _read(self, segments: list[str]) -> Index:
        """The rows of all segments that no later one made void."""
        read = lambda name, kind: self.spark.read.parquet(f"{self.folder}/{name}/{kind}")
        if len(segments) == 1:
            return Index(*(read(segments[0], kind) for kind in ("docs", "postings", "texts")))
        void = [read(name, "void").select(F.col("idx").alias("_idx"), F.lit(k).alias("_by")) for k, name in enumerate(segments) if k]
        void = reduce(DataFrame.unionByName, void).groupBy("_idx").agg(F.max("_by").alias("_by"))

        def alive(kind: str) -> DataFrame:
            parts = [read(name, kind).withColumn("_in", F.lit(k)) for k, name in enumerate(segments)]
            rows = reduce(DataFrame.unionByName, parts)
            return rows.join(void, (F.col("idx") == F.col("_idx")) & (F.col("_by") > F.col("_in")), "left_anti").drop("_in")

        return Index(alive("docs"), alive("postings"), alive("texts"))

    def load(self) -> tuple[Index | None, str]:
        """(index, reason): the reason is empty, or no-index, version, library, broken or settings, checked in this order."""
        m = self.manifest()
        if not m:
            return None, "no-index"
        if m.get("version") != INDEX_VERSION:
            return None, "version"
        if m.get("library") != self.library:
            return None, "library"
        try:
            index = self._read(m["segments"])
            index.n_docs = m["count"]
        except Exception:  # a missing or unreadable table
            return None, "broken"
        if m.get("signature") and m["signature"] != self.settings.signature():
            return None, "settings"
        return index, ""

    def cancel(self) -> None:
        """Stop a build that runs in another thread: its Spark jobs end and it raises ``BuildCancelled``."""
        self._cancelled = True
        self.spark.sparkContext.cancelJobsWithTag(self._tag)

    def build(self, items: DataFrame, force: bool = False, partial: bool = False, fetch: Callable[[DataFrame], DataFrame] | None = None, progress: Callable[[str, dict], None] | None = None) -> dict:
        """Bring the index up to date with the listed items and return a summary of the run.

        ``items`` may bring their text, or ``fetch`` adds content, method and warn to the
        rows of ``items`` that it is given, which are only the new and changed ones. An index
        that can't be loaded, ``force`` or settings without ``incremental`` mean a full build.
        Else unchanged documents keep their rows, changed ones their idx, and ids that are no
        longer listed go, unless the listing is ``partial``. Without changes nothing is
        written. Of repeated ids one row counts. ``progress`` is told each phase: scan, plan,
        extract, save, done. A failed or cancelled run leaves the last version in place.
        """
        self._cancelled = False
        sc = self.spark.sparkContext
        sc.addJobTag(self._tag)
        try:
            with scratch():
                return self._build(items, force, partial, fetch, progress or (lambda phase, about: None))
        except Exception as e:
            if self._cancelled:
                raise BuildCancelled from e
            raise
        finally:
            sc.removeJobTag(self._tag)

    def _build(self, items: DataFrame, force: bool, partial: bool, fetch, progress) -> dict:
        def phase(name: str, **about) -> None:
            if self._cancelled:
                raise BuildCancelled
            progress(name, about)

        began = time.time()
        phase("scan")
        items = items.filter(F.col("id").isNotNull()).dropDuplicates(["id"])
        index, reason = (None, "forced") if force or not self.settings.incremental else self.load()
        m = self.manifest()
        segments, next_idx = (m["segments"], m["next_idx"]) if index else ([], 0)
        listed = stage(complete(items).select("id", "mtime", "ext", "size"), "listed")
        total = listed.count()
        if index:
            d = diff(listed, index.docs)
            gone = stage(d.removed.join(index.docs.select("id", "idx"), "id").select("idx"), "gone") if not partial else self.spark.createDataFrame([], "idx long")
            ids = stage(d.changed.join(index.docs.select("id", "idx"), "id", "left"), "changed")
        else:
            gone = self.spark.createDataFrame([], "idx long")
            ids = listed.select("id", F.lit(None).cast("long").alias("idx"))
        removed, changed = gone.count(), ids.count()
        phase("plan", total=total, changed=changed, removed=removed)
        summary = {"total": total, "changed": changed, "removed": removed, "with_text": 0, "by_method": {}, "warnings": [], "reason": reason}
        if index and not changed and not removed:
            summary |= {"terms": m["terms"], "seconds": time.time() - began}
            phase("done", summary=summary)
            return summary
        name = f"s{len(segments)}-{int(began * 1000)}-{uuid.uuid4().hex[:8]}"
        path = f"{self.folder}/{name}"
        fresh = allocate(ids.filter(F.col("idx").isNull()).select("id"), next_idx)
        numbered = ids.filter(F.col("idx").isNotNull()).unionByName(fresh)
        todo = items.join(numbered.select("id"), "id", "left_semi")
        phase("extract", total=changed)
        todo = complete(fetch(todo) if fetch else todo).join(numbered, "id")
        limit = self.settings.max_chars
        todo = todo.withColumn("content", F.substring("content", 1, limit)).withColumn("cLen", F.length("content").cast("long")).withColumn("len", field_lengths()).withColumn("folded_name", folded("name"))
        todo = stage(todo, "todo")
        phase("save")
        self._write(path, Index(todo.select(*DOC), build_postings(todo), todo.select("idx", "content")))
        ids.filter(F.col("idx").isNotNull()).select("idx").unionByName(gone).write.parquet(f"{path}/void")
        segments = [*segments, name]
        index = self._read(segments)
        if len(segments) > self.MOST_SEGMENTS:
            segments = [f"m-{name}"]
            self._write(f"{self.folder}/{segments[0]}", index)
            index = self._read(segments)
        stats = totals(index.docs).first()
        methods = {r.method: r.n for r in index.docs.groupBy("method").agg(F.count("*").alias("n")).collect()}
        last = todo.agg(F.count_if(F.col("cLen") > 0).alias("with_text"), F.max("idx").alias("idx")).first()
        manifest = {
            "version": INDEX_VERSION, "library": self.library, "built_at": int(time.time() * 1000), "signature": self.settings.signature(), "segments": segments, "before": m["segments"] if m and "segments" in m else [], "count": stats.docs,
            "next_idx": max(next_idx, 0 if last.idx is None else last.idx + 1), "terms": index.postings.select("term").distinct().count(), "stats": {"with_text": stats.with_text, "by_method": methods},
        }
        if self._cancelled:
            raise BuildCancelled
        write_pointer(self.spark, f"{self.folder}/manifest.json", manifest)
        for other in set(children(self.spark, self.folder)) - {*manifest["segments"], *manifest["before"], "manifest.json"}:
            remove(self.spark, f"{self.folder}/{other}")
        warnings = todo.filter(F.col("warn") != "").select("id", "name", "warn").orderBy("id").limit(200).collect()
        summary |= {
            "with_text": last.with_text, "terms": manifest["terms"], "by_method": {r.method: r.n for r in todo.groupBy("method").agg(F.count("*").alias("n")).collect()},
            "warnings": [r.asDict() for r in warnings], "seconds": time.time() - began,
        }
        phase("done", summary=summary)
        return summary

    def _write(self, path: str, index: Index) -> None:
        """A segment's tables; postings lie by term, and a term that many documents hold is split by idx."""
        index.docs.write.parquet(f"{path}/docs")
        index.postings.repartitionByRange("term", "idx").sortWithinPartitions("term", "idx").write.parquet(f"{path}/postings")
        index.texts.write.parquet(f"{path}/texts")

    def bytes(self) -> int:
        """Stored size of the tables in force; 0 if there are none."""
        m = self.manifest()
        total = 0
        for segment in m["segments"] if m else []:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{segment}")
            files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
            total += files.getContentSummary(hadoop).getLength() if files.exists(hadoop) else 0
        return total
