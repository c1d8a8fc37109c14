"""A library on disk as DataFrames: item folders with their metadata and payload files."""

from __future__ import annotations

import json
from pathlib import Path
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import Settings
from foliant.sources.extract import extract_files, readable

if TYPE_CHECKING:
    from foliant.operators.index import IndexStore

META = """id string, name string, ext string, url string, annotation string, size long, btime long, mtime long, modificationTime long,
tags array<string>, folders array<string>, isDeleted boolean, star int"""
_OWN = r"/images/([^/]+)\.info/"
THUMBNAIL = r"(?i)_thumbnail\.[a-z0-9]+$"


def scan_library(spark: SparkSession, library: str, settings: Settings | None = None) -> DataFrame:
    """One row per item that has readable metadata and a payload file.

    Deleted items are left out unless the settings include them. The payload is the first
    file by name that is neither metadata nor a thumbnail; its extension, modification time
    and size count, with the metadata's as fallback. Listing reads no file contents but the
    metadata's. Columns: id, name, fileName, ext, rel, path, tags, folders, star, url,
    annotation, mtime, addedAt, size.
    """
    settings = settings or Settings()
    listed = spark.read.format("binaryFile").load(f"{library}/images/*.info/*").select("path", "length", "modificationTime")
    files = listed.select("path", F.col("length").alias("bytes"), F.unix_millis("modificationTime").alias("changed"), F.regexp_extract("path", _OWN, 1).alias("item"), F.regexp_extract("path", r"[^/]+$", 0).alias("file"))
    # one JSON object per file; a file that isn't one parses to null and is left out
    texts = spark.read.option("wholetext", True).text(f"{library}/images/*.info/metadata.json").select(F.regexp_extract(F.input_file_name(), _OWN, 1).alias("item"), F.from_json("value", META).alias("m"))
    meta = texts.filter(F.col("m.id").isNotNull() | F.col("m.name").isNotNull() | F.col("m.ext").isNotNull()).select("item", "m.*")
    meta = meta.filter(F.lit(settings.include_trashed) | ~F.coalesce("isDeleted", F.lit(False)))
    payload = files.filter((F.col("file") != "metadata.json") & ~F.rlike("file", F.lit(THUMBNAIL)))
    first = payload.groupBy("item").agg(F.min(F.struct("file", "path", "bytes", "changed")).alias("p"))
    own = F.lower(F.regexp_extract("p.file", r"\.([^.]+)$", 1))
    none = F.array().cast("array<string>")
    # Spark's file listing leaves out empty files: metadata of size 0 without a visible payload stands for one
    met = meta.join(first, "item", "left").filter(F.col("p").isNotNull() | (F.col("size") == 0))
    blank = F.concat("name", F.lit("."), F.coalesce("ext", F.lit("")))
    return met.select(
        F.url_decode(F.replace("item", F.lit("+"), F.lit("%2B"))).alias("id"),
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("p.file", blank).alias("fileName"),
        F.when(F.coalesce(own, F.lit("")) != "", own).otherwise(F.lower(F.coalesce("ext", F.lit("")))).alias("ext"),
        F.concat(F.lit("images/"), "item", F.lit(".info/"), F.coalesce("p.file", blank)).alias("rel"),
        F.coalesce("p.path", F.lit("")).alias("path"),
        F.coalesce("tags", none).alias("tags"),
        F.coalesce("folders", none).alias("folders"),
        F.coalesce("star", F.lit(0)).cast("long").alias("star"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("annotation", F.lit("")).alias("annotation"),
        F.coalesce("p.changed", "modificationTime", "mtime", F.lit(0)).alias("mtime"),
        F.coalesce(F.nullif("btime", F.lit(0)), "mtime", F.lit(0)).alias("addedAt"),
        F.coalesce("p.bytes", "size", F.lit(0)).alias("size"),
    )


def read_folders(spark: SparkSession, library: str) -> DataFrame:
    """(id, name, created_at) of the library's top-level folders; empty where they can't be read."""
    shape = "folders array<struct<id:string,name:string>>"
    empty = spark.createDataFrame([], "id string, name string, created_at timestamp_ntz")
    try:
        text = spark.read.option("wholetext", True).text(f"{library}/metadata.json")
        rows = text.select(F.explode(F.from_json("value", shape)["folders"]).alias("f")).select("f.id", "f.name", F.lit(None).cast("timestamp_ntz").alias("created_at"))
        return rows if text.count() else empty
    except Exception:  # no such file
        return empty


#: up to so many files are named to the reader one by one; more are read by pattern
NAMED_FILES = 100_000


def list_items(spark: SparkSession, library: str, settings: Settings | None = None) -> DataFrame:
    """The scanned items with named folders, without any body text."""
    from foliant.operators.index import name_folders

    return name_folders(scan_library(spark, library, settings), read_folders(spark, library))


def read_texts(spark: SparkSession, library: str, items: DataFrame, settings: Settings | None = None, readers: dict | None = None) -> DataFrame:
    """``items`` (from ``list_items``) with the body text of their files: content, method, warn.

    Only payload files of readable formats within the size limit are opened. Up to
    ``NAMED_FILES`` items are read by path; for more, the folder is read by pattern, and
    file names and sizes are tested before any byte is read.
    """
    settings = settings or Settings()
    named = [r.path for r in items.filter((F.col("path") != "") & readable("path", readers)).select("path").limit(NAMED_FILES + 1).toLocalIterator()]
    if not named:
        files = None
    elif len(named) <= NAMED_FILES:
        files = spark.read.format("binaryFile").load(named)
    else:
        name = F.col("_metadata.file_name")
        files = spark.read.format("binaryFile").load(f"{library}/images/*.info/*").filter(readable("_metadata.file_name", readers) & (name != "metadata.json") & ~F.rlike(name, F.lit(THUMBNAIL)))
    if files is not None:
        files = files.filter((F.col("_metadata.file_size") <= settings.max_file_size) & (F.col("length") <= settings.max_file_size))
    return extract_files(items, files, settings.max_chars, settings.max_file_size, readers)


def read_items(spark: SparkSession, library: str, settings: Settings | None = None, readers: dict | None = None) -> DataFrame:
    """All scanned items with named folders and their files' body text, as an index takes them in."""
    return read_texts(spark, library, list_items(spark, library, settings), settings, readers)


def update_index(store: IndexStore, library: str, readers: dict | None = None, **how) -> dict:
    """Bring an index up to date with a library; only new and changed items are opened."""
    spark, settings = store.spark, store.settings
    return store.build(list_items(spark, library, settings), fetch=lambda rows: read_texts(spark, library, rows, settings, readers), **how)


def load_settings(path: str) -> dict:
    """Stored settings; a missing or broken file means none."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
        return value if isinstance(value, dict) else {}
    except (OSError, ValueError):
        return {}


def save_settings(path: str, values: dict) -> None:
    """Write beside the file, then rename over it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    draft = target.with_name(target.name + ".new")
    draft.write_text(json.dumps(values, ensure_ascii=False, indent=1), encoding="utf-8")
    draft.replace(target)
