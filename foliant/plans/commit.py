"""A pointer file that is replaced in one step, in any folder Hadoop can rename in."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop.toUri() if "://" in path else spark._jvm.java.net.URI("file:///"), spark._jsc.hadoopConfiguration())


def read_pointer(spark: SparkSession, path: str) -> dict | None:
    """The JSON object of a pointer file, None where there is none or it can't be read."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(hadoop):
        return None
    stream = files.open(hadoop)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def write_pointer(spark: SparkSession, path: str, value: dict) -> None:
    """Write beside the pointer file, then rename over it: readers see the old or the new object."""
    target, context = _path(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    stream = files.create(draft, True)
    try:
        stream.write(bytearray(json.dumps(value, ensure_ascii=False).encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(draft, target, options)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder with all it holds, if it exists."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies directly in a folder; none if it doesn't exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []


def listing(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of a file, or of what lies directly in a folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files)
