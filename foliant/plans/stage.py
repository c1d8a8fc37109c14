"""Intermediate tables in the folder that all executors share.

``stage`` writes a DataFrame as Parquet and reads it back: the lineage ends there,
so a lost executor costs a re-read and never a recomputation, and a plan that is
used twice is computed once. Staged tables are deleted when the program ends, or when the
``scratch`` block ends in which they were made.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
import shutil
import tempfile
from typing import TypeVar
import uuid

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

_made: list[tuple[SparkSession, str]] = []
_own: dict[str, str | None] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder where that is unset (tests, local mode)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        folder = _own.setdefault(app, None) or "file://" + tempfile.mkdtemp(prefix="foliant-")
        _own[app] = folder
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, removed when the program or the ``scratch`` block around it ends."""
    path = f"{shared_dir(spark).rstrip('/')}/foliant-{uuid.uuid4().hex}/{name}"
    _made.append((spark, path.rpartition("/")[0]))
    return path


def stage(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written once and read back with its schema."""
    spark = frame.sparkSession
    path = new_folder(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def at_once(*actions: Callable[[], T]) -> list[T]:
    """Run independent Spark actions side by side, so that small ones don't wait for each other; results in order, the first error is raised."""
    inherit = inheritable_thread_target(SparkSession.builder.getOrCreate())
    with ThreadPoolExecutor(len(actions)) as pool:
        return [f.result() for f in [pool.submit(inherit(a)) for a in actions]]


@contextmanager
def scratch() -> Iterator[None]:
    """Delete at the end of the block what was staged in it; frames over those tables can't be used afterwards."""
    before = len(_made)
    try:
        yield
    finally:
        _delete(before)


def _delete(since: int) -> None:
    made, _made[since:] = _made[since:], []
    for spark, path in made:
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone
            if path.startswith("file://"):
                shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _clean() -> None:
    _delete(0)


atexit.register(_clean)
