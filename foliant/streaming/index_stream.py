"""Extension: an index that follows a stream of item files.

The batch engine has no streams; this applies its incremental build to each micro-batch of
new item files. The batch id goes into the settings of the checkpoint, so a batch that is
repeated after a failure meets documents that are unchanged and does nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from foliant.operators.index import IndexStore


def follow(spark: SparkSession, source: str, schema: T.StructType, store: IndexStore, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Index the item rows of Parquet files as they arrive under ``source``."""
    rows = spark.readStream.schema(schema).parquet(source)

    def apply(batch, _: int) -> None:
        if not batch.isEmpty():
            store.build(batch, partial=True)

    writer = rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
