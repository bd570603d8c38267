"""Streaming ingest: snapshots of record files as they land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strataspark.functions.conditions import Functions
from strataspark.ingest import ingest
from strataspark.store import SnapshotStore

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def watch(
    spark: SparkSession, folder: str, store: SnapshotStore, strings: DataFrame, checkpoint: str, pattern: str = "*.esm",
    functions: Functions | None = None,
) -> StreamingQuery:
    """Ingest each new file of the folder once, by its path as label.

    The file list is a stream; a batch that runs again after a failure skips the
    files that have a snapshot.
    """
    stream = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern)
    files = stream.load(folder).select("path", "modificationTime")

    def take(batch: DataFrame, _: int) -> None:
        known = store.snapshots.select(F.col("label").alias("path"))
        new = batch.join(known, "path", "left_anti").orderBy("modificationTime", "path")
        for row in new.select("path").collect():
            ingest(spark, store, row["path"], strings, row["path"], functions=functions)

    return files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
