"""Snapshot store: Parquet tables partitioned by snapshot, one folder per store.

A snapshot's data is written first and its row in ``snapshots`` last: a snapshot
without a row isn't there for readers, so a broken ingest leaves nothing visible.
One writer at a time hands out ids.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark import model
from strataspark.operators import lookups
from strataspark.shared import Scratch

TABLES = {
    "records": model.RECORDS, "fields": model.FIELDS, "strings": model.STRINGS, "subrecords": model.SUBRECORDS,
}


class SnapshotStore:
    """The snapshots below ``root``, any path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, str(root).rstrip("/")

    # folders go through Hadoop's file system: the root may be on any store
    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        return self._fs().exists(self._path(path))

    def _drop(self, path: str) -> None:
        self._fs().delete(self._path(path), True)

    def size(self) -> int:
        """Bytes of all files of the store."""
        return self._fs().getContentSummary(self._path(self.root)).getLength() if self._exists(self.root) else 0

    def _read(self, path: str, schema: str) -> DataFrame:
        if not self._exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    @property
    def snapshots(self) -> DataFrame:
        return self._read(f"{self.root}/snapshots", model.SNAPSHOTS)

    def table(self, name: str, snapshot_id: int | None = None) -> DataFrame:
        """Rows of one table; of one snapshot, by partition pruning, if it is given."""
        rows = self._read(f"{self.root}/{name}", TABLES[name])
        return rows if snapshot_id is None else rows.where(F.col("snapshot_id") == snapshot_id)

    def records(self, snapshot_id: int) -> DataFrame:
        return self.table("records", snapshot_id)

    def fields(self, snapshot_id: int) -> DataFrame:
        return self.table("fields", snapshot_id)

    def strings(self, snapshot_id: int) -> DataFrame:
        return self.table("strings", snapshot_id)

    def keywords(self, snapshot_id: int) -> DataFrame:
        """form_id, editor_id of the keyword records."""
        rows = self.records(snapshot_id).where("record_type = 'KYWD' AND nullif(editor_id, '') IS NOT NULL")
        return rows.select("snapshot_id", "form_id", "editor_id")

    def latest_id(self) -> int | None:
        row = lookups.latest(self.snapshots.select("id")).first()
        return None if row is None else row["id"]

    def two_latest(self) -> tuple[int | None, int | None]:
        """(older, newer); (None, None) with fewer than two snapshots."""
        ids = [r["id"] for r in lookups.latest(self.snapshots.select("id"), 2).collect()]
        return (ids[1], ids[0]) if len(ids) == 2 else (None, None)

    def new_id(self) -> int:
        """One more than the largest id ever given, visible or not."""
        last = self.latest_id() or 0
        for name in TABLES:
            if self._exists(f"{self.root}/{name}"):
                for s in self._fs().listStatus(self._path(f"{self.root}/{name}")):
                    part = s.getPath().getName()
                    if part.startswith("snapshot_id="):
                        last = max(last, int(part.split("=")[1]))
        return last + 1

    def write(self, name: str, snapshot_id: int, rows: DataFrame) -> None:
        """Write one table's rows of a snapshot (its own folder, so a retry replaces them)."""
        columns = [c for c in model.columns(TABLES[name]) if c != "snapshot_id"]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot_id={snapshot_id}")

    def publish(
        self, snapshot_id: int, label: str, file_hash: str, file_size: int, record_count: int, string_count: int,
        has_subrecords: bool,
    ) -> None:
        """Make a written snapshot visible."""
        row = self.spark.createDataFrame(
            [(snapshot_id, label, file_hash, file_size, record_count, string_count, has_subrecords)],
            "id long, label string, file_hash string, file_size long, record_count long, string_count long, has_subrecords boolean",
        )
        row = row.withColumn("created_at", F.date_trunc("second", F.current_timestamp()))
        row.select(*model.columns(model.SNAPSHOTS)).coalesce(1).write.mode("append").parquet(f"{self.root}/snapshots")

    def _keep_rows(self, kept: DataFrame) -> None:
        """Replace the snapshots table by ``kept``: written aside, then swapped in."""
        aside = f"{self.root}/snapshots-{uuid.uuid4().hex}"
        kept.coalesce(1).write.parquet(aside)
        self._drop(f"{self.root}/snapshots")
        self._fs().rename(self._path(aside), self._path(f"{self.root}/snapshots"))

    def delete(self, ids: list[int]) -> int:
        """Delete snapshots: their rows first, their diffs, then their data."""
        if not ids:
            return 0
        there = {r["id"] for r in self.snapshots.select("id").collect()}
        gone = sorted(there & set(ids))
        if gone:
            self._keep_rows(self.snapshots.where(~F.col("id").isin(gone)))
            for name, schema in (("diffs", model.DIFFS), ("diff_entries", model.DIFF_ENTRIES)):
                if self._exists(f"{self.root}/{name}"):
                    self._drop_diffs(name, schema, gone)
        for name in TABLES:
            for i in ids:
                self._drop(f"{self.root}/{name}/snapshot_id={i}")
        return len(gone)

    def _drop_diffs(self, name: str, schema: str, gone: list[int]) -> None:
        for part in self._fs().listStatus(self._path(f"{self.root}/{name}")):
            found = part.getPath().getName()
            if found.startswith("pair=") and {int(x) for x in found[5:].split("-")} & set(gone):
                self._drop(f"{self.root}/{name}/{found}")

    def purge(self, keep: int) -> int:
        """Delete all but the ``keep`` newest snapshots."""
        return self.delete([r["id"] for r in lookups.purge_set(self.snapshots, keep).collect()])

    def clear(self) -> int:
        return self.delete([r["id"] for r in self.snapshots.select("id").collect()])

    def save_diff(self, old_id: int, new_id: int, changes: DataFrame) -> int:
        """Store a diff's entries, then its row; the diff's id is that of its pair of snapshots."""
        diff_id = old_id * (1 << 32) + new_id
        with Scratch(self.spark) as scratch:
            changes = scratch(changes)
            counts = {r["change_type"]: r["n"] for r in changes.groupBy("change_type").agg(F.count("*").alias("n")).collect()}
            entries = changes.select(F.lit(diff_id).cast("long").alias("diff_id"), *model.columns(model.DIFF_ENTRIES)[1:])
            entries.write.mode("overwrite").parquet(f"{self.root}/diff_entries/pair={old_id}-{new_id}")
        row = self.spark.createDataFrame(
            [(diff_id, old_id, new_id, counts.get("added", 0), counts.get("removed", 0), counts.get("modified", 0))],
            "id long, old_snapshot_id long, new_snapshot_id long, added_count long, removed_count long, modified_count long",
        ).withColumn("created_at", F.current_timestamp())
        row.select(*model.columns(model.DIFFS)).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/diffs/pair={old_id}-{new_id}")
        return diff_id

    def diffs(self) -> DataFrame:
        return self._read(f"{self.root}/diffs", model.DIFFS)

    def diff_entries(self) -> DataFrame:
        return self._read(f"{self.root}/diff_entries", model.DIFF_ENTRIES)
