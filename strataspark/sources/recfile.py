"""Spark data source "recfile": records of binary record files.

    spark.dataSource.register(RecordFileSource)
    spark.read.format("recfile").load(path)  # or a list of paths

Options: ``skipTypes`` (comma-separated; default the placement types),
``targetBytes`` of a partition (default 32 MB), ``pushDown`` (true where the
session sets spark.sql.python.filterPushdown.enabled). The driver reads group headers to
plan partitions of whole group children; each task reads its range alone. Filters
on record_type prune top-level groups and records at their headers.
Several files are one scan: a partition takes ranges of small files up to ``targetBytes``.
``ordinal`` is a record's offset in its file, so it orders records as the file does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from strataspark.functions.tables import SKIPPED_TYPES
from strataspark.model import RAW_RECORDS
from strataspark.sources import binary

TARGET_BYTES = 32 << 20


#: Records of an Arrow batch.
BATCH_RECORDS = 2048


def _batch(found: list[binary.RawRecord]) -> pa.RecordBatch:
    subs = [s for r in found for s in r.subrecords]
    parts = pa.StructArray.from_arrays(
        [
            pa.array([name for name, _ in subs], type=pa.string()), pa.array([len(d) for _, d in subs], type=pa.int32()),
            pa.array([d for _, d in subs], type=pa.binary()),
        ],
        names=["type", "size", "data"],
    )
    ends = np.cumsum([0, *(len(r.subrecords) for r in found)]).astype(np.int32)
    number = lambda name, kind: pa.array([getattr(r, name) for r in found], type=kind)
    columns = [
        number("at", pa.int64()), pa.array([r.kind for r in found], type=pa.string()),
        *(number(c, pa.int64()) for c in ("data_size", "flags", "form_id", "revision")), number("version", pa.int32()),
        pa.ListArray.from_arrays(pa.array(ends), parts),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["ordinal", "record_type", "data_size", "flags", "form_id", "revision", "version", "subrecords"])


@dataclass
class Ranges(InputPartition):
    """(path, start, end) of each range."""

    parts: list[tuple[str, int, int]]


class RecordFileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recfile"

    def schema(self) -> str:
        return RAW_RECORDS

    def reader(self, schema) -> RecordFileReader:
        pushing = self.options.get("pushDown", "false").lower() == "true"
        return (PushingReader if pushing else RecordFileReader)(self.options)


class RecordFileReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        given = options.get("skipTypes")
        names = SKIPPED_TYPES if given is None else [t for t in given.split(",") if t]
        self.skipped = frozenset(t.encode("ascii") for t in names)
        self.target = int(options.get("targetBytes", TARGET_BYTES))
        self.wanted: frozenset[str] | None = None

    def partitions(self) -> list[Ranges]:
        found, room = [], 0
        for path in self.paths:
            with binary.open_any(path) as f:
                ranges = binary.plan_ranges(f, self.skipped, self.target, self.wanted)
            for start, end in ranges:
                if not found or room < end - start:
                    found.append(Ranges([]))
                    room = self.target
                found[-1].parts.append((path, start, end))
                room -= end - start
        return found or [Ranges([])]  # without partitions Spark reads one that is None

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for path, start, end in partition.parts:
            with binary.open_any(path) as f:
                f.seek(start)
                data = f.read(end - start)
            found = binary.records_in(data, start, self.skipped, self.wanted)
            while some := list(islice(found, BATCH_RECORDS)):
                yield _batch(some)


class PushingReader(RecordFileReader):
    """Takes filters; sessions refuse such a reader unless they allow pushdown to Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Take record types from the filters; Spark still applies all of them."""
        for f in filters:
            values = None
            if isinstance(f, EqualTo) and f.attribute == ("record_type",):
                values = {f.value}
            elif isinstance(f, In) and f.attribute == ("record_type",):
                values = set(f.value)
            if values is not None:
                self.wanted = frozenset(values if self.wanted is None else self.wanted & values)
            yield f


def read_records(
    spark: SparkSession, path: str | list[str], skip_types: tuple[str, ...] | None = None, target_bytes: int = TARGET_BYTES
) -> DataFrame:
    """Records of one file, or of several in one scan."""
    spark.dataSource.register(RecordFileSource)
    reader = spark.read.format("recfile").option("targetBytes", str(target_bytes))
    reader = reader.option("pushDown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if skip_types is not None:
        reader = reader.option("skipTypes", ",".join(skip_types))
    return reader.load(path)
