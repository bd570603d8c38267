"""Ingest of a record file as a snapshot, and its parts as DataFrame operators."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.conditions import Functions
from strataspark.functions.decoders import decode, string_ids
from strataspark.operators.lookups import localized, upsert
from strataspark.sources import binary
from strataspark.sources.recfile import read_records
from strataspark.shared import Scratch
from strataspark.store import SnapshotStore

HASHED_BYTES = 1 << 20


def content_hash(subrecords: Column) -> Column:
    """SHA-256 of the subrecords in order: name, size as two bytes, data."""
    # strings hold any bytes, so the parts are joined as they are
    size = lambda s: F.unhex(F.concat(F.right(F.format_string("%04X", s["size"]), F.lit(2)), F.left(F.format_string("%04X", s["size"]), F.lit(2))))
    part = lambda s: F.concat(s["type"], size(s).cast("string"), s["data"].cast("string"))
    return F.sha2(F.array_join(F.transform(subrecords, part), "").cast("binary"), 256)


def first_data(subrecords: Column, name: str, size: int | None = None) -> Column:
    """Data of the first subrecord of a name (and of a size, if given)."""
    return F.get(
        F.filter(subrecords, lambda s: (s["type"] == name) & (F.lit(True) if size is None else s["size"] == size)), 0
    )["data"]


def _u32(data: Column) -> Column:
    h = F.hex(data)
    swapped = F.concat(*[F.substring(h, i, 2) for i in (7, 5, 3, 1)])
    return F.when(F.octet_length(data) == 4, F.conv(swapped, 16, 10).cast("long"))


def text_of(data: Column) -> Column:
    """UTF-8 text without trailing zero bytes; bad bytes become U+FFFD."""
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "\\x00+$", "")


def project(raw: DataFrame) -> DataFrame:
    """Records' own columns from their subrecords; names are still string ids."""
    subs = F.col("subrecords")
    return raw.select(
        "ordinal", "form_id", "record_type", text_of(first_data(subs, "EDID")).alias("editor_id"),
        _u32(first_data(subs, "FULL", 4)).alias("full_name_id"), _u32(first_data(subs, "DESC", 4)).alias("desc_id"),
        content_hash(subs).alias("data_hash"), "flags", "data_size",
    )


def decoded(raw: DataFrame, strings: DataFrame, functions: Functions | None = None) -> DataFrame:
    """record, form_id, ordinal, field_name, field_value, field_type of all records.

    The string ids that decoding needs are found first and joined as a map, so no
    string table has to fit a task.
    """
    known = functions or {}
    names = raw.select("ordinal", "form_id", "record_type", "subrecords")

    @F.pandas_udf("array<long>")
    def needed(kinds: pd.Series, subs: pd.Series) -> pd.Series:
        return pd.Series([string_ids(k, _pairs(s)) for k, s in zip(kinds, subs, strict=True)], dtype=object)

    some = names.where(F.col("record_type").isin("ACTI", "INFO", "MESG"))
    asked = some.select("ordinal", F.explode(needed("record_type", "subrecords")).alias("string_id"))
    texts = asked.join(strings.select("string_id", "text"), "string_id")
    looked_up = texts.groupBy(F.col("ordinal").alias("o")).agg(
        F.map_from_entries(F.collect_set(F.struct("string_id", "text"))).alias("texts")
    )
    rows = names.join(looked_up, F.col("ordinal") == F.col("o"), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            subs = batch["subrecords"]
            ends, parts = subs.offsets.to_pylist(), subs.values
            sub_names, sub_data = parts.field("type").to_pylist(), parts.field("data").to_pylist()
            keys, form_ids, kinds, texts = (batch[c].to_pylist() for c in ("ordinal", "form_id", "record_type", "texts"))
            n, names, values, types = [], [], [], []
            for k, (kind, own) in enumerate(zip(kinds, texts, strict=True)):
                pairs = list(zip(sub_names[ends[k] : ends[k + 1]], sub_data[ends[k] : ends[k + 1]], strict=True))
                found = decode(kind, pairs, dict(own or ()).get, known)
                n.append(len(found))
                for name, value, field_type in found:
                    names.append(name)
                    values.append(value)
                    types.append(field_type)
            times = np.array(n, dtype=np.int64)
            place = np.arange(len(names)) - np.repeat(np.cumsum(times) - times, times)
            columns = [
                np.repeat(np.array(keys, dtype=np.int64), times), np.repeat(np.array(form_ids, dtype=np.int64), times), place.astype(np.int32),
            ]
            text = [pa.array(x, type=pa.string()) for x in (names, values, types)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *text], [x.split()[0] for x in DECODED.split(", ")])

    return rows.select("ordinal", "form_id", "record_type", "subrecords", "texts").mapInArrow(run, DECODED)


#: Rows of ``decoded``; record is the ordinal of the field's record.
DECODED = "record long, form_id long, ordinal int, field_name string, field_value string, field_type string"


def _pairs(subs) -> list[tuple[str, bytes]]:
    return [(s["type"], bytes(s["data"])) for s in subs]


def raw_subrecords(raw: DataFrame) -> DataFrame:
    """form_id, sub_type, sub_index, data of every subrecord."""
    return raw.select("form_id", F.posexplode("subrecords").alias("sub_index", "s")).select(
        "form_id", F.col("s.type").alias("sub_type"), "sub_index", F.col("s.data").alias("data")
    )


def head_hash(path: str) -> tuple[str, int]:
    """SHA-256 of a file's first MiB, and its size."""
    with binary.open_any(path) as f:
        size = binary.file_size(f)
        f.seek(0)
        return sha256(f.read(HASHED_BYTES)).hexdigest(), size


def ingest(
    spark: SparkSession, store: SnapshotStore, path: str, strings: DataFrame, label: str | None = None, full: bool = False,
    functions: Functions | None = None,
) -> int:
    """Read a record file into a new snapshot and return its id.

    Of records with one id the last in the file stays, as do its fields. The
    snapshot becomes visible when all its tables are written.
    """
    snapshot_id = store.new_id()
    label = label or datetime.now().strftime("snapshot-%Y%m%d-%H%M%S")
    digest, size = head_hash(path)
    with Scratch(spark) as scratch:
        raw = scratch(read_records(spark, path))
        texts = scratch(strings)
        store.write("records", snapshot_id, upsert(localized(project(raw), texts), ["form_id"]))
        fields = upsert(decoded(raw, texts, functions), ["form_id", "field_name"], "record")
        store.write("fields", snapshot_id, fields)
        store.write("strings", snapshot_id, texts.select("string_id", "text", F.lit("").alias("source")))
        if full:
            store.write("subrecords", snapshot_id, raw_subrecords(raw))
        store.publish(snapshot_id, label, digest, size, raw.count(), texts.count(), full)
    return snapshot_id
