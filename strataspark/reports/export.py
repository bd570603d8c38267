"""Record exports: CSV and JSON rows as tables, and their files."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator
from itertools import chain
from textwrap import indent

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import hex_id
from strataspark.operators.refs import resolve_fields

CSV_COLUMNS = ("form_id", "record_type", "editor_id", "full_name", "description", "flags", "data_size", "data_hash")


def typed_rows(records: DataFrame) -> DataFrame:
    """CSV rows of an export of one type: hex flags, 200 characters of description, no nulls."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return records.select(
        hex_id(F.col("form_id")).alias("form_id"), "record_type", text("editor_id"), text("full_name"),
        F.substring(F.coalesce("desc_text", F.lit("")), 1, 200).alias("description"),
        hex_id(F.col("flags")).alias("flags"), "data_size", "data_hash",
    )


def all_rows(records: DataFrame) -> DataFrame:
    """CSV rows of an export of all types: decimal flags, whole descriptions."""
    return records.select(
        hex_id(F.col("form_id")).alias("form_id"), "record_type", "editor_id", "full_name",
        F.col("desc_text").alias("description"), "flags", "data_size", "data_hash",
    )


def csv_line(columns: list[str]) -> Column:
    """A row as a CSV line: values with commas, quotes or line breaks are quoted, null is empty."""

    def value(c: str) -> Column:
        text = F.coalesce(F.col(c).cast("string"), F.lit(""))
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.when(text.rlike('[",\\r\\n]'), quoted).otherwise(text)

    return F.concat_ws(",", *map(value, columns))


def write_csv(records: DataFrame, path: str, record_type: str | None = None) -> None:
    """CSV part files, written in parallel: put together in order of name they are one
    CSV in order of type and id, with its header first."""
    rows = records.where(F.col("record_type") == record_type) if record_type else records
    keyed = (typed_rows if record_type else all_rows)(rows)
    lines = keyed.select(F.lit(1).alias("k"), "record_type", "form_id", csv_line(keyed.columns).alias("value"))
    header = records.sparkSession.createDataFrame([(0, "", "", ",".join(CSV_COLUMNS))], lines.schema)
    ordered = header.unionByName(lines).orderBy("k", "record_type", "form_id")
    ordered.select("value").write.mode("overwrite").option("lineSep", "\r\n").text(path)


def csv_parts(records: DataFrame, record_type: str | None = None) -> Iterator[str]:
    """The CSV line by line, in order of type and id, as the rows reach the driver."""
    rows = records.where(F.col("record_type") == record_type) if record_type else records
    rows = (typed_rows if record_type else all_rows)(rows.orderBy("record_type", "form_id"))
    line = io.StringIO()
    writer = csv.writer(line)
    for row in chain([CSV_COLUMNS], rows.toLocalIterator(prefetchPartitions=True)):
        writer.writerow(row)
        yield line.getvalue()
        line.seek(0)
        line.truncate()


def json_rows(records: DataFrame, fields: DataFrame) -> DataFrame:
    """form_id and the exported values of each record, its fields as an ordered array."""
    shown = resolve_fields(fields, records)
    grouped = shown.groupBy(F.col("form_id").alias("f")).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "field_name", "display"))).alias("fields")
    )
    return records.join(grouped, F.col("form_id") == F.col("f"), "left").select(
        "form_id", "record_type", "editor_id", "full_name", "flags", "data_size", "fields"
    )


def json_parts(records: DataFrame, fields: DataFrame, record_type: str | None = None) -> Iterator[str]:
    """All records with their fields as one JSON array, record by record."""
    rows = json_rows(records, fields)
    if record_type:
        rows = rows.where(F.col("record_type") == record_type)
    before = "[\n"
    for r in rows.orderBy("record_type", "form_id").toLocalIterator(prefetchPartitions=True):
        entry = {
            "form_id": f"0x{r['form_id']:08X}", "record_type": r["record_type"], "editor_id": r["editor_id"],
            "full_name": r["full_name"], "flags": f"0x{r['flags']:08X}", "data_size": r["data_size"],
        }
        if r["fields"]:
            entry["fields"] = {f["field_name"]: f["display"] for f in r["fields"]}
        yield before + indent(json.dumps(entry, indent=2), "  ")
        before = ",\n"
    yield "[]" if before == "[\n" else "\n]"
