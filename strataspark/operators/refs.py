"""Names of referenced records and cross references within a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import display_name, hex_id, parse_hex
from strataspark.operators.lookups import edges


def names(records: DataFrame) -> DataFrame:
    """id, name of the records that have one."""
    named = records.select(
        F.col("form_id").alias("id"), display_name(F.col("full_name"), F.col("editor_id")).alias("name")
    )
    return named.where("name IS NOT NULL")


def resolve_fields(fields: DataFrame, records: DataFrame) -> DataFrame:
    """Fields with ``display``: ``value (Name)`` for ids of named records, else the value."""
    keyed = fields.withColumn("__id", F.when(F.col("field_type") == "formid", parse_hex(F.col("field_value"))))
    joined = keyed.join(names(records), F.col("__id") == F.col("id"), "left")
    shown = F.when(F.col("name").isNotNull(), F.concat("field_value", F.lit(" ("), "name", F.lit(")")))
    return joined.withColumn("display", shown.otherwise(F.col("field_value"))).drop("__id", "id", "name")


def xrefs(fields: DataFrame, records: DataFrame, ids: DataFrame) -> DataFrame:
    """src, src_name, field_name, dst, dst_name, ordinal of edges with both ends in ``ids``."""
    inside = (
        edges(fields)
        .join(ids.select(F.col("form_id").alias("src")), "src", "left_semi")
        .join(ids.select(F.col("form_id").alias("dst")), "dst", "left_semi")
    )
    named = names(records)
    sources = named.select(F.col("id").alias("src"), F.col("name").alias("src_name"))
    targets = named.select(F.col("id").alias("dst"), F.col("name").alias("dst_name"))
    out = inside.join(sources, "src", "left").join(targets, "dst", "left")
    return out.select(
        "src", F.coalesce("src_name", hex_id(F.col("src"))).alias("src_name"), "field_name",
        "dst", F.coalesce("dst_name", hex_id(F.col("dst"))).alias("dst_name"), "ordinal",
    )


def forward(refs: DataFrame) -> DataFrame:
    """src, targets: what each record refers to, in field order."""
    e = F.array_sort(F.collect_list(F.struct("ordinal", "field_name", "dst", "dst_name")))
    return refs.groupBy("src").agg(e.alias("targets"))


#: Ids of sources in one row of ``reverse``: bounds its array whatever refers to a record.
SOURCE_IDS = 1 << 16


def reverse(refs: DataFrame) -> DataFrame:
    """dst, part, sources: what refers to each record, by source and field order; in parts
    of SOURCE_IDS ids, as much may refer to one record."""
    e = F.array_sort(F.collect_list(F.struct("src", "ordinal", "field_name", "src_name")))
    return refs.groupBy("dst", F.floor(F.col("src") / SOURCE_IDS).alias("part")).agg(e.alias("sources"))


def sequence_names(ids: DataFrame, records: DataFrame) -> DataFrame:
    """pos, form_id, name of an ordered id list; empty where no record or name is known."""
    named = records.select("form_id", display_name(F.col("full_name"), F.col("editor_id")).alias("name"))
    return ids.join(named, "form_id", "left").select("pos", "form_id", F.coalesce("name", F.lit("")).alias("name"))
