"""Snapshot diff: records by content hash, then fields of the changed ones.

Sides may come from one store or two: both are plain tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = ("record_type", "editor_id", "full_name", "data_hash")


def diff_records(old: DataFrame, new: DataFrame, record_type: str | None = None) -> DataFrame:
    """form_id, change_type, record_type, editor_id, full_name, old_type, old_hash, new_hash.

    One full outer join on the key; added and modified rows show the new side,
    removed rows the old one. ``record_type`` filters added and removed rows by
    their own type and modified rows by the old type.
    """
    a = old.select("form_id", *[F.col(c).alias(f"old_{c}") for c in KEPT])
    b = new.select("form_id", *[F.col(c).alias(f"new_{c}") for c in KEPT])
    change = (
        F.when(F.col("old_data_hash").isNull(), "added")
        .when(F.col("new_data_hash").isNull(), "removed")
        .when(F.col("old_data_hash") != F.col("new_data_hash"), "modified")
    )
    joined = a.join(b, "form_id", "full_outer").withColumn("change_type", change).where("change_type IS NOT NULL")
    gone = F.col("change_type") == "removed"
    out = joined.select(
        "form_id", "change_type",
        *[F.when(gone, F.col(f"old_{c}")).otherwise(F.col(f"new_{c}")).alias(c) for c in KEPT[:3]],
        F.col("old_record_type").alias("old_type"),
        F.col("old_data_hash").alias("old_hash"), F.col("new_data_hash").alias("new_hash"),
    )
    if record_type is not None:
        own = F.when(F.col("change_type") == "modified", F.col("old_type")).otherwise(F.col("record_type"))
        out = out.where(own == record_type)
    return out


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.join(old.select("form_id"), "form_id", "left_anti")


def removed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("form_id"), "form_id", "left_anti")


def modified(old: DataFrame, new: DataFrame) -> DataFrame:
    """New side of records whose hash differs, with old_hash."""
    before = old.select("form_id", F.col("data_hash").alias("old_hash"))
    return new.join(before, "form_id").where(F.col("data_hash") != F.col("old_hash"))


def summary(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))


def diff_fields(changes: DataFrame, old_fields: DataFrame, new_fields: DataFrame) -> DataFrame:
    """form_id, field_name, old_value, new_value, field_type of the modified records.

    Values alone are compared; the type is the new field's, else the old one's.
    Only the modified records' fields are read through the join.
    """
    ids = changes.where(F.col("change_type") == "modified").select("form_id")

    def side(fields: DataFrame, name: str) -> DataFrame:
        return fields.join(ids, "form_id", "left_semi").select(
            "form_id", "field_name", F.col("field_value").alias(f"{name}_value"), F.col("field_type").alias(f"{name}_type")
        )

    both = side(old_fields, "old").join(side(new_fields, "new"), ["form_id", "field_name"], "full_outer")
    kind = F.when(F.col("new_value").isNotNull(), F.col("new_type")).otherwise(F.col("old_type"))
    return both.where(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(
        "form_id", "field_name", "old_value", "new_value", F.coalesce(kind, F.lit("str")).alias("field_type")
    )


def hash_only(changes: DataFrame, field_changes: DataFrame) -> DataFrame:
    """Modified records none of whose fields changed."""
    return changes.where(F.col("change_type") == "modified").join(
        field_changes.select("form_id"), "form_id", "left_anti"
    )
