"""Point lookups, listings and counts over the snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataspark.functions.text import contains, parse_hex

STRING_LIMIT = 200


def snapshot_by_id(snapshots: DataFrame, snapshot_id: int) -> DataFrame:
    return snapshots.where(F.col("id") == snapshot_id)


def list_snapshots(snapshots: DataFrame) -> DataFrame:
    return snapshots.orderBy("id")


def latest(snapshots: DataFrame, n: int = 1) -> DataFrame:
    """The n newest snapshots, newest first."""
    return snapshots.orderBy(F.desc("id")).limit(n)


def purge_set(snapshots: DataFrame, keep: int) -> DataFrame:
    """Ids of all but the ``keep`` newest snapshots."""
    if keep < 0:
        raise ValueError("keep must not be negative")
    return snapshots.select("id").orderBy(F.desc("id")).offset(keep)


def records_by_type(records: DataFrame, record_type: str) -> DataFrame:
    return records.where(F.col("record_type") == record_type).orderBy("form_id")


def record_by_key(records: DataFrame, form_id: int) -> DataFrame:
    return records.where(F.col("form_id") == form_id)


def fields_of(fields: DataFrame, form_id: int) -> DataFrame:
    """A record's fields in the order they were decoded."""
    return fields.where(F.col("form_id") == form_id).orderBy("ordinal")


def hashes(records: DataFrame) -> DataFrame:
    return records.select("form_id", "data_hash")


def paths_of(fields: DataFrame, ids: DataFrame, field_name: str) -> DataFrame:
    """form_id, field_value of one field (icon, model) for the ids of a table."""
    wanted = fields.where(F.col("field_name") == field_name).select("form_id", "field_value")
    return wanted.join(ids.select("form_id"), "form_id", "left_semi")


def string_by_id(strings: DataFrame, string_id: int) -> DataFrame:
    return strings.where(F.col("string_id") == string_id)


def search_strings(strings: DataFrame, query: str, limit: int = STRING_LIMIT) -> DataFrame:
    """Strings that contain the query (wildcards alive), the first ``limit`` by id."""
    return strings.where(contains(F.col("text"), query)).orderBy("string_id").limit(limit)


def strings_containing(strings: DataFrame, query: str) -> DataFrame:
    """Strings that contain the query, letters of any script folded, no wildcards."""
    return strings.where(F.contains(F.lower("text"), F.lower(F.lit(query))))


def type_counts(records: DataFrame) -> DataFrame:
    """record_type, n: most frequent first, ties by type."""
    return records.groupBy("record_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "record_type")


def string_count(strings: DataFrame) -> DataFrame:
    return strings.agg(F.count("*").alias("n"))


def subrecord_stats(raw: DataFrame, top: int = 30) -> DataFrame:
    """record_type, n, subrecords of the most frequent types of a record file."""
    stats = raw.groupBy("record_type").agg(
        F.count("*").alias("n"), F.sum(F.size("subrecords")).cast("long").alias("subrecords")
    )
    return stats.orderBy(F.desc("n"), "record_type").limit(top)


def capped(rows: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group."""
    place = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= n).drop("__place")


def upsert(rows: DataFrame, key: list[str], ordinal: str = "ordinal") -> DataFrame:
    """The last row of each key by ordinal, as insert-or-replace leaves it."""
    last = Window.partitionBy(*key).orderBy(F.desc(ordinal))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def merge_by_priority(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of tables; of rows with one key the last table's stays."""
    tagged = [p.withColumn("__source", F.lit(i)) for i, p in enumerate(parts)]
    union = tagged[0]
    for p in tagged[1:]:
        union = union.unionByName(p)
    return upsert(union, [key], "__source").drop("__source")


def localized(records: DataFrame, strings: DataFrame) -> DataFrame:
    """Records with full_name and desc_text looked up by full_name_id and desc_id."""
    names = strings.select(F.col("string_id").alias("__name_id"), F.col("text").alias("full_name"))
    texts = strings.select(F.col("string_id").alias("__desc_id"), F.col("text").alias("desc_text"))
    out = records.join(names, F.col("full_name_id") == F.col("__name_id"), "left")
    return out.join(texts, F.col("desc_id") == F.col("__desc_id"), "left").drop("__name_id", "__desc_id")


def edges(fields: DataFrame) -> DataFrame:
    """src, field_name, dst, ordinal of every id-valued field; bad and zero ids left out."""
    found = fields.where(F.col("field_type") == "formid").select(
        F.col("form_id").alias("src"), "field_name", parse_hex(F.col("field_value")).alias("dst"), "ordinal"
    )
    return found.where(F.col("dst").isNotNull() & (F.col("dst") != 0))


def edge_groups(fields: DataFrame) -> DataFrame:
    """src, refs: the edges of each source in the order of its fields."""
    grouped = edges(fields).groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "field_name", "dst"))).alias("e")
    )
    refs = F.transform("e", lambda x: F.struct(x["field_name"].alias("field_name"), x["dst"].alias("dst")))
    return grouped.select("src", refs.alias("refs"))
