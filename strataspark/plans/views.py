"""Snapshot-shaped views over the driver's tables, in Spark and in DuckDB SQL.

Two snapshots of ``part`` stand for two loads of a record file, ``lineitem`` for
references between records, ``documents`` for the string table and the days of
``events`` for the snapshot list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.text import hex_id


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _records(part: DataFrame, new: bool) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    if new:
        size = F.when(key % 4 == 0, size + 1).otherwise(size)
    cents = F.round(F.col("p_retailprice") * 100).cast("long")
    prefix = F.when(key % 13 == 0, "ATX_").when(key % 17 == 0, "test_").when(key % 19 == 0, "zzz_").otherwise("")
    text = F.concat_ws("/", "p_name", "p_brand", size.cast("string"), cents.cast("string"))
    if new:
        text = F.when(key % 9 == 0, F.concat(text, F.lit("/h"))).otherwise(text)
    return part.where(key % 10 != (7 if new else 3)).select(
        key.alias("form_id"), F.col("p_type").alias("record_type"),
        F.concat(prefix, F.replace("p_name", F.lit(" "), F.lit("_"))).alias("editor_id"),
        F.col("p_name").alias("full_name"), F.sha2(text, 256).alias("data_hash"),
        size.cast("long").alias("size"), cents.alias("cents"), F.col("p_brand").alias("brand"),
    )


def records(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    return _records(read(spark, sf_dir, "part"), new).drop("size", "cents", "brand")


def fields(spark: SparkSession, sf_dir: str, new: bool) -> DataFrame:
    """The records' decoded fields, one row for each."""
    wide = _records(read(spark, sf_dir, "part"), new)
    return wide.select(
        "form_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("field_name"), v.alias("field_value"), F.lit(t).alias("field_type"))
                    for i, (n, v, t) in enumerate(
                        (
                            ("size", F.col("size").cast("string"), "int"),
                            ("cents", F.col("cents").cast("string"), "int"),
                            ("brand", F.col("brand"), "str"),
                            ("supplier_ref", hex_id(F.col("form_id") % 100), "formid"),
                        )
                    )
                ]
            )
        ),
    )


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("string_id"), "text")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot for each day of events: id (from 1), label, record_count."""
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("record_count"))
    first = days.agg(F.min("day").alias("first"))
    return days.join(F.broadcast(first)).select(
        (F.datediff("day", "first") + 1).cast("long").alias("id"),
        F.concat(F.lit("snapshot-"), F.date_format("day", "yyyyMMdd")).alias("label"), "record_count",
    )


# The same views in DuckDB SQL.
def _records_sql(new: bool) -> str:
    size = "CASE WHEN p_partkey % 4 = 0 THEN p_size + 1 ELSE p_size END" if new else "p_size"
    tail = "|| CASE WHEN p_partkey % 9 = 0 THEN '/h' ELSE '' END" if new else ""
    return f"""
SELECT form_id, record_type, editor_id, full_name, sha256(t {tail.replace('p_partkey', 'form_id')}) AS data_hash, size, cents, brand FROM (
  SELECT p_partkey AS form_id, p_type AS record_type,
    CASE WHEN p_partkey % 13 = 0 THEN 'ATX_' WHEN p_partkey % 17 = 0 THEN 'test_' WHEN p_partkey % 19 = 0 THEN 'zzz_' ELSE '' END || replace(p_name, ' ', '_') AS editor_id,
    p_name AS full_name, ({size})::BIGINT AS size, round(p_retailprice * 100)::BIGINT AS cents, p_brand AS brand,
    p_name || '/' || p_brand || '/' || ({size})::VARCHAR || '/' || (round(p_retailprice * 100)::BIGINT)::VARCHAR AS t
  FROM part WHERE p_partkey % 10 <> {7 if new else 3})"""


def _fields_sql(view: str) -> str:
    return f"""
SELECT form_id, 0 AS ordinal, 'size' AS field_name, size::VARCHAR AS field_value, 'int' AS field_type FROM {view}
UNION ALL SELECT form_id, 1, 'cents', cents::VARCHAR, 'int' FROM {view}
UNION ALL SELECT form_id, 2, 'brand', brand, 'str' FROM {view}
UNION ALL SELECT form_id, 3, 'supplier_ref', printf('0x%08X', form_id % 100), 'formid' FROM {view}"""


def with_views(body: str, recursive: bool = False) -> str:
    """The body after the views it may name."""
    days = """
SELECT (datediff('day', min(day) OVER (), day) + 1)::BIGINT AS id, 'snapshot-' || strftime(day, '%Y%m%d') AS label, record_count FROM (
  SELECT ts::DATE AS day, count(*) AS record_count FROM events GROUP BY 1)"""
    views = {
        "r_old": _records_sql(False), "r_new": _records_sql(True), "f_old": _fields_sql("r_old"), "f_new": _fields_sql("r_new"),
        "strs": "SELECT doc_id AS string_id, text FROM documents", "snaps": days,
    }
    named = ",\n".join(f"{k} AS ({v})" for k, v in views.items())
    return f"WITH {'RECURSIVE ' if recursive else ''}{named}{',' if body.lstrip().startswith('+') else ''}\n{body.lstrip().lstrip('+')}"
