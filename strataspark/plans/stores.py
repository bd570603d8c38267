"""Queries over a snapshot store that is filled from the driver's tables, over raw records that are
built from them, over exports, and over the small single-file formats."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark import ingest
from strataspark.operators import diff, lookups
from strataspark.plans import files, views
from strataspark.plans.views import read
from strataspark.reports import export
from strataspark.shared import shared_dir
from strataspark.sources import archives
from strataspark.store import SnapshotStore


def _store(spark: SparkSession) -> SnapshotStore:
    return SnapshotStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


def _put(store: SnapshotStore, spark: SparkSession, sf_dir: str, new: bool, label: str) -> int:
    """A snapshot of the views' records, fields and strings."""
    own, texts = store.new_id(), views.strings(spark, sf_dir)
    nothing = [F.lit(None).cast("string").alias("desc_text"), *[F.lit(None).cast("long").alias(c) for c in ("full_name_id", "desc_id")]]
    sizes = [(F.col("form_id") % 7).alias("flags"), (F.col("form_id") % 100).alias("data_size")]
    store.write("records", own, views.records(spark, sf_dir, new).select("*", *nothing, *sizes))
    store.write("fields", own, views.fields(spark, sf_dir, new).withColumn("ordinal", F.col("ordinal").cast("int")))
    store.write("strings", own, texts.withColumn("source", F.lit("")))
    store.publish(own, label, "0" * 64, 1234, store.records(own).count(), store.strings(own).count(), False)
    return own


def store_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshots, of which a purge leaves the two newest; an id is never given twice."""
    store = _store(spark)
    for i, new in enumerate((False, True, False)):
        _put(store, spark, sf_dir, new, f"load {i + 1}")
    store.purge(2)
    store.delete([3])
    _put(store, spark, sf_dir, True, "load 4")
    return lookups.list_snapshots(store.snapshots).select("id", "label", "file_size", "record_count", "string_count", "has_subrecords")


STORE_SNAPSHOTS = """SELECT id::BIGINT AS id, 'load ' || CASE id WHEN 3 THEN 4 ELSE id END AS label, 1234::BIGINT AS file_size,
    (SELECT count(*) FROM r_new) AS record_count, (SELECT count(*) FROM strs) AS string_count, false AS has_subrecords FROM (VALUES (2), (3)) v(id)"""


def store_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the second snapshot with their number of fields, and the fields of one record."""
    store = _store(spark)
    _put(store, spark, sf_dir, False, "one")
    _put(store, spark, sf_dir, True, "two")
    older, newer = store.two_latest()
    n = store.fields(newer).groupBy("form_id").agg(F.count("*").alias("n_fields"))
    own = store.records(newer).join(n, "form_id").select("form_id", "record_type", "editor_id", "data_hash", "flags", "data_size", "n_fields")
    of_one = lookups.fields_of(store.fields(older), 42).agg(F.count("*").alias("of_one"))
    return own.join(F.broadcast(of_one))


STORE_TABLES = """SELECT form_id, record_type, editor_id, data_hash, form_id % 7 AS flags, form_id % 100 AS data_size, 4::BIGINT AS n_fields,
    (SELECT count(*) FROM f_old WHERE form_id = 42) AS of_one FROM r_new"""


def store_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entries of the diff of two stored snapshots, with the stored counts."""
    store = _store(spark)
    one, two = _put(store, spark, sf_dir, False, "one"), _put(store, spark, sf_dir, True, "two")
    own = store.save_diff(one, two, diff.diff_records(store.records(one), store.records(two)))
    counts = store.diffs().where(F.col("id") == own).select("added_count", "removed_count", "modified_count")
    entries = store.diff_entries().where(F.col("diff_id") == own).select("form_id", "change_type", "record_type", "old_hash", "new_hash")
    return entries.join(F.broadcast(counts))


def store_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword records of a stored snapshot."""
    store = _store(spark)
    own = store.new_id()
    rows = views.records(spark, sf_dir, new=True).withColumn("record_type", F.when(F.col("form_id") % 3 == 0, "KYWD").otherwise("MISC"))
    rows = rows.withColumn("editor_id", F.when(F.col("form_id") % 5 != 0, F.col("editor_id")).otherwise(""))
    more = {c: F.lit(None).cast("long") for c in ("full_name_id", "desc_id", "flags", "data_size")}
    store.write("records", own, rows.withColumns({**more, "desc_text": F.lit(None).cast("string")}))
    return store.keywords(own).select("form_id", "editor_id")


STORE_KEYWORDS = "SELECT form_id, editor_id FROM r_new WHERE form_id % 3 = 0 AND form_id % 5 <> 0 AND editor_id <> ''"


# Raw records


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw records: names, string ids and lines as subrecords."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.concat("l_returnflag", "l_linestatus").cast("binary").alias("data"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    rows = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    number = lambda n: F.unhex(F.concat(F.lpad(F.hex(n % 256), 2, "0"), F.lpad(F.hex(F.floor(n / 256) % 256), 2, "0"), F.lit("0000")))

    def sub(name: str, data: Column) -> Column:
        return F.struct(F.lit(name).alias("type"), F.octet_length(data).alias("size"), data.alias("data"))

    head = [
        sub("EDID", F.concat(F.lit("Order_"), key.cast("string"), F.lit("\0")).cast("binary")), sub("FULL", number(key % 3000)), sub("DESC", number(key % 5000)),
    ]
    part = F.transform(F.coalesce("x", F.array()), lambda x: F.struct(F.lit("LINE").alias("type"), F.octet_length(x["data"]).alias("size"), x["data"].alias("data")))
    return rows.select(
        key.alias("ordinal"), F.substring("o_orderpriority", 1, 1).alias("record_type"), F.lit(0).cast("long").alias("data_size"),
        (key % 11).alias("flags"), key.alias("form_id"), F.concat(F.array(*head), part).alias("subrecords"),
    )


def record_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, localized texts and hashes of records, from their subrecords."""
    texts = views.strings(spark, sf_dir)
    return lookups.localized(ingest.project(_raw(spark, sf_dir)), texts).select(
        "form_id", "record_type", "editor_id", "full_name_id", "desc_id", "full_name", "desc_text", "data_hash", "flags"
    )


RECORD_PROJECTION = """+ l AS (SELECT l_orderkey, string_agg(hex('LINE') || '0200' || hex(l_returnflag || l_linestatus), ''
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS h FROM lineitem GROUP BY 1),
  o AS (SELECT *, o_orderkey % 3000 AS a, o_orderkey % 5000 AS b FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
  SELECT o_orderkey AS form_id, substr(o_orderpriority, 1, 1) AS record_type, 'Order_' || o_orderkey AS editor_id, a AS full_name_id, b AS desc_id,
    n.text AS full_name, d.text AS desc_text, sha256(unhex(hex('EDID') || printf('%02X00', strlen('Order_' || o_orderkey) + 1) || hex('Order_' || o_orderkey) || '00'
      || hex('FULL') || '0400' || printf('%02X%02X0000', a % 256, a // 256) || hex('DESC') || '0400' || printf('%02X%02X0000', b % 256, b // 256)
      || coalesce(h, ''))) AS data_hash, o_orderkey % 11 AS flags
  FROM o LEFT JOIN strs n ON n.string_id = a LEFT JOIN strs d ON d.string_id = b"""


def subrecord_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and subrecords by type."""
    return lookups.subrecord_stats(_raw(spark, sf_dir))


SUBRECORD_STATS = """SELECT substr(o_orderpriority, 1, 1) AS record_type, count(DISTINCT o_orderkey) AS n, (3 * count(DISTINCT o_orderkey) + count(l_orderkey))::BIGINT AS subrecords
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1"""


def raw_subrecords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subrecords that a full ingest keeps."""
    rows = ingest.raw_subrecords(_raw(spark, sf_dir))
    return rows.select("form_id", "sub_type", "sub_index", F.hex("data").alias("data"))


RAW_SUBRECORDS = """SELECT o_orderkey AS form_id, 'EDID' AS sub_type, 0 AS sub_index, hex('Order_' || o_orderkey) || '00' AS data FROM orders
  UNION ALL SELECT o_orderkey, 'FULL', 1, printf('%02X%02X0000', o_orderkey % 3000 % 256, o_orderkey % 3000 // 256) FROM orders
  UNION ALL SELECT o_orderkey, 'DESC', 2, printf('%02X%02X0000', o_orderkey % 5000 % 256, o_orderkey % 5000 // 256) FROM orders
  UNION ALL SELECT l_orderkey, 'LINE', (2 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::INTEGER,
    hex(l_returnflag || l_linestatus) FROM lineitem"""


def string_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.string_count(views.strings(spark, sf_dir))


STRING_COUNTS = "SELECT count(*) AS n FROM strs"


# Exports


def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = views.strings(spark, sf_dir).select(F.col("string_id").alias("form_id"), F.col("text").alias("desc_text"))
    rows = views.records(spark, sf_dir, new=True).join(texts, "form_id", "left")
    return rows.withColumns({"flags": F.col("form_id") * 3, "data_size": F.col("form_id") % 100})


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a CSV export of all records."""
    rows = export.all_rows(_described(spark, sf_dir))
    return rows.select("form_id", export.csv_line(rows.columns).alias("line"))


_CSV = lambda c: f"""CASE WHEN regexp_matches({c}, '[",\\r\\n]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
EXPORT_CSV = f"""SELECT printf('0x%08X', form_id) AS form_id, printf('0x%08X', form_id) || ',' || {_CSV('record_type')} || ',' || {_CSV('editor_id')} || ','
    || {_CSV('full_name')} || ',' || coalesce({_CSV('t.text')}, '') || ',' || (form_id * 3) || ',' || (form_id % 100) || ',' || data_hash AS line
  FROM r_new LEFT JOIN strs t ON t.string_id = form_id"""


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of a JSON export, with their fields as JSON text."""
    rows = export.json_rows(_described(spark, sf_dir), views.fields(spark, sf_dir, new=True))
    fields = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field_name"], f["display"])))
    return rows.select("form_id", "record_type", "flags", "data_size", F.to_json(fields).alias("fields"))


EXPORT_JSON = """SELECT f.form_id, any_value(record_type) AS record_type, f.form_id * 3 AS flags, f.form_id % 100 AS data_size,
    '{' || string_agg('"' || field_name || '":"' || replace(CASE WHEN field_type = 'formid' AND name IS NOT NULL THEN field_value || ' (' || name || ')' ELSE field_value END, '"', '\\"') || '"',
      ',' ORDER BY ordinal) || '}' AS fields
  FROM f_new f JOIN r_new r ON r.form_id = f.form_id
  LEFT JOIN (SELECT form_id AS id, coalesce(nullif(full_name, ''), nullif(editor_id, '')) AS name FROM r_new) n
    ON field_type = 'formid' AND id = CASE WHEN field_type = 'formid' THEN ('0x' || substr(field_value, 3))::BIGINT END
  GROUP BY f.form_id"""


# Single-file formats


def _file(make):
    @F.pandas_udf("binary")
    def run(keys: pd.Series, names: pd.Series) -> pd.Series:
        return pd.Series([make(k, n.encode()) for k, n in zip(keys, names, strict=True)], dtype=object)

    return run("p_partkey", "p_name")


def voice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audio behind the lip data of voice files; every fifth file is none."""
    made = _file(lambda k, n: (b"FUZE" if k % 5 else b"FUZ0") + struct.pack("<II", 1, k % 50) + bytes(k % 50) + n)
    rows = read(spark, sf_dir, "part").select("p_partkey", made.alias("content"))
    return rows.select("p_partkey", archives.voice_audio(F.col("content")).cast("string").alias("audio"))


VOICE_FILES = "SELECT p_partkey, CASE WHEN p_partkey % 5 <> 0 THEN p_name END AS audio FROM part"


def script_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of compiled scripts."""

    def made(k: int, name: bytes) -> bytes:
        texts = [name + b".psc", b"user%d" % k, b"pc"]
        return b"\xfa\x57\xc0\xde" + struct.pack("<BBHQ", 3, k % 10, k % 4, k * 1000) + b"".join(struct.pack("<H", len(t)) + t for t in texts)

    rows = read(spark, sf_dir, "part").select("p_partkey", _file(made).alias("content"))
    return rows.select("p_partkey", archives.script_header(F.col("content")).alias("h")).select(
        "p_partkey", "h.major_version", "h.minor_version", "h.game_id", F.col("h.compilation_time").cast("long").alias("compilation_time"),
        "h.source_file", "h.user_name", "h.machine_name",
    )


SCRIPT_FILES = """SELECT p_partkey, 3 AS major_version, (p_partkey % 10)::INTEGER AS minor_version, (p_partkey % 4)::INTEGER AS game_id,
    p_partkey * 1000 AS compilation_time, p_name || '.psc' AS source_file, 'user' || p_partkey AS user_name, 'pc' AS machine_name FROM part"""


def material_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texture of material files, and the materials that model files name."""

    def material(k: int, name: bytes) -> bytes:
        path = b"textures\\" + name + b"%d.dds\0" % k
        return b"BGSM" + bytes(56) + struct.pack("<I", len(path)) + path + bytes(10)

    def model(k: int, name: bytes) -> bytes:
        texts = [name + b"\\m%d.BGSM" % k, b"node", name + b".bgem"][: k % 4]
        head = b"Header\n" + bytes(9) + struct.pack("<II", 2, 30) + bytes(3) + struct.pack("<H", 1) + struct.pack("<I", 4) + b"kind" + bytes(12)
        return head + struct.pack("<II", len(texts), 0) + b"".join(struct.pack("<I", len(t)) + t for t in texts)

    rows = read(spark, sf_dir, "part").select("p_partkey", _file(material).alias("a"), _file(model).alias("b"))
    return rows.select(
        "p_partkey", archives.material_texture(F.col("a")).alias("texture"), F.array_join(archives.model_materials(F.col("b")), "|").alias("materials")
    )


MATERIAL_FILES = """SELECT p_partkey, 'textures\\' || p_name || p_partkey || '.dds' AS texture,
    CASE WHEN p_partkey % 4 >= 1 THEN p_name || '/m' || p_partkey || '.BGSM' ELSE '' END || CASE WHEN p_partkey % 4 = 3 THEN '|' || p_name || '.bgem' ELSE '' END AS materials
  FROM part"""


def icon_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the archive entry of their icon, as far as there is one."""
    parts = files.bucketed(read(spark, sf_dir, "part").where("p_partkey % 3 <> 0").select("p_partkey"), "p_partkey")

    def built(group: pd.DataFrame) -> bytes:
        names = [f"{archives.ICON_PATH.upper()}{k:08X}.DDS" for k in sorted(group["p_partkey"])]
        return files.builders.texture_archive(
            [{"name": n, "height": 4, "width": 4, "mips": 1, "format": 71, "chunks": [(b"12345678", False, 0, 0)]} for n in names]
        )

    entries = archives.list_archive(spark, *files.written(parts, built, ".ba2"))
    ids = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("form_id"))
    return archives.icons_of(ids, entries).select("form_id", "name", "unpacked_size")


ICON_ENTRIES = """SELECT p_partkey AS form_id, CASE WHEN p_partkey % 3 <> 0 THEN 'textures/interface/workshopicons/' || printf('%08x', p_partkey) || '.dds' END AS name,
    CASE WHEN p_partkey % 3 <> 0 THEN 8::BIGINT END AS unpacked_size FROM part"""
