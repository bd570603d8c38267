"""Queries over files of the binary formats, which executors build from the driver's tables.

Buckets of rows become record files, archives, string tables and sequences in the shared
folder; the engine's sources read them, and SQL says from the rows what must come out.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import tables
from strataspark.operators import refs, tree
from strataspark.plans import views
from strataspark.plans.views import read
from strataspark.shared import shared_dir
from strataspark.sources import archives, binary, builders
from strataspark.sources.recfile import read_records

#: Rows of a file, about.
FILE_ROWS = 5_000


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with the file that each goes to."""
    n = max(2, -(-rows.count() // FILE_ROWS))
    return rows.withColumn("bucket", F.col(key) % n)


def written(rows: DataFrame, build: Callable[[pd.DataFrame], bytes], suffix: str) -> list[str]:
    """Paths of the files, one for each bucket."""
    folder = f"{shared_dir(rows.sparkSession)}/files-{uuid.uuid4().hex}"

    def run(group: pd.DataFrame) -> pd.DataFrame:
        path = f"{folder}/{int(group['bucket'].iloc[0]):06d}{suffix}"
        binary.write_any(path, build(group))
        return pd.DataFrame({"path": [path]})

    return sorted(r["path"] for r in rows.groupBy("bucket").applyInPandas(run, "path string").collect())


# Record files

TYPES = ("WEAP", "ARMO", "MISC", "NPC_", "REFR")


def _record_file(group: pd.DataFrame) -> bytes:
    """Top-level groups by type; every other part in a child group, placement groups with more."""
    groups = []
    for code, own in group.sort_values("p_partkey").groupby(group["p_partkey"] % 5):
        kind = TYPES[code]
        made = [
            builders.record(
                kind, k, [("EDID", f"Part{k}\0".encode()), ("DATA", struct.pack("<if", size, size / 8))], flags=k % 3, revision=k % 1000,
                version=k % 200, compressed=k % 4 == 0,
            )
            for k, size in zip(own["p_partkey"].tolist(), own["p_size"].tolist(), strict=True)
        ]
        hidden = builders.group(b"", [builders.record("REFR", 1, [])], group_type=9)
        groups.append(builders.group(kind.encode(), [*made[::2], builders.group(b"", [*made[1::2], hidden], group_type=1)]))
    return builders.record_file(groups, header=builders.subrecord("HEDR", bytes(12)))


def record_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as a record, packed or plain, nested or not, read by the source."""
    paths = written(bucketed(read(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey"), _record_file, ".esm")
    return read_records(spark, paths).select(
        "form_id", "record_type", (F.col("flags").bitwiseAND(F.lit(3))).alias("flags"),
        (F.col("flags").bitwiseAND(F.lit(tables.COMPRESSED_FLAG)) != 0).alias("packed"), "revision", "version",
        F.when(F.col("flags") < tables.COMPRESSED_FLAG, F.col("data_size")).alias("plain_size"),
        F.array_join(F.transform("subrecords", lambda s: F.concat(s["type"], F.lit(":"), s["size"].cast("string"), F.lit(":"), F.hex(s["data"]))), ",").alias("subs"),
    )


RECORD_SCAN = """SELECT p_partkey AS form_id, ['WEAP', 'ARMO', 'MISC', 'NPC_'][p_partkey % 5 + 1] AS record_type, p_partkey % 3 AS flags,
    p_partkey % 4 = 0 AS packed, p_partkey % 1000 AS revision, (p_partkey % 200)::INTEGER AS version,
    CASE WHEN p_partkey % 4 <> 0 THEN length('Part' || p_partkey) + 21 END AS plain_size,
    'EDID:' || (length('Part' || p_partkey) + 1) || ':' || hex('Part' || p_partkey) || '00,DATA:8:' || printf('%02X000000', p_size) || single AS subs
  FROM part JOIN (SELECT range AS n, {single} AS single FROM range(0, 60)) ON n = p_size WHERE p_partkey % 5 <> 4""".format(
    single="CASE range " + " ".join(f"WHEN {n} THEN '{struct.pack('<f', n / 8).hex().upper()}'" for n in range(60)) + " END"
)


# Archives


def _archive(group: pd.DataFrame) -> bytes:
    rows = group.sort_values("p_partkey")
    return builders.general_archive([
        (f"Textures\\Part\\{brand[-2:]}\\Item{k}.{'DDS' if k % 3 else 'pex'}", f"{name} {k}".encode() * (k % 4 + 1), k % 2 == 0)
        for k, name, brand in zip(rows["p_partkey"].tolist(), rows["p_name"], rows["p_brand"], strict=True)
    ])


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = bucketed(read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey")
    return archives.list_archive(spark, *written(parts, _archive, ".ba2"))


_NAME = "'Textures/Part/' || right(p_brand, 2) || '/Item' || p_partkey || CASE WHEN p_partkey % 3 <> 0 THEN '.DDS' ELSE '.pex' END"
_CONTENT = "repeat(p_name || ' ' || p_partkey, (p_partkey % 4 + 1)::INTEGER)"


def archive_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing and extraction of general archives with every part as a file."""
    entries = _archives(spark, sf_dir)
    content = archives.contents(entries).select("archive", "place", F.col("content").cast("string").alias("content"))
    joined = entries.join(content, ["archive", "place"])
    return joined.select("name", "unpacked_size", (F.col("packed_size") > 0).alias("packed"), "content")


ARCHIVE_CONTENTS = f"""SELECT {_NAME} AS name, strlen({_CONTENT})::BIGINT AS unpacked_size, p_partkey % 2 = 0 AS packed, {_CONTENT} AS content FROM part"""


def archive_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts whose path matches a glob."""
    return archives.matching(_archives(spark, sf_dir), archives.SCRIPTS, "*/part/*1/item*2.pex").select("name", "unpacked_size")


ARCHIVE_MATCHING = f"""SELECT name, strlen(content)::BIGINT AS unpacked_size FROM (SELECT {_NAME} AS name, {_CONTENT} AS content FROM part)
  WHERE lower(name) GLOB '*/part/*1/item*2.pex'"""


def archive_containing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.containing(_archives(spark, sf_dir), "ITEM12").select("name")


ARCHIVE_CONTAINING = f"SELECT name FROM (SELECT {_NAME} AS name FROM part) WHERE contains(lower(name), 'item12')"


def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _archives(spark, sf_dir)
    wanted = read(spark, sf_dir, "part").where("p_partkey = 77").select(F.right("p_brand", F.lit(2)).alias("b")).first()["b"]
    return archives.by_path(entries, f"textures\\part\\{wanted}\\ITEM77.dds").select("name", "unpacked_size")


ARCHIVE_LOOKUP = f"SELECT {_NAME} AS name, strlen({_CONTENT})::BIGINT AS unpacked_size FROM part WHERE p_partkey = 77"


def _textures(group: pd.DataFrame) -> bytes:
    rows = group.sort_values("p_partkey")
    return builders.texture_archive([
        {
            "name": f"Textures\\{name}\\{k}.DDS", "height": 4 * (k % 16 + 1), "width": 8 * (k % 8 + 1), "mips": k % 5 + 1, "format": 71 + k % 3,
            "tile": k % 4, "chunks": [(bytes([c]) * (16 + k % 7 * c), k % 2 == 0, c, c) for c in range(k % 3 + 1)],
        }
        for k, name in zip(rows["p_partkey"].tolist(), rows["p_name"], strict=True)
    ])


def texture_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing and extraction of texture archives."""
    parts = bucketed(read(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey")
    entries = archives.list_archive(spark, *written(parts, _textures, ".ba2"))
    content = archives.contents(entries).select("archive", "place", F.hex("content").alias("content"))
    return entries.join(content, ["archive", "place"]).select(
        "name", "height", "width", "mips", "format", "tile", F.size("chunks").alias("chunks"), "unpacked_size", "content"
    )


TEXTURE_ARCHIVES = """SELECT 'textures/' || lower(p_name) || '/' || p_partkey || '.dds' AS name, (4 * (p_partkey % 16 + 1))::INTEGER AS height,
    (8 * (p_partkey % 8 + 1))::INTEGER AS width, (p_partkey % 5 + 1)::INTEGER AS mips, (71 + p_partkey % 3)::INTEGER AS format,
    (p_partkey % 4)::INTEGER AS tile, (p_partkey % 3 + 1)::INTEGER AS chunks, strlen(content) // 2 AS unpacked_size, content FROM (
    SELECT *, repeat('00', 16) || CASE WHEN p_partkey % 3 > 0 THEN repeat('01', (16 + p_partkey % 7)::INTEGER) ELSE '' END
      || CASE WHEN p_partkey % 3 > 1 THEN repeat('02', (16 + p_partkey % 7 * 2)::INTEGER) ELSE '' END AS content FROM part)"""


# String tables and sequences


def string_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the string table, through string files of both kinds."""
    texts = views.strings(spark, sf_dir)
    rows = texts.withColumn("bucket", F.col("string_id") % max(2, -(-texts.count() // 500)))

    def build(prefixed: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            content = builders.string_file(dict(zip(group["string_id"].tolist(), group["text"], strict=True)), prefixed)
            return pd.DataFrame({"content": [content]})

        return run

    parts = []
    for prefixed in (False, True):
        files = rows.groupBy("bucket").applyInPandas(build(prefixed), "content binary")
        found = files.select(F.explode(archives.string_rows(F.col("content"), prefixed)).alias("s"))
        parts.append(found.select("s.string_id", "s.text", F.lit(prefixed).alias("prefixed")))
    return parts[0].unionByName(parts[1])


STRING_FILES = "SELECT string_id, text, prefixed FROM strs, (VALUES (false), (true)) p(prefixed)"


def sequence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of each order as a sequence file, read with their names."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"))

    @F.pandas_udf("binary")
    def packed(lists: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(f"<{len(x)}I", *x) + b"\0\1" for x in lists], dtype=object)

    files = orders.select("l_orderkey", packed(F.transform("lines", lambda x: x["l_partkey"])).alias("content"))
    ids = files.select("l_orderkey", F.posexplode(archives.sequence_ids(F.col("content"))).alias("at", "form_id"))
    ids = ids.select(F.struct("l_orderkey", "at").alias("pos"), "form_id")
    named = refs.sequence_names(ids, views.records(spark, sf_dir, new=True))
    return named.select(F.col("pos.l_orderkey").alias("l_orderkey"), F.col("pos.at").cast("long").alias("pos"), "form_id", "name")


SEQUENCE_NAMES = """SELECT l_orderkey, pos, t.form_id, coalesce(nullif(full_name, ''), nullif(editor_id, ''), '') AS name FROM (
    SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
      l_partkey AS form_id FROM lineitem) t LEFT JOIN r_new r ON r.form_id = t.form_id"""


# Leveled lists

REGIONS, NATIONS, CUSTOMERS = 1 << 28, 2 << 28, 3 << 28


def _world(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Regions list their nations, nations their customers: records, fields, roots."""
    region, nation, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))

    def record(rows: DataFrame, base: int, key: str, name: str, kind: str) -> DataFrame:
        return rows.select(
            (F.col(key).cast("long") + base).alias("form_id"), F.lit(kind).alias("record_type"), F.col(name).alias("full_name"), F.lit(None).cast("string").alias("editor_id")
        )

    records = record(region, REGIONS, "r_regionkey", "r_name", "LVLI").unionByName(record(nation, NATIONS, "n_nationkey", "n_name", "LVLN"))
    records = records.unionByName(record(customer, CUSTOMERS, "c_custkey", "c_name", "MISC"))
    held = nation.select(
        (F.col("n_regionkey").cast("long") + REGIONS).alias("form_id"), (F.col("n_nationkey").cast("long") + NATIONS).alias("ref"), F.lit(1).alias("n"), F.lit(0).alias("level")
    ).unionByName(customer.select(
        (F.col("c_nationkey").cast("long") + NATIONS).alias("form_id"), (F.col("c_custkey") + CUSTOMERS).alias("ref"),
        (F.col("c_custkey") % 3).cast("int").alias("n"), (F.col("c_custkey") % 5).cast("int").alias("level"),
    ))
    listed = held.groupBy("form_id").agg(F.array_sort(F.collect_list(F.struct("ref", "n", "level"))).alias("e"))
    named = lambda i, part, value: F.struct(F.concat(F.lit("entry_"), i.cast("string"), F.lit(f"_{part}")).alias("field_name"), value.alias("field_value"))
    each = F.flatten(F.transform("e", lambda x, i: F.array(
        named(i, "ref", F.format_string("0x%08X", x["ref"])), named(i, "count", x["n"].cast("string")), named(i, "level", x["level"].cast("string"))
    )))
    own = F.array(
        F.struct(F.lit("chance_none").alias("field_name"), (F.col("form_id") % 7).cast("string").alias("field_value")),
        F.struct(F.lit("use_all").alias("field_name"), F.when(F.col("form_id") % 2 == 1, "True").otherwise("False").alias("field_value")),
    )
    fields = listed.select("form_id", F.inline(F.concat(own, each)))
    roots = region.select((F.col("r_regionkey").cast("long") + REGIONS).alias("root"))
    return records, fields, roots


def tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leveled-list trees of all regions as text."""
    return tree.lines(*_world(spark, sf_dir)).select("root", F.col("seq").cast("long").alias("seq"), "line")


_ENTRY = "printf('0x%08X', {key})"
TREE_TEXT = f"""+ lists AS (
    SELECT r_regionkey + {REGIONS} AS root, -1 AS a, -1 AS b, r_name || ' (' || printf('0x%08X', r_regionkey + {REGIONS}) || ') [LVLI]' AS line FROM region
    UNION ALL SELECT r_regionkey + {REGIONS}, -1, 0, '  Chance None: ' || ((r_regionkey + {REGIONS}) % 7) || '%  Use All: '
      || CASE WHEN (r_regionkey + {REGIONS}) % 2 = 1 THEN 'True' ELSE 'False' END FROM region
    UNION ALL SELECT n_regionkey + {REGIONS}, n_nationkey, -1, '  - ' || n_name || ' [LVLN] ' || printf('0x%08X', n_nationkey + {NATIONS}) FROM nation
    UNION ALL SELECT n_regionkey + {REGIONS}, n_nationkey, c_custkey, '    - ' || c_name || CASE WHEN c_custkey % 3 > 1 THEN ' x' || (c_custkey % 3) ELSE '' END
      || CASE WHEN c_custkey % 5 > 0 THEN ' (lvl ' || (c_custkey % 5) || ')' ELSE '' END || ' [MISC] ' || printf('0x%08X', c_custkey + {CUSTOMERS})
      FROM customer JOIN nation ON c_nationkey = n_nationkey)
  SELECT root::BIGINT AS root, row_number() OVER (PARTITION BY root ORDER BY a, b) - 3 AS seq, line FROM lists"""


# Content hashes


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each order's lines as subrecords."""
    from strataspark.ingest import content_hash as hashed

    data = F.concat("l_returnflag", "l_linestatus", F.lit("/"), F.col("l_quantity").cast("int").cast("string")).cast("binary")
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", data.alias("data"))
    orders = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("x"))
    sub = F.transform("x", lambda x: F.struct(
        F.format_string("L%03d", x["l_linenumber"]).alias("type"), F.octet_length(x["data"]).alias("size"), x["data"].alias("data")
    ))
    return orders.select("l_orderkey", hashed(sub).alias("data_hash"))


CONTENT_HASH = """SELECT l_orderkey, sha256(unhex(string_agg(hex(printf('L%03d', l_linenumber)) || printf('%02X00', strlen(d)) || hex(d), ''
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))) AS data_hash
  FROM (SELECT *, l_returnflag || l_linestatus || '/' || l_quantity::INTEGER AS d FROM lineitem) GROUP BY 1"""
