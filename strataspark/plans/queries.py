"""Driver queries over the snapshot views, each with its DuckDB SQL."""

from __future__ import annotations

import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions.tables import TYPE_NAMES
from strataspark.functions.text import display_name, hex_id, parse_hex, present, shortened, type_name
from strataspark.ingest import decoded
from strataspark.operators import diff, lookups, refs, search, tree, unreleased
from strataspark.plans import files, roundtrip, stores, views
from strataspark.plans.views import read, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL after the views."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, recursive)
        return f

    return register


def _old(s: SparkSession, d: str) -> DataFrame:
    return views.records(s, d, new=False)


def _new(s: SparkSession, d: str) -> DataFrame:
    return views.records(s, d, new=True)


CHANGES = """+ changes AS (
  SELECT coalesce(n.form_id, o.form_id) AS form_id,
    CASE WHEN o.form_id IS NULL THEN 'added' WHEN n.form_id IS NULL THEN 'removed' ELSE 'modified' END AS change_type,
    coalesce(n.record_type, o.record_type) AS record_type, coalesce(n.editor_id, o.editor_id) AS editor_id,
    coalesce(n.full_name, o.full_name) AS full_name, o.record_type AS old_type, o.data_hash AS old_hash, n.data_hash AS new_hash
  FROM r_old o FULL JOIN r_new n ON o.form_id = n.form_id WHERE o.data_hash IS DISTINCT FROM n.data_hash)"""

FIELD_CHANGES = CHANGES + """, field_changes AS (
  SELECT coalesce(n.form_id, o.form_id) AS form_id, coalesce(n.field_name, o.field_name) AS field_name,
    o.field_value AS old_value, n.field_value AS new_value,
    coalesce(CASE WHEN n.field_value IS NOT NULL THEN n.field_type ELSE o.field_type END, 'str') AS field_type
  FROM (SELECT * FROM f_old WHERE form_id IN (SELECT form_id FROM changes WHERE change_type = 'modified')) o
  FULL JOIN (SELECT * FROM f_new WHERE form_id IN (SELECT form_id FROM changes WHERE change_type = 'modified')) n
    ON o.form_id = n.form_id AND o.field_name = n.field_name
  WHERE o.field_value IS DISTINCT FROM n.field_value)"""


@query(CHANGES + " SELECT * FROM changes")
def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    return diff.diff_records(_old(s, d), _new(s, d))


@query(CHANGES + " SELECT change_type, count(*) AS n FROM changes GROUP BY 1")
def diff_summary(s: SparkSession, d: str) -> DataFrame:
    return diff.summary(snapshot_diff(s, d))


_SIDE = "form_id, record_type, editor_id, full_name, data_hash"


@query(f"SELECT {_SIDE} FROM r_new n WHERE NOT EXISTS (SELECT 1 FROM r_old o WHERE o.form_id = n.form_id)")
def diff_added(s: SparkSession, d: str) -> DataFrame:
    return diff.added(_old(s, d), _new(s, d))


@query(f"SELECT {_SIDE} FROM r_old o WHERE NOT EXISTS (SELECT 1 FROM r_new n WHERE o.form_id = n.form_id)")
def diff_removed(s: SparkSession, d: str) -> DataFrame:
    return diff.removed(_old(s, d), _new(s, d))


@query("""SELECT n.form_id, n.record_type, n.editor_id, n.full_name, n.data_hash, o.data_hash AS old_hash
  FROM r_new n JOIN r_old o ON o.form_id = n.form_id WHERE o.data_hash <> n.data_hash""")
def diff_modified(s: SparkSession, d: str) -> DataFrame:
    return diff.modified(_old(s, d), _new(s, d))


@query(CHANGES + """ SELECT * FROM changes WHERE
  CASE WHEN change_type = 'modified' THEN old_type ELSE record_type END = 'PROMO'""")
def diff_by_type(s: SparkSession, d: str) -> DataFrame:
    return diff.diff_records(_old(s, d), _new(s, d), "PROMO")


@query(FIELD_CHANGES + " SELECT * FROM field_changes")
def field_diff(s: SparkSession, d: str) -> DataFrame:
    return diff.diff_fields(snapshot_diff(s, d), views.fields(s, d, False), views.fields(s, d, True))


@query(FIELD_CHANGES + """ SELECT * FROM changes c WHERE change_type = 'modified'
  AND NOT EXISTS (SELECT 1 FROM field_changes f WHERE f.form_id = c.form_id)""")
def hash_only(s: SparkSession, d: str) -> DataFrame:
    return diff.hash_only(snapshot_diff(s, d), field_diff(s, d))


@query("SELECT record_type, count(*) AS n FROM r_new GROUP BY 1")
def type_counts(s: SparkSession, d: str) -> DataFrame:
    return lookups.type_counts(_new(s, d))


@query(f"SELECT {_SIDE} FROM r_new WHERE record_type = 'STANDARD'")
def records_by_type(s: SparkSession, d: str) -> DataFrame:
    return lookups.records_by_type(_new(s, d), "STANDARD")


@query(f"SELECT {_SIDE} FROM r_new WHERE form_id = 42")
def record_by_key(s: SparkSession, d: str) -> DataFrame:
    return lookups.record_by_key(_new(s, d), 42)


@query("SELECT form_id, data_hash FROM r_new")
def hash_projection(s: SparkSession, d: str) -> DataFrame:
    return lookups.hashes(_new(s, d))


@query(f"SELECT {_SIDE} FROM r_new WHERE full_name ILIKE '%re%' OR editor_id ILIKE '%re%' ORDER BY record_type, form_id LIMIT 500")
def search_text(s: SparkSession, d: str) -> DataFrame:
    return search.search_records(_new(s, d), "RE")


@query(f"SELECT {_SIDE} FROM r_new WHERE editor_id ILIKE 'atx\\_%' ESCAPE '\\' ORDER BY record_type, form_id LIMIT 500")
def search_glob(s: SparkSession, d: str) -> DataFrame:
    return search.search_records(_new(s, d), editor_id="atx_*")


@query(f"SELECT {_SIDE} FROM r_new WHERE full_name ILIKE '%0x2A%' OR editor_id ILIKE '%0x2A%' OR form_id = 42 ORDER BY record_type, form_id LIMIT 500")
def search_formid(s: SparkSession, d: str) -> DataFrame:
    return search.search_records(_new(s, d), "0x2A")


@query(f"""SELECT {_SIDE} FROM r_new WHERE record_type = 'ECONOMY' AND (full_name ILIKE '%a%' OR editor_id ILIKE '%a%')
  ORDER BY record_type, form_id LIMIT 500""")
def search_typed(s: SparkSession, d: str) -> DataFrame:
    return search.search_records(_new(s, d), "a", record_type="ECONOMY")


@query("SELECT string_id, text FROM strs WHERE text ILIKE '%license%' ORDER BY string_id LIMIT 200")
def string_search(s: SparkSession, d: str) -> DataFrame:
    return lookups.search_strings(views.strings(s, d), "license")


@query("SELECT string_id, text FROM strs WHERE contains(lower(text), 'über')")
def string_contains(s: SparkSession, d: str) -> DataFrame:
    return lookups.strings_containing(views.strings(s, d), "Über")


@query("SELECT string_id, text FROM strs WHERE string_id = 7")
def string_by_id(s: SparkSession, d: str) -> DataFrame:
    return lookups.string_by_id(views.strings(s, d), 7)


@query("""SELECT r.form_id, n.text AS full_name, t.text AS desc_text FROM (
    SELECT form_id, form_id % 3000 AS full_name_id, (form_id * 7) % 3000 AS desc_id FROM r_new) r
  LEFT JOIN strs n ON n.string_id = full_name_id LEFT JOIN strs t ON t.string_id = desc_id""")
def string_join(s: SparkSession, d: str) -> DataFrame:
    key = F.col("form_id")
    rows = _new(s, d).select("form_id", (key % 3000).alias("full_name_id"), ((key * 7) % 3000).alias("desc_id"))
    return lookups.localized(rows, views.strings(s, d)).select("form_id", "full_name", "desc_text")


@query("SELECT * FROM snaps ORDER BY id")
def list_snapshots(s: SparkSession, d: str) -> DataFrame:
    return lookups.list_snapshots(views.snapshots(s, d))


@query("SELECT * FROM snaps WHERE id = 3")
def snapshot_by_id(s: SparkSession, d: str) -> DataFrame:
    return lookups.snapshot_by_id(views.snapshots(s, d), 3)


@query("SELECT * FROM snaps ORDER BY id DESC LIMIT 1")
def latest_snapshot(s: SparkSession, d: str) -> DataFrame:
    return lookups.latest(views.snapshots(s, d))


@query("SELECT * FROM snaps ORDER BY id DESC LIMIT 2")
def two_latest(s: SparkSession, d: str) -> DataFrame:
    return lookups.latest(views.snapshots(s, d), 2)


@query("SELECT id FROM snaps ORDER BY id DESC OFFSET 5")
def purge_set(s: SparkSession, d: str) -> DataFrame:
    return lookups.purge_set(views.snapshots(s, d), 5)


@query("SELECT count(*) AS n FROM snaps")
def snapshot_count(s: SparkSession, d: str) -> DataFrame:
    return views.snapshots(s, d).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def upsert_dedup(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return lookups.upsert(rows, ["o_custkey"], "o_orderkey")


@query("""SELECT string_id, text FROM (
    SELECT string_id, text, 0 AS p FROM strs WHERE string_id % 3 <> 0
    UNION ALL SELECT string_id, 'two ' || string_id, 1 FROM strs WHERE string_id % 2 = 0)
  QUALIFY row_number() OVER (PARTITION BY string_id ORDER BY p DESC) = 1""")
def string_merge(s: SparkSession, d: str) -> DataFrame:
    rows = views.strings(s, d)
    over = rows.where("string_id % 2 = 0").select("string_id", F.concat(F.lit("two "), F.col("string_id").cast("string")).alias("text"))
    return lookups.merge_by_priority([rows.where("string_id % 3 <> 0"), over], "string_id")


EDGES = """+ e AS (SELECT form_id AS src, field_name, ('0x' || substr(field_value, 3))::BIGINT AS dst, ordinal FROM f_new
  WHERE field_type = 'formid' AND field_value <> '0x00000000')"""


@query(EDGES + " SELECT * FROM e")
def formid_edges(s: SparkSession, d: str) -> DataFrame:
    return lookups.edges(views.fields(s, d, True))


@query("""SELECT l_partkey AS src, string_agg(dst, ',' ORDER BY dst) AS refs FROM (
    SELECT DISTINCT l_partkey, printf('0x%08X', l_suppkey) AS dst FROM lineitem WHERE l_suppkey <> 0) GROUP BY 1""")
def edge_groups(s: SparkSession, d: str) -> DataFrame:
    pairs = read(s, d, "lineitem").select("l_partkey", "l_suppkey").distinct()
    rows = pairs.select(
        F.col("l_partkey").alias("form_id"), F.lit("supplier_ref").alias("field_name"),
        hex_id(F.col("l_suppkey")).alias("field_value"), F.lit("formid").alias("field_type"), F.col("l_suppkey").cast("int").alias("ordinal"),
    )
    grouped = lookups.edge_groups(rows)
    return grouped.select("src", F.array_join(F.array_sort(F.transform("refs", lambda r: hex_id(r["dst"]))), ",").alias("refs"))


NAMES = "coalesce(nullif(full_name, ''), nullif(editor_id, ''))"


@query(f"""SELECT f.form_id, f.field_name, f.field_value, CASE WHEN f.field_type = 'formid' AND n.name IS NOT NULL
    THEN field_value || ' (' || n.name || ')' ELSE field_value END AS display
  FROM f_new f LEFT JOIN (SELECT form_id AS id, {NAMES} AS name FROM r_new) n
    ON f.field_type = 'formid' AND n.id = CASE WHEN f.field_type = 'formid' THEN ('0x' || substr(field_value, 3))::BIGINT END""")
def name_resolution(s: SparkSession, d: str) -> DataFrame:
    shown = refs.resolve_fields(views.fields(s, d, True), _new(s, d))
    return shown.select("form_id", "field_name", "field_value", "display")


XREFS = CHANGES + """, x AS (
  SELECT f.form_id AS src, coalesce(a.name, printf('0x%08X', f.form_id)) AS src_name, f.field_name, dst,
    coalesce(b.name, printf('0x%08X', dst)) AS dst_name, ordinal
  FROM (SELECT form_id, field_name, ('0x' || substr(field_value, 3))::BIGINT AS dst, ordinal FROM f_new
        WHERE field_type = 'formid' AND field_value <> '0x00000000') f
  LEFT JOIN (SELECT form_id AS id, """ + NAMES + """ AS name FROM r_new) a ON a.id = f.form_id
  LEFT JOIN (SELECT form_id AS id, """ + NAMES + """ AS name FROM r_new) b ON b.id = dst
  WHERE f.form_id IN (SELECT form_id FROM changes) AND dst IN (SELECT form_id FROM changes))"""


def _xrefs(s: SparkSession, d: str) -> DataFrame:
    return refs.xrefs(views.fields(s, d, True), _new(s, d), snapshot_diff(s, d).select("form_id"))


@query(XREFS + """ SELECT src, string_agg(field_name || '>' || dst_name, ',' ORDER BY ordinal, field_name, dst) AS targets FROM x GROUP BY 1""")
def xrefs_forward(s: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform("targets", lambda t: F.concat(t["field_name"], F.lit(">"), t["dst_name"])), ",")
    return refs.forward(_xrefs(s, d)).select("src", joined.alias("targets"))


@query(XREFS + """ SELECT dst, src // 65536 AS part, string_agg(src_name || '>' || field_name, ',' ORDER BY src, ordinal, field_name) AS sources
  FROM x GROUP BY 1, 2""")
def xrefs_reverse(s: SparkSession, d: str) -> DataFrame:
    joined = F.array_join(F.transform("sources", lambda t: F.concat(t["src_name"], F.lit(">"), t["field_name"])), ",")
    return refs.reverse(_xrefs(s, d)).select("dst", "part", joined.alias("sources"))


@query("""SELECT form_id, field_value FROM f_new WHERE field_name = 'brand'
  AND form_id IN (SELECT form_id FROM r_new WHERE record_type = 'PROMO')""")
def path_lookup(s: SparkSession, d: str) -> DataFrame:
    return lookups.paths_of(views.fields(s, d, True), lookups.records_by_type(_new(s, d), "PROMO"), "brand")


@query(f"SELECT {_SIDE} FROM r_new WHERE editor_id ILIKE 'ATX_%'")
def unreleased_atx(s: SparkSession, d: str) -> DataFrame:
    return unreleased.shop(_new(s, d))


CUT = " UNION ALL ".join(
    f"SELECT {_SIDE}, {i} AS pattern FROM r_new WHERE editor_id ILIKE '{p}'" for i, p in enumerate(unreleased.CUT_PATTERNS)
)


@query(CUT)
def unreleased_cut(s: SparkSession, d: str) -> DataFrame:
    return unreleased.cut(_new(s, d))


_TYPES = ("STANDARD", "PROMO", "ECONOMY")
_HIGH = f"""form_id > (SELECT floor(max(form_id) * 0.995::DOUBLE) FROM r_new) AND record_type IN {_TYPES}"""


@query(f"SELECT {_SIDE} FROM r_new WHERE {_HIGH}")
def unreleased_high(s: SparkSession, d: str) -> DataFrame:
    return unreleased.high(_new(s, d), _TYPES)


@query(f"SELECT {_SIDE} FROM r_new WHERE record_type = 'PROMO' AND editor_id ILIKE 'ATX_%'")
def unreleased_quests(s: SparkSession, d: str) -> DataFrame:
    return unreleased.quests(_new(s, d), "PROMO")


@query(f"""SELECT category, count(*) AS n FROM (
    SELECT '{unreleased.SHOP}' AS category FROM r_new WHERE editor_id ILIKE 'ATX_%'
    UNION ALL SELECT '{unreleased.CUT}' FROM ({CUT})
    UNION ALL SELECT '{unreleased.HIGH}' FROM r_new WHERE form_id > (SELECT floor(max(form_id) * 0.995::DOUBLE) FROM r_new) AND record_type IN {unreleased.HIGH_TYPES}
    UNION ALL SELECT '{unreleased.QUESTS}' FROM r_new WHERE record_type = 'QUST' AND editor_id ILIKE 'ATX_%') GROUP BY 1""")
def heuristic_counts(s: SparkSession, d: str) -> DataFrame:
    return unreleased.heuristic_counts(_new(s, d))


@query("""SELECT p_partkey AS form_id, f.field_name, CASE f.field_name WHEN 'value' THEN cents::VARCHAR ELSE printf('%.2f', (p_size / 8)::FLOAT::DOUBLE) END AS field_value,
    f.field_type, f.ordinal FROM (SELECT p_partkey, p_size, round(p_retailprice * 100)::INTEGER AS cents FROM part),
    (VALUES (0, 'value', 'int'), (1, 'weight', 'float')) f(ordinal, field_name, field_type)""")
def decode_misc_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Parts as records in bytes, decoded again by the engine's decoder."""

    @F.pandas_udf("array<struct<type: string, size: int, data: binary>>")
    def encode(cents: pd.Series, size: pd.Series) -> pd.Series:
        data = [struct.pack("<if", c, n / 8) for c, n in zip(cents, size, strict=True)]
        return pd.Series([[{"type": "DATA", "size": len(x), "data": x}] for x in data], dtype=object)

    raw = read(s, d, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("form_id"), F.lit("MISC").alias("record_type"),
        encode(F.round(F.col("p_retailprice") * 100).cast("int"), "p_size").alias("subrecords"),
    )
    none = s.createDataFrame([], "string_id long, text string")
    return decoded(raw, none).select("form_id", "field_name", "field_value", "field_type", "ordinal")


@query("""SELECT p_partkey, CASE WHEN t LIKE '0x%' AND regexp_full_match(substr(t, 3), '[0-9A-Fa-f]+') THEN t::BIGINT END AS id FROM (
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'zz' ELSE printf('0x%X', p_partkey * 4097) END AS t FROM part)""")
def hex_parse(s: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    text = F.when(key % 5 == 0, "zz").otherwise(F.format_string("0x%X", key * 4097))
    return read(s, d, "part").select("p_partkey", parse_hex(text).alias("id"))


PARTS = "+ n AS (SELECT count(*) AS n FROM part)"


@query(PARTS + """, e AS (SELECT p_partkey AS parent, (2 * p_partkey + 1) % n AS child FROM part, n
    UNION ALL SELECT p_partkey, (3 * p_partkey) % n FROM part, n),
  c(root, node, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part
    UNION SELECT root, child, depth + 1 FROM c JOIN e ON parent = node WHERE depth < 5)
  SELECT root, node, min(depth)::INTEGER AS depth FROM c GROUP BY 1, 2""", recursive=True)
def tree_closure(s: SparkSession, d: str) -> DataFrame:
    part = read(s, d, "part").select("p_partkey")
    n = F.broadcast(part.agg(F.count("*").alias("n")))
    key = F.col("p_partkey")
    edges = part.join(n).select(key.alias("parent"), F.explode(F.array((2 * key + 1) % F.col("n"), (3 * key) % F.col("n"))).alias("child"))
    return tree.closure(edges, part.select(key.alias("root")), max_depth=5)


@query(f"SELECT {_SIDE} FROM r_new QUALIFY row_number() OVER (PARTITION BY record_type ORDER BY form_id) <= 50")
def capped_per_category(s: SparkSession, d: str) -> DataFrame:
    return lookups.capped(_new(s, d), "record_type", ["form_id"], 50)


@query("""SELECT printf('0x%08X', form_id) AS form_id, record_type, coalesce(editor_id, '') AS editor_id, coalesce(full_name, '') AS full_name,
    substr(coalesce(t.text, ''), 1, 200) AS description, printf('0x%08X', form_id * 3) AS flags, data_hash
  FROM r_new LEFT JOIN strs t ON t.string_id = form_id WHERE record_type = 'PROMO'""")
def export_rows_typed(s: SparkSession, d: str) -> DataFrame:
    from strataspark.reports.export import typed_rows

    return typed_rows(_described(s, d).where("record_type = 'PROMO'")).drop("data_size")


@query("""SELECT printf('0x%08X', form_id) AS form_id, record_type, editor_id, full_name, t.text AS description, form_id * 3 AS flags, data_hash
  FROM r_new LEFT JOIN strs t ON t.string_id = form_id""")
def export_rows_all(s: SparkSession, d: str) -> DataFrame:
    from strataspark.reports.export import all_rows

    return all_rows(_described(s, d)).drop("data_size")


def _described(s: SparkSession, d: str) -> DataFrame:
    texts = views.strings(s, d).select(F.col("string_id").alias("form_id"), F.col("text").alias("desc_text"))
    rows = _new(s, d).join(texts, "form_id", "left")
    return rows.withColumns({"flags": F.col("form_id") * 3, "data_size": F.lit(0).cast("long")})


@query(f"""SELECT string_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS shown FROM strs""")
def string_preview(s: SparkSession, d: str) -> DataFrame:
    return views.strings(s, d).select("string_id", shortened(F.col("text"), 100).alias("shown"))


@query(f"""SELECT form_id, {NAMES} AS name, nullif(replace(editor_id, 'ATX_', ''), '') AS bare FROM r_new""")
def display_names(s: SparkSession, d: str) -> DataFrame:
    return _new(s, d).select(
        "form_id", display_name(F.col("full_name"), F.col("editor_id")).alias("name"),
        present(F.replace("editor_id", F.lit("ATX_"), F.lit(""))).alias("bare"),
    )


_KINDS = ("WEAP", "NPC_", "OMOD", "????", "XXXX")
_NAMED = " ".join(f"WHEN '{t}' THEN '{TYPE_NAMES[t]}'" for t in _KINDS if t in TYPE_NAMES)


@query(f"SELECT p_partkey, kind, CASE kind {_NAMED} ELSE kind END AS shown FROM (SELECT p_partkey, {list(_KINDS)}[p_partkey % 5 + 1] AS kind FROM part)")
def type_names(s: SparkSession, d: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 5).cast("int"))
    return read(s, d, "part").select("p_partkey", kind.alias("kind"), type_name(kind).alias("shown"))


# Queries over bytes that are built from the tables

for _name, _types in roundtrip.FAMILIES.items():
    QUERIES[_name] = roundtrip.decode_family(_types)
    ORACLE_SQL[_name] = with_views(roundtrip.family_sql(_types))
QUERIES["condition_fields"] = roundtrip.condition_fields
ORACLE_SQL["condition_fields"] = with_views(roundtrip.conditions_sql())
for _name in (
    "record_scan", "archive_contents", "archive_matching", "archive_containing", "archive_lookup", "texture_archives", "string_files",
    "sequence_names", "tree_text", "content_hash",
):
    QUERIES[_name] = getattr(files, _name)
    ORACLE_SQL[_name] = with_views(getattr(files, _name.upper()))
for _name in (
    "store_snapshots", "store_tables", "store_keywords", "record_projection", "subrecord_stats", "raw_subrecords", "string_counts", "export_csv",
    "export_json", "voice_files", "script_files", "material_files", "icon_entries",
):
    QUERIES[_name] = getattr(stores, _name)
    ORACLE_SQL[_name] = with_views(getattr(stores, _name.upper()))
QUERIES["store_diff"] = stores.store_diff
ORACLE_SQL["store_diff"] = with_views(CHANGES + """ SELECT form_id, change_type, record_type, old_hash, new_hash,
    (SELECT count(*) FROM changes WHERE change_type = 'added') AS added_count, (SELECT count(*) FROM changes WHERE change_type = 'removed') AS removed_count,
    (SELECT count(*) FROM changes WHERE change_type = 'modified') AS modified_count FROM changes""")
