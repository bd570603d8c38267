"""From snapshot tables to the rows of a report.

Joins, names and caps are DataFrame operations; what is collected is what the
report shows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.functions.text import hex_id, parse_hex
from strataspark.operators import diff, lookups, refs, unreleased
from strataspark.reports.render import Category, Diff, Item, Link
from strataspark.shared import Scratch

TEXT_CAP, MARKDOWN_CAP, HTML_CAP, EXPORT_CAP, DETAILED = 50, 100, 500, 5000, 10


def items(records: DataFrame) -> list[Item]:
    """Records in their order as report items."""
    rows = records.select("form_id", "record_type", "editor_id", "full_name")
    return [Item(*r) for r in rows.toLocalIterator(prefetchPartitions=True)]


def _with_fields(found: list[Item], ids: DataFrame, fields: DataFrame, records: DataFrame) -> None:
    """Give the items, whose form_id ``ids`` has, their fields, with the names of what they refer to."""
    if not found:
        return
    shown = refs.resolve_fields(fields.join(ids, "form_id", "left_semi"), records).orderBy("form_id", "ordinal")
    by_id: dict[int, list[tuple[str, str]]] = {}
    for r in shown.select("form_id", "field_name", "display").toLocalIterator(prefetchPartitions=True):
        by_id.setdefault(r["form_id"], []).append((r["field_name"], r["display"]))
    for x in found:
        x.fields = by_id.get(x.form_id, [])


def _with_links(found: list[Item], links: DataFrame) -> None:
    by_id = {x.form_id: x for x in found}
    for r in links.orderBy("src", "ordinal").toLocalIterator():
        if r["src"] in by_id:
            by_id[r["src"]].refers.append(Link(r["field_name"], r["dst"], r["dst_name"]))
        if r["dst"] in by_id:
            by_id[r["dst"]].referred.append(Link(r["field_name"], r["src"], r["src_name"]))


def _side(value: str, records: DataFrame, changes: DataFrame) -> DataFrame:
    """Field changes with one side's value shown by name."""
    named = refs.names(records).select(F.col("id").alias("__id"), F.col("name").alias("__name"))
    key = F.when(F.col("field_type") == "formid", parse_hex(F.col(value)))
    out = changes.withColumn("__key", key).join(named, F.col("__key") == F.col("__id"), "left")
    shown = F.when(F.col("__name").isNotNull(), F.concat(value, F.lit(" ("), "__name", F.lit(")"))).otherwise(F.col(value))
    return out.withColumn(value, shown).drop("__key", "__id", "__name")


def diff_report(
    old: tuple[int, str, DataFrame, DataFrame], new: tuple[int, str, DataFrame, DataFrame], record_type: str | None = None
) -> Diff:
    """The diff of two snapshots, each given as (id, label, records, fields)."""
    with Scratch(old[2].sparkSession) as scratch:
        changes = scratch(diff.diff_records(old[2], new[2], record_type))
        ids = changes.select("form_id")
        out = Diff(old[0], new[0], old[1], new[1])
        for kind, side in (("added", new), ("removed", old), ("modified", new)):
            own = changes.where(F.col("change_type") == kind)
            found = items(own.orderBy("form_id"))
            setattr(out, kind, found)
            if kind != "modified":
                _with_fields(found, own.select("form_id"), side[3], side[2])
            _with_links(found, refs.xrefs(side[3], side[2], ids))
        changed = diff.diff_fields(changes, old[3], new[3])
        changed = _side("new_value", new[2], _side("old_value", old[2], changed)).orderBy("form_id", "field_name")
        by_id = {x.form_id: x for x in out.modified}
        for r in changed.toLocalIterator():
            by_id[r["form_id"]].changes.append((r["field_name"], r["old_value"], r["new_value"]))
    return out


def search_report(found: DataFrame, records: DataFrame, fields: DataFrame) -> list[Item]:
    """Search results, the first DETAILED of them with their fields."""
    out = items(found)
    ids = fields.sparkSession.createDataFrame([(x.form_id,) for x in out[:DETAILED]], "form_id long")
    _with_fields(out[:DETAILED], ids, fields, records)
    return out


def unreleased_report(records: DataFrame, cap: int) -> list[Category]:
    """The categories that have records, each with its first ``cap``."""
    found = unreleased.find_unreleased(records)
    totals = {r["category"]: r["n"] for r in found.groupBy("category").agg(F.count("*").alias("n")).collect()}
    shown = lookups.capped(found, "category", ["pattern", "place"], cap).orderBy("pattern", "place")
    by_category: dict[str, list[Item]] = {}
    for r in shown.collect():
        by_category.setdefault(r["category"], []).append(Item(r["form_id"], r["record_type"], r["editor_id"], r["full_name"]))
    names = (unreleased.SHOP, unreleased.CUT, unreleased.HIGH, unreleased.QUESTS)
    return [Category(n, totals[n], by_category[n]) for n in names if n in totals]


def snapshot_lines(snapshots: DataFrame) -> list[str]:
    """The snapshot list as text."""
    lines = [f"{'ID':>4}  {'Label':<30}  {'Created':<20}  {'Records':>10}  {'Strings':>10}  {'File Hash':<16}", "-" * 100]
    for s in lookups.list_snapshots(snapshots).collect():
        created = s["created_at"].strftime("%Y-%m-%d %H:%M:%S")
        lines.append(
            f"{s['id']:>4}  {s['label']:<30}  {created:<20}  {s['record_count']:>10,}  {s['string_count']:>10,}  {s['file_hash'][:16]}"
        )
    return lines


def record_lines(record, fields: DataFrame, records: DataFrame) -> list[str]:
    """One record in full."""
    lines = [f"Record 0x{record['form_id']:08X}", f"  Type:       {record['record_type']}"]
    lines += [f"  Editor ID:  {record['editor_id'] or '(none)'}", f"  Name:       {record['full_name'] or '(none)'}"]
    if text := record["desc_text"]:
        lines.append(f"  Description:{text[:200] + '...' if len(text) > 200 else text}")
    lines += [f"  Flags:      0x{record['flags']:08X}", f"  Data Size:  {record['data_size']:,} bytes", f"  Data Hash:  {record['data_hash'][:16]}..."]
    shown = refs.resolve_fields(lookups.fields_of(fields, record["form_id"]), records).orderBy("ordinal").collect()
    if shown:
        lines += ["", "  Decoded Fields:"]
        lines += [f"    {f['field_name']:<25} = {f['display']} ({f['field_type']})" for f in shown]
    return lines


def sequence_lines(ids: DataFrame, records: DataFrame) -> list[str]:
    rows = refs.sequence_names(ids, records).orderBy("pos")
    return [r[0] for r in rows.select(F.concat(hex_id(F.col("form_id")), F.lit("  "), "name")).collect()]

