"""Schemas of the stored tables and of the sources' rows."""

from __future__ import annotations

SNAPSHOTS = (
    "id long, label string, created_at timestamp, file_hash string, file_size long, "
    "record_count long, string_count long, has_subrecords boolean"
)
RECORDS = (
    "snapshot_id long, form_id long, record_type string, editor_id string, full_name string, full_name_id long, "
    "desc_text string, desc_id long, data_hash string, flags long, data_size long"
)
FIELDS = "snapshot_id long, form_id long, ordinal int, field_name string, field_value string, field_type string"
STRINGS = "snapshot_id long, string_id long, text string, source string"
SUBRECORDS = "snapshot_id long, form_id long, sub_type string, sub_index int, data binary"
DIFFS = (
    "id long, old_snapshot_id long, new_snapshot_id long, created_at timestamp, "
    "added_count long, removed_count long, modified_count long"
)
DIFF_ENTRIES = (
    "diff_id long, form_id long, change_type string, record_type string, editor_id string, full_name string, "
    "old_hash string, new_hash string"
)

SUBRECORD = "struct<type: string, size: int, data: binary>"
RAW_RECORDS = (
    "ordinal long, record_type string, data_size long, flags long, form_id long, revision long, version int, "
    "subrecords array<struct<type: string, size: int, data: binary>>"
)
FIELD_TYPES = ("float", "int", "str", "formid", "flags", "enum")
EAV = "array<struct<name: string, value: string, type: string>>"


def columns(schema: str) -> list[str]:
    """Column names of a flat schema string."""
    return [part.split()[0] for part in schema.split(", ")]
