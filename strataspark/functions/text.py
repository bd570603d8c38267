"""Column functions on names, ids, patterns and text forms of values. All JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataspark.functions.tables import TYPE_NAMES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An escape character that doesn't occur in patterns: these have no escapes.
NO_ESCAPE = "\x01"


def hex_id(value: Column, digits: int = 8) -> Column:
    """0x and upper-case hex digits, zero-padded."""
    return F.format_string(f"0x%0{digits}X", value.cast("long"))


def parse_hex(text: Column) -> Column:
    """Value of a hex literal with or without 0x; null for anything else."""
    bare = F.regexp_replace(F.trim(text), "^0[xX]", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{1,15}$"), F.conv(bare, 16, 10).cast("long"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def like(text: Column, pattern: str) -> Column:
    """LIKE that folds A-Z only, with % and _ as wildcards and no escape character."""
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in pattern)
    return F.like(ascii_lower(text), F.lit(folded), F.lit(NO_ESCAPE))


def contains(text: Column, part: str) -> Column:
    """LIKE '%part%': wildcards within ``part`` stay alive."""
    return like(text, f"%{part}%")


def glob_to_like(pattern: str) -> str:
    """* and ? of a glob as LIKE wildcards."""
    return pattern.replace("*", "%").replace("?", "_")


def parse_id_literal(query: str) -> int | None:
    """An id as typed: 0x is hex, else Python's integer literals; None if it isn't one."""
    try:
        return int(query, 16) if query.startswith("0x") else int(query, 0)
    except ValueError:
        return None


def present(text: Column) -> Column:
    """The text, or null where it is empty."""
    return F.nullif(text, F.lit(""))


def display_name(full_name: Column, editor_id: Column) -> Column:
    """Full name, else editor id; empty counts as missing."""
    return F.coalesce(present(full_name), present(editor_id))


def type_name(record_type: Column) -> Column:
    """Display name of a record type, the type itself where it has none."""
    pairs = [F.lit(x) for item in TYPE_NAMES.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), record_type), record_type)


def shortened(text: Column, n: int) -> Column:
    """At most n characters, an ellipsis after a cut."""
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
