"""Round trips of the binary formats: rows of the driver's tables become bytes, which the engine's
readers and decoders read again, beside SQL that says from the same rows what must come out.

Records have a value for every field of their type's layout, computed from the key of
``part`` by a rule that both sides state: numbers in Python, texts in SQL.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataspark.functions import tables
from strataspark.functions.decoders import SPECS, UNIVERSAL, parsed
from strataspark.ingest import decoded
from strataspark.model import SUBRECORD
from strataspark.plans.views import read, strings

#: Types of each decoder query: of eight parts in a row, each is a record of another type.
FAMILIES = {
    "decode_items": ("WEAP", "ARMO", "ALCH", "AMMO", "MISC", "BOOK", "KEYM", "CONT"),
    "decode_actors": ("NPC_", "FACT", "RACE", "PERK", "LVLI", "LVLN", "AVIF", "ENTM"),
    "decode_magic": ("ENCH", "MGEF", "SPEL", "OMOD", "PROJ", "EXPL", "HAZD", "GLOB"),
    "decode_world": ("CELL", "WRLD", "LCTN", "REGN", "WTHR", "WATR", "STAT", "MSTT"),
    "decode_objects": ("ACTI", "FURN", "FLOR", "TERM", "COBJ", "SCOL", "CURV", "AACT"),
    "decode_dialogue": ("QUST", "DIAL", "INFO", "IDLE", "MESG", "LSCR", "CNCY", "GMST"),
}

Made = list[tuple[str, bytes]]


@dataclass
class Line:
    """A decoded field as SQL over ``part``: its value, type, and where it is there."""

    name: str
    value: str
    kind: str
    where: str = "true"


@dataclass
class Layout:
    """How a type's records are made of (key, name), and their fields in order."""

    parts: list[Callable[[int, str], Made]] = field(default_factory=list)
    lines: list[Line] = field(default_factory=list)


@dataclass(frozen=True)
class Number:
    """(key * a + b) % m * by, in Python and in SQL."""

    a: int
    b: int
    m: int
    by: int = 1

    def of(self, key: int) -> int:
        return (key * self.a + self.b) % self.m * self.by

    @property
    def sql(self) -> str:
        return f"((p_partkey * {self.a} + {self.b}) % {self.m} * {self.by})"


SIZES = {"u8": 1, "u16": 2, "u32": 4, "i32": 4, "id": 4, "h2": 1, "h4": 2, "h8": 4}


def size_of(kind: str) -> int:
    base = kind.rstrip("?").partition(":")[0]
    if base.startswith("enum"):
        return int(base[4:]) // 8
    return int(base[4:] or 1) if base.startswith("bool") else 4 if base[0] == "f" else SIZES[base]


def number_for(kind: str, seed: int) -> Number:
    base, _, table = kind.rstrip("?").partition(":")
    if kind.endswith("?"):
        return Number(3 + 2 * seed, 7 * seed, 5, {1: 40, 2: 9001}.get(size_of(kind), 800_000_011))
    if base.startswith("enum"):
        return Number(1 + 2 * seed, seed, max(getattr(tables, table)) + 3)
    return Number(3 + 2 * seed, 7 * seed, 4001 if base[0] == "f" or base == "i32" else 256 ** size_of(kind) - 5)


def bytes_for(kind: str, n: int) -> bytes:
    if kind[0] == "f":
        return struct.pack("<f", (n - 500) / 8)
    return struct.pack("<i", n - 500) if kind == "i32" else n.to_bytes(size_of(kind), "little")


def case(table: dict[int, str], code: str) -> str:
    return f"CASE {' '.join(f'WHEN {code} = {k} THEN {v!r}' for k, v in sorted(table.items()))} ELSE ({code})::VARCHAR END"


def shown(name: str, kind: str, n: str) -> Line:
    """The field of a value of which ``n`` is the SQL."""
    base, _, table = kind.rstrip("?").partition(":")
    where = f"{n} <> 0" if kind.endswith("?") else "true"
    if base[0] == "f":
        return Line(name, f"printf('%.{base[1:]}f', ({n} - 500) / 8)", "float")
    if base == "i32":
        return Line(name, f"({n} - 500)::VARCHAR", "int")
    if base.startswith("bool"):
        mask = int(table, 0) or -1
        return Line(name, f"CASE WHEN {n} & {mask} <> 0 THEN 'True' ELSE 'False' END", "str")
    if base.startswith("enum"):
        return Line(name, case(getattr(tables, table), n), "enum")
    if base[0] == "u":
        return Line(name, f"{n}::VARCHAR", "int", where)
    digits = 8 if base == "id" else int(base[1:])
    return Line(name, f"printf('0x%0{digits}X', {n})", "formid" if base == "id" else "flags", where)


def add_block(out: Layout, block: str, seed: int) -> None:
    """The subrecords of a block, and their fields."""
    sub, mode, entry, least, values = parsed(block)
    if values[0][1] == "text":
        name = values[0][0]
        for i in range(2 if mode == "*" else 1):
            out.parts.append(lambda key, text, i=i: [(sub, f"{text} {name} {i}".encode() + b"\0")])
            out.lines.append(Line(name.replace("{i}", str(i)), f"p_name || ' {name} {i}'", "str"))
        return
    # fields at one place show one value
    at_place: dict[int, str] = {}
    for _, kind, at, _ in values:
        if at not in at_place or at_place[at].startswith("bool"):
            at_place[at] = kind
    times = 2 if mode else 1
    numbers = [
        {at: number_for(kind, seed + at % 13 + 3 * i) for at, kind in at_place.items()} for i in range(times)
    ]
    size = entry or max(least, *(max(needed, at + size_of(kind)) for _, kind, at, needed in values))

    def made(key: int, text: str) -> Made:
        parts = []
        for own in numbers:
            data = bytearray(size)
            for at, n in own.items():
                raw = bytes_for(at_place[at], n.of(key))
                data[at : at + len(raw)] = raw
            parts.append(bytes(data))
        return [(sub, b"".join(parts) + b"end"[: key % 3])] if entry else [(sub, p) for p in parts]

    out.parts.append(made)
    for i, own in enumerate(numbers):
        out.lines += [shown(name.replace("{i}", str(i)), kind, own[at].sql) for name, kind, at, _ in values]


def _le(n: int) -> bytes:
    return n.to_bytes(4, "little")


def _effects(key: int, text: str) -> Made:
    out: Made = []
    for i in range(key % 3):
        out += [("EFID", _le(key * 31 + i)), ("EFIT", struct.pack("<fII", (key % 80 + i) / 8, key % 7 + i, key % 9 + i))]
    return out + [("EFID", _le(key))] * (key % 2)  # one without an item isn't an effect


def _setting(key: int, text: str) -> Made:
    kind = "fiubs"[key // 8 % 5]
    value = {
        "f": struct.pack("<f", (key % 900 - 300) / 8), "b": _le(key // 40 % 2), "s": text.encode() + b"\0\0",
    }.get(kind, struct.pack("<i", key % 1000 - 300))
    return [("EDID", f"{kind}Set\0".encode()), ("DATA", value)]


def _modification(key: int, text: str) -> Made:
    data = bytes([key % 5, key % 3]) + bytes(6)
    for i in range(key % 3):
        data += struct.pack("<BBHIfff", (key + i) % 8, (key + i) % 5, 0, key * 17 + i, (key % 70) / 8, -i / 4, 0.5) + bytes(4)
    return [("DATA", data)]


HEX = "printf('0x%08X', {})"
#: The text of a string id, if there is one.
TEXT_OF = "(SELECT nullif(any_value(text), '') FROM strs WHERE string_id = p_partkey % 3000)"
SETTING = """CASE p_partkey // 8 % 5 WHEN 0 THEN printf('%.6f', (p_partkey % 900 - 300) / 8) WHEN 3 THEN
  CASE WHEN p_partkey // 40 % 2 = 1 THEN 'True' ELSE 'False' END WHEN 4 THEN p_name ELSE (p_partkey % 1000 - 300)::VARCHAR END"""
VERB = f"coalesce({TEXT_OF}, printf('0x%08X', p_partkey % 3000))"

#: What doesn't fit a block, by its name: subrecords and fields.
SPECIAL: dict[str, tuple[Callable[[int, str], Made], list[Line]]] = {
    "effects": (_effects, [
        line
        for i in range(2)
        for line in (
            Line(f"effect_{i}_id", HEX.format(f"p_partkey * 31 + {i}"), "formid", f"p_partkey % 3 > {i}"),
            Line(f"effect_{i}_magnitude", f"printf('%.2f', (p_partkey % 80 + {i}) / 8)", "float", f"p_partkey % 3 > {i}"),
            Line(f"effect_{i}_area", f"(p_partkey % 7 + {i})::VARCHAR", "int", f"p_partkey % 3 > {i}"),
            Line(f"effect_{i}_duration", f"(p_partkey % 9 + {i})::VARCHAR", "int", f"p_partkey % 3 > {i}"),
        )
    ]),
    "setting": (_setting, [
        Line("value", SETTING, kind, f"p_partkey // 8 % 5 IN ({codes})") for kind, codes in (("float", "0"), ("int", "1, 2"), ("str", "3, 4"))
    ]),
    "global": (lambda key, text: [("FNAM", b"slfx"[key // 8 % 4 : key // 8 % 4 + 1])], [
        Line("type", "['short', 'long', 'float', '0x78'][p_partkey // 8 % 4 + 1]", "str")
    ]),
    "modification": (_modification, [
        Line("include_count", "(p_partkey % 5)::VARCHAR", "int"), Line("property_count", "(p_partkey % 3)::VARCHAR", "int"),
        *(
            Line(f"prop_{i}_{name}", value, kind, f"p_partkey % 3 > {i}")
            for i in range(2)
            for name, value, kind in (
                ("value_type", case(tables.OMOD_VALUE_TYPE, f"((p_partkey + {i}) % 8)"), "enum"),
                ("function_type", case(tables.OMOD_FUNCTION_TYPE, f"((p_partkey + {i}) % 5)"), "enum"),
                ("keyword", HEX.format(f"p_partkey * 17 + {i}"), "formid"), ("value1", "printf('%.4f', p_partkey % 70 / 8)", "float"),
                ("value2", "'0.0000'" if i == 0 else "'-0.2500'", "float"), ("step", "'0.5000'", "float"),
            )
        ),
    ]),
    "verb": (lambda key, text: [("VNAM", _le(key % 3000))], [Line("verb_override", VERB, "str", "p_partkey % 3000 <> 0")]),
    "response": (lambda key, text: [("RNAM", _le(key % 3000))], [Line("response_text_loc", VERB, "str", "p_partkey % 3000 <> 0")]),
    "buttons": (lambda key, text: [("ITXT", _le(key % 3000)), ("ITXT", b"no"), ("ITXT", f"Press {text}\0".encode())], [
        Line("button_0", TEXT_OF, "str", f"p_partkey % 3000 <> 0 AND {TEXT_OF} IS NOT NULL"), Line("button_2", "'Press ' || p_name", "str"),
    ]),
    "weathers": (lambda key, text: [("RDWT", struct.pack("<6I", key % 3 * 1000, key % 50, 0, key + 1, 7, 0) + b"cut")], [
        Line("weather_0_id", HEX.format("p_partkey % 3 * 1000"), "formid", "p_partkey % 3 <> 0"),
        Line("weather_0_weight", "(p_partkey % 50)::VARCHAR", "int", "p_partkey % 3 <> 0"),
        Line("weather_1_id", HEX.format("p_partkey + 1"), "formid"), Line("weather_1_weight", "'7'", "int"),
    ]),
    "clouds": (lambda key, text: [("00TX", b"a\0")] * (key % 3) + [("10TX", b"\0"), ("TX00", b"ab")], [
        Line("cloud_texture_count", "(p_partkey % 3)::VARCHAR", "int", "p_partkey % 3 > 0")
    ]),
    "placements": (lambda key, text: [("DATA", bytes(28 * (key % 4) + key % 5))], [
        Line("placement_count", "(p_partkey % 4)::VARCHAR", "int", "p_partkey % 4 > 0")
    ]),
    "curve": (lambda key, text: [("CRVE", b"x")] * (key % 3), [
        Line("curve_entry_count", "(p_partkey % 3)::VARCHAR", "int", "p_partkey % 3 > 0")
    ]),
}


def layout(record_type: str) -> Layout:
    out = Layout()
    for seed, block in enumerate([*SPECS[record_type], *UNIVERSAL]):
        if block[0] == "[":
            part, lines = SPECIAL[block[1:-1]]
            out.parts.append(part)
            out.lines += lines
        else:
            add_block(out, block, seed)
    return out


def records(spark: SparkSession, sf_dir: str, types: tuple[str, ...]) -> DataFrame:
    """ordinal, form_id, record_type, subrecords of each part as a record of one of the types."""

    @F.pandas_udf(f"array<{SUBRECORD}>")
    def made(keys: pd.Series, names: pd.Series) -> pd.Series:
        layouts = [layout(t) for t in types]
        out = []
        for key, name in zip(keys, names, strict=True):
            subs = [s for part in layouts[key % len(types)].parts for s in part(key, name)]
            out.append([{"type": n, "size": len(d), "data": d} for n, d in subs])
        return pd.Series(out, dtype=object)

    key = F.col("p_partkey")
    kind = F.get(F.array(*map(F.lit, types)), (key % len(types)).cast("int"))
    return read(spark, sf_dir, "part").select(
        key.alias("ordinal"), key.alias("form_id"), kind.alias("record_type"), made("p_partkey", "p_name").alias("subrecords")
    )


def decode_family(types: tuple[str, ...]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        raw = records(spark, sf_dir, types)
        texts = strings(spark, sf_dir).groupBy("string_id").agg(F.any_value("text").alias("text"))
        kinds = raw.select(F.col("form_id").alias("of"), "record_type")
        fields = decoded(raw, texts)
        return fields.join(kinds, F.col("form_id") == F.col("of")).select(
            "form_id", "record_type", "ordinal", "field_name", "field_value", "field_type"
        )

    return run


def family_sql(types: tuple[str, ...]) -> str:
    lines = []
    for i, t in enumerate(types):
        for k, x in enumerate(layout(t).lines):
            lines.append(
                f"SELECT p_partkey AS form_id, '{t}' AS record_type, {k} AS k, '{x.name}' AS field_name, {x.value} AS field_value, "
                f"'{x.kind}' AS field_type FROM part WHERE p_partkey % {len(types)} = {i} AND {x.where}"
            )
    return (
        "SELECT form_id, record_type, (row_number() OVER (PARTITION BY form_id ORDER BY k) - 1)::INTEGER AS ordinal, field_name, field_value, "
        f"field_type FROM ({' UNION ALL '.join(lines)})"
    )


# Conditions

#: Names and parameter kinds of the functions in the fixture; others have none.
FUNCTIONS = {
    0: ("Plain", "none", "none"), 1: ("Counted", "integer", "formid"), 2: ("Named", "string", "axis"), 3: ("Valued", "actor_value", "none"),
    4: ("Referred", "formid", "string"), 5: ("Turned", "axis", "integer"),
}
COMPARED = (0.0, 1.0, 2.5, -1.5)


def _conditions(key: int, text: str) -> Made:
    reference = (0, 0xFFFFFFFF, key)[key % 3]
    data = struct.pack("<I", key % 8 * 32) + struct.pack("<f", COMPARED[key % 4]) + struct.pack("<HH", key % 7, 0)
    data += struct.pack("<5I", key * 13, key % 9, key % 12, reference, 0)
    out = [("CIS1", b"lost\0"), ("CTDA", data[: (8, 16, 24, 32)[key // 4 % 4]])]
    return out + [("CIS1", f"{text}\0".encode())] * (key % 5 == 0) + [("CIS2", f"two {text}\0".encode())] * (key % 7 == 0)


def condition_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a record with one condition, of lengths from 8 to 32 bytes."""

    @F.pandas_udf(f"array<{SUBRECORD}>")
    def made(keys: pd.Series, names: pd.Series) -> pd.Series:
        rows = [_conditions(k, n) for k, n in zip(keys, names, strict=True)]
        return pd.Series([[{"type": n, "size": len(d), "data": d} for n, d in subs] for subs in rows], dtype=object)

    raw = read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("form_id"), F.lit("AAPD").alias("record_type"),
        made("p_partkey", "p_name").alias("subrecords"),
    )
    none = spark.createDataFrame([], "string_id long, text string")
    return decoded(raw, none, FUNCTIONS).select("form_id", "ordinal", "field_name", "field_value", "field_type")


def _hex(n: str) -> str:
    """SQL: four bytes, least first, in lower-case hex."""
    return "printf('%02x%02x%02x%02x', " + ", ".join(f"({n} >> {s}) & 255" for s in (0, 8, 16, 24)) + ")"


def _parameter(kind: str, n: str, text: str) -> str:
    return {
        "integer": f"({n})::VARCHAR", "actor_value": f"({n})::VARCHAR", "formid": f"printf('0x%08X', {n})",
        "string": f"""nullif('"' || {text} || '"', '""')""", "axis": case(tables.AXES, n),
    }.get(kind, "NULL")


def conditions_sql() -> str:
    name = f"CASE f {' '.join(f'WHEN {k} THEN {v[0]!r}' for k, v in FUNCTIONS.items())} ELSE 'Unknown_' || f END"
    parameter = lambda j, n, text: f"CASE f {' '.join(f'WHEN {k} THEN {_parameter(v[j], n, text)}' for k, v in FUNCTIONS.items())} END"
    operator = f"CASE code {' '.join(f'WHEN {k} THEN {v!r}' for k, v in tables.CONDITION_OPERATORS.items())} ELSE '?op' || code END"
    run_on = f"CASE r {' '.join(f'WHEN {k} THEN {v!r}' for k, v in tables.CONDITION_RUN_ON.items())} ELSE 'Unknown(' || r || ')' END"
    parts = [
        Line("condition_count", "'1'", "int"),
        Line("condition_0_raw", "substr(raw, 1, 2 * n)", "str"),
        Line("condition_0_function", "f::VARCHAR", "int"),
        Line("condition_0_function_name", name, "str"),
        Line("condition_0_operator", operator, "str"),
        Line("condition_0_comparison", "printf('%.6f', compared)", "float"),
        Line("condition_0_param1_hex", HEX.format("a"), "str", "n >= 16"),
        Line("condition_0_param1_string", "one", "str", "one IS NOT NULL"),
        Line("condition_0_param2_hex", HEX.format("b"), "str", "n >= 20"),
        Line("condition_0_param2_string", "two", "str", "two IS NOT NULL"),
        Line("condition_0_run_on", run_on, "str", "n >= 24"),
        Line("condition_0_reference", HEX.format("key"), "formid", "n >= 28 AND key % 3 = 2"),
        Line(
            "condition_0_summary",
            f"{name} || '(' || concat_ws(', ', {parameter(1, 'a', 'one')}, {parameter(2, 'b', 'two')}) || ') ' || {operator} || ' ' || "
            f"CASE key % 4 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2.50' ELSE '-1.50' END || ' [on ' || {run_on} || ']'",
            "str", "n >= 10",
        ),
    ]
    zero = "printf('%08x', 0)"
    raw = " || ".join((
        _hex("(p_partkey % 8 * 32)"), "['00000000', '0000803f', '00002040', '0000c0bf'][p_partkey % 4 + 1]", _hex("(p_partkey % 7)"),
        _hex("(p_partkey * 13)"), _hex("(p_partkey % 9)"), _hex("(p_partkey % 12)"),
        f"CASE p_partkey % 3 WHEN 0 THEN {zero} WHEN 1 THEN 'ffffffff' ELSE {_hex('p_partkey')} END", zero,
    ))
    base = f"""SELECT p_partkey AS key, [8, 16, 24, 32][p_partkey // 4 % 4 + 1] AS n, {raw} AS raw, p_partkey % 8 AS code,
    [0.0, 1.0, 2.5, -1.5][p_partkey % 4 + 1]::DOUBLE AS compared, CASE WHEN n >= 10 THEN p_partkey % 7 ELSE 0 END AS f,
    CASE WHEN n >= 16 THEN p_partkey * 13 ELSE 0 END AS a, CASE WHEN n >= 20 THEN p_partkey % 9 ELSE 0 END AS b,
    CASE WHEN n >= 24 THEN p_partkey % 12 ELSE 0 END AS r, CASE WHEN p_partkey % 5 = 0 THEN p_name END AS one,
    CASE WHEN p_partkey % 7 = 0 THEN 'two ' || p_name END AS two FROM part"""
    union = " UNION ALL ".join(
        f"SELECT key AS form_id, {k} AS k, '{x.name}' AS field_name, {x.value} AS field_value, '{x.kind}' AS field_type FROM base WHERE {x.where}"
        for k, x in enumerate(parts)
    )
    return (
        f"+ base AS ({base}) SELECT form_id, (row_number() OVER (PARTITION BY form_id ORDER BY k) - 1)::INTEGER AS ordinal, field_name, "
        f"field_value, field_type FROM ({union})"
    )
