"""Condition blocks: operators, run-on targets, parameters and their summary.

Names and parameter kinds of condition functions are a parameter (``Functions``),
loaded from a table with the columns index, name, kind1, kind2; functions that the
table doesn't have are shown by number.
"""

from __future__ import annotations

import csv
import math
import struct
from collections.abc import Iterable

from strataspark.functions.tables import AXES, CONDITION_OPERATORS, CONDITION_RUN_ON, PARAMETER_KINDS

#: index -> (name, kind of parameter 1, kind of parameter 2)
Functions = dict[int, tuple[str, str, str]]
Triple = tuple[str, str, str]


def load_functions(lines: Iterable[str]) -> Functions:
    """Functions from CSV lines with a header."""
    out: Functions = {}
    for row in csv.DictReader(lines):
        kinds = (row.get("kind1") or "none", row.get("kind2") or "none")
        for kind in kinds:
            if kind not in PARAMETER_KINDS:
                raise ValueError(f"no kind of parameter: {kind!r}")
        out[int(row["index"])] = (row["name"], *kinds)
    return out


def operator_text(op_byte: int) -> str:
    code = op_byte >> 5 & 7
    return CONDITION_OPERATORS.get(code, f"?op{code}")


def run_on_text(code: int) -> str:
    return CONDITION_RUN_ON.get(code, f"Unknown({code})")


def fixed(value: float, digits: int) -> str:
    return f"{value:.{digits}f}"


def parameter_text(value: int, kind: str, text: str | None) -> str:
    """A parameter as its kind shows it; empty for none and for a string that isn't there."""
    match kind:
        case "string":
            return f'"{text}"' if text else ""
        case "formid":
            return f"0x{value:08X}"
        case "actor_value" | "integer":
            return str(value)
        case "axis":
            return AXES.get(value, str(value))
        case "float":
            return fixed(struct.unpack("<f", value.to_bytes(4, "little"))[0], 2)
    return ""


def comparison_text(value: float) -> str:
    """Whole numbers without decimals; nan and inf as such."""
    if math.isfinite(value) and value == int(value):
        return str(int(value))
    return fixed(value, 2)


def condition_blocks(subrecords: list[tuple[str, bytes]]) -> list[tuple[bytes, str | None, str | None]]:
    """(data, string 1, string 2) of each condition: strings go with the condition before."""
    out: list[list] = []
    for kind, data in subrecords:
        if kind == "CTDA":
            out.append([data, None, None])
        elif kind in ("CIS1", "CIS2") and out:
            out[-1][1 if kind == "CIS1" else 2] = data.rstrip(b"\0").decode("utf-8", "replace")
    return [tuple(x) for x in out]


def condition_fields(subrecords: list[tuple[str, bytes]], functions: Functions) -> list[Triple]:
    """Fields of all conditions of a record, in order."""
    blocks = condition_blocks(subrecords)
    if not blocks:
        return []
    out: list[Triple] = [("condition_count", str(len(blocks)), "int")]
    for i, (data, first, second) in enumerate(blocks):
        n = len(data)
        u32 = lambda at: int.from_bytes(data[at : at + 4], "little") if n >= at + 4 else 0  # noqa: B023, E731
        number = int.from_bytes(data[8:10], "little") if n >= 10 else 0
        compared = struct.unpack_from("<f", data, 4)[0] if n >= 8 else 0.0
        op = operator_text(data[0] if n else 0)
        name, kind1, kind2 = functions.get(number, (f"Unknown_{number}", "none", "none"))

        def put(field: str, value: str, kind: str = "str", i: int = i) -> None:
            out.append((f"condition_{i}_{field}", value, kind))

        put("raw", data.hex())
        put("function", str(number), "int")
        put("function_name", name)
        put("operator", op)
        if n >= 8:
            put("comparison", fixed(compared, 6), "float")
        if n >= 16:
            put("param1_hex", f"0x{u32(12):08X}")
        if first:
            put("param1_string", first)
        if n >= 20:
            put("param2_hex", f"0x{u32(16):08X}")
        if second:
            put("param2_string", second)
        if n >= 24:
            put("run_on", run_on_text(u32(20)))
        if n >= 28 and u32(24) not in (0, 0xFFFFFFFF):
            put("reference", f"0x{u32(24):08X}", "formid")
        if n >= 10:
            shown = (parameter_text(u32(12), kind1, first), parameter_text(u32(16), kind2, second))
            call = f"{name}({', '.join(x for x in shown if x)})"
            put("summary", f"{call} {op} {comparison_text(compared)} [on {run_on_text(u32(20))}]")
    return out
