"""Decoders: hand-written expectations, size boundaries of every block, conditions."""

from __future__ import annotations

import struct

import pytest

from strataspark.functions import conditions, decoders
from strataspark.functions.decoders import SPECS, decode, parsed

NONE = {}.get


def fields(kind, subs, look_up=NONE, functions=None):
    return decode(kind, subs, look_up, functions or {})


def test_weapon_by_hand():
    d = bytearray(170)
    struct.pack_into("<I", d, 0, 7)
    struct.pack_into("<f", d, 4, 0.25)
    struct.pack_into("<f", d, 24, 0.25)
    struct.pack_into("<f", d, 52, 2.5)
    struct.pack_into("<I", d, 56, 2**32 - 1)
    d[101] = 9
    struct.pack_into("<I", d, 112, 77)
    got = fields("WEAP", [("DNAM", bytes(d)), ("CRDT", struct.pack("<fff", 1.5, -0.04, 0)), ("DAMA", struct.pack("<IfIf", 1, 2.25, 3, 4) + b"rest")])
    assert got == [
        ("animation_type", "shotgun", "enum"), ("speed", "0.2500", "float"), ("reach", "0.0000", "float"), ("min_range", "0.2", "float"),
        ("max_range", "0.0", "float"), ("attack_delay", "0.0000", "float"), ("out_of_range_dmg_mult", "0.0000", "float"),
        ("secondary_damage", "0.0000", "float"), ("weight", "2.50", "float"), ("value", "4294967295", "int"), ("damage", "0.0", "float"),
        ("num_projectiles", "9", "int"), ("sound_level", "77", "enum"), ("crit_damage", "1.5", "float"), ("crit_multiplier", "-0.0400", "float"),
        ("damage_type_0_id", "0x00000001", "formid"), ("damage_type_0_value", "2.2", "float"), ("damage_type_1_id", "0x00000003", "formid"),
        ("damage_type_1_value", "4.0", "float"),
    ]


def test_npc_order_follows_the_listing_not_the_offsets():
    d = struct.pack("<I8H", 0x802, 5, 6, 7, 8, 9, 10, 11, 12)
    got = dict((n, v) for n, v, _ in fields("NPC_", [("ACBS", d)]))
    assert got == {
        "npc_flags": "0x00000802", "is_essential": "True", "is_unique": "False", "is_protected": "True", "level": "7",
        "health_offset": "10", "magicka_offset": "5", "stamina_offset": "6",
    }


def blocks():
    return [(kind, b) for kind, spec in SPECS.items() for b in spec if b[0] != "["]


@pytest.mark.parametrize(("kind", "block"), blocks(), ids=lambda x: x.split()[0])
def test_every_block_at_its_least_size(kind, block):
    name, mode, entry, least, values = parsed(block)
    assert all(at + 1 <= max(least, needed) for _, _, at, needed in values)
    short = [("EDID", b"x\0"), (name, b"\1" * (least - 1))]
    own = {v[0].replace("{i}", "0") for v in values}
    assert not own & {n for n, _, _ in fields(kind, short)}
    full = fields(kind, [("EDID", b"x\0"), (name, b"\1" * least)])
    expected = [v[0].replace("{i}", "0") for v in values if v[3] <= least]
    assert [n for n, _, _ in full if n in own] == expected
    assert all(t in ("float", "int", "str", "formid", "flags", "enum") for _, _, t in full)
    if mode == "*":  # the index counts parts that are too small
        two = fields(kind, [(name, b""), (name, b"\1" * least)])
        assert {n for n, _, _ in two if n in {v[0].replace("{i}", "1") for v in values}}


def test_types_are_complete():
    assert len(SPECS) == 48


def test_optional_ids_and_settings():
    assert ("next_perk", "0x00000005", "formid") in fields("PERK", [("NNAM", struct.pack("<I", 5))])
    assert fields("PERK", [("NNAM", bytes(4))]) == []
    value = struct.pack("<i", -2)
    for name, expected in (("fA", None), ("iA", ("value", "-2", "int")), ("uA", ("value", "-2", "int")), ("bA", ("value", "True", "str")), ("xA", [])):
        got = fields("GMST", [("EDID", name.encode() + b"\0"), ("DATA", value)])
        assert expected is None or got == ([expected] if expected else [])
    assert fields("GMST", [("EDID", b"sA\0"), ("DATA", b"text\xff\0\0")]) == [("value", "text�", "str")]
    assert fields("GLOB", [("FNAM", b"s"), ("FLTV", struct.pack("<f", 1e7))]) == [("type", "short", "str"), ("value", "10000000.000000", "float")]
    assert fields("GLOB", [("FNAM", b"\x01")]) == [("type", "0x01", "str")]


def test_lists_effects_and_counts():
    lvlo = struct.pack("<HHIHH", 3, 0, 0xAB, 2, 0)
    got = fields("LVLN", [("LVLF", b"\5"), ("LVLO", b"short"), ("LVLO", lvlo)])
    assert ("lvl_flags", "0x05", "flags") in got and ("use_all", "True", "str") in got and ("calculate_all_lte_pc", "False", "str") in got
    assert [x for x in got if x[0].startswith("entry_")] == [
        ("entry_1_level", "3", "int"), ("entry_1_ref", "0x000000AB", "formid"), ("entry_1_count", "2", "int"),
    ]
    effects = [("EFID", struct.pack("<I", 1)), ("EFID", b"ab"), ("EFIT", struct.pack("<fII", 0.125, 2, 3)), ("EFIT", b""), ("EFIT", b"extra")]
    assert fields("SPEL", effects) == [
        ("effect_0_id", "0x00000001", "formid"), ("effect_0_magnitude", "0.12", "float"), ("effect_0_area", "2", "int"), ("effect_0_duration", "3", "int"),
    ]
    assert fields("SCOL", [("DATA", bytes(57)), ("DATA", bytes(27))]) == [("placement_count", "2", "int")]
    assert fields("WTHR", [("00TX", b"ab"), ("10TX", b""), ("L0TX", b"ab")]) == [("cloud_texture_count", "2", "int")]
    assert fields("CURV", [("CRVE", b""), ("CRVE", b"")]) == [("curve_entry_count", "2", "int")]
    rdwt = struct.pack("<IIIIII", 0, 5, 0, 9, 6, 0)
    assert fields("REGN", [("RDWT", rdwt)]) == [("weather_1_id", "0x00000009", "formid"), ("weather_1_weight", "6", "int")]


def test_modification_properties_stop_at_the_end():
    prop = struct.pack("<BBHIfffI", 1, 2, 0, 7, 0.5, 1.5, 2.5, 0)
    got = fields("OMOD", [("DATA", bytes([1, 3]) + bytes(6) + prop + prop[:10])])
    assert got[:2] == [("include_count", "1", "int"), ("property_count", "3", "int")]
    assert got[2:] == [
        ("prop_0_value_type", "float", "enum"), ("prop_0_function_type", "add", "enum"), ("prop_0_keyword", "0x00000007", "formid"),
        ("prop_0_value1", "0.5000", "float"), ("prop_0_value2", "1.5000", "float"), ("prop_0_step", "2.5000", "float"),
    ]


def test_localized_fields():
    texts = {5: "Open", 6: ""}.get
    assert fields("ACTI", [("VNAM", struct.pack("<I", 5))], texts) == [("verb_override", "Open", "str")]
    assert fields("ACTI", [("VNAM", struct.pack("<I", 6))], texts) == [("verb_override", "0x00000006", "str")]
    itxt = [("ITXT", struct.pack("<I", 5)), ("ITXT", struct.pack("<I", 9)), ("ITXT", b"Maybe\0"), ("ITXT", b"abc")]
    assert fields("MESG", itxt, texts) == [("button_0", "Open", "str"), ("button_2", "Maybe", "str")]
    got = fields("INFO", [("RNAM", struct.pack("<I", 5)), ("CTDA", b"")], texts)
    assert got[0] == ("response_text_loc", "Open", "str") and [n for n, _, _ in got].count("condition_count") == 1
    assert decoders.string_ids("MESG", itxt) == [5, 9, int.from_bytes(b"Mayb", "little")] and decoders.string_ids("WEAP", itxt) == []


def test_universal_fields():
    subs = [("KWDA", struct.pack("<II", 1, 2) + b"x"), ("MODL", b"a.nif\0"), ("ICON", b"i\0"), ("MICO", b"\0")]
    assert fields("????", subs) == [
        ("icon", "i", "str"), ("model", "a.nif", "str"), ("keyword_0", "0x00000001", "formid"), ("keyword_1", "0x00000002", "formid"),
    ]


FUNCTIONS = conditions.load_functions(["index,name,kind1,kind2", "14,GetIt,formid,string", "6,Pos,axis,float", "7,None,,"])


def ctda(function=14, op=0x60, compared=2.0, p1=0x10, p2=0, run_on=1, ref=0, size=32):
    return struct.pack("<B3xfHHIIIIi", op, compared, function, 0, p1, p2, run_on, ref, -1)[:size]


def test_condition_by_hand():
    subs = [("CIS1", b"lost\0"), ("CTDA", ctda(ref=0xAB)), ("CIS2", b"text\0"), ("CTDA", ctda(function=99, op=0xE0, compared=0.5, ref=0xFFFFFFFF, run_on=20))]
    got = fields("MISC", subs, functions=FUNCTIONS)
    assert got == [
        ("condition_count", "2", "int"),
        ("condition_0_raw", ctda(ref=0xAB).hex(), "str"), ("condition_0_function", "14", "int"), ("condition_0_function_name", "GetIt", "str"),
        ("condition_0_operator", ">=", "str"), ("condition_0_comparison", "2.000000", "float"), ("condition_0_param1_hex", "0x00000010", "str"),
        ("condition_0_param2_hex", "0x00000000", "str"), ("condition_0_param2_string", "text", "str"), ("condition_0_run_on", "Target", "str"),
        ("condition_0_reference", "0x000000AB", "formid"), ("condition_0_summary", 'GetIt(0x00000010, "text") >= 2 [on Target]', "str"),
        ("condition_1_raw", ctda(function=99, op=0xE0, compared=0.5, ref=0xFFFFFFFF, run_on=20).hex(), "str"), ("condition_1_function", "99", "int"),
        ("condition_1_function_name", "Unknown_99", "str"), ("condition_1_operator", "?op7", "str"), ("condition_1_comparison", "0.500000", "float"),
        ("condition_1_param1_hex", "0x00000010", "str"), ("condition_1_param2_hex", "0x00000000", "str"), ("condition_1_run_on", "Unknown(20)", "str"),
        ("condition_1_summary", "Unknown_99() ?op7 0.50 [on Unknown(20)]", "str"),
    ]


@pytest.mark.parametrize(("size", "last"), [(0, "operator"), (4, "operator"), (8, "comparison"), (10, "summary"), (16, "summary"), (24, "summary"), (28, "summary")])
def test_short_conditions(size, last):
    got = conditions.condition_fields([("CTDA", ctda(size=size, ref=5))], FUNCTIONS)
    assert got[-1][0] == f"condition_0_{last}"
    names = {n.removeprefix("condition_0_") for n, _, _ in got}
    assert ("param1_hex" in names, "param2_hex" in names, "run_on" in names, "reference" in names) == (size >= 16, size >= 20, size >= 24, size >= 28)


def test_parameters_and_numbers():
    one = struct.unpack("<I", struct.pack("<f", 1.5))[0]
    text = conditions.condition_fields([("CTDA", ctda(function=6, p1=2, p2=one, compared=float("nan")))], FUNCTIONS)[-1][1]
    assert text == "Pos(Z, 1.50) >= nan [on Target]"
    assert conditions.comparison_text(float("inf")) == "inf" and conditions.comparison_text(-3.0) == "-3"
    with pytest.raises(ValueError):
        conditions.load_functions(["index,name,kind1,kind2", "1,a,what,"])
