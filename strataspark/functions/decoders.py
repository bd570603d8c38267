"""Declarative decoders of 48 record types.

A type is a list of blocks. A block names a subrecord, the least size it must
have and its fields:

    SUB>=N       the first subrecord of that name
    SUB*>=N      each one; {i} in a field's name counts all of that name
    SUB/S>=N     the first one as an array of entries of S bytes; {i} counts them

A field is ``name=kind@offset``, with ``>=M`` if it needs a larger subrecord than
its block. Kinds: u8 u16 u32 i32 (int), f1 f2 f4 f6 (float with so many decimals), h2
h4 h8 (flags as hex of one, two, four bytes), id (form id), id? (form id unless zero),
enumN:TABLE (code of N bits), bool:MASK and bool2:MASK, bool4:MASK (a flag of one,
two, four bytes; MASK 0 is any bit), text (the whole subrecord; only over 1 byte).
What doesn't fit this form is a function in SPECIAL, named by a block in brackets.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import lru_cache

from strataspark.functions import tables
from strataspark.functions.conditions import Functions, Triple, condition_fields

Subrecords = list[tuple[str, bytes]]
#: The data of a record's subrecords, by name, in order.
Held = dict[str, list[bytes]]
Lookup = Callable[[int], "str | None"]

# Layouts of the records' subrecords.
SPECS: dict[str, list[str]] = {
    "WEAP": [
        "DNAM>=170 animation_type=enum32:WEAP_ANIMATION_TYPE@0 speed=f4@4 reach=f4@8 min_range=f1@24 max_range=f1@28"
        " attack_delay=f4@32 out_of_range_dmg_mult=f4@44 secondary_damage=f4@48 weight=f2@52 value=u32@56 damage=f1@60"
        " num_projectiles=u8@101 sound_level=enum32:WEAP_SOUND_LEVEL@112",
        "CRDT>=12 crit_damage=f1@0 crit_multiplier=f4@4",
        "DAMA/8>=8 damage_type_{i}_id=id@0 damage_type_{i}_value=f1@4",
    ],
    "ARMO": ["DATA>=8 value=i32@0 weight=f2@4 health=u32@8>=12", "DNAM>=4 armor_rating=u32@0", "BOD2>=8 biped_slots=h8@0"],
    "ALCH": [
        "DATA>=4 weight=f2@0",
        "ENIT>=12 value=i32@0 enit_flags=h8@4 is_food=bool4:0x2@4 is_medicine=bool4:0x10000@4 is_poison=bool4:0x20000@4"
        " addiction=id?@8 consume_sound=id?@16>=20",
        "[effects]",
    ],
    "NPC_": [
        "ACBS>=20 npc_flags=h8@0 is_essential=bool4:0x2@0 is_unique=bool4:0x4@0 is_protected=bool4:0x800@0 level=u16@8"
        " health_offset=u16@14 magicka_offset=u16@4 stamina_offset=u16@6",
        "DNAM>=4 base_health=u16@0 base_action_points=u16@2", "RNAM>=4 race=id@0",
    ],
    "QUST": [
        "DATA>=4 quest_flags=h8@0 start_game_enabled=bool4:0x1@0 wilderness_encounter=bool4:0x80@0 priority=u32@4>=8"
        " quest_type=enum32:QUST_TYPE@8>=16"
    ],
    "COBJ": [
        "CNAM>=4 created_object=id@0", "BNAM>=4 workbench_keyword=id@0", "DNAM>=8 created_count=u32@4",
        "FVPA/8>=8 component_{i}_id=id@0 component_{i}_count=u32@4",
    ],
    "AMMO": ["DATA>=8 projectile_count=i32@0 weight=f4@4", "DNAM>=16 projectile=id@0 ammo_flags=h8@4 speed=f1@8"],
    "MISC": ["DATA>=8 value=i32@0 weight=f2@4"],
    "BOOK": ["DATA>=8 value=i32@0 weight=f2@4"],
    "KEYM": ["DATA>=8 value=i32@0 weight=f2@4"],
    "GMST": ["[setting]"],
    "GLOB": ["[global]", "FLTV>=4 value=f6@0"],
    "CONT": ["CNTO*>=8 item_{i}_id=id@0 item_{i}_count=i32@4"],
    "FLOR": ["PFIG>=4 harvest_ingredient=id@0"],
    "LVLI": [
        "LVLD>=1 chance_none=u8@0", "LVLF>=1 lvl_flags=h2@0 calculate_all=bool:1@0 calculate_all_lte_pc=bool:2@0 use_all=bool:4@0",
        "LLCT>=1 entry_count=u8@0", "LVLO*>=12 entry_{i}_level=u16@0 entry_{i}_ref=id@4 entry_{i}_count=u16@8",
    ],
    "PERK": [
        "DATA>=5 is_playable=bool:0@0 trait=u8@1 level=u8@2 num_ranks=u8@3 hidden=bool:0@4", "NNAM>=4 next_perk=id?@0",
    ],
    "ENCH": [
        "ENIT>=36 cost=u32@0 ench_flags=h8@4 cast_type=enum32:CASTING_TYPE@8 charge_amount=u32@12 target_type=enum32:TARGET_TYPE@16"
        " enchant_type=enum32:ENCH_TYPE@20 charge_time=f4@24 base_enchantment=id?@28",
        "[effects]",
    ],
    "MGEF": [
        "DATA>=52 mgef_flags=h8@0 base_cost=f4@4 related_id=id?@8 magic_skill=i32@12 resist_value=u32@16 casting_light=id?@24"
        " taper_weight=f4@28 archetype=enum32:MGEF_ARCHETYPE@48>=60 casting_type=enum32:CASTING_TYPE@52>=60 delivery=enum32:TARGET_TYPE@56>=64"
    ],
    "SPEL": [
        "SPIT>=36 cost=u32@0 spell_flags=h8@4 spell_type=enum32:SPEL_TYPE@8 charge_time=f4@12 cast_type=enum32:CASTING_TYPE@16"
        " target_type=enum32:TARGET_TYPE@20 cast_duration=f4@24 range=f4@28 half_cost_perk=id?@32",
        "[effects]",
    ],
    "OMOD": ["[modification]"],
    "FACT": [
        "DATA>=4 faction_flags=h8@0 hidden_from_pc=bool4:1@0 special_combat=bool4:2@0 track_crime=bool4:0x40@0 can_be_owner=bool4:0x80@0",
        "XNAM*>=12 relation_{i}_faction=id@0 relation_{i}_modifier=i32@4 relation_{i}_reaction=enum32:FACT_REACTION@8",
    ],
    "RACE": [
        "DATA>=48 race_flags=h8@0 starting_health=f1@36 starting_magicka=f1@40 starting_stamina=f1@44", "DNAM>=4 default_hair=id?@0",
    ],
    "TERM": ["DNAM>=2 terminal_header=text@0", "BTXT*>=2 menu_item_{i}=text@0", "ITXT*>=2 item_text_{i}=text@0"],
    "AVIF": ["ANAM>=2 abbreviation=text@0", "AVFL>=4 default_value=f4@0", "DATA>=4 avif_flags=h8@0"],
    "ACTI": ["FNAM>=2 acti_flags=h4@0", "WNAM>=4 water_type=id?@0", "RNAM>=4 sound=id?@0", "[verb]"],
    "LSCR": ["NNAM>=2 loading_screen_nif=text@0", "ONAM>=12 rotation_min=f4@0 rotation_max=f4@4 zoom=f4@8"],
    "MESG": ["DNAM>=4 mesg_flags=h8@0 is_message_box=bool4:1@0", "TNAM>=4 display_time=u32@0", "[buttons]"],
    "FURN": ["FNAM>=2 furn_flags=h4@0", "WBDT>=2 bench_type=enum8:FURN_BENCH_TYPE@0 uses_skill=u8@1", "KNAM>=4 interact_keyword=id?@0"],
    "AACT": ["CNAM>=4 color=h8@0"],
    "STAT": ["DNAM>=4 max_angle=f2@0 leaf_amplitude=f4@4>=8 leaf_frequency=f4@8>=12"],
    "MSTT": ["DATA>=1 mstt_flags=h2@0 on_local_map=bool:1@0", "SNAM>=4 sound=id?@0"],
    "CELL": [
        "DATA>=2 cell_flags=h4@0 is_interior=bool2:1@0 has_water=bool2:2@0 public_area=bool2:0x20@0", "XCLC>=8 grid_x=i32@0 grid_y=i32@4",
        "XNAM>=4 water_height=f2@0", "XCMO>=4 music_type=id?@0",
    ],
    "WRLD": [
        "DNAM>=8 default_land_height=f2@0 default_water_height=f2@4", "MNAM>=16 usable_x=u32@0 usable_y=u32@4", "NAM0>=8 min_x=f2@0 min_y=f2@4",
        "NAM9>=8 max_x=f2@0 max_y=f2@4", "CNAM>=4 climate=id?@0", "WNAM>=4 water_type=id?@0",
    ],
    "LCTN": ["PNAM>=4 parent_location=id?@0", "LCEC>=4 encounter_zone=id?@0", "CNAM>=4 location_color=h8@0", "NAM1>=4 min_level=i32@0"],
    "REGN": [
        "RDMP>=2 map_name=text@0", "RDAT*>=8 region_data_{i}_type=enum32:REGN_DATA_TYPE@0 region_data_{i}_flags=h8@4", "[weathers]",
    ],
    "WTHR": [
        "DNAM>=24 fog_day_near=f2@0 fog_day_far=f2@4 fog_night_near=f2@8 fog_night_far=f2@12 fog_day_power=f4@16 fog_night_power=f4@20",
        "DATA>=19 wind_speed=u8@0 trans_delta=u8@4 sun_glare=u8@5 sun_damage=u8@6 precip_begin_fade_in=u8@7 precip_end_fade_out=u8@8",
        "[clouds]",
    ],
    "DIAL": [
        "DATA>=1 topic_flags=h2@0 topic_type=enum8:DIAL_TYPE@1>=2 topic_subtype=enum16:DIAL_SUBTYPE@2>=4", "SNAM>=4 branch=id?@0",
        "QNAM>=4 quest=id?@0",
    ],
    "INFO": ["ENAM>=2 info_flags=h4@0 hours_until_reset=u16?@2>=4", "NAM1>=2 response_text=text@0", "[response]"],
    "IDLE": ["DNAM>=2 animation_file=text@0", "ENAM>=2 animation_event=text@0", "ANAM>=4 parent_idle=id?@0"],
    "ENTM": ["BNAM>=2 entitlement_id=text@0", "DNAM>=4 price=u32@0 entm_flags=h8@4>=8", "INAM>=2 image_path=text@0"],
    "SCOL": ["ONAM*>=4 static_{i}_ref=id@0", "[placements]"],
    "EXPL": [
        "DATA>=40 light=id?@0 sound1=id?@4 sound2=id?@8 image_space_modifier=id?@12 force=f2@16 damage=f2@20 radius=f2@24 expl_flags=h8@36"
    ],
    "PROJ": [
        "DATA>=36 proj_flags=h8@0 proj_type=enum16:PROJ_TYPE@4 gravity=f4@8 speed=f2@12 range=f2@16 light=id?@20 muzzle_light=id?@24"
        " explosion=id?@28 sound=id?@32"
    ],
    "HAZD": [
        "DATA>=28 limit=u32@0 radius=f2@4 lifetime=f2@8 image_space_modifier=id?@12 hazd_flags=h8@16 spell=id?@20 light=id?@24"
    ],
    "WATR": [
        "DNAM>=16 opacity=f4@0 shallow_color_r=u8@4 shallow_color_g=u8@5 shallow_color_b=u8@6 deep_color_r=u8@8 deep_color_g=u8@9"
        " deep_color_b=u8@10",
        "ANAM>=4 fog_near_amount=f4@0", "FNAM>=1 watr_flags=h2@0", "SNAM>=4 damage_spell=id?@0",
    ],
    "CURV": ["JASF>=2 json_asset_file=text@0", "[curve]"],
    "CNCY": ["DURL>=2 display_name=text@0", "MXCT>=4 max_count=u32@0", "CRTY>=2 currency_type=u16@0", "FNAM>=4 cncy_flags=h8?@0"],
}
SPECS["LVLN"] = SPECS["LVLI"]
#: After the type's own fields, in every record.
UNIVERSAL = ["ICON>=2 icon=text@0", "MICO>=2 icon_small=text@0", "MODL>=2 model=text@0", "KWDA/4>=4 keyword_{i}=id@0"]


def text_of(data: bytes) -> str:
    """UTF-8 without trailing zero bytes; bad bytes are replaced."""
    return data.rstrip(b"\0").decode("utf-8", "replace")


def held_by(subs: Subrecords) -> Held:
    out: Held = {}
    for name, data in subs:
        out.setdefault(name, []).append(data)
    return out


def first(subs: Subrecords, name: str) -> bytes | None:
    return next((d for n, d in subs if n == name), None)


def _unsigned(data: bytes, at: int, size: int) -> int:
    return int.from_bytes(data[at : at + size], "little")


def _single(data: bytes, at: int, digits: int) -> str:
    return f"{struct.unpack_from('<f', data, at)[0]:.{digits}f}"


Shown = tuple[str, str]


@lru_cache(maxsize=None)
def reader(kind: str) -> Callable[[bytes, int], "Shown | None"]:
    """What reads one value of a kind at an offset: (text, field type), None if it isn't shown."""
    optional = kind.endswith("?")
    base, _, table = kind.rstrip("?").partition(":")
    if base == "text":
        return lambda data, at: (text_of(data), "str")
    if base[0] == "f":
        single, form = struct.Struct("<f").unpack_from, f"%.{base[1:]}f"
        return lambda data, at: (form % single(data, at), "float")
    if base == "i32":
        signed = struct.Struct("<i").unpack_from
        return lambda data, at: (str(signed(data, at)[0]), "int")
    if base.startswith("bool"):
        mask, size = int(table, 0) or -1, int(base[4:] or 1)
        return lambda data, at: (str(bool(_unsigned(data, at, size) & mask)), "str")
    if base.startswith("enum"):
        names, size = getattr(tables, table), int(base[4:]) // 8

        def chosen(data: bytes, at: int) -> Shown:
            number = _unsigned(data, at, size)
            return names.get(number, str(number)), "enum"

        return chosen
    size = {"id": 4, "u8": 1, "u16": 2, "u32": 4, "h2": 1, "h4": 2, "h8": 4}[base]
    form = "%d" if base[0] == "u" else f"0x%0{8 if base == 'id' else base[1:]}X"
    own = "int" if base[0] == "u" else "formid" if base == "id" else "flags"

    def number_of(data: bytes, at: int) -> Shown | None:
        number = _unsigned(data, at, size)
        return None if optional and not number else (form % number, own)

    return number_of


@lru_cache(maxsize=None)
def parsed(block: str):
    """(subrecord, mode, entry size, least size, [(name, kind, offset, least size)])."""
    head, *items = block.split()
    m = re.fullmatch(r"(\w+)(\*|/(\d+))?>=(\d+)", head)
    values = []
    for item in items:
        v = re.fullmatch(r"([^=]+)=([^@]+)@(\d+)(?:>=(\d+))?", item)
        values.append((v[1], v[2], int(v[3]), int(v[4] or 0)))
    return m[1], m[2] or "", int(m[3] or 0), int(m[4]), values


@lru_cache(maxsize=None)
def _compiled(block: str):
    name, mode, entry, least, values = parsed(block)
    return name, mode, entry, least, [(field, reader(kind), at, needed) for field, kind, at, needed in values]


def _block(block: str, held: Held) -> list[Triple]:
    name, mode, entry, least, values = _compiled(block)
    own = held.get(name)
    if own is None:
        return []
    if mode == "*":
        parts = [(i, d) for i, d in enumerate(own) if len(d) >= least]
    else:
        data = own[0]
        if len(data) < least:
            return []
        if not entry:
            return [(f, *shown) for f, read, at, needed in values if len(data) >= needed and (shown := read(data, at)) is not None]
        parts = [(i, data[i * entry : (i + 1) * entry]) for i in range(len(data) // entry)]
    return [
        (field.replace("{i}", str(i)), *shown)
        for i, data in parts
        for field, read, at, needed in values
        if len(data) >= needed and (shown := read(data, at)) is not None
    ]


def _effects(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    """Effects with their items, pairwise; an effect id cut short is left out."""
    ids, items = ([d for n, d in subs if n == name] for name in ("EFID", "EFIT"))
    out: list[Triple] = []
    for i, (own, item) in enumerate(zip(ids, items, strict=False)):
        if len(own) < 4:
            continue
        out.append((f"effect_{i}_id", f"0x{_unsigned(own, 0, 4):08X}", "formid"))
        if len(item) >= 12:
            out.append((f"effect_{i}_magnitude", _single(item, 0, 2), "float"))
            out.append((f"effect_{i}_area", str(_unsigned(item, 4, 4)), "int"))
            out.append((f"effect_{i}_duration", str(_unsigned(item, 8, 4)), "int"))
    return out


def _setting(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    data, name = first(subs, "DATA"), first(subs, "EDID")
    if data is None or len(data) < 4:
        return []
    match text_of(name or b"")[:1]:
        case "f":
            return [("value", _single(data, 0, 6), "float")]
        case "i" | "u":
            return [("value", *reader("i32")(data, 0))]
        case "s":
            return [("value", text_of(data), "str")]
        case "b":
            return [("value", str(bool(_unsigned(data, 0, 4))), "str")]
    return []


def _global(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    data = first(subs, "FNAM")
    if not data:
        return []
    return [("type", {"s": "short", "l": "long", "f": "float"}.get(chr(data[0]), f"0x{data[0]:02X}"), "str")]


def _modification(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    data = first(subs, "DATA")
    if data is None or len(data) < 2:
        return []
    out: list[Triple] = [("include_count", str(data[0]), "int"), ("property_count", str(data[1]), "int")]
    entry = (
        "value_type=enum8:OMOD_VALUE_TYPE@0 function_type=enum8:OMOD_FUNCTION_TYPE@1 keyword=id@4 value1=f4@8 value2=f4@12 step=f4@16"
    )
    for i in range(min(data[1], max(0, len(data) - 8) // 24)):
        own = [("DATA", data[8 + 24 * i : 32 + 24 * i])]
        out += [(f"prop_{i}_{name}", value, kind) for name, value, kind in _block(f"DATA>=24 {entry}", held_by(own))]
    return out


def _localized(name: str, sub: str) -> Callable[[Subrecords, Lookup], list[Triple]]:
    """A string id as its text, as hex where there is none."""

    def run(subs: Subrecords, look_up: Lookup) -> list[Triple]:
        data = first(subs, sub)
        number = _unsigned(data, 0, 4) if data is not None and len(data) >= 4 else 0
        return [(name, look_up(number) or f"0x{number:08X}", "str")] if number else []

    return run


def _response(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    n = sum(name == "CTDA" for name, _ in subs)
    return _localized("response_text_loc", "RNAM")(subs, look_up) + ([("condition_count", str(n), "int")] if n else [])


def _buttons(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    out = []
    for i, data in enumerate(d for n, d in subs if n == "ITXT"):
        if len(data) >= 4:
            number = _unsigned(data, 0, 4)
            text = look_up(number) if number else None
            if text or len(data) > 4:
                out.append((f"button_{i}", text or text_of(data), "str"))
    return out


def _weathers(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    found = _block("RDWT/12>=12 weather_{i}_id=id@0 weather_{i}_weight=u32@4", held_by(subs))
    none = {name.removesuffix("_id") for name, value, _ in found if value == "0x00000000" and name.endswith("_id")}
    return [x for x in found if x[0].rpartition("_")[0] not in none]


def _clouds(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    n = sum(len(name) == 4 and name.endswith("0TX") and len(d) > 1 for name, d in subs)
    return [("cloud_texture_count", str(n), "int")] if n else []


def _placements(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    n = sum(len(d) // 28 for name, d in subs if name == "DATA" and len(d) >= 28)
    return [("placement_count", str(n), "int")] if n else []


def _curve(subs: Subrecords, look_up: Lookup) -> list[Triple]:
    n = sum(name == "CRVE" for name, _ in subs)
    return [("curve_entry_count", str(n), "int")] if n else []


SPECIAL: dict[str, Callable[[Subrecords, Lookup], list[Triple]]] = {
    "effects": _effects, "setting": _setting, "global": _global, "modification": _modification,
    "verb": _localized("verb_override", "VNAM"), "buttons": _buttons, "weathers": _weathers, "clouds": _clouds,
    "response": _response, "placements": _placements, "curve": _curve,
}


def decode(record_type: str, subs: Subrecords, look_up: Lookup, functions: Functions) -> list[Triple]:
    """(field name, text, field type) of a record in order; of a name decoded twice
    the later value stays, at its later place."""
    held = held_by(subs)
    out: list[Triple] = []
    for block in [*SPECS.get(record_type, ()), *UNIVERSAL]:
        out += SPECIAL[block[1:-1]](subs, look_up) if block[0] == "[" else _block(block, held)
    if "CTDA" in held:
        out += condition_fields(subs, functions)
    last = {name: k for k, (name, _, _) in enumerate(out)}
    return out if len(last) == len(out) else [x for k, x in enumerate(out) if last[x[0]] == k]


#: Where string ids stand that decoding looks up: (record type, subrecord).
STRING_IDS = {("ACTI", "VNAM"), ("INFO", "RNAM"), ("MESG", "ITXT")}


def string_ids(record_type: str, subs: Subrecords) -> list[int]:
    """String ids that decoding this record looks up."""
    return [
        number
        for name, data in subs
        if (record_type, name) in STRING_IDS and len(data) >= 4 and (number := _unsigned(data, 0, 4))
    ]
