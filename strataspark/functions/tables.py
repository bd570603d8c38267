"""Code tables of record fields."""

from __future__ import annotations

# Texts of enumerated codes, by table.
WEAP_ANIMATION_TYPE = {
    0: "hand_to_hand", 1: "melee_1h", 2: "melee_2h", 3: "pistol_ballistic", 4: "pistol_automatic",
    5: "rifle_ballistic", 6: "rifle_automatic", 7: "shotgun", 8: "thrown", 9: "mine", 10: "bow",
    11: "crossbow", 12: "cryolator",
}
WEAP_SOUND_LEVEL = {0: "loud", 1: "normal", 2: "silent", 3: "very_loud"}
MGEF_ARCHETYPE = {
    0: "value_modifier", 1: "script", 2: "dispel", 3: "cure_disease", 4: "absorb", 5: "dual_value_modifier",
    6: "calm", 7: "demoralize", 8: "frenzy", 9: "disarm", 10: "command_summoned", 11: "invisibility",
    12: "light", 13: "darkness", 14: "nighteye", 15: "lock", 16: "open", 17: "bound_weapon",
    18: "summon_creature", 19: "detect_life", 20: "telekinesis", 21: "paralysis", 22: "reanimate",
    23: "soul_trap", 24: "turn_undead", 25: "guide", 26: "werewolf_feed", 27: "cure_paralysis",
    28: "cure_addiction", 29: "cure_poison", 30: "concussion", 31: "stimpak", 32: "accumulate_magnitude",
    33: "stagger", 34: "peak_value_modifier", 35: "cloak", 36: "werewolf", 37: "slow_time", 38: "rally",
    39: "enhance_weapon", 40: "spawn_hazard", 41: "etherealize", 42: "banish", 43: "spawn_scripted_ref",
    44: "disguise", 45: "grab_actor", 46: "vampire_lord",
}
CASTING_TYPE = {0: "constant_effect", 1: "fire_and_forget", 2: "concentration"}
TARGET_TYPE = {0: "self", 1: "touch", 2: "aimed", 3: "target_actor", 4: "target_location"}
SPEL_TYPE = {0: "spell", 1: "disease", 2: "power", 3: "lesser_power", 4: "ability", 5: "addiction"}
ENCH_TYPE = {6: "enchantment", 12: "staff_enchantment"}
OMOD_VALUE_TYPE = {0: "int", 1: "float", 2: "bool", 3: "formid_int", 4: "formid_float", 5: "enum"}
OMOD_FUNCTION_TYPE = {0: "set", 1: "mul_add", 2: "add"}
FACT_REACTION = {0: "neutral", 1: "enemy", 2: "ally", 3: "friend"}
QUST_TYPE = {
    0: "none", 1: "main_quest", 2: "side_quest", 3: "misc", 4: "daily", 5: "event", 6: "dungeon", 7: "challenge",
    8: "world_event",
}
FURN_BENCH_TYPE = {
    0: "none", 1: "create_object", 2: "smithing_armor", 3: "enchanting", 4: "alchemy", 5: "smithing_weapon",
    6: "power_armor",
}
DIAL_TYPE = {
    0: "topic", 1: "conversation", 2: "combat", 3: "persuasion", 4: "detection", 5: "service", 6: "misc",
    7: "scene_dialog",
}
DIAL_SUBTYPE = {
    0: "custom", 1: "force_greet", 2: "rumors", 3: "custom_2", 4: "call", 5: "follow", 6: "move", 7: "attack",
    8: "inspect", 9: "retrieve", 10: "stay", 11: "release", 12: "show_relationships", 13: "reject", 14: "heal",
    15: "assign", 16: "enter", 17: "custom_3", 18: "custom_4", 19: "custom_5",
}
REGN_DATA_TYPE = {2: "objects", 3: "weather", 4: "map", 5: "land", 6: "grass", 7: "sound", 8: "imposter"}
PROJ_TYPE = {1: "missile", 2: "lobber", 3: "beam", 4: "flame", 5: "cone", 6: "barrier", 7: "arrow"}

# Condition operators (three bits), run-on targets, parameter kinds and axes.
CONDITION_OPERATORS = {0: "==", 1: "!=", 2: ">", 3: ">=", 4: "<", 5: "<="}
CONDITION_RUN_ON = {
    0: "Subject", 1: "Target", 2: "Reference", 3: "CombatTarget", 4: "LinkedReference", 5: "QuestAlias",
    6: "PackageData", 7: "EventData", 8: "CommandTarget",
}
PARAMETER_KINDS = ("none", "string", "integer", "float", "formid", "actor_value", "axis")
AXES = {0: "X", 1: "Y", 2: "Z"}

# Record types of placements, which ingest skips, and the flag of packed records.
SKIPPED_TYPES = ("REFR", "NAVM", "ACHR", "PGRE", "PMIS", "PHZD", "PARW")
COMPRESSED_FLAG = 0x00040000

# Display names of record types.
TYPE_NAMES = {
    "AACT": "Action", "ACHR": "Placed NPC", "ACTI": "Activator", "ALCH": "Ingestible", "AMMO": "Ammunition",
    "ANIO": "Animated Object", "ARMA": "Armor Addon", "ARMO": "Armor", "ARTO": "Art Object", "ASPC": "Acoustic Space",
    "AVIF": "Actor Value", "BOOK": "Book/Note/Holotape", "CELL": "Cell", "CLAS": "Class", "CLMT": "Climate", "CNCY": "Currency",
    "COBJ": "Constructible Object", "COLL": "Collision Layer", "CONT": "Container", "CSTY": "Combat Style", "CURV": "Curve Table",
    "DIAL": "Dialog Topic", "DLBR": "Dialog Branch", "DMGT": "Damage Type", "DOOR": "Door", "ENCH": "Object Effect",
    "ENTM": "Entitlement", "EQUP": "Equip Type", "EXPL": "Explosion", "FACT": "Faction", "FLOR": "Flora", "FLST": "FormID List",
    "FURN": "Furniture", "GLOB": "Global", "GMST": "Game Setting", "GRAS": "Grass", "HAZD": "Hazard", "HDPT": "Head Part",
    "IDLE": "Idle Animation", "IDLM": "Idle Marker", "IMAD": "Image Space Adapter", "IMGS": "Image Space", "INFO": "Dialog Response",
    "INGR": "Ingredient", "IPCT": "Impact", "IPDS": "Impact Data Set", "KEYM": "Key", "KYWD": "Keyword", "LAYR": "Layer",
    "LCRT": "Location Ref Type", "LCTN": "Location", "LENS": "Lens Flare", "LGTM": "Lighting Template", "LIGH": "Light",
    "LSCR": "Load Screen", "LTEX": "Landscape Texture", "LVLI": "Leveled Item", "LVLN": "Leveled NPC", "MATT": "Material Type",
    "MESG": "Message", "MGEF": "Magic Effect", "MISC": "Misc Item", "MOVT": "Movement Type", "MSTT": "Moveable Static",
    "MUSC": "Music Type", "MUST": "Music Track", "NAVM": "Navmesh", "NOTE": "Note", "NPC_": "Non-Player Character",
    "OMOD": "Object Modification", "OTFT": "Outfit", "PACK": "Package", "PERK": "Perk", "PKIN": "Pack-In", "PROJ": "Projectile",
    "QUST": "Quest", "RACE": "Race", "REFR": "Placed Object", "REGN": "Region", "RELA": "Relationship", "REVB": "Reverb Parameters",
    "RFGP": "Reference Group", "SCEN": "Scene", "SCOL": "Static Collection", "SMBN": "Story Manager Branch Node",
    "SMQN": "Story Manager Quest Node", "SNCT": "Sound Category", "SNDR": "Sound Descriptor", "SOPM": "Sound Output Model",
    "SOUN": "Sound Marker", "SPEL": "Spell", "STAT": "Static", "TACT": "Talking Activator", "TERM": "Terminal", "TRNS": "Transform",
    "TXST": "Texture Set", "VTYP": "Voice Type", "WATR": "Water", "WEAP": "Weapon", "WRLD": "Worldspace", "WTHR": "Weather",
}
