"""Binary formats: readers against the builders, damaged input, random round trips."""

from __future__ import annotations

import io
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataspark.sources import binary, builders

SKIP = binary.SKIPPED
names = st.text("ABCDEFGHIJ", min_size=4, max_size=4)
subs = st.lists(st.tuples(names, st.binary(max_size=40)), max_size=5)


def parse(data: bytes, target: int = 1 << 20, skipped=SKIP, wanted=None):
    f = io.BytesIO(data)
    out = []
    for a, b in binary.plan_ranges(f, skipped, target, wanted):
        f.seek(a)
        out += binary.records_in(f.read(b - a), a, skipped, wanted)
    return out


@settings(max_examples=60, deadline=None)
@given(
    st.lists(st.lists(st.tuples(st.sampled_from(["WEAP", "ARMO"]), st.integers(1, 2**32 - 1), subs, st.booleans()), max_size=6), max_size=4),
    st.integers(24, 300),
)
def test_file_round_trip_for_any_partition_size(groups, target):
    data = builders.record_file(
        [builders.group(b"WEAP", [builders.record(k, i, s, compressed=c) for k, i, s, c in g]) for g in groups], b"head"
    )
    got = [(r.kind, r.form_id, r.subrecords) for r in parse(data, target)]
    assert got == [(k, i, s) for g in groups for k, i, s, _ in g]
    assert [r.at for r in parse(data, target)] == sorted(r.at for r in parse(data, target))


def test_nested_groups_descend_but_for_placements():
    rec = lambda i: builders.record("MISC", i, [])
    inner = builders.group(b"\1\0\0\0", [rec(2), builders.group(b"\2\0\0\0", [rec(3)], 8), builders.group(b"\2\0\0\0", [rec(4)], 9)], 6)
    data = builders.record_file([builders.group(b"CELL", [rec(1), inner, rec(5)])])
    for target in (24, 60, 1 << 20):
        assert [r.form_id for r in parse(data, target)] == [1, 2, 5]


def test_skipped_types_and_truncation():
    skipped = builders.group(b"REFR", [builders.record("MISC", 9, [])])
    mixed = builders.group(b"MISC", [builders.record("REFR", 1, []), builders.record("MISC", 2, [("DATA", b"12345678")])])
    data = builders.record_file([skipped, mixed])
    assert [r.form_id for r in parse(data)] == [2]
    assert [r.form_id for r in parse(data, skipped=frozenset())] == [9, 1, 2]
    assert parse(data[:-3]) == []
    assert [r.form_id for r in parse(data, wanted=frozenset({"MISC"}))] == [2]
    with pytest.raises(ValueError):
        parse(b"GRUP" + bytes(40))


def test_bad_compression_and_overrunning_subrecord():
    bad = bytearray(builders.record("MISC", 1, [("DATA", b"x" * 50)], compressed=True))
    bad[30] ^= 0xFF
    short = struct.pack("<4sIIIIHH", b"MISC", 2, 0x40000, 2, 0, 0, 0) + b"ab"
    good = builders.record("MISC", 3, [("EDID", b"a\0")])
    over = struct.pack("<4sIIIIHH", b"MISC", 15, 0, 4, 0, 0, 0) + builders.subrecord("EDID", b"b\0") + b"DATA\xff\0" + b"z"
    data = builders.record_file([builders.group(b"MISC", [bytes(bad), short, good, over])])
    got = parse(data)
    assert [(r.form_id, r.subrecords) for r in got] == [(3, [("EDID", b"a\0")]), (4, [("EDID", b"b\0")])]


def test_archives():
    files = [("Strings\\A.strings", b"one" * 50, True), ("b.bin", b"raw", False), ("empty", b"", False)]
    f = io.BytesIO(builders.general_archive(files))
    entries = binary.archive_entries(f)
    assert [e.name for e in entries] == ["Strings/A.strings", "b.bin", "empty"]
    assert [binary.extract(f, e) for e in entries] == [c for _, c, _ in files]
    with pytest.raises(ValueError):
        binary.archive_entries(io.BytesIO(b"nothing here, nothing at all"))


@pytest.mark.parametrize(("form", "code", "size"), [(71, b"DXT1", 8 * 4 * 2), (98, b"DX10", 16 * 4 * 2), (28, b"DX10", 4 * 16 * 8)])
def test_textures(form, code, size):
    chunks = [(b"a" * size, True, 0, 0), (b"b" * 10, False, 1, 3)]
    f = io.BytesIO(builders.texture_archive([{"name": "T\\X.DDS", "height": 8, "width": 16, "mips": 4, "format": form, "chunks": chunks}]))
    (e,) = binary.archive_entries(f)
    assert (e.name, e.height, e.width, e.mips) == ("t/x.dds", 8, 16, 4)
    assert binary.first_level_size(16, 8, form) == size
    whole = binary.texture_file(e, binary.extract_chunks(f, e))
    head = 4 + 124 + (20 if code == b"DX10" else 0)
    assert whole[:4] == b"DDS " and whole[84:88] == code and whole[head:] == b"a" * size + b"b" * 10
    assert struct.unpack_from("<7I", whole, 4)[2:4] == (8, 16) and struct.unpack_from("<I", whole, 4 + 28) == (4,)
    first = binary.texture_file(e, [b"a" * size + b"more"], first_only=True)
    assert first[head:] == b"a" * size and struct.unpack_from("<I", first, 4 + 28) == (1,)


@given(st.dictionaries(st.integers(0, 2**32 - 1), st.text(st.characters(exclude_characters="\0", exclude_categories=["Cs"])), max_size=8), st.booleans())
def test_string_files(texts, prefixed):
    data = builders.string_file(texts, prefixed)
    assert binary.string_file(data, prefixed) == {k: t for k, t in texts.items()}
    assert binary.string_file(b"1234567", prefixed) == {}


def test_small_formats():
    assert binary.sequence_ids(struct.pack("<II", 7, 2**32 - 1) + b"xy") == [7, 2**32 - 1]
    fuz = b"FUZE" + struct.pack("<II", 1, 3) + b"lip" + b"audio"
    assert binary.voice_audio(fuz) == b"audio"
    assert binary.voice_audio(fuz[:14]) is None and binary.voice_audio(b"RIFF" + bytes(20)) is None
    pex = b"\xfa\x57\xc0\xde\3\x09" + struct.pack("<HQ", 4, 123) + b"".join(struct.pack("<H", len(s)) + s for s in (b"a.psc", b"me", b"pc"))
    head = binary.script_header(pex)
    assert head["source_file"] == "a.psc" and head["user_name"] == "me" and head["machine_name"] == "pc" and head["compilation_time"] == 123
    assert binary.script_header(b"x" * 20) is None
    bgsm = b"BGSM" + bytes(56) + struct.pack("<I", 10) + b"t/tex.dds\0" + bytes(10)
    assert binary.material_texture(bgsm) == "t/tex.dds" and binary.material_texture(b"BGSM") is None
    head = b"A model file\n" + struct.pack("<IBIII", 0x14020007, 1, 12, 2, 155) + b"\1a" * 3 + b"\1b" * 3 + b"\0\0"
    nif = head + struct.pack("<H", 1) + struct.pack("<I", 4) + b"Node" + bytes(2 * 2 + 4 * 2)
    nif += struct.pack("<II", 2, 30) + struct.pack("<I", 9) + b"m\\x.BGSM\0"[:8] + b"s" + struct.pack("<I", 3) + b"abc"
    assert binary.model_materials(nif) == [] and binary.model_materials(b"none") == []
    nif = nif.replace(b"m\\x.BGSMs", b"mm\\x.BGSM")
    assert binary.model_materials(nif) == ["mm/x.BGSM"]
