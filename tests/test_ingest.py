"""Ingest, store and the queries over a real snapshot, with small built files."""

from __future__ import annotations

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from strataspark import ingest as ing
from strataspark.functions.decoders import decode
from strataspark.operators import diff, lookups, refs, tree, unreleased
from strataspark.operators.search import search_records
from strataspark.sources import builders
from strataspark.sources.archives import by_path, contents, containing, list_archive, matching, read_strings, sequence
from strataspark.sources.media import counters, extract_icons, extract_scripts, extract_sounds
from strataspark.sources.recfile import read_records
from strataspark.store import SnapshotStore

STRINGS = {1: "Iron sword", 2: "Überlong text", 3: ""}


def lvlo(ref, level=1, count=1):
    return ("LVLO", struct.pack("<HHIHH", level, 0, ref, count, 0))


def records(weight=1.5, extra=True):
    rows = [
        ("MISC", 0x10, [("EDID", b"ATX_Thing\0"), ("FULL", struct.pack("<I", 1)), ("DATA", struct.pack("<if", 5, weight))], False),
        ("MISC", 0x11, [("EDID", b"zzz_old\0"), ("DATA", struct.pack("<if", 5, 0.25)), ("KWDA", struct.pack("<II", 0x30, 0x99))], True),
        ("MISC", 0x10, [("EDID", b"ATX_Thing\0"), ("FULL", struct.pack("<I", 1)), ("DATA", struct.pack("<if", 6, weight))], False),
        ("KYWD", 0x30, [("EDID", b"KeyWord\0"), ("DESC", struct.pack("<I", 2))], False),
        ("LVLI", 0x40, [("EDID", b"ListA\0"), ("LVLD", b"\x0a"), ("LVLF", b"\x04"), lvlo(0x10, 2, 3), lvlo(0x41), lvlo(0x40), lvlo(0x41)], False),
        ("LVLI", 0x41, [("EDID", b"ListB\0"), lvlo(0x11), lvlo(0x7777)], False),
        ("ACTI", 0x50, [("VNAM", struct.pack("<I", 2))], False),
    ]
    return rows + ([("QUST", 0x60, [("EDID", b"atx_quest\0")], False)] if extra else [])


def write(path, rows):
    kinds = {}
    for k, i, s, c in rows:
        kinds.setdefault(k, []).append(builders.record(k, i, s, compressed=c))
    path.write_bytes(builders.record_file([builders.group(k.encode(), r) for k, r in kinds.items()]))
    return str(path)


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("game")
    archive = folder / "World - Localization.ba2"
    archive.write_bytes(
        builders.general_archive(
            [
                ("strings/world_en.strings", builders.string_file({1: "other", 2: STRINGS[2]}), True),
                ("strings/world_en.dlstrings", builders.string_file({3: "x"}, True), False),
                ("strings/nw_en.strings", builders.string_file({1: STRINGS[1], 3: ""}), False),
            ]
        )
    )
    strings = read_strings(spark, str(archive), "World")
    store = SnapshotStore(spark, str(folder / "store"))
    one = ing.ingest(spark, store, write(folder / "a.esm", records()), strings, "one", full=True)
    two = ing.ingest(spark, store, write(folder / "b.esm", records(weight=2.5, extra=False)), strings, "two")
    return store, one, two, folder, strings


def test_strings_later_files_win(world):
    rows = {r["string_id"]: (r["text"], r["source"]) for r in world[4].collect()}
    assert {k: t for k, (t, _) in rows.items()} == STRINGS and rows[1][1] == "strings/nw_en.strings"


def test_records_match_a_plain_reading(world):
    store, one, *_ = world
    got = {r["form_id"]: r for r in store.records(one).collect()}
    assert len(got) == 7
    sword = got[0x10]
    assert (sword["editor_id"], sword["full_name"], sword["full_name_id"], sword["desc_text"]) == ("ATX_Thing", "Iron sword", 1, None)
    subs = records()[2][2]
    digest = hashlib.sha256(b"".join(n.encode() + struct.pack("<H", len(d)) + d for n, d in subs)).hexdigest()
    assert sword["data_hash"] == digest  # of two records with one id the last stays
    assert got[0x30]["desc_text"] == STRINGS[2] and got[0x50]["editor_id"] is None
    assert store.keywords(one).select("form_id").collect()[0][0] == 0x30


def test_fields_match_the_decoder(world):
    store, one, *_ = world
    for kind, i, subs, _ in records()[1:]:
        want = decode(kind, subs, STRINGS.get, {})
        got = [(r["field_name"], r["field_value"], r["field_type"]) for r in lookups.fields_of(store.fields(one), i).collect()]
        assert got == want


def test_snapshot_rows_and_subrecords(world):
    store, one, two, *_ = world
    rows = lookups.list_snapshots(store.snapshots).collect()
    assert [(r["id"], r["label"], r["record_count"], r["string_count"], r["has_subrecords"]) for r in rows] == [(one, "one", 8, 3, True), (two, "two", 7, 3, False)]
    assert store.two_latest() == (one, two) and store.size() > 0
    subs = store.table("subrecords", one)
    assert subs.count() == sum(len(s) for _, _, s, _ in records()) and store.table("subrecords", two).count() == 0


def test_diff_of_the_two(world):
    store, one, two, *_ = world
    changes = diff.diff_records(store.records(one), store.records(two))
    assert {(r["form_id"], r["change_type"]) for r in changes.collect()} == {(0x10, "modified"), (0x60, "removed")}
    changed = diff.diff_fields(changes, store.fields(one), store.fields(two)).collect()
    assert [(r["field_name"], r["old_value"], r["new_value"]) for r in changed] == [("weight", "1.50", "2.50")]
    back = diff.diff_records(store.records(two), store.records(one))
    assert {(r["form_id"], r["change_type"]) for r in back.collect()} == {(0x10, "modified"), (0x60, "added")}
    assert diff.diff_records(store.records(one), store.records(one)).count() == 0
    diff_id = store.save_diff(one, two, changes)
    assert store.diffs().where(F.col("id") == diff_id).first()["removed_count"] == 1
    assert store.diff_entries().count() == 2


def test_search_refs_and_heuristics(world):
    store, one, *_ = world
    rec, fld = store.records(one), store.fields(one)
    ids = lambda df: [r["form_id"] for r in df.collect()]
    assert ids(search_records(rec, "SWORD")) == [0x10]
    assert ids(search_records(rec, "0x41")) == [0x41] and ids(search_records(rec, "65")) == [0x41]
    assert ids(search_records(rec, editor_id="list?")) == [0x40, 0x41]
    assert ids(search_records(rec, "Word", record_type="KYWD")) == [0x30]
    shown = refs.resolve_fields(fld, rec).where("form_id = 17 AND field_name LIKE 'keyword%'").orderBy("ordinal").collect()
    assert [r["display"] for r in shown] == ["0x00000030 (KeyWord)", "0x00000099"]
    found = unreleased.find_unreleased(rec).groupBy("category").count().collect()
    # the largest id is the quest's; atx_ counts as the prefix does
    assert {r["category"]: r["count"] for r in found} == {unreleased.SHOP: 2, unreleased.CUT: 1, unreleased.HIGH: 1, unreleased.QUESTS: 1}


def test_tree(world):
    store, one, *_ = world
    root = lambda i: store.spark.createDataFrame([(i,)], "root long")
    made = tree.lines(store.records(one), store.fields(one), root(0x40)).orderBy("seq").collect()
    assert [r["line"] for r in made] == [
        "ListA (0x00000040) [LVLI]", "  Chance None: 10%  Use All: True",
        "  - Iron sword x3 (lvl 2) [MISC] 0x00000010", "  - ListB (lvl 1) [LVLI] 0x00000041",
        "    - zzz_old (lvl 1) [MISC] 0x00000011", "    - 0x00007777 (lvl 1)  0x00007777",
        "  - ListA (lvl 1) [LVLI] 0x00000040", "  - ListB (lvl 1) [LVLI] 0x00000041",
    ]
    assert tree.lines(store.records(one), store.fields(one), root(0x10)).count() == 0
    flat = tree.expand(store.records(one), store.fields(one), root(0x40), max_depth=0).collect()
    assert {r["depth"] for r in flat} == {1} and len(flat) == 4


def test_source_pushes_types_down(spark, world):
    path = str(world[3] / "a.esm")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        rows = read_records(spark, path, target_bytes=64).where("record_type = 'LVLI'")
        assert [r["form_id"] for r in rows.orderBy("ordinal").collect()] == [0x40, 0x41]
        assert read_records(spark, path, skip_types=("MISC", "LVLI")).count() == 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_many_files_are_one_scan(spark, world, tmp_path):
    paths = []
    for i in range(300):
        made = [builders.record("MISC", 10 * i + k, [("EDID", b"x\0")]) for k in range(i % 3)]
        paths.append(str(tmp_path / f"{i:03d} ,\u00e9\".esm"))
        (tmp_path / paths[-1]).write_bytes(builders.record_file([builders.group(b"MISC", made)] if made else []))
    rows = read_records(spark, paths)
    assert sorted(r["form_id"] for r in rows.collect()) == [10 * i + k for i in range(300) for k in range(i % 3)]
    assert rows.rdd.getNumPartitions() < 10 and "Union" not in rows._jdf.queryExecution().executedPlan().toString()
    assert read_records(spark, paths[:9], target_bytes=1).rdd.getNumPartitions() > 3
    both = read_records(spark, [str(world[3] / "a.esm")] * 2, target_bytes=64)
    assert sorted(both.collect()) == sorted(read_records(spark, str(world[3] / "a.esm")).collect() * 2)
    with pytest.raises(Exception, match="no TES4"):
        (tmp_path / "none.esm").write_bytes(b"nothing")
        read_records(spark, [*paths[:2], str(tmp_path / "none.esm")]).collect()


def test_a_file_without_wanted_records_is_empty(spark, tmp_path):
    path = str(tmp_path / "refr.esm")
    (tmp_path / "refr.esm").write_bytes(builders.record_file([builders.group(b"REFR", [builders.record("REFR", 1, [])])]))
    assert read_records(spark, path).collect() == [] == read_records(spark, [path, path]).collect()
    assert read_records(spark, path, skip_types=()).count() == 1


def test_archives_and_media(spark, tmp_path):
    fuz = b"FUZE" + struct.pack("<II", 1, 3) + b"lipAUDIO"
    files = [
        ("sound/A.FUZ", fuz, True), ("sound/b.xwm", b"xwm", False), ("sound/c.wav", b"wav", False), ("scripts/../../up.pex", b"pex", False),
        ("sound/bad.fuz", b"no", False), ("textures/interface/workshopicons/00000010.dds", b"dds", False),
    ]
    path, broken = tmp_path / "m.ba2", tmp_path / "broken.ba2"
    path.write_bytes(builders.general_archive(files))
    broken.write_bytes(b"nothing")
    entries = list_archive(spark, str(path), str(broken), strict=False)
    assert entries.count() == 6
    with pytest.raises(ValueError):
        list_archive(spark, str(broken))
    assert [r["name"] for r in containing(entries, "SOUND/").collect()] == ["sound/A.FUZ", "sound/b.xwm", "sound/c.wav", "sound/bad.fuz"]
    assert contents(by_path(entries, "SOUND\\C.wav")).first()["content"] == b"wav"
    assert matching(entries, (".wav", ".xwm"), "*/b.*").count() == 1 and matching(entries, (".wav", ".xwm"), "sound").count() == 2
    out = tmp_path / "out"
    status = extract_sounds(entries, str(out), convert=False)
    assert counters(status) == {"found": 4, "extracted": 3, "converted": 0, "errors": 1}
    assert (out / "sound/A.xwm").read_bytes() == b"AUDIO"
    assert counters(extract_scripts(entries, str(out)))["extracted"] == 1 and not (tmp_path / "up.pex").exists()
    ids = spark.createDataFrame([(0x10,), (0x11,)], "form_id long")
    icons = {r["form_id"]: r["path"] for r in extract_icons(ids, entries, str(out)).collect()}
    assert icons[0x11] is None  # 0x10 needs an image library
    seq = tmp_path / "x.seq"
    seq.write_bytes(struct.pack("<II", 0x11, 0x10) + b"z")
    rows = spark.createDataFrame([(0x10, "", "Name")], "form_id long, full_name string, editor_id string")
    named = refs.sequence_names(sequence(spark, str(seq)), rows).orderBy("pos").collect()
    assert [(r["form_id"], r["name"]) for r in named] == [(0x11, ""), (0x10, "Name")]


def test_retention(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    assert store.latest_id() is None and store.two_latest() == (None, None) and store.purge(5) == 0 and store.clear() == 0
    path = write(tmp_path / "a.esm", records())
    none = spark.createDataFrame([], "string_id long, text string, source string")
    ids = [ing.ingest(spark, store, path, none, f"s{i}") for i in range(3)]
    assert ids == [1, 2, 3]
    with pytest.raises(ValueError):
        store.purge(-1)
    assert store.purge(2) == 1 and store.records(1).count() == 0 and store.records(2).count() == 7
    assert ing.ingest(spark, store, path, none) == 4
    assert store.clear() == 3 and store.snapshots.count() == 0


def test_content_hash_takes_any_bytes(spark):
    from hashlib import sha256

    from strataspark.ingest import content_hash
    from strataspark.model import SUBRECORD

    rows = [(1, [("DATA", 256, bytes(range(256))), ("FULL", 3, b"\xff\xfe\x00"), ("EDID", 0, b"")]), (2, []), (3, [("BIG_", 65_535, b"\x80" * 65_535)])]
    got = {r["k"]: r["h"] for r in spark.createDataFrame(rows, f"k int, s array<{SUBRECORD}>").select("k", content_hash(F.col("s")).alias("h")).collect()}
    assert got == {k: sha256(b"".join(n.encode() + len(d).to_bytes(2, "little") + d for n, _, d in subs)).hexdigest() for k, subs in rows}
