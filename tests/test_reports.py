"""Renderers, exports, command line, profiles and streaming, over a small world."""

from __future__ import annotations

import json
import struct

import pytest

from strataspark import cli, profiles
from strataspark.reports import render
from strataspark.reports.render import Category, Diff, Item, Link
from strataspark.sources import builders


def sample() -> Diff:
    a = Item(0x10, "WEAP", "NewGun", "Gun <1>", fields=[("weight", "1.50"), ("owner", "0x00000020 (Bob)")], refers=[Link("owner", 0x20, "Bob")])
    r = Item(0x20, "NPC_", None, None, referred=[Link("owner", 0x10, "Gun <1>")])
    m = Item(0x30, "MISC", "Cup", None, changes=[("value", "1", "2"), ("model", None, "m.nif")])
    h = Item(0x31, "ARMO", "Hat", "Hat")
    return Diff(1, 2, "old", "new", [a], [r], [m, h])


def test_diff_text():
    assert render.diff_text(sample()) == "\n".join(
        [
            "Diff: #1 (old) -> #2 (new)", "Added: 1  Removed: 1  Modified: 2", "",
            "=== ADDED (1) ===", f"  + 0x00000010  WEAP    {'NewGun':<40}  Gun <1>", "      weight: 1.50", "      owner: 0x00000020 (Bob)",
            "      → references: Bob (0x00000020) via owner", "",
            "=== REMOVED (1) ===", f"  - 0x00000020  NPC_    {'':<40}  ", "      ← referenced by: Gun <1> (0x00000010) via owner", "",
            "=== MODIFIED (2) ===", "  ~ 0x00000030  MISC    Cup", "      value: 1 -> 2", "      model: (none) -> m.nif", "  ~ 0x00000031  ARMO    Hat",
        ]
    )


def test_diff_json():
    data = json.loads(render.diff_json(sample()))
    assert list(data) == ["added", "removed", "modified", "summary"] and data["summary"] == {"added": 1, "removed": 1, "modified": 2}
    assert data["added"][0] == {
        "form_id": "0x00000010", "type": "WEAP", "editor_id": "NewGun", "name": "Gun <1>", "fields": {"weight": "1.50", "owner": "0x00000020 (Bob)"},
        "references": [{"field": "owner", "target": "0x00000020", "name": "Bob"}],
    }
    assert "fields" not in data["removed"][0] and data["removed"][0]["name"] is None
    assert data["modified"][0]["changes"][1] == {"field": "model", "old": None, "new": "m.nif"} and data["modified"][1]["changes"] == []


def test_diff_markdown_and_icons():
    d = sample()
    lines = render.diff_markdown(d).split("\n")
    assert lines[:8] == ["# Diff: old -> new", "", "| Metric | Count |", "|--------|-------|", "| Added | 1 |", "| Removed | 1 |", "| Modified | 2 |", ""]
    assert "| 0x00000010 | WEAP | NewGun | Gun <1> |" in lines and "- → `owner` → Bob (`0x00000020`)" in lines
    assert "### Bob (0x00000020)" not in lines  # removed records without fields have no detail
    assert "| model |  | m.nif |" in lines and "### Cup (0x00000030)" in lines
    d.added[0].icon = d.modified[0].icon = "icons/x.png"
    lines = render.diff_markdown(d, icons=True).split("\n")
    assert "| ![icon](icons/x.png) | 0x00000010 | WEAP | NewGun | Gun <1> |" in lines and "### Cup (0x00000030) ![icon](icons/x.png)" in lines
    assert "|------|--------|------|-----------|------|" in lines


def test_html_pages():
    d = sample()
    html = render.diff_html(d)
    assert html.startswith("<!DOCTYPE html>") and html.endswith("</html>") and "Gun &lt;1&gt;" in html and "Gun <1>" not in html
    assert html.count('data-hash-only="1"') == 1 and "badge-weap" in html and "1 ref)" in html and "2 fields)" in html
    d.added[0].icon = "icons/x.png"
    assert 'data-full="icons/full/x.png"' in render.diff_html(d)
    items = [Item(i, "ZZZZ", f"e{i}") for i in range(3)]
    assert "Showing 3 of 9 records." in render.export_html(items, 9) and "Showing" not in render.export_html(items, 3)
    assert "<td>e1</td>" in render.search_html(items) and "badge-default" in render.search_html(items)
    categories = [Category("A B", 9, items)]
    assert 'id="cat-a-b"' in render.unreleased_html(categories)
    assert render.unreleased_text(categories).endswith("  ... and 6 more") and "| A B | 9 |" in render.unreleased_markdown(categories)


@pytest.fixture(scope="module")
def game(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")

    def write(name, weight, extra):
        misc = [
            builders.record("MISC", 0x10, [("EDID", b"ATX_Cup\0"), ("FULL", struct.pack("<I", 1)), ("DATA", struct.pack("<if", 5, weight)), ("KWDA", struct.pack("<I", 0x30))]),
            builders.record("MISC", 0x11, [("EDID", b"Plain\0")]),
        ]
        groups = [builders.group(b"MISC", misc), builders.group(b"KYWD", [builders.record("KYWD", 0x30, [("EDID", b'Key "word"\0')])])]
        groups += [builders.group(b"LVLI", [builders.record("LVLI", 0x40, [("LVLO", struct.pack("<HHIHH", 1, 0, 0x10, 1, 0))])])] if extra else []
        (folder / name).write_bytes(builders.record_file(groups))

    write("World.esm", 1.5, False)
    texts = builders.string_file({1: "Golden Cup, old", 2: "x" * 150})
    (folder / "World - Localization.ba2").write_bytes(builders.general_archive([("strings/world_en.strings", texts, True)]))
    (folder / "World.seq").write_bytes(struct.pack("<II", 0x10, 0x99))
    return folder, write


def test_commands(spark, game, tmp_path, monkeypatch):
    folder, write = game
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    said: list[str] = []
    answers: list[str] = []

    def run(*args, code=0):
        said.clear()
        assert cli.main(list(args), spark, said.append, lambda _: answers.pop(0)) == code, said
        return "\n".join(said)

    assert "Which record file?" in run("list", code=2)
    answers[:] = ["bad name", "main", str(folder / "World.esm"), "", "main"]
    assert "Saved" in run("init")
    assert "No snapshots found." in run("list", code=2)
    assert "Snapshot #1: first, 3 records, 2 strings." in run("snapshot", "-l", "first")
    answers[:] = ["n"]
    run("snapshot", "-l", "again")
    assert run("diff") == ""  # same file: not confirmed
    write("World.esm", 2.5, True)
    run("snapshot", "-l", "second", "--full")
    assert "second" in run("list")
    text = run("diff")
    assert "Added: 1  Removed: 0  Modified: 1" in text and "weight: 1.50 -> 2.50" in text
    assert "referenced by" in text  # the new list holds the changed cup
    out = tmp_path / "d.html"
    assert "Diff written" in run("diff", "--old", "1", "--new", "3", "--format", "html", "-o", str(out)) and "hash only" not in out.read_text()
    assert "Two snapshots" not in run("diff", "--format", "json", "--type", "KYWD")
    assert "1 records" in run("search", "golden") and "keyword_0: 0x00000030 (Key \"word\")" in run("search", "golden")
    assert "No records" in run("search", "nothing")
    assert "# Search Results (1 records)" in run("search", "cup", "--format", "markdown")
    shown = run("show", "0x40", "--expand")
    assert "Type:       LVLI" in shown and "- Golden Cup, old (lvl 1) [MISC] 0x00000010" in shown
    assert "Invalid" in run("show", "zz", code=2) and "not found" in run("show", "77", code=2)
    assert "Atomic Shop (ATX_) (1 items)" in run("unreleased")
    assert "MISC             2" in run("stats")
    assert f"0x00000002: {'x' * 100}..." in run("strings", "search", "xxx")
    csv_all, csv_typed = run("export", "--format", "csv"), run("export", "--format", "csv", "--type", "MISC")
    assert '0x00000030,KYWD,"Key ""word""",,,0,' in csv_all and '0x00000010,MISC,ATX_Cup,"Golden Cup, old",,0x00000000,' in csv_typed
    data = json.loads(run("export", "--format", "json"))
    assert [x["form_id"] for x in data] == ["0x00000030", "0x00000040", "0x00000010", "0x00000011"] and data[2]["fields"]["weight"] == "2.50"
    assert "Total: 2 records" in run("export", "--format", "markdown", "--type", "MISC")
    assert "Export: All Records" in run("export", "--format", "html")
    assert "0x00000010  Golden Cup, old" in run("seq") and "0x00000099  " in run("seq")
    assert "0 files" in run("sounds", "--list-only") and "Found: 0" in run("scripts", "-o", str(tmp_path))
    assert "Deleted 1 old snapshot(s). Kept 2 most recent." in run("purge", "--keep", "2")
    assert "Nothing to purge." in run("purge", "--keep", "2")
    answers[:] = ["y"]
    assert "Deleted 2 snapshot(s)." in run("clear") and "already empty" in run("clear")


def test_profiles(tmp_path):
    path = tmp_path / "below" / "c.toml"
    file = tmp_path / "a\\b.esm"
    own = profiles.Profiles({"one": file, "two": tmp_path / "x"}, "one")
    own.write(path)
    assert profiles.Profiles.read(path) == own and profiles.Profiles.read(tmp_path / "none") == profiles.Profiles()
    for missing in ({}, {"name": "two"}, {"name": "none"}, {"file": tmp_path / "y"}):
        with pytest.raises(profiles.UsageError):
            own.choose(**missing)
    with pytest.raises(profiles.UsageError):
        profiles.Profiles().choose()
    file.write_bytes(b"")
    assert own.choose() == own.choose(name="one") == own.choose(file, "none") == file and own.label(file) == "one"
    assert own.label(tmp_path / "Other.esm") == "other"
    assert own.may_be_called("a-B_1") and not own.may_be_called("a b") and not own.may_be_called("")


def test_companions_beside_a_record_file(tmp_path):
    file = tmp_path / "World.esm"
    for name in ("Sounds02", "Sounds10", "Sounds11", "Startup", "B UpdateMain", "00UpdateMain1", "Meshes", "WorkshopIcons"):
        (tmp_path / f"World - {name}.ba2").write_bytes(b"")
    (tmp_path / "Other - Sounds01.ba2").write_bytes(b"")
    names = lambda holding: [p.stem.removeprefix("World - ") for p in profiles.companions(file, holding)]
    assert names("sounds") == ["Sounds02", "Sounds10"] and names("textures") == [] and names("icons") == ["WorkshopIcons"]
    assert names("scripts") == ["Startup", "00UpdateMain1", "B UpdateMain"] and names("meshes") == ["Meshes", "00UpdateMain1", "B UpdateMain"]
    assert names("strings") == [] and profiles.strings_archive(file).name == "World - Localization.ba2"


def test_streaming_landing(spark, game, tmp_path):
    from strataspark.store import SnapshotStore
    from strataspark.streaming.landing import watch

    folder, write = game
    landing = tmp_path / "landing"
    landing.mkdir()
    store = SnapshotStore(spark, str(tmp_path / "store"))
    none = spark.createDataFrame([], "string_id long, text string, source string")
    for n in (1, 2):
        write("tmp.esm", float(n), n == 2)
        (folder / "tmp.esm").rename(landing / f"{n}.esm")
        watch(spark, str(landing), store, none, str(tmp_path / "check")).awaitTermination()
        assert store.snapshots.count() == n
    assert store.records(2).count() == 4


def test_csv_files(spark, tmp_path):
    from strataspark.reports.export import csv_parts, write_csv

    rows = spark.createDataFrame(
        [(2, "MISC", 'say "a", b', None, None, 5, 7, "h"), (1, "ARMO", "e", "n", "d\nx", 1, 2, "g")],
        "form_id long, record_type string, editor_id string, full_name string, desc_text string, flags long, data_size long, data_hash string",
    )
    write_csv(rows, str(tmp_path / "out"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "out").glob("part-*.txt")))
    assert text == "".join(csv_parts(rows)) and '"d\nx"' in text and '0x00000002,MISC,"say ""a"", b",,,5,7,h\r\n' in text


def test_json_parts_are_one_array(spark):
    import json

    from strataspark.reports.export import json_parts

    rows = spark.createDataFrame(
        [(2, "MISC", 'say "a"', None, 5, 7), (1, "ARMO", None, "é\nn", 1, 2)],
        "form_id long, record_type string, editor_id string, full_name string, flags long, data_size long",
    )
    fields = spark.createDataFrame([(2, 0, "value", "3", "int"), (2, 1, "ref", "0x00000001", "formid")], "form_id long, ordinal int, field_name string, field_value string, field_type string")
    text = "".join(json_parts(rows, fields))
    data = json.loads(text)
    assert text == json.dumps(data, indent=2) and [x["form_id"] for x in data] == ["0x00000001", "0x00000002"]
    assert data[1]["fields"] == {"value": "3", "ref": "0x00000001 (é\nn)"} and "fields" not in data[0]
    assert "".join(json_parts(rows.limit(0), fields)) == "[]" and len(list(json_parts(rows, fields))) == 3
