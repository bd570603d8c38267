"""Command line: ``python -m strataspark.cli COMMAND``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable
from pathlib import Path

from strataspark import profiles
from strataspark.profiles import UsageError

VERSION = "0.1"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strataspark", description="Versioned snapshots of record files.")
    top.add_argument("--file", type=Path, help="record file")
    top.add_argument("--profile", "-p", help="profile that names the record file")
    top.add_argument("--store", help="folder of the snapshot store (default: by profile)")
    top.add_argument("--functions", type=Path, help="CSV of condition functions: index,name,kind1,kind2")
    top.add_argument("--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple) -> None:
        p = sub.add_parser(name, help=text, description=text)
        for *flags, more in options:
            p.add_argument(*flags, **more)

    flag = {"action": "store_true"}
    number = {"type": int}
    output = ("--output", "-o", {"help": "file to write"})
    icons = ("--icons", {"action": argparse.BooleanOptionalAction, "default": True, "help": "extract icons beside a written report"})
    snapshot = ("--snapshot", {"type": int, "help": "snapshot id (default: latest)"})
    kind = ("--type", {"help": "record type"})
    form = lambda *of: ("--format", {"choices": of, "default": of[0]})
    command("init", "Set up profiles.")
    command("snapshot", "Read a record file into a new snapshot.", ("--label", "-l", {}), ("--full", flag))
    command("list", "List all snapshots.")
    command(
        "diff", "Compare two snapshots.", ("--latest", flag), ("--old", number), ("--new", number), kind,
        form("text", "json", "markdown", "html"), ("--other-file", {"type": Path}), ("--vs", {}), output, icons, ("--yes", flag),
    )
    command("search", "Search records.", ("query", {}), kind, ("--edid", {}), snapshot, form("text", "markdown", "html"), output, icons)
    command("show", "Show one record.", ("form_id", {}), snapshot, ("--expand", flag))
    command("unreleased", "List content that may be unreleased.", form("text", "markdown", "html"), output, icons)
    command("stats", "Count records by type.")
    command("strings", "Search strings.", ("action", {"choices": ["search"]}), ("query", {}), snapshot)
    command("export", "Export records.", ("--format", {"choices": ["csv", "json", "markdown", "html"], "required": True}), kind, snapshot, output, icons)
    command("purge", "Delete old snapshots.", ("--keep", {"type": int, "default": 5}))
    command("clear", "Delete all snapshots.", ("--yes", flag))
    media = (("--filter", "-f", {}), ("--output", "-o", {"default": "."}), ("--list-only", flag))
    command("sounds", "Extract sounds.", *media, ("--raw", flag))
    command("scripts", "Extract scripts.", *media)
    command("seq", "List the ids of the sequence file.", output)
    return top


class Commands:
    """The commands over one record file and its store."""

    def __init__(self, args: argparse.Namespace, spark=None, say=print, ask=input) -> None:
        self.args, self.say, self.ask = args, say, ask
        self.settings = profiles.home() / "config.toml"
        self.profiles = profiles.Profiles.read(self.settings)
        self._spark = spark

    @property
    def spark(self):
        if self._spark is None:
            from strataspark.session import local_session

            self._spark = local_session()
        return self._spark

    @property
    def file(self) -> Path:
        return self.profiles.choose(self.args.file, self.args.profile)

    def store_of(self, file: Path):
        from strataspark.store import SnapshotStore

        root = profiles.home() / "stores" / self.profiles.label(file)
        return SnapshotStore(self.spark, str(root))

    @property
    def store(self):
        from strataspark.store import SnapshotStore

        return SnapshotStore(self.spark, self.args.store) if self.args.store else self.store_of(self.file)

    def snapshot_id(self) -> int:
        found = self.args.snapshot if getattr(self.args, "snapshot", None) is not None else self.store.latest_id()
        if found is None:
            raise UsageError("No snapshots found.")
        return found

    def put(self, text: str | Iterable[str], what: str) -> None:
        """Write a report, whole or in parts, to the named file, else show it."""
        if self.args.output:
            with Path(self.args.output).open("w", encoding="utf-8") as f:
                f.writelines([text] if isinstance(text, str) else text)
            self.say(f"{what} written to {self.args.output}")
        else:
            self.say(text if isinstance(text, str) else "".join(text))

    def give_icons(self, items: list) -> bool:
        """Extract the items' icons beside the written report; whether that was asked for."""
        from strataspark.sources.archives import list_archive
        from strataspark.sources.media import extract_icons

        if not (self.args.icons and self.args.output and items):
            return False
        known = self.args.file or self.args.profile or self.profiles.default
        for archive in profiles.companions(self.file, "icons") if known else []:
            ids = self.spark.createDataFrame([(x.form_id,) for x in items], "form_id long").distinct()
            entries = list_archive(self.spark, str(archive), strict=False)
            paths = {r["form_id"]: r["path"] for r in extract_icons(ids, entries, str(Path(self.args.output).parent)).collect()}
            for x in items:
                x.icon = paths.get(x.form_id)
        return True

    # commands

    def init(self) -> None:
        while name := self.ask("Profile name (empty to end): ").strip():
            if not self.profiles.may_be_called(name):
                self.say("Names have letters, digits, _ and - only.")
                continue
            file = Path(self.ask("Record file: ").strip())
            if not file.exists():
                self.say(f"Not found: {file}")
                continue
            self.profiles.files[name] = file
        if self.profiles.files:
            names = ", ".join(self.profiles.files)
            chosen = self.ask(f"Default profile ({names}): ").strip()
            self.profiles.default = chosen if chosen in self.profiles.files else next(iter(self.profiles.files))
            self.profiles.write(self.settings)
            self.say(f"Saved {self.settings}")

    def snapshot(self) -> None:
        from strataspark.functions.conditions import load_functions
        from strataspark.ingest import ingest
        from strataspark.sources.archives import read_strings

        functions = load_functions(self.args.functions.open()) if self.args.functions else {}
        strings = read_strings(self.spark, str(profiles.strings_archive(self.file)), self.file.stem)
        made = ingest(self.spark, self.store, str(self.file), strings, self.args.label, self.args.full, functions)
        row = self.store.snapshots.where(f"id = {made}").first()
        self.say(f"Snapshot #{made}: {row['label']}, {row['record_count']:,} records, {row['string_count']:,} strings.")

    def list(self) -> None:
        from strataspark.reports.build import snapshot_lines

        if self.store.latest_id() is None:
            raise UsageError("No snapshots found.")
        self.say("\n".join(snapshot_lines(self.store.snapshots)))

    def _side(self, store, snapshot_id: int):
        row = store.snapshots.where(f"id = {snapshot_id}").first()
        if row is None:
            raise UsageError(f"Snapshot #{snapshot_id} not found.")
        return row, (row["id"], row["label"], store.records(snapshot_id), store.fields(snapshot_id))

    def diff(self) -> None:
        from strataspark.reports import render
        from strataspark.reports.build import diff_report

        a = self.args
        if a.other_file and a.vs:
            raise UsageError("--vs and --other-file exclude each other.")
        old_store = new_store = self.store
        if a.vs or a.other_file:
            new_store = self.store_of(self.profiles.choose(name=a.vs) if a.vs else a.other_file)
            old_id, new_id = a.old or old_store.latest_id(), a.new or new_store.latest_id()
        elif a.latest or (a.old is None and a.new is None):
            old_id, new_id = old_store.two_latest()
        else:
            old_id, new_id = a.old, a.new
        if old_id is None or new_id is None:
            raise UsageError("Two snapshots are needed: take more, or name them by --old and --new.")
        (first, old), (second, new) = self._side(old_store, old_id), self._side(new_store, new_id)
        same = old_store.root == new_store.root and first["file_hash"] == second["file_hash"]
        if same and not a.yes and self.ask("Both snapshots have the same file hash. Go on? [y/N] ").strip().lower() != "y":
            return
        report = diff_report(old, new, a.type)
        icons = self.give_icons([x for _, _, items in report.parts for x in items])
        made = {
            "text": render.diff_text, "json": render.diff_json, "html": render.diff_html,
            "markdown": lambda d: render.diff_markdown(d, icons),
        }[a.format](report)
        self.put(made, "Diff")

    def search(self) -> None:
        from strataspark.operators.search import search_records
        from strataspark.reports import render
        from strataspark.reports.build import search_report

        own = self.snapshot_id()
        records = self.store.records(own)
        found = search_report(search_records(records, self.args.query, self.args.type, self.args.edid), records, self.store.fields(own))
        if not found:
            self.say(f"No records found matching '{self.args.query}'.")
        elif self.args.format == "text":
            self.say(render.search_text(found))
        else:
            icons = self.give_icons(found)
            self.put(render.search_html(found) if self.args.format == "html" else render.search_markdown(found, icons), "Search results")

    def show(self) -> None:
        from strataspark.functions.text import parse_id_literal
        from strataspark.operators import lookups, tree
        from strataspark.reports.build import record_lines
        from strataspark.shared import Scratch

        form_id = parse_id_literal(self.args.form_id)
        if form_id is None:
            raise UsageError(f"Invalid FormID: {self.args.form_id}")
        own = self.snapshot_id()
        records, fields = self.store.records(own), self.store.fields(own)
        record = lookups.record_by_key(records, form_id).first()
        if record is None:
            raise UsageError(f"Record {self.args.form_id} not found in snapshot #{own}.")
        lines = record_lines(record, fields, records)
        if self.args.expand and record["record_type"] in tree.LISTS:
            root = self.spark.createDataFrame([(form_id,)], "root long")
            with Scratch(self.spark) as scratch:
                made = tree.lines(records, fields, root, scratch=scratch).orderBy("seq").collect()
            lines += ["", "  Leveled List Tree:", *[r["line"] for r in made]]
        self.say("\n".join(lines))

    def unreleased(self) -> None:
        from strataspark.reports import build, render

        caps = {"text": build.TEXT_CAP, "markdown": build.MARKDOWN_CAP, "html": build.HTML_CAP}
        found = build.unreleased_report(self.store.records(self.snapshot_id()), caps[self.args.format])
        if self.args.format == "text":
            self.say(render.unreleased_text(found))
            return
        icons = self.give_icons([x for c in found for x in c.items])
        text = render.unreleased_html(found) if self.args.format == "html" else render.unreleased_markdown(found, icons)
        self.put(text, "Unreleased content")

    def stats(self) -> None:
        from strataspark.operators import lookups

        row, _ = self._side(self.store, self.snapshot_id())
        self.say(f"Snapshot #{row['id']}: {row['label']} ({row['created_at']})")
        self.say(f"Records: {row['record_count']:,}  Strings: {row['string_count']:,}")
        self.say(f"Store size: {self.store.size() / 1024 / 1024:.1f} MB\n\n{'Type':<8}  {'Count':>8}\n{'-' * 18}")
        for r in lookups.type_counts(self.store.records(row["id"])).collect():
            self.say(f"{r['record_type']:<8}  {r['n']:>8,}")

    def strings(self) -> None:
        from pyspark.sql import functions as F

        from strataspark.functions.text import shortened
        from strataspark.operators.lookups import search_strings

        found = search_strings(self.store.strings(self.snapshot_id()), self.args.query)
        rows = found.select("string_id", shortened(F.col("text"), 100).alias("text")).collect()
        if not rows:
            self.say(f"No strings found matching '{self.args.query}'.")
            return
        self.say(f"Found {len(rows)} strings:\n")
        for r in rows:
            self.say(f"  0x{r['string_id']:08X}: {r['text']}")

    def export(self) -> None:
        from pyspark.sql import functions as F

        from strataspark.reports import build, export, render

        own, kind = self.snapshot_id(), self.args.type
        records, fields = self.store.records(own), self.store.fields(own)
        if self.args.format == "csv":
            text = export.csv_parts(records, kind)
        elif self.args.format == "json":
            text = export.json_parts(records, fields, kind)
        else:
            rows = records.where(F.col("record_type") == kind) if kind else records
            total, rows = rows.count(), rows.orderBy("record_type", "form_id")
            html = self.args.format == "html"
            found = build.items(rows.limit(build.EXPORT_CAP) if html else rows)
            icons = self.give_icons(found)
            text = render.export_html(found, total, kind) if html else render.export_markdown(found, total, kind, icons)
        self.put(text, "Export")

    def purge(self) -> None:
        n = self.store.purge(self.args.keep)
        self.say(f"Deleted {n} old snapshot(s). Kept {self.args.keep} most recent." if n else "Nothing to purge.")

    def clear(self) -> None:
        total = self.store.snapshots.count()
        if not total:
            self.say("The store is already empty.")
        elif self.args.yes or self.ask(f"Delete all {total} snapshot(s)? [y/N] ").strip().lower() == "y":
            self.say(f"Deleted {self.store.clear()} snapshot(s).")

    def _media(self, archives: list[Path], extensions: tuple[str, ...], extract) -> None:
        from strataspark.sources.archives import list_archive, matching
        from strataspark.sources.media import counters

        entries = list_archive(self.spark, *map(str, archives), strict=False)
        if self.args.list_only:
            names = [r["name"] for r in matching(entries, extensions, self.args.filter).orderBy("archive", "place").collect()]
            self.say("\n".join([*names, f"{len(names)} files"]))
            return
        n = counters(extract(entries))
        self.say(f"Found: {n['found']}  Extracted: {n['extracted']}  Converted: {n['converted']}  Errors: {n['errors']}")

    def sounds(self) -> None:
        from strataspark.sources.archives import AUDIO
        from strataspark.sources.media import extract_sounds

        a = self.args
        self._media(profiles.companions(self.file, "sounds"), AUDIO, lambda e: extract_sounds(e, a.output, a.filter, not a.raw))

    def scripts(self) -> None:
        from strataspark.sources.archives import SCRIPTS
        from strataspark.sources.media import extract_scripts

        self._media(profiles.companions(self.file, "scripts"), SCRIPTS, lambda e: extract_scripts(e, self.args.output, self.args.filter))

    def seq(self) -> None:
        from strataspark.reports.build import sequence_lines
        from strataspark.sources.archives import sequence

        path = self.file.with_suffix(".seq")
        if not path.exists():
            raise UsageError(f"SEQ file not found: {path}")
        if path.stat().st_size < 4:
            raise UsageError("SEQ file is empty or too small.")
        latest = self.store.latest_id()
        lines = sequence_lines(sequence(self.spark, str(path)), self.store.records(latest if latest is not None else -1))
        self.say(f"Found {len(lines)} auto-start quest FormIDs in {path.name}\n\n{'FormID':<12}  Name/Editor ID\n{'-' * 60}")
        self.say("\n".join(f"  {x}" for x in lines))
        if self.args.output:
            Path(self.args.output).write_text("\n".join(lines), encoding="utf-8")
            self.say(f"\nWritten to {self.args.output}")


def main(argv: list[str] | None = None, spark=None, say=print, ask=input) -> int:
    args = parser().parse_args(argv)
    try:
        getattr(Commands(args, spark, say, ask), args.command)()
    except UsageError as e:
        say(str(e))
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
