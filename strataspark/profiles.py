"""Named record files of a user, and the archives that go with a record file."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

APP = "strataspark"


class UsageError(Exception):
    """Something the user can set right."""


def home() -> Path:
    """Folder of the profiles and of the stores of record files."""
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / APP


@dataclass
class Profiles:
    """Record files by profile name, kept as a TOML file.

    ``default`` names the one that is meant where the user names none.
    """

    files: dict[str, Path] = field(default_factory=dict)
    default: str | None = None

    @staticmethod
    def may_be_called(name: str) -> bool:
        """Whether a name can stand as a bare TOML key."""
        return re.fullmatch(r"[a-zA-Z0-9_-]+", name) is not None

    @classmethod
    def read(cls, path: Path) -> Profiles:
        """The stored profiles; none where there is no file."""
        stored = tomllib.loads(path.read_text(encoding="utf-8")) if path.exists() else {}
        tables = stored.get("profiles", {})
        return cls({name: Path(tables[name]["file"]) for name in tables}, stored.get("default_profile"))

    def write(self, path: Path) -> None:
        """Store the profiles; single quotes keep the backslashes of paths as they are."""
        tables = [f"[profiles.{name}]\nfile = '{file}'\n" for name, file in self.files.items()]
        head = [f'default_profile = "{self.default}"\n'] if self.default else []
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(head + tables), encoding="utf-8")

    def choose(self, file: Path | None = None, name: str | None = None) -> Path:
        """The file itself if one is given, else that of the named or of the default profile; it must exist."""
        if file is None:
            wanted = name or self.default
            if wanted is None:
                raise UsageError("Which record file? Name one with --file, a profile with --profile, or set up a default with 'init'.")
            if wanted not in self.files:
                known = ", ".join(sorted(self.files)) or "none so far"
                raise UsageError(f"There is no profile {wanted!r} (known: {known}).")
            file = self.files[wanted]
        if not file.exists():
            raise UsageError(f"There is no record file at {file}." + ("" if name is None else f" Set profile {name!r} anew with 'init'."))
        return file

    def label(self, file: Path) -> str:
        """What the file's store is called: its profile, else its own name in lower case."""
        same = [name for name, own in self.files.items() if own.resolve() == file.resolve()]
        return same[0] if same else file.stem.lower()


#: Archives beside a record file, by what they hold: names behind the record file's own. ``#`` is
#: a number from 01 to 10; ``*`` stands for any text.
COMPANIONS = {
    "strings": ["Localization"],
    "icons": ["WorkshopIcons"],
    "sounds": ["Sounds#"],
    "textures": ["Textures#"],
    "scripts": ["MiscClient", "Startup", "*UpdateMain*"],
    "meshes": ["Meshes", "MeshesExtra", "*UpdateMain*"],
    "materials": ["Materials", "*UpdateMain*"],
}


def companions(file: Path, holding: str) -> list[Path]:
    """The archives of a kind that are there, in the order of the table, then of their names."""
    found: list[Path] = []
    for name in COMPANIONS[holding]:
        numbers = [f"{i:02d}" for i in range(1, 11)] if "#" in name else [""]
        for number in numbers:
            archive = f"{file.stem} - {name.replace('#', number)}.ba2"
            found += sorted(file.parent.glob(archive)) if "*" in name else [p for p in [file.parent / archive] if p.exists()]
    return found


def strings_archive(file: Path) -> Path:
    """Where the string tables of a record file are, or would be."""
    return file.parent / f"{file.stem} - {COMPANIONS['strings'][0]}.ba2"
