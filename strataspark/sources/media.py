"""Extraction of sounds, scripts and icons from archives to files, as status rows.

Each task writes its own entries below an output folder that all tasks reach and
returns what became of them; counts are an aggregate of the rows.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path, PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataspark.sources import binary
from strataspark.sources.archives import AUDIO, SCRIPTS, contents, icons_of, matching

STATUS = "name string, path string, status string"
CONVERTER = "ffmpeg"
CONVERT_SECONDS = 30


def _target(folder: str, name: str, extension: str | None = None) -> Path:
    """Path of an entry below the folder; names can't lead out of it."""
    parts = [p for p in PurePosixPath(name).parts if p not in ("..", "/", ".")]
    path = Path(folder, *parts)
    return path.with_suffix(extension) if extension else path


def _write(path: Path, data: bytes) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    part = tempfile.NamedTemporaryFile(dir=path.parent, delete=False)
    with part:
        part.write(data)
    os.replace(part.name, path)  # a task that runs twice leaves whole files


def to_wave(data: bytes, path: Path) -> bool:
    """Convert audio with the external converter; False if that doesn't work out."""
    path.parent.mkdir(parents=True, exist_ok=True)
    try:
        done = subprocess.run(
            [CONVERTER, "-y", "-i", "pipe:0", "-vn", str(path)], input=data, capture_output=True, timeout=CONVERT_SECONDS
        )
    except (OSError, subprocess.SubprocessError):
        return False
    return done.returncode == 0 and path.exists()


def extract_sounds(entries: DataFrame, folder: str, pattern: str | None = None, convert: bool = True) -> DataFrame:
    """name, path, status (extracted, converted, error) of each sound.

    Voice files lose their lip data; audio becomes a wave file where the converter is
    there and works, else it is written as it is.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        converter = convert and shutil.which(CONVERTER) is not None
        for batch in batches:
            out = []
            for name, data in zip(batch["name"], batch["content"], strict=True):
                kind = PurePosixPath(name).suffix.lower()
                audio = binary.voice_audio(data) if kind == ".fuz" and data is not None else data
                if audio is None:
                    out.append((name, None, "error"))
                    continue
                wave = _target(folder, name, ".wav")
                if kind != ".wav" and converter and to_wave(audio, wave):
                    out.append((name, str(wave), "converted"))
                    continue
                path = _target(folder, name, ".xwm" if kind == ".fuz" else None)
                _write(path, audio)
                out.append((name, str(path), "extracted"))
            yield pd.DataFrame(out, columns=["name", "path", "status"])

    return contents(matching(entries, AUDIO, pattern)).select("name", "content").mapInPandas(run, STATUS)


def extract_scripts(entries: DataFrame, folder: str, pattern: str | None = None) -> DataFrame:
    """name, path, status (extracted, error) of each script."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, data in zip(batch["name"], batch["content"], strict=True):
                if data is None:
                    out.append((name, None, "error"))
                    continue
                path = _target(folder, name)
                _write(path, data)
                out.append((name, str(path), "extracted"))
            yield pd.DataFrame(out, columns=["name", "path", "status"])

    return contents(matching(entries, SCRIPTS, pattern)).select("name", "content").mapInPandas(run, STATUS)


def counters(status: DataFrame) -> dict[str, int]:
    """found, extracted, converted, errors of an extraction."""
    n = {r["status"]: r["count"] for r in status.groupBy("status").count().collect()}
    converted = n.get("converted", 0)
    return {
        "found": sum(n.values()), "extracted": n.get("extracted", 0) + converted, "converted": converted, "errors": n.get("error", 0),
    }


def to_png(data: bytes, path: Path, largest: int) -> bool:
    """Write a texture as PNG, scaled down to ``largest`` (0: not at all); False without an image library."""
    try:
        import io

        from PIL import Image
    except ImportError:
        return False
    try:
        image = Image.open(io.BytesIO(data)).convert("RGBA")
        if largest:
            image.thumbnail((largest, largest), Image.LANCZOS)
        path.parent.mkdir(parents=True, exist_ok=True)
        image.save(path, "PNG")
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def extract_icons(ids: DataFrame, entries: DataFrame, folder: str, largest: int = 128) -> DataFrame:
    """form_id, path: thumbnails below ``icons`` and whole images below ``icons/full``; null where there is none."""
    wanted = icons_of(ids, entries)
    read = contents(wanted.where("name IS NOT NULL").select(*entries.columns)).select(
        F.col("archive").alias("a"), F.col("place").alias("p"), "content"
    )
    rows = wanted.join(read, (F.col("archive") == F.col("a")) & (F.col("place") == F.col("p")), "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for form_id, data in zip(batch["form_id"], batch["content"], strict=True):
                name = f"{form_id:08X}.png"
                small, full = Path(folder, "icons", name), Path(folder, "icons", "full", name)
                if data is None or not (small.exists() or to_png(data, small, largest)):
                    out.append((form_id, None))
                    continue
                if not full.exists():
                    to_png(data, full, 0)
                out.append((form_id, f"icons/{name}"))
            yield pd.DataFrame(out, columns=["form_id", "path"])

    return rows.select("form_id", "content").mapInPandas(run, "form_id long, path string")
