"""Archives, string tables and single-file formats as DataFrames.

Listings and contents of archives are read by the tasks, each opening the
archive at its own entries.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from strataspark.functions.text import ascii_lower, hex_id
from strataspark.operators.lookups import merge_by_priority, upsert
from strataspark.sources import binary

LISTING = (
    "archive string, place int, name string, offset long, packed_size long, unpacked_size long, height int, width int, "
    "mips int, format int, tile int, "
    "chunks array<struct<offset: long, packed_size: long, unpacked_size: long, first_mip: int, last_mip: int>>"
)
ENTRIES_PER_TASK = 512
AUDIO, SCRIPTS = (".fuz", ".xwm", ".wav"), (".pex",)


def list_archive(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """Entries of archives in order; with ``strict`` off unreadable archives are left out.

    The driver looks at the archives' heads alone; each listing is read by a task.
    """
    there = []
    for path in paths:
        try:
            with binary.open_any(path) as f:
                binary.archive_head(f)
            there.append((path,))
        except (ValueError, OSError):
            if strict:
                raise
    schema = to_arrow_schema(spark.createDataFrame([], LISTING).schema)
    sizes = [f.name for f in schema.field("chunks").type.value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch["archive"].to_pylist()):
            try:
                with binary.open_any(path) as f:
                    found = binary.archive_entries(f)
            except (ValueError, OSError, EOFError, struct.error):
                if strict:
                    raise
                continue
            rows = [
                {
                    **{n: getattr(e, n) for n in schema.names[2:-1]}, "archive": path, "place": i,
                    "chunks": [dict(zip(sizes, c, strict=True)) for c in e.chunks],
                }
                for i, e in enumerate(found)
            ]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.createDataFrame(there, "archive string").repartition(max(1, len(there))).mapInArrow(run, LISTING)


def by_path(entries: DataFrame, path: str) -> DataFrame:
    """The entry of exactly that path, in any case; of duplicates the last."""
    same = entries.where(F.lower("name") == path.lower().replace("\\", "/"))
    return same.orderBy(F.desc("place")).limit(1)


def containing(entries: DataFrame, part: str) -> DataFrame:
    """Entries whose path contains the part in any case, in order."""
    return entries.where(F.contains(F.lower("name"), F.lit(part.lower()))).orderBy("archive", "place")


def matching(entries: DataFrame, extensions: tuple[str, ...], pattern: str | None = None) -> DataFrame:
    """Entries of the extensions that contain the pattern, or match it as a glob if it has * or ?."""
    name = F.lower("name")
    found = entries.where(F.regexp_extract(name, r"(\.[^./]*)$", 1).isin(*extensions))
    if pattern and re.search(r"[*?]", pattern):
        glob = fnmatch.translate(pattern.lower()).replace("(?s:", "(?:").replace("\\Z", "").replace("\\z", "")
        found = found.where(name.rlike(f"(?s)^{glob}$"))
    elif pattern:
        found = found.where(F.contains(name, F.lit(pattern.lower())))
    return found


def _entry(row) -> binary.ArchiveEntry:
    chunks = [] if row.chunks is None else [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in row.chunks]
    return binary.ArchiveEntry(row.name_, row.offset, row.packed_size, row.unpacked_size, chunks=chunks)


def contents(entries: DataFrame) -> DataFrame:
    """archive, place, name, content (null where it can't be read) of the entries."""
    n = max(1, -(-entries.count() // ENTRIES_PER_TASK))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, part in batch.groupby("archive", sort=False):
                with binary.open_any(path) as f:
                    for row in part.rename(columns={"name": "name_"}).itertuples():
                        try:
                            out.append((path, row.place, row.name_, binary.extract(f, _entry(row))))
                        except (zlib.error, OSError, ValueError):
                            out.append((path, row.place, row.name_, None))
            yield pd.DataFrame(out, columns=["archive", "place", "name", "content"])

    chosen = entries.select("archive", "place", "name", "offset", "packed_size", "unpacked_size", "chunks").repartition(n)
    return chosen.mapInPandas(run, "archive string, place int, name string, content binary")


# String tables

PARTS = ((".strings", False), (".dlstrings", True), (".ilstrings", True))


def string_rows(content: Column, length_prefixed: bool) -> Column:
    """(string_id, text) pairs of a string file, as an array column."""

    @F.pandas_udf("array<struct<string_id: long, text: string>>")
    def run(files: pd.Series) -> pd.Series:
        return pd.Series(
            [None if d is None else [{"string_id": k, "text": t} for k, t in binary.string_file(d, length_prefixed).items()] for d in files],
            dtype=object,
        )

    return run(content)


def read_strings(spark: SparkSession, archive: str, stem: str, language: str = "en") -> DataFrame:
    """string_id, text, source of a language: main files, then the ``nw`` ones; later files win."""
    entries = list_archive(spark, archive)
    parts = []
    for prefix, (suffix, prefixed) in ((p, s) for p in (stem.lower(), "nw") for s in PARTS):
        one = containing(entries, f"strings/{prefix}_{language}{suffix}").limit(1)
        rows = contents(one).select("name", F.explode(string_rows(F.col("content"), prefixed)).alias("s"))
        parts.append(rows.select("s.string_id", "s.text", F.col("name").alias("source")))
    return merge_by_priority(parts, "string_id")


# Single-file formats, over binary columns


def _each(result_type: str, read) -> Callable[[Column], Column]:
    """A column function that reads each file's bytes; null for null."""

    def column(content: Column) -> Column:
        @F.pandas_udf(result_type)
        def run(files: pd.Series) -> pd.Series:
            return pd.Series([None if d is None else read(d) for d in files], dtype=object)

        return run(content)

    return column


model_materials = _each("array<string>", binary.model_materials)
material_texture = _each("string", binary.material_texture)
voice_audio = _each("binary", binary.voice_audio)
sequence_ids = _each("array<long>", binary.sequence_ids)


SCRIPT = (
    "struct<major_version: int, minor_version: int, game_id: int, compilation_time: decimal(20,0), "
    "source_file: string, user_name: string, machine_name: string>"
)


def script_header(content: Column) -> Column:
    from decimal import Decimal

    @F.pandas_udf(SCRIPT)
    def run(files: pd.Series) -> pd.DataFrame:
        found = [binary.script_header(d) if d is not None else None for d in files]
        names = [x.split(":")[0].strip() for x in SCRIPT[7:-1].replace("decimal(20,0)", "d").split(",")]
        rows = [{n: (f or {}).get(n) for n in names} for f in found]
        out = pd.DataFrame(rows, columns=names, dtype=object)
        out["compilation_time"] = [None if t is None else Decimal(t) for t in out["compilation_time"]]
        for n in names[:3]:
            out[n] = out[n].astype("Int32")
        return out

    return run(content)


def sequence(spark: SparkSession, path: str) -> DataFrame:
    """pos, form_id of a sequence file's ids."""
    with binary.open_any(path) as f:
        ids = binary.sequence_ids(f.read())
    return spark.createDataFrame(list(enumerate(ids)), "pos long, form_id long")


# Icons

ICON_PATH = "textures/interface/workshopicons/"


def icons_of(ids: DataFrame, entries: DataFrame) -> DataFrame:
    """form_id with the archive entry of its icon (nulls where there is none): a join on the constructed path."""
    wanted = ids.select("form_id", F.concat(F.lit(ICON_PATH), F.lower(F.substring(hex_id(F.col("form_id")), 3, 8)), F.lit(".dds")).alias("__path"))
    last = upsert(entries.withColumn("__key", ascii_lower(F.col("name"))), ["__key"], "place")
    return wanted.join(last, F.col("__path") == F.col("__key"), "left").drop("__path", "__key")
