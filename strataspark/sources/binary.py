"""Readers of the binary formats on open files and bytes. No Spark here.

Damaged input ends silently where the format allows it, as documented on each
function; only a wrong file type raises.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

from strataspark.functions.tables import COMPRESSED_FLAG, SKIPPED_TYPES

HEADER = 24
#: Kinds of child groups that hold placements only.
PLACEMENT_GROUPS = (8, 9)


def open_any(path: str) -> BinaryIO:
    """A seekable file on any store: local paths directly, others by their URI."""
    if "://" not in path and not path.startswith("file:"):
        return open(path, "rb")
    if path.startswith("file:"):
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def write_any(path: str, data: bytes) -> None:
    """Write a whole file on any store, its folder with it."""
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        with store.open_output_stream(inner) as f:
            f.write(data)
        return
    local = "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with open(local, "wb") as f:
        f.write(data)


def _at(f: BinaryIO, start: int, n: int) -> bytes:
    f.seek(start)
    return f.read(n)


def file_size(f: BinaryIO) -> int:
    f.seek(0, 2)
    return f.tell()


# Record files


def split_subrecords(data: bytes) -> list[tuple[str, bytes]]:
    """(name, data) of a record's subrecords, up to the first that overruns."""
    out, at = [], 0
    while at + 6 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 6], "little")
        if at + 6 + n > len(data):
            break
        out.append((data[at : at + 4].decode("ascii", "replace"), data[at + 6 : at + 6 + n]))
        at += 6 + n
    return out


@dataclass
class RawRecord:
    at: int
    kind: str
    data_size: int
    flags: int
    form_id: int
    revision: int
    version: int
    subrecords: list[tuple[str, bytes]]


def records_in(data: bytes, base: int, skipped: frozenset[bytes], wanted: frozenset[str] | None = None) -> Iterator[RawRecord]:
    """Records of a run of whole group children that starts at file offset ``base``.

    Groups are descended but for placement groups; a record or group that overruns
    ends its level. Compressed records that don't unpack are left out.
    """
    levels = [(0, len(data))]
    while levels:
        at, end = levels.pop()
        while at + HEADER <= end:
            if data[at : at + 4] == b"GRUP":
                size, kind = int.from_bytes(data[at + 4 : at + 8], "little"), int.from_bytes(data[at + 12 : at + 16], "little")
                stop = min(at + size, end)
                if kind in PLACEMENT_GROUPS or size < HEADER:
                    if size < HEADER:
                        break
                    at += size
                    continue
                levels.append((at + size, end))  # what follows, once the group is through
                at, end = at + HEADER, stop
                continue
            tag, size, flags, form_id, revision, version, _ = struct.unpack_from("<4sIIIIHH", data, at)
            start, at = at, at + HEADER + size
            tag = tag.rstrip(b"\0")
            if tag in skipped:
                continue
            if at > end:
                break
            kind = tag.decode("ascii", "replace")
            if wanted is not None and kind not in wanted:
                continue
            body = data[start + HEADER : at]
            if flags & COMPRESSED_FLAG:
                if len(body) < 4:
                    continue
                try:
                    body = zlib.decompress(body[4:])
                except zlib.error:
                    continue
            yield RawRecord(base + start, kind, size, flags, form_id, revision, version, split_subrecords(body))


def plan_ranges(f: BinaryIO, skipped: frozenset[bytes], target: int, wanted: frozenset[str] | None = None) -> list[tuple[int, int]]:
    """File ranges of whole group children, about ``target`` bytes each, by reading headers only.

    Top-level groups of skipped (or, with ``wanted``, of other) types are left out.
    A child group larger than the target is planned in turn.
    """
    size = file_size(f)
    if _at(f, 0, 4) != b"TES4":
        raise ValueError("not a record file: no TES4 at its start")
    out: list[tuple[int, int]] = []

    def within(at: int, end: int) -> None:
        begun = at
        while at + HEADER <= end:
            head = _at(f, at, HEADER)
            n = int.from_bytes(head[4:8], "little")
            if head[:4] == b"GRUP":
                if n < HEADER:
                    break
                kind = int.from_bytes(head[12:16], "little")
                if kind in PLACEMENT_GROUPS or n > target:
                    if at > begun:
                        out.append((begun, at))
                    if kind not in PLACEMENT_GROUPS:
                        within(at + HEADER, min(at + n, end))
                    at += n
                    begun = at
                    continue
            else:
                n += HEADER
            at += n
            if at - begun >= target:
                out.append((begun, min(at, end)))
                begun = at
        if begun < end:
            out.append((begun, end))

    at = HEADER + int.from_bytes(_at(f, 4, 4), "little")
    while at + HEADER <= size:
        head = _at(f, at, HEADER)
        n, label, kind = int.from_bytes(head[4:8], "little"), head[8:12], int.from_bytes(head[12:16], "little")
        if head[:4] != b"GRUP" or n < HEADER:
            break
        named = label.rstrip(b"\0")
        unwanted = wanted is not None and named.isalnum() and not NESTING & {named} and named.decode("ascii", "replace") not in wanted
        if not (kind == 0 and (named in skipped or unwanted)):
            within(at + HEADER, min(at + n, size))
        at += n
    return [(a, b) for a, b in out if b > a]


#: Top-level groups that hold records of other types.
NESTING = frozenset({b"CELL", b"WRLD", b"DIAL", b"QUST"})
SKIPPED = frozenset(t.encode() for t in SKIPPED_TYPES)


# Archives


@dataclass
class ArchiveEntry:
    name: str
    offset: int
    packed_size: int
    unpacked_size: int
    height: int | None = None
    width: int | None = None
    mips: int | None = None
    format: int | None = None
    tile: int | None = None
    chunks: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def archive_head(f: BinaryIO) -> tuple[bytes, int, int]:
    """Kind of an archive, number of its files, and where their names begin."""
    head = _at(f, 0, 24)
    if len(head) < 24 or head[:4] != b"BTDX":
        raise ValueError("not an archive: bad magic")
    kind, count, names_at = head[8:12], *struct.unpack_from("<IQ", head, 12)
    if kind not in (b"GNRL", b"DX10"):
        raise ValueError(f"unknown archive type {kind!r}")
    return kind, count, names_at


def archive_entries(f: BinaryIO) -> list[ArchiveEntry]:
    """Files of a general or texture archive, in order; backslashes of names as slashes."""
    kind, count, names_at = archive_head(f)
    out = []
    for _ in range(count):
        if kind == b"GNRL":
            offset, packed, unpacked = struct.unpack_from("<QII", f.read(36), 16)
            out.append(ArchiveEntry("", offset, packed, unpacked))
            continue
        chunks_n, _, height, width, mips, form, tile = struct.unpack_from("<xBHHHBBH", f.read(24), 12)
        chunks = [struct.unpack_from("<QIIHH", f.read(24)) for _ in range(chunks_n)]
        out.append(
            ArchiveEntry(
                "", chunks[0][0] if chunks else 0, sum(c[1] for c in chunks), sum(c[2] for c in chunks),
                height, width, mips, form, tile, chunks,
            )
        )
    f.seek(names_at)
    for e in out:
        name = f.read(int.from_bytes(f.read(2), "little")).decode("utf-8", "replace").replace("\\", "/")
        e.name = name.lower() if kind == b"DX10" else name
    return out


def _stored(f: BinaryIO, offset: int, packed: int, unpacked: int) -> bytes:
    data = _at(f, offset, packed or unpacked)
    return zlib.decompress(data) if packed else data


def extract(f: BinaryIO, entry: ArchiveEntry) -> bytes:
    """A file's content; of a texture its chunks one after another."""
    if entry.chunks:
        return b"".join(extract_chunks(f, entry))
    return _stored(f, entry.offset, entry.packed_size, entry.unpacked_size)


def extract_chunks(f: BinaryIO, entry: ArchiveEntry) -> list[bytes]:
    return [_stored(f, *c[:3]) for c in entry.chunks]


# Texture files

# Block bytes and legacy code of block-compressed formats; uncompressed formats of four bytes.
BLOCK_FORMATS = {
    71: (8, b"DXT1"), 72: (8, b"DXT1"), 74: (16, b"DXT3"), 75: (16, b"DXT3"), 77: (16, b"DXT5"), 78: (16, b"DXT5"),
    79: (8, b"ATI1"), 80: (8, b"ATI1"), 83: (16, b""), 84: (16, b""), 98: (16, b""), 99: (16, b""),
}
FOUR_BYTE_FORMATS = (28, 29, 87, 91)


def first_level_size(width: int, height: int, form: int) -> int:
    """Bytes of a texture's largest level."""
    if form in FOUR_BYTE_FORMATS:
        return 4 * width * height
    across, down = (max(1, -(-n // 4)) for n in (width, height))
    return across * down * BLOCK_FORMATS.get(form, (16, b""))[0]


def texture_file(entry: ArchiveEntry, chunks: list[bytes], first_only: bool = False) -> bytes:
    """A texture as a file with header; with ``first_only`` its largest level alone."""
    levels = 1 if first_only else entry.mips
    largest = first_level_size(entry.width, entry.height, entry.format)
    flags, caps = 0x1 | 0x2 | 0x4 | 0x1000 | 0x80000, 0x1000
    if levels > 1:
        flags, caps = flags | 0x20000, caps | 0x400000 | 0x8
    code = BLOCK_FORMATS.get(entry.format, (16, b""))[1] or b"DX10"
    head = struct.pack("<5I", 124, flags, entry.height, entry.width, largest) + struct.pack("<III", 0, 1, levels) + bytes(40)
    head = head.ljust(72, b"\0") + struct.pack("<II4s", 32, 4, code)
    head = head.ljust(104, b"\0") + struct.pack("<I", caps)
    out = b"DDS " + head.ljust(124, b"\0")
    if code == b"DX10":
        out += struct.pack("<5I", entry.format, 3, 0, 1, 0)
    data = b"".join(chunks)
    return out + (chunks[0][:largest] if first_only else data)


# String tables


def string_file(data: bytes, length_prefixed: bool) -> dict[int, str]:
    """id -> text; entries beyond the end are left out, a cut directory raises struct.error."""
    if len(data) < 8:
        return {}
    count = int.from_bytes(data[:4], "little")
    directory = struct.unpack_from(f"<{2 * count}I", data, 8)
    body = 8 + 8 * count
    out = {}
    for key, offset in zip(directory[::2], directory[1::2], strict=True):
        at = body + offset
        if length_prefixed:
            if at + 4 <= len(data):
                n = int.from_bytes(data[at : at + 4], "little")
                out[key] = data[at + 4 : at + 4 + n].rstrip(b"\0").decode("utf-8", "replace")
        elif at < len(data):
            end = data.find(b"\0", at)
            out[key] = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace")
    return out


# Small formats


def sequence_ids(data: bytes) -> list[int]:
    """Unsigned ids of a sequence file; trailing bytes are ignored."""
    return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))


def voice_audio(data: bytes) -> bytes | None:
    """Audio of a voice file behind its lip data; None if it isn't one."""
    if len(data) < 12 or data[:4] != b"FUZE":
        return None
    start = 12 + int.from_bytes(data[8:12], "little")
    return data[start:] if start <= len(data) else None


def script_header(data: bytes) -> dict | None:
    """Versions, time and names of a compiled script; None if it isn't one."""
    if len(data) < 16 or data[:4] != b"\xfa\x57\xc0\xde":
        return None
    names, at = [], 16
    for _ in range(3):
        n = int.from_bytes(data[at : at + 2], "little") if at + 2 <= len(data) else 0
        if at + 2 + n > len(data):
            names.append("")
            at += 2 if at + 2 <= len(data) else 0
            continue
        names.append(data[at + 2 : at + 2 + n].decode("utf-8", "replace"))
        at += 2 + n
    game, time = struct.unpack_from("<HQ", data, 6)
    return {
        "major_version": data[4], "minor_version": data[5], "game_id": game, "compilation_time": time,
        "source_file": names[0], "user_name": names[1], "machine_name": names[2],
    }


def model_materials(data: bytes) -> list[str]:
    """Material paths in a model file's string table; none if it can't be read."""
    try:
        at = data.index(b"\n") + 1 + 9
        blocks, stream = struct.unpack_from("<II", data, at)
        at += 8
        for _ in range(6 if stream >= 130 else 3):
            at += 1 + data[at]
        at += 2 if stream >= 130 else 0
        (kinds,) = struct.unpack_from("<H", data, at)
        at += 2
        for _ in range(kinds):
            at += 4 + struct.unpack_from("<I", data, at)[0]
        at += 6 * blocks
        (count,) = struct.unpack_from("<I", data, at)
        at += 8
        out = []
        for _ in range(count):
            (n,) = struct.unpack_from("<I", data, at)
            text = data[at + 4 : at + 4 + n].decode("ascii", "replace")
            at += 4 + n
            if text.lower().endswith((".bgsm", ".bgem")):
                out.append(text.replace("\\", "/"))
        return out
    except (struct.error, IndexError, ValueError):
        return []


def _path_at(data: bytes, at: int) -> str | None:
    if at + 4 > len(data):
        return None
    n = int.from_bytes(data[at : at + 4], "little")
    if not 5 <= n <= 260 or at + 4 + n > len(data):
        return None
    try:
        text = data[at + 4 : at + 4 + n].decode("ascii")
    except UnicodeDecodeError:
        return None
    return text.rstrip("\0 ") if "/" in text or "\\" in text else None


def material_texture(data: bytes) -> str | None:
    """The first texture path of a material file."""
    if len(data) < 65 or data[:4] not in (b"BGSM", b"BGEM"):
        return None
    for at in (60, *range(40, min(120, len(data) - 8))):
        path = _path_at(data, at)
        if path and path.lower().endswith(".dds"):
            return path
    return None
