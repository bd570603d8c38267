"""Byte builders of the binary formats, the inverses of the readers: for fixtures and exports."""

from __future__ import annotations

import struct
import zlib

from strataspark.functions.tables import COMPRESSED_FLAG


def subrecord(name: str, data: bytes) -> bytes:
    return struct.pack("<4sH", name.encode("ascii"), len(data)) + data


def record(
    kind: str, form_id: int, subrecords: list[tuple[str, bytes]], flags: int = 0, revision: int = 0, version: int = 0,
    compressed: bool = False,
) -> bytes:
    data = b"".join(subrecord(n, d) for n, d in subrecords)
    if compressed:
        data, flags = struct.pack("<I", len(data)) + zlib.compress(data), flags | COMPRESSED_FLAG
    return struct.pack("<4sIIIIHH", kind.encode("ascii"), len(data), flags, form_id, revision, version, 0) + data


def group(label: bytes, children: list[bytes], group_type: int = 0) -> bytes:
    data = b"".join(children)
    return struct.pack("<4sI4sIII", b"GRUP", 24 + len(data), label.ljust(4, b"\0"), group_type, 0, 0) + data


def record_file(groups: list[bytes], header: bytes = b"") -> bytes:
    return struct.pack("<4sIIIIHH", b"TES4", len(header), 0, 0, 0, 0, 0) + header + b"".join(groups)


def general_archive(files: list[tuple[str, bytes, bool]]) -> bytes:
    """An archive of (name, content, packed) files."""
    at = 24 + 36 * len(files)
    entries, contents, names = b"", b"", b""
    for name, content, packed in files:
        stored = zlib.compress(content) if packed else content
        entries += struct.pack("<I4sIIQII4s", 0, b"\0" * 4, 0, 0, at + len(contents), len(stored) if packed else 0, len(content), b"\0" * 4)
        contents += stored
        raw = name.encode("utf-8")
        names += struct.pack("<H", len(raw)) + raw
    return struct.pack("<4sI4sIQ", b"BTDX", 1, b"GNRL", len(files), at + len(contents)) + entries + contents + names


def texture_archive(files: list[dict]) -> bytes:
    """An archive of textures: name, height, width, mips, format, tile, chunks [(content, packed, first mip, last mip)]."""
    size = sum(24 + 24 * len(f["chunks"]) for f in files)
    at, entries, contents, names = 24 + size, b"", b"", b""
    for f in files:
        entries += struct.pack(
            "<I4sIBBHHHBBH", 0, b"dds\0", 0, 0, len(f["chunks"]), 24, f["height"], f["width"], f["mips"], f["format"], f.get("tile", 0)
        )
        for content, packed, low, high in f["chunks"]:
            stored = zlib.compress(content) if packed else content
            entries += struct.pack("<QIIHHI", at + len(contents), len(stored) if packed else 0, len(content), low, high, 0)
            contents += stored
        raw = f["name"].encode("utf-8")
        names += struct.pack("<H", len(raw)) + raw
    return struct.pack("<4sI4sIQ", b"BTDX", 1, b"DX10", len(files), at + len(contents)) + entries + contents + names


def string_file(texts: dict[int, str], length_prefixed: bool = False) -> bytes:
    directory, body = b"", b""
    for key, text in texts.items():
        directory += struct.pack("<II", key, len(body))
        raw = text.encode("utf-8") + b"\0"
        body += struct.pack("<I", len(raw)) + raw if length_prefixed else raw
    return struct.pack("<II", len(texts), len(body)) + directory + body
