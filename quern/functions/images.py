"""Image headers (SRC-21, PRD-41): sizes from the first bytes of a body, and whether an image is an icon."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a body that are looked at.
HEAD = 512 << 10
ICON = 64


def header_size(body: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a PNG, GIF, BMP, WebP or JPEG, None where the header does not say."""
    b = (body or b"")[:HEAD]
    try:
        if b[:8] == b"\x89PNG\r\n\x1a\n":
            return struct.unpack_from(">II", b, 16)
        if b[:4] == b"GIF8":
            return struct.unpack_from("<HH", b, 6)
        if b[:2] == b"BM":
            width, height = struct.unpack_from("<ii", b, 18)
            return width, abs(height)
        if b[:4] == b"RIFF" and b[8:12] == b"WEBP":
            return _webp(b)
        if b[:2] == b"\xff\xd8":
            return _jpeg(b)
    except (struct.error, IndexError):
        pass
    return None


def _webp(b: bytes) -> tuple[int, int] | None:
    kind = b[12:16]
    if kind == b"VP8X":
        return int.from_bytes(b[24:27], "little") + 1, int.from_bytes(b[27:30], "little") + 1
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    width, height = struct.unpack_from("<HH", b, 26)
    return width & 0x3FFF, height & 0x3FFF


def _jpeg(b: bytes) -> tuple[int, int] | None:
    """The first frame's size; segments before it are skipped by their lengths."""
    at = 2
    while b[at] == 0xFF:
        mark = b[at + 1]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", b, at + 5)
            return width, height
        at += 2 if mark == 0x01 or 0xD0 <= mark <= 0xD9 else 2 + struct.unpack_from(">H", b, at + 2)[0]
    return None


def size(body: Column) -> Column:
    """(width, height) of image bodies, nulls where the header does not say."""

    @F.arrow_udf("width int, height int")
    def probed(bodies: pa.Array) -> pa.Array:
        found = [header_size(b) or (None, None) for b in bodies.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int32()) for k in range(2)], names=["width", "height"])

    return probed(F.substring(body, 1, HEAD))


def is_icon(url: Column, width: Column, height: Column) -> Column:
    """A vector or icon file, or a measured image without a side beyond ``ICON`` points."""
    named = F.lower(url).rlike(r"\.(?:svg|ico)(?:[?#]|$)")
    return named | F.coalesce((width <= ICON) & (F.coalesce(height, width) <= ICON), F.lit(False))
