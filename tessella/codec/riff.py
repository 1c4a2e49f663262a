"""RIFF palettes: ``RIFF``, size, ``PAL ``, ``data``, size, version, count, then (r, g, b, flags)."""

from __future__ import annotations

import struct

from tessella.codec.errors import need

HEAD = struct.Struct("<4sI4s4sIHH")
VERSION = 0x0300
Entry = tuple[int, int, int, int]


def read(data: bytes) -> list[Entry]:
    """256 entries; those the file lacks are zero."""
    need(len(data) >= HEAD.size, "RIFF header cut off")
    riff, _, pal, chunk, _, _, n = HEAD.unpack_from(data)
    need(riff == b"RIFF", "not a RIFF file")
    need(pal == b"PAL " and chunk == b"data", "not a palette")
    need(1 <= n <= 256, "1 to 256 entries expected")
    need(len(data) >= HEAD.size + 4 * n, "entries cut off")
    own = list(struct.iter_unpack("4B", data[HEAD.size : HEAD.size + 4 * n]))
    return own + [(0, 0, 0, 0)] * (256 - n)


def write(entries: list[Entry], version: int = VERSION) -> bytes:
    """Always 256 entries: 1048 bytes."""
    own = (list(entries) + [(0, 0, 0, 0)] * 256)[:256]
    body = b"".join(struct.pack("4B", *e) for e in own)
    return HEAD.pack(b"RIFF", HEAD.size - 8 + len(body), b"PAL ", b"data", 4 + len(body), version or VERSION, 256) + body
