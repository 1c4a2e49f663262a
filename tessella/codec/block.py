"""Palette blocks: tag 0x0300, size, an optional patch tag, a 37-byte header, then 3- or 4-byte entries."""

from __future__ import annotations

import struct

from tessella.codec.errors import FormatError, need

TAG = 0x0300
PATCH_TAGS = (0x008B, 0x000B)
#: id, header size, name, count, reserved, title, start, cycles, fe, colours, default, type, valid
HEADER = struct.Struct("<hB9sBh10sBBHHBBI")
Entry = tuple[int, int, int, int]
GREY = [(i, i, i, 0) for i in range(256)]


def parse(data: bytes, at: int = 0) -> tuple[list[Entry], int]:
    """(256 entries r, g, b, remap; how many the block has) of the block at an offset."""
    need(len(data) >= at + 6, "block cut off")
    tag, _ = struct.unpack_from("<HI", data, at)
    need(tag == TAG, "no palette block")
    at += 6
    if len(data) >= at + 2 and struct.unpack_from("<H", data, at)[0] in PATCH_TAGS:
        at += 2
    need(len(data) >= at + HEADER.size, "header cut off")
    *_, start, _, _, n, _, kind, _ = HEADER.unpack_from(data, at)
    at += HEADER.size
    size = 4 if kind == 0 else 3
    need(len(data) >= at + size * n, "entries cut off")
    out = list(GREY)
    for k in range(n):
        entry = data[at + size * k : at + size * (k + 1)]
        if start + k < 256:
            out[start + k] = (entry[1], entry[2], entry[3], entry[0]) if size == 4 else (entry[0], entry[1], entry[2], 0)
    return out, n


def write(entries: list[Entry]) -> bytes:
    """A block of 256 entries with remap 0: 1067 bytes."""
    head = HEADER.pack(0, 14, b"GENPAL", 1, 0, b"", 0, 0, 0, 256, 1, 0, 0)
    body = b"".join(bytes((0, r, g, b)) for r, g, b, _ in (list(entries) + [(0, 0, 0, 0)] * 256)[:256])
    return struct.pack("<HI", TAG, HEADER.size + len(body)) + head + body


def scan(data: bytes) -> tuple[list[Entry], int, int] | None:
    """(entries, colours, offset) of the block with most colours, of equals the first; broken candidates are skipped."""
    best, at = None, data.find(b"\x00\x03")
    while at >= 0:
        try:
            entries, n = parse(data, at)
        except FormatError:
            n = 0
        if 1 <= n <= 256 and (best is None or n > best[1]):
            best = entries, n, at
        at = data.find(b"\x00\x03", at + 1)
    return best
