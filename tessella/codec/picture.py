"""P56 pictures: two headers, a palette of 3-byte entries, and one block of 8-bit pixels."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from tessella.codec.errors import need

#: Fixed values of the format.
TAG, PICTURE_HEADER, PALETTE_AT, CEL_HEADER, PIXELS_AT = 0x8181, 14, 62, 42, 868
WIDTH, HEIGHT, TRANSPARENT = 640, 480, 255
FIRST_COLOR, N_COLORS, TRIPLE, ENTRIES = 29, 33, 36, 41


@dataclass
class Picture:
    width: int
    height: int
    palette: list[tuple[int, int, int]]
    pixels: bytes


def read(data: bytes) -> Picture:
    need(len(data) >= 64, "file too short")
    tag, header = struct.unpack_from("<ih", data, 0)
    need(tag == TAG, "wrong tag")
    need(header == PICTURE_HEADER, "wrong header size")
    need(struct.unpack_from("<i", data, 10)[0] == PALETTE_AT, "wrong palette offset")
    need(all(struct.unpack_from("<HH", data, 14)), "no resolution")
    width, height = struct.unpack_from("<HH", data, 18)
    at = struct.unpack_from("<i", data, 42)[0]
    need(0 <= at <= len(data) - 4, "pixel block out of range")
    n = struct.unpack_from("<i", data, at)[0]
    need(n >= width * height and at + 4 + n <= len(data), "pixels cut off")
    need(len(data) >= PALETTE_AT + ENTRIES, "palette cut off")
    first, count = struct.unpack_from("<H", data, PALETTE_AT + FIRST_COLOR)[0], struct.unpack_from("<H", data, PALETTE_AT + N_COLORS)[0]
    size = 3 if data[PALETTE_AT + TRIPLE] else 4
    start = PALETTE_AT + ENTRIES
    need(start + size * count <= len(data), "palette entries cut off")
    palette = [(0, 0, 0)] * 256
    for k in range(count):
        if first + k < 256:
            entry = data[start + size * k : start + size * (k + 1)]
            palette[first + k] = tuple(entry[-3:])
    return Picture(width, height, palette, data[at + 4 : at + 4 + width * height])


def write(pixels: bytes, palette: list[tuple[int, int, int]], width: int = WIDTH, height: int = HEIGHT) -> bytes:
    """A file of 255 palette entries; offsets are known beforehand."""
    need(len(pixels) == width * height, "pixels do not fill the picture")
    head = struct.pack("<ihBBHiHH", TAG, PICTURE_HEADER, 1, 0, CEL_HEADER, PALETTE_AT, width, height)
    head += struct.pack("<HHhhBBHiiiiiihhh", width, height, 0, 0, TRANSPARENT, 0, 0, len(pixels), 0, 0, PIXELS_AT, 0, 0, 0, 0, 0) + b"\0\0"
    colors = (list(palette) + [(0, 0, 0)] * 255)[:255]
    block = struct.pack("<HHB9sBhH", 0x0322, 0, 14, b"GENPAL", 1, 0, 0) + bytes.fromhex("003400000200 5A0E0000") + struct.pack("<BBHHBBI", 0, 0, 0, 255, 1, 1, 0)
    return head + block + b"".join(bytes(c) for c in colors) + struct.pack("<i", len(pixels)) + pixels
