"""V56 views: loops of cels over one palette, their rows run-length coded in a control and a data stream.

All stored offsets count from the end of the 26-byte stamp. A loop is either cels or the mirror of another loop.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from tessella.codec.errors import need

#: Fixed values of the format.
STAMP = 26
PALETTE_TAG, IMAGE_TAG, ROWS_TAG, END_TAG = 0x0300, 0x0400, 0x0500, 0x0600
LOOP_HEADER, CEL_HEADERS, PALETTE_HEADER = 16, (0x24, 0x34), 37
FLAGS_A, FLAGS_B, CEL_FLAGS, EXTRA, FILL = 0xFF01, 0x0030, 0x8A, 0x0084, 0x03FFFFFF
VARIANTS = {"A": 0x12, "B": 0x10}  # sizes of the header; that of A ends with one more field
TRANSPARENT, MOST, RUN = 255, 63, 3
DEFAULT_STAMP = b"\x80\x80" + bytes(STAMP - 2)


@dataclass
class Cel:
    width: int
    height: int
    pixels: bytes
    x_hot: int = 0
    y_hot: int = 0
    transparent: int = TRANSPARENT


@dataclass
class Loop:
    cels: list[Cel] = field(default_factory=list)
    mirror_of: int | None = None


@dataclass
class View:
    loops: list[Loop]
    palette: list[tuple[int, int, int]]
    variant: str = "A"
    resolution: tuple[int, int] = (640, 480)
    flags: tuple[int, int] = (FLAGS_A, FLAGS_B)
    cel_header: int = CEL_HEADERS[1]
    extra: int = EXTRA


# -- rows


def encode_row(row: bytes, transparent: int = TRANSPARENT) -> tuple[bytes, bytes]:
    """Control and data bytes of one row."""
    control, data, literal = bytearray(), bytearray(), bytearray()

    def end_literal() -> None:
        for k in range(0, len(literal), MOST):
            piece = literal[k : k + MOST]
            control.append(len(piece))
            data.extend(piece)
        literal.clear()

    at = 0
    while at < len(row):
        v, stop = row[at], at + 1
        while stop < len(row) and row[stop] == v:
            stop += 1
        while at < stop:
            n = min(MOST, stop - at)
            if v == transparent:
                end_literal()
                control.append(0xC0 + n)
            elif n >= RUN:
                end_literal()
                control.append(0x80 + n)
                data.append(v)
            else:
                literal.extend(row[at:stop])
            at += n
    end_literal()
    return bytes(control), bytes(data)


def decode_row(control: memoryview, data: memoryview, width: int, transparent: int = TRANSPARENT) -> bytes:
    out, c, d = bytearray(), 0, 0
    while len(out) < width:
        need(c < len(control), "control bytes run out")
        op = control[c]
        c += 1
        n = op & 0x3F if op >= 0x80 else op
        need(n > 0, "empty run")
        if op >= 0xC0:
            out += bytes([transparent]) * n
        elif op >= 0x80:
            need(d < len(data), "data bytes run out")
            out += bytes([data[d]]) * n
            d += 1
        else:
            need(d + n <= len(data), "data bytes run out")
            out += data[d : d + n]
            d += n
    return bytes(out[:width])


# -- files


def check(view: View) -> None:
    """What a file can hold."""
    need(bool(view.loops), "no loops")
    need(len(view.palette) == 256, "256 palette entries expected")
    need(view.variant in VARIANTS and view.cel_header in CEL_HEADERS, "unknown view header")
    for loop in view.loops:
        if loop.mirror_of is not None:
            need(not loop.cels, "a mirror has no cels")
            need(0 <= loop.mirror_of < min(len(view.loops), 128) and view.loops[loop.mirror_of].mirror_of is None, "a mirror needs a loop of images")
        else:
            need(1 <= len(loop.cels) <= 255, "1 to 255 cels expected")
            for cel in loop.cels:
                need(cel.width > 0 and cel.height > 0 and len(cel.pixels) == cel.width * cel.height, "pixels do not fill the cel")


def encode(view: View, stamp: bytes = DEFAULT_STAMP) -> bytes:
    check(view)
    need(len(stamp) == STAMP, "a stamp has 26 bytes")
    size = VARIANTS[view.variant]
    stride = view.cel_header
    cels = [c for loop in view.loops for c in loop.cels]
    tables = 2 + size + LOOP_HEADER * len(view.loops)
    palette_at = tables + stride * len(cels)
    colors = b"".join(bytes((1, *c)) for c in view.palette)
    head = struct.pack("<hB9sBh10sBBHHBBI", 0, 14, b"", 1, 0, b"", 0, 0, 0, 256, 1, 0, 0)
    palette = struct.pack("<HI", PALETTE_TAG, len(head) + len(colors)) + head + colors
    rows = [[encode_row(c.pixels[c.width * y : c.width * (y + 1)], c.transparent) for y in range(c.height)] for c in cels]
    sizes = [(sum(len(a) for a, _ in r), sum(len(b) for _, b in r)) for r in rows]
    control_at = palette_at + len(palette) + 6
    data_at = control_at + sum(a for a, _ in sizes)
    rows_at = data_at + sum(b for _, b in sizes) + 6
    out = [stamp, struct.pack("<HHHHIBBHH", size, len(view.loops), *view.flags, palette_at, LOOP_HEADER, stride, *view.resolution)]
    if view.variant == "A":
        out.append(struct.pack("<H", view.extra))
    # a mirror points at the cels of the next loop of images, or at the end of all
    starts, n = [], 0
    for loop in view.loops:
        starts.append(None if loop.mirror_of is not None else tables + stride * n)
        n += len(loop.cels)
    for k, loop in enumerate(view.loops):
        at = next((s for s in starts[k:] if s is not None), palette_at)
        first = bytes((0xFF, 0, len(loop.cels), 0xFF)) if loop.mirror_of is None else bytes((loop.mirror_of, 1, 0, 0xFF))
        out.append(first + struct.pack("<III", FILL, 0, at))
    table = []
    for c, r, (a, b) in zip(cels, rows, sizes, strict=True):
        head = struct.pack("<HHhhBBHIIIIII", c.width, c.height, c.x_hot, c.y_hot, c.transparent, CEL_FLAGS, 0, a + b, a, 0, control_at, data_at, rows_at)
        out.append(head.ljust(stride, b"\0"))
        for part in (0, 1):
            at = 0
            for row in r:
                table.append(struct.pack("<I", at))
                at += len(row[part])
        control_at, data_at, rows_at = control_at + a, data_at + b, rows_at + 8 * c.height
    control, data = (b"".join(row[part] for r in rows for row in r) for part in (0, 1))
    out += [palette, struct.pack("<HI", IMAGE_TAG, len(control) + len(data)), control, data, struct.pack("<HI", ROWS_TAG, 0), *table, struct.pack("<HI", END_TAG, 0)]
    return b"".join(out)


def decode(file: bytes) -> View:
    need(len(file) >= STAMP + 18, "file too short")
    body = memoryview(file)[STAMP:]
    size, loops, flag_a, flag_b, _, loop_header, stride, *resolution = struct.unpack_from("<HHHHIBBHH", body, 0)
    variant = next((k for k, v in VARIANTS.items() if v == size), None)
    need(variant is not None, "unknown view header")
    need(loop_header == LOOP_HEADER and stride in CEL_HEADERS, "unknown header sizes")
    need(loops > 0, "no loops")
    at = 2 + size
    need(len(body) >= at + LOOP_HEADER * loops, "loop headers cut off")
    extra = struct.unpack_from("<H", body, at - 2)[0] if variant == "A" else EXTRA
    found = []
    for k in range(loops):
        b = body[at + LOOP_HEADER * k : at + LOOP_HEADER * (k + 1)]
        mirror = b[1] == 1 and b[2] == 0 and b[0] != 0xFF
        found.append((b[0] if mirror else None, 0 if mirror else b[2], struct.unpack_from("<I", b, 12)[0]))
    at += LOOP_HEADER * loops + stride * sum(n for _, n, _ in found)
    need(len(body) >= at + 6, "palette cut off")
    tag, length = struct.unpack_from("<HI", body, at)
    need(tag == PALETTE_TAG and length >= PALETTE_HEADER + 1024 and len(body) >= at + 6 + length, "no palette")
    entries = body[at + 6 + PALETTE_HEADER : at + 6 + PALETTE_HEADER + 1024]
    palette = [tuple(entries[4 * i + 1 : 4 * i + 4]) for i in range(256)]
    at += 6 + length
    need(len(body) >= at + 6, "images cut off")
    tag, length = struct.unpack_from("<HI", body, at)
    need(tag == IMAGE_TAG and len(body) >= at + 6 + length + 6, "no images")
    streams_end = at + 6 + length
    tag, length = struct.unpack_from("<HI", body, streams_end)
    need(tag == ROWS_TAG and length == 0, "no row tables")
    need(bytes(body[streams_end + 6 :]).find(struct.pack("<H", END_TAG)) >= 0, "no end")
    out = []
    for mirror_of, n, table in found:
        cels = []
        for k in range(n):
            need(len(body) >= table + stride * (k + 1), "cel header out of range")
            w, h, x, y, transparent, _, _, both, control, _, control_at, data_at, rows_at = struct.unpack_from("<HHhhBBHIIIIII", body, table + stride * k)
            need(w > 0 and h > 0 and both >= control, "bad cel")
            need(control_at + control <= streams_end and data_at + both - control <= streams_end and rows_at + 8 * h <= len(body), "cel out of range")
            offsets = struct.unpack_from(f"<{2 * h}I", body, rows_at)
            c, d = body[control_at : control_at + control], body[data_at : data_at + both - control]
            cels.append(Cel(w, h, b"".join(decode_row(c[offsets[r] :], d[offsets[h + r] :], w, transparent) for r in range(h)), x, y, transparent))
        out.append(Loop(cels, mirror_of))
    return View(out, palette, variant, tuple(resolution), (flag_a, flag_b), stride, extra)
