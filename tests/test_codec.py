import random
import struct

import pytest

from tessella.codec import block, picture, png, riff, view
from tessella.codec.errors import FormatError

rng = random.Random(11)
COLORS = [(rng.randrange(256), rng.randrange(256), rng.randrange(256)) for _ in range(256)]
ENTRIES = [(*c, k % 5) for k, c in enumerate(COLORS)]


def test_riff():
    data = riff.write(ENTRIES)
    assert len(data) == 1048 and struct.unpack_from("<I", data, 4) == (1040,) and struct.unpack_from("<I", data, 16) == (1028,)
    assert riff.read(data) == ENTRIES
    short = struct.pack("<4sI4s4sIHH", b"RIFF", 0, b"PAL ", b"data", 0, 0x300, 3) + bytes(range(12))
    assert riff.read(short) == [(0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11)] + [(0, 0, 0, 0)] * 253


@pytest.mark.parametrize("cut", [lambda d: b"RIFX" + d[4:], lambda d: d[:8] + b"PAX " + d[12:], lambda d: d[:22] + b"\0\0" + d[24:], lambda d: d[:22] + b"\1\2" + d[24:], lambda d: d[:-1], lambda d: d[:10]])
def test_broken_riff(cut):
    with pytest.raises(FormatError):
        riff.read(cut(riff.write(ENTRIES)))


@pytest.mark.parametrize("patch", [None, 0x008B, 0x000B])
@pytest.mark.parametrize("kind", [0, 1])
def test_block(patch, kind):
    n, start = 10, 250
    head = block.HEADER.pack(0, 14, b"x", 1, 0, b"t", start, 0, 0, n, 1, kind, 0)
    body = b"".join(bytes((9, *COLORS[k])) if kind == 0 else bytes(COLORS[k]) for k in range(n))
    data = struct.pack("<HI", 0x300, 0) + (struct.pack("<H", patch) if patch else b"") + head + body
    got, count = block.parse(data)
    assert count == n
    assert got[249] == (249, 249, 249, 0) and got[250] == (*COLORS[0], 9 if kind == 0 else 0) and len(got) == 256
    with pytest.raises(FormatError):
        block.parse(data[:-1])


def test_block_round_trip_and_scan():
    data = block.write(ENTRIES)
    assert len(data) == 1067 and struct.unpack_from("<I", data, 2) == (1061,)
    assert [e[:3] for e in block.parse(data)[0]] == COLORS
    small = struct.pack("<HI", 0x300, 0) + block.HEADER.pack(0, 14, b"", 1, 0, b"", 0, 0, 0, 2, 1, 1, 0) + bytes(6)
    found = block.scan(b"\x01\x00\x03\xff" + small + data + data)
    assert found[1:] == (256, 4 + len(small)) and block.scan(b"nothing") is None


def test_picture():
    pixels = bytes(rng.randrange(255) for _ in range(640 * 480))
    data = picture.write(pixels, COLORS)
    assert len(data) == 308072 and struct.unpack_from("<i", data, 42) == (868,)
    p = picture.read(data)
    assert (p.width, p.height, p.pixels, p.palette[:255], p.palette[255]) == (640, 480, pixels, COLORS[:255], (0, 0, 0))
    four = bytearray(data)
    four[62 + 36] = 0  # entries of four bytes
    struct.pack_into("<H", four, 62 + 33, 2)
    assert picture.read(bytes(four)).palette[0] == tuple(data[62 + 42 : 62 + 45])


@pytest.mark.parametrize("at,value", [(0, b"\0\0\0\0"), (4, b"\x0f\0"), (10, b"\0\0\0\0"), (14, b"\0\0"), (18, b"\xff\xff"), (42, b"\xff\xff\xff\x7f"), (62 + 33, b"\xff\xff")])
def test_broken_picture(at, value):
    data = bytearray(picture.write(bytes(6), COLORS, 3, 2))
    data[at : at + len(value)] = value
    with pytest.raises(FormatError):
        picture.read(bytes(data))


def cel(w, h):
    return view.Cel(w, h, bytes(rng.choice([255, 255, 3, 3, 3, 7, rng.randrange(256)]) for _ in range(w * h)), -2, 5)


@pytest.mark.parametrize("variant,more", [("A", ()), ("B", ()), ("A", ((320, 200), (0x0101, 7), 0x24, 99))])
def test_view_round_trip(variant, more):
    v = view.View([view.Loop(mirror_of=1), view.Loop([cel(2, 2), cel(200, 3)]), view.Loop([cel(7, 7)]), view.Loop(mirror_of=2)], COLORS, variant, *more)
    assert view.decode(view.encode(v)) == v


def test_rows():
    for n in [1, 2, 3, 62, 63, 64, 65, 66, 126, 128]:
        for v in (255, 4):
            c, d = view.encode_row(bytes([v]) * n)
            assert view.decode_row(memoryview(c), memoryview(d), n) == bytes([v]) * n
            assert not {0, 0x80, 0xC0} & set(c) and all(x & 0x3F for x in c)
    assert view.decode_row(memoryview(b"\xff"), memoryview(b""), 5) == b"\xff" * 5  # cut at the row's width


@pytest.mark.parametrize("loops", [[], [view.Loop(mirror_of=0)], [view.Loop([])], [view.Loop([view.Cel(2, 2, b"abc")])], [view.Loop([cel(1, 1)], mirror_of=0)], [view.Loop([cel(1, 1)] * 256)]])
def test_unfit_views(loops):
    with pytest.raises(FormatError):
        view.encode(view.View(loops, COLORS))


def test_broken_views():
    data = view.encode(view.View([view.Loop([cel(5, 5)])], COLORS))
    for cut in (20, 40, 60, 300, len(data) - 200):
        with pytest.raises(FormatError):
            view.decode(data[:cut])
    with pytest.raises(FormatError):
        view.decode(data[:26] + b"\x11" + data[27:])
    with pytest.raises(FormatError):
        view.decode_row(memoryview(b"\x80"), memoryview(b""), 4)


def test_png():
    data = png.write(2, 1, b"\1\2\3\xff\4\5\6\0")
    assert data.startswith(b"\x89PNG") and data.endswith(b"IEND\xaeB`\x82")
