"""Colour arithmetic as column expressions; all integers, except the linear-light curve."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Integer YCbCr weights and offsets (8 fractional bits).
Y_WEIGHTS = (77, 150, 29)
CB_WEIGHTS = (-43, -85, 128)
CR_WEIGHTS = (128, -107, -21)
CHROMA_OFFSET = 128
#: The sRGB curve.
SRGB_KNEE, LINEAR_KNEE, SLOPE, OFFSET, GAMMA = 0.04045, 0.0031308, 12.92, 0.055, 2.4
#: Alpha from which a pixel is opaque.
OPAQUE = 128


def pack(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpack(rgb: Column) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(rgb, s).bitwiseAND(255) for s in (16, 8, 0))


def argb(a: Column, rgb: Column) -> Column:
    """A signed 32-bit pixel, alpha on top."""
    return F.shiftleft(a.cast("int"), 24).bitwiseOR(rgb.cast("int"))


def alpha(pixel: Column) -> Column:
    return F.shiftright(pixel, 24).bitwiseAND(255)


def is_opaque(pixel: Column) -> Column:
    return alpha(pixel) >= OPAQUE


def _weighted(r: Column, g: Column, b: Column, w: tuple[int, int, int]) -> Column:
    # an arithmetic shift rounds down, also below zero
    return F.shiftright(r * w[0] + g * w[1] + b * w[2], 8)


def ycbcr(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return _weighted(r, g, b, Y_WEIGHTS), _weighted(r, g, b, CB_WEIGHTS) + CHROMA_OFFSET, _weighted(r, g, b, CR_WEIGHTS) + CHROMA_OFFSET


def srgb_to_linear(byte: Column) -> Column:
    c = byte / F.lit(255.0)
    return F.when(c <= SRGB_KNEE, c / SLOPE).otherwise(F.pow((c + OFFSET) / (1 + OFFSET), F.lit(GAMMA)))


def linear_to_srgb(x: Column) -> Column:
    """A byte; halves go to the even neighbour."""
    s = F.when(x <= LINEAR_KNEE, x * SLOPE).otherwise(F.pow(x, F.lit(1 / GAMMA)) * (1 + OFFSET) - OFFSET)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.rint(s * 255).cast("int")))


def squared_distance(one: tuple[Column, ...], other: tuple[Column, ...]) -> Column:
    out = F.lit(0)
    for x, y in zip(one, other, strict=True):
        out = out + (x - y) * (x - y)
    return out
