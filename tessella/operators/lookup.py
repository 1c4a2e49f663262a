"""Palette lookups: exact first, then nearest, on distinct colours only.

A palette is at most 256 rows, so it is always broadcast. A colour is compared with the entries that may be nearest to a
colour of its cell, one of 512 in the colour cube; there are at most 2**24 distinct colours, however many pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color

#: The last entry is never matched.
MATCHED = 255
TRANSPARENT = 255
#: Upper bits of each channel that name a cell.
CELL_BITS = 3


def keyed(palette: DataFrame) -> DataFrame:
    """One row per colour: the lowest index that has it."""
    return palette.where(F.col("idx") < MATCHED).groupBy(color.pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).agg(F.min("idx").alias("idx"))


def cell_of(rgb: Column) -> Column:
    """The cell of the colour cube that a colour lies in: the upper bits of its channels."""
    r, g, b = (F.shiftright(c, 8 - CELL_BITS) for c in color.unpack(rgb))
    return F.shiftleft(r, 2 * CELL_BITS).bitwiseOR(F.shiftleft(g, CELL_BITS)).bitwiseOR(b)


def candidates(cells: DataFrame, entries: DataFrame, *keys: str) -> DataFrame:
    """(keys, cell, idx, pr, pg, pb): the entries that can be nearest to a colour of one of ``cells``, by ``keys`` if there are many palettes.

    Those are no farther from the cell's nearest corner than some entry is from its farthest. At most 512 x 255 rows a palette."""
    side, mask = 1 << (8 - CELL_BITS), (1 << CELL_BITS) - 1
    own = cells.select(*keys, "cell").distinct()
    palettes = entries.select(*keys, "idx", *[F.col(c).alias(f"p{c}") for c in "rgb"])
    pairs = own.join(palettes, list(keys)) if keys else own.crossJoin(F.broadcast(palettes))  # a palette: at most 256 rows
    near = far = F.lit(0)
    for shift, c in zip((2, 1, 0), "rgb", strict=True):
        low = F.shiftright("cell", shift * CELL_BITS).bitwiseAND(mask) * side
        below, above = low - F.col(f"p{c}"), F.col(f"p{c}") - (low + side - 1)
        out, across = F.greatest(below, above, F.lit(0)), F.greatest(-below, -above)
        near, far = near + out * out, far + across * across
    within = Window.partitionBy(*keys, "cell")
    return pairs.withColumn("near", near).withColumn("least", F.min(far).over(within)).where("near <= least").select(*keys, "cell", "idx", "pr", "pg", "pb")


def key_of(rgb: Column) -> Column:
    """Distance to a candidate and its index in one integer (the distance is under 2**18): a minimum of it is a hash aggregate."""
    return color.squared_distance(color.unpack(rgb), (F.col("pr"), F.col("pg"), F.col("pb"))) * 256 + F.col("idx")


def nearest(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """(rgb, idx, d2) of each distinct ``rgb``: the least squared distance, of equals the lowest index."""
    own = colors.select("rgb").distinct().withColumn("cell", cell_of(F.col("rgb")))
    near = F.broadcast(candidates(own, palette.where(F.col("idx") < MATCHED)))
    best = own.join(near, "cell").groupBy("rgb").agg(F.min(key_of(F.col("rgb"))).alias("k"))
    return best.select("rgb", F.col("k").bitwiseAND(255).alias("idx"), F.shiftright("k", 8).alias("d2"))


def exact_then_nearest(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """(rgb, idx, exact) of each distinct ``rgb``; only misses are searched for."""
    found = colors.select("rgb").distinct().join(F.broadcast(keyed(palette)), "rgb", "left")
    hit = found.where("idx is not null").select("rgb", "idx", F.lit(True).alias("exact"))
    miss = nearest(found.where("idx is null"), palette).select("rgb", "idx", F.lit(False).alias("exact"))
    return hit.unionByName(miss)


def indexed(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """``pixels`` (argb, ...) with idx: the transparent index below half opacity, else the colour's entry."""
    own = pixels.withColumn("rgb", F.col("argb").bitwiseAND(0xFFFFFF)).withColumn("opaque", color.is_opaque(F.col("argb")))
    table = exact_then_nearest(own.where("opaque"), palette).select("rgb", "idx")
    return own.join(table, "rgb", "left").withColumn("idx", F.when(F.col("opaque"), F.col("idx")).otherwise(TRANSPARENT)).drop("rgb", "opaque")


def dereferenced(pixels: DataFrame, palette: DataFrame, transparent: int = TRANSPARENT) -> DataFrame:
    """``pixels`` (idx, ...) with argb: opaque palette colours, 0 at the transparent index."""
    pal = F.broadcast(palette.select(F.col("idx"), color.argb(F.lit(255), color.pack(F.col("r"), F.col("g"), F.col("b"))).alias("argb")))
    return pixels.join(pal, "idx", "left").withColumn("argb", F.when(F.col("idx") == transparent, F.lit(0)).otherwise(F.coalesce("argb", color.argb(F.lit(255), F.lit(0)))))


def chroma(palette: DataFrame) -> DataFrame:
    y, cb, cr = color.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return palette.select("idx", y.alias("y"), cb.alias("cb"), cr.alias("cr"))


def _pairs(palette: DataFrame) -> DataFrame:
    a = chroma(palette).select(F.col("idx").alias("i"), F.col("y").alias("y1"), F.col("cb").alias("cb1"), F.col("cr").alias("cr1"))
    b = F.broadcast(chroma(palette).select(F.col("idx").alias("j"), F.col("y").alias("y2"), F.col("cb").alias("cb2"), F.col("cr").alias("cr2")))
    d2 = color.squared_distance((F.col("y1"), F.col("cb1"), F.col("cr1")), (F.col("y2"), F.col("cb2"), F.col("cr2")))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", d2.alias("d2"))


def near_pairs(palette: DataFrame, radius: int) -> DataFrame:
    """Pairs i < j of entries of one palette (256 rows) within ``radius`` in YCbCr."""
    return _pairs(palette).where(F.col("d2") <= radius * radius)


def closest_pair(palette: DataFrame) -> DataFrame:
    """The nearest two entries; of equals the first pair."""
    best = _pairs(palette).agg(F.min(F.struct("d2", "i", "j")).alias("m"))
    return best.select("m.i", "m.j", "m.d2")
