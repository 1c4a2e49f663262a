"""Nearest-neighbour resampling: a target pixel reads the source pixel under its centre; source pixels go where they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANVAS = (640, 480)
#: Keys that an image's rows are dealt over.
SLOTS = 16


def contain_scale(w: Column, h: Column, to: tuple[int, int]) -> Column:
    """Largest scale at which all fits, never above 1."""
    return F.least(F.lit(1.0), F.lit(float(to[0])) / w, F.lit(float(to[1])) / h)


def cover_scale(w: Column, h: Column, to: tuple[int, int]) -> Column:
    """Least scale at which nothing stays empty."""
    return F.greatest(F.lit(float(to[0])) / w, F.lit(float(to[1])) / h)


def scaled(n: Column, scale: Column) -> Column:
    """A side at a scale: rounded half to even, at least 1."""
    return F.greatest(F.lit(1), F.rint(n * scale).cast("int"))


def source_of(at: Column, source: Column, target: Column) -> Column:
    """The source coordinate under the centre of a target pixel."""
    return F.least(source - 1, F.floor((at + 0.5) * source / target).cast("int"))


def targets(images: DataFrame, to: tuple[int, int] = CANVAS, cover: bool = False) -> DataFrame:
    """(img, w, h, tw, th, dx, dy): the resized sides and where they start on the canvas; dx and dy may be negative."""
    scale = (cover_scale if cover else contain_scale)(F.col("w"), F.col("h"), to)
    own = images.withColumn("scale", scale).withColumn("tw", scaled(F.col("w"), F.col("scale"))).withColumn("th", scaled(F.col("h"), F.col("scale")))
    return own.select("img", "w", "h", "tw", "th", F.expr(f"int(({to[0]} - tw) div 2)").alias("dx"), F.expr(f"int(({to[1]} - th) div 2)").alias("dy"))


def targets_of(at: Column, source: Column, target: Column, start: Column, side: int) -> Column:
    """The target coordinates on a canvas of that side whose pixel reads the source coordinate ``at``; null if there are none.

    A step more than the exact range either way, then those that :func:`source_of` sends to ``at``."""
    near = lambda k: F.floor(k * target / source).cast("int")
    lo = F.greatest(near(at) - 1, F.lit(0), -start)
    hi = F.least(near(at + 1) + 1, target - 1, F.lit(side - 1) - start)
    return F.when(lo <= hi, F.filter(F.sequence(lo, hi), lambda k: source_of(k, source, target) == at))


def resized(pixels: DataFrame, images: DataFrame, to: tuple[int, int] = CANVAS, cover: bool = False) -> DataFrame:
    """Pixels (img, x, y, v) of the resized image on canvas coordinates, cut to the canvas.

    Each source pixel names its targets, so pixels meet only their image's row. Rows that are made by explode count as nothing
    in Spark's sizes: a grid of targets, or exploded pixels, might go to the driver whole. So the join is one by sorting, and a
    large image's rows of pixels are dealt over SLOTS keys."""
    t = targets(images, to, cover).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))))
    own = pixels.withColumn("slot", F.pmod("y", F.lit(SLOTS))).hint("merge").join(t, ["img", "slot"])
    own = own.select("*", F.explode(targets_of(F.col("x"), F.col("w"), F.col("tw"), F.col("dx"), to[0])).alias("tx"))
    own = own.select("*", F.explode(targets_of(F.col("y"), F.col("h"), F.col("th"), F.col("dy"), to[1])).alias("ty"))
    return own.select("img", (F.col("tx") + F.col("dx")).alias("x"), (F.col("ty") + F.col("dy")).alias("y"), "v")


def on_canvas(pixels: DataFrame, images: DataFrame, to: tuple[int, int] = CANVAS, empty: int = 255) -> DataFrame:
    """Every canvas pixel of each image; where there is none, ``empty``."""
    grid = images.select("img").crossJoin(F.broadcast(pixels.sparkSession.range(to[0] * to[1]).select(F.expr(f"int(id % {to[0]})").alias("x"), F.expr(f"int(id div {to[0]})").alias("y"))))
    return grid.join(pixels, ["img", "x", "y"], "left").select("img", "x", "y", F.coalesce("v", F.lit(empty)).alias("v"))
