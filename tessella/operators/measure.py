"""Histograms, bounds and totals of pixels and frames; partial aggregates first, as Spark plans them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color


def histogram(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img", color.pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).agg(F.count(F.lit(1)).alias("n"))


def first_seen(pixels: DataFrame) -> DataFrame:
    """Distinct opaque colours of each image in scan order: (img, rgb, ord)."""
    opaque = pixels.where(F.col("a") >= color.OPAQUE)
    own = opaque.groupBy("img", color.pack(F.col("r"), F.col("g"), F.col("b")).alias("rgb")).agg(F.min("pos").alias("pos"))
    return own.select("img", "rgb", (F.row_number().over(Window.partitionBy("img").orderBy("pos")) - 1).alias("ord"))


def bounds(pixels: DataFrame, *keys: str) -> DataFrame:
    return pixels.groupBy(*keys).agg(*[f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("min", F.min), ("max", F.max))])


def mean_color(colors: DataFrame, *keys: str) -> DataFrame:
    """Whole-number means of distinct colours, rounded towards zero."""
    return colors.groupBy(*keys).agg(*[F.expr(f"int(sum({c}) div count(*))").alias(c) for c in "rgb"], F.count(F.lit(1)).alias("n"))


def highest_index(pixels: DataFrame, *keys: str) -> DataFrame:
    """The largest index, and whether the reserved one is free."""
    return pixels.groupBy(*keys).agg(F.max("idx").alias("top")).withColumn("usable", F.col("top") <= 254)


def loop_totals(loops: DataFrame) -> DataFrame:
    return loops.agg(F.sum("n_cels").alias("cels"), F.max("n_cels").alias("most"), F.count_if(F.col("kind") != "mirror").alias("images"), F.count(F.lit(1)).alias("loops"))


def mirror_consistency(loops: DataFrame, key: str) -> DataFrame:
    """Per key: whether there are mirrors and images, and how many targets; a sound one has mirrors of one target or images only."""
    own = loops.groupBy(key).agg(F.bool_or(F.col("kind") == "mirror").alias("any_mirror"), F.bool_or(F.col("kind") == "image").alias("any_image"), F.count_distinct("mirror_of").alias("targets"))
    return own.withColumn("sound", ~(F.col("any_mirror") & F.col("any_image")) & (F.col("targets") <= 1))


def best_candidate(candidates: DataFrame, key: str) -> DataFrame:
    """The candidate with most colours of each key; of equals the first in the file. No sort: a maximum of structs."""
    best = candidates.groupBy(key).agg(F.max(F.struct("n", (-F.col("off")).alias("o"))).alias("m"))
    return best.select(key, F.col("m.n").alias("n"), (-F.col("m.o")).alias("off"))
