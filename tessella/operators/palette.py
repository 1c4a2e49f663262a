"""Palettes as rows (idx, r, g, b, meta), 256 of them when whole. All built-in, no shuffle beyond a join on idx."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 256
CHANNELS = ("r", "g", "b", "meta")


def slots(spark: SparkSession) -> DataFrame:
    return spark.range(SIZE).select(F.col("id").cast("int").alias("idx"))


def grey_ramp(spark: SparkSession) -> DataFrame:
    """The default palette: r = g = b = idx."""
    i = F.col("idx")
    return slots(spark).select(i, i.alias("r"), i.alias("g"), i.alias("b"), F.lit(0).alias("meta"))


def padded(entries: DataFrame) -> DataFrame:
    """256 rows: entries beyond the end go, missing ones are black; of entries with one index the largest counts."""
    one = entries.where(F.col("idx").between(0, SIZE - 1)).groupBy("idx").agg(F.max(F.struct(*CHANNELS)).alias("e"))
    own = F.broadcast(one.select("idx", "e.*"))  # at most 256 rows
    return slots(entries.sparkSession).join(own, "idx", "left").select("idx", *[F.coalesce(c, F.lit(0)).alias(c) for c in CHANNELS])


def with_meta(palette: DataFrame, meta: int) -> DataFrame:
    """Colours kept, every meta byte the same: 0 towards RIFF, the remap value towards the block form."""
    return palette.withColumn("meta", F.lit(meta))


def placed(entries: DataFrame, start: int, over: DataFrame) -> DataFrame:
    """Entries (ord, r, g, b, meta) from index ``start`` on, over a base palette. Later duplicates win; the rest is dropped."""
    at = entries.withColumn("idx", F.coalesce(F.col("at"), F.col("ord") + start) if "at" in entries.columns else F.col("ord") + start).where(F.col("idx").between(0, SIZE - 1))
    last = at.groupBy("idx").agg(F.max(F.struct("ord", *CHANNELS)).alias("e")).select("idx", *[F.col(f"e.{c}").alias(f"new_{c}") for c in CHANNELS])
    return over.join(F.broadcast(last), "idx", "left").select("idx", *[F.coalesce(f"new_{c}", c).alias(c) for c in CHANNELS])


def color_at(palette: DataFrame, idx: int) -> DataFrame:
    return palette.where(F.col("idx") == idx)


def with_color(palette: DataFrame, idx: int, r: int, g: int, b: int) -> DataFrame:
    hit = F.col("idx") == idx
    return palette.select("idx", *[F.when(hit, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zip("rgb", (r, g, b), strict=True)], "meta")


def grid(palette: DataFrame, side: int = 16) -> DataFrame:
    """Cells of the display: the reserved last entry is shown white."""
    shown = lambda c: F.when(F.col("idx") == SIZE - 1, F.lit(255)).otherwise(F.col(c)).alias(c)
    return palette.select("idx", (F.col("idx") % side).alias("x"), F.expr(f"int(idx div {side})").alias("y"), shown("r"), shown("g"), shown("b"))


def rgb_key(r: str = "r", g: str = "g", b: str = "b") -> Column:
    from tessella.functions.color import pack

    return pack(F.col(r), F.col(g), F.col(b))
