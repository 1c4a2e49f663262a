"""Offsets as prefix sums, references between loops, and the order of cels and loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOOP_HEADER, CEL_HEADER = 16, 0x34


def before(value: str, keys: list[str], order: list[str]) -> Column:
    """The exclusive running sum of ``value`` within ``keys``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(value).over(w) - F.col(value)


def row_offsets(lengths: DataFrame, frame: str, row: str) -> DataFrame:
    """Where each row's control and data bytes start in its frame."""
    return lengths.select(frame, row, before("control", [frame], [row]).alias("control_at"), before("data", [frame], [row]).alias("data_at"))


def frame_slices(lengths: DataFrame, view: str, order: list[str]) -> DataFrame:
    """Where each frame's bytes start in its view, and how many there are until the next one starts."""
    starts = lengths.withColumn("at", before("size", [view], order)).withColumn("total", F.sum("size").over(Window.partitionBy(view)))
    return starts.select(view, *order, "at", (F.lead("at", 1).over(Window.partitionBy(view).orderBy(*order))).alias("next"), "total").select(view, *order, "at", (F.coalesce("next", "total") - F.col("at")).alias("size"))


def cel_tables(loops: DataFrame, view: str, header: int) -> DataFrame:
    """Per loop the ordinal of its first cel header and the offset of its table.

    A mirror has no cels: its ordinal is null and its offset that of the next loop that is no mirror, or the end."""
    image = F.col("kind") != "mirror"
    own = loops.withColumn("n", F.when(image, F.col("n_cels")).otherwise(0))
    own = own.withColumn("first", F.when(image, before("n", [view], ["lp"]))).withColumn("loops", F.count(F.lit(1)).over(Window.partitionBy(view))).withColumn("cels", F.sum("n").over(Window.partitionBy(view)))
    base = F.lit(header) + F.col("loops") * LOOP_HEADER
    own = own.withColumn("own_at", F.when(image, base + F.col("first") * CEL_HEADER))
    ahead = F.first("own_at", ignorenulls=True).over(Window.partitionBy(view).orderBy("lp").rowsBetween(1, Window.unboundedFollowing))
    return own.withColumn("ahead", ahead).select(view, "lp", "kind", "first", F.coalesce("own_at", "ahead", base + F.col("cels") * CEL_HEADER).alias("table_at"))


def mirror_targets(loops: DataFrame, key: str) -> DataFrame:
    """Mirrors beside the loop they refer to; a reference is kept, nothing is flipped."""
    t = loops.select(F.col("lp").alias("t_lp"), F.col("kind").alias("target_kind"), F.col("n_cels").alias("target_cels"), F.col(key).alias("t_key"))
    return loops.where("kind = 'mirror'").join(t, (F.col("mirror_of") == F.col("t_lp")) & (F.col(key) == F.col("t_key")), "left").select(key, "lp", "mirror_of", "target_kind", "target_cels")


def ragged(frames: DataFrame, view: str) -> DataFrame:
    """All (loop, cel) places up to the largest numbers of each; a missing one mirrors its own loop."""
    size = frames.groupBy(view).agg(F.max("lp").alias("ml"), F.max("cel").alias("mc"))
    grid = size.select(view, F.explode(F.sequence(F.lit(0), F.col("ml"))).alias("lp"), "mc").select(view, "lp", F.explode(F.sequence(F.lit(0), F.col("mc"))).alias("cel"))
    return grid.join(frames.select(view, "lp", "cel", "kind", "mirror_of"), [view, "lp", "cel"], "left").select(view, "lp", "cel", F.coalesce("kind", F.lit("mirror")).alias("kind"), F.when(F.col("kind").isNull(), F.col("lp")).otherwise(F.col("mirror_of")).alias("mirror_of"))


def transposed(frames: DataFrame, view: str) -> DataFrame:
    """Frames numbered loop by loop, and cel by cel within a loop."""
    return frames.withColumn("ord", F.row_number().over(Window.partitionBy(view).orderBy("lp", "cel")) - 1)


def sections(sizes: DataFrame) -> DataFrame:
    """Offsets of a view's sections from the byte sizes of those before: headers, palette, image chunk, row tables."""
    chunk = 6
    palette = F.col("headers")
    image = palette + chunk + F.col("palette")
    control = image + chunk
    data = control + F.col("control")
    return sizes.select("*", palette.alias("palette_at"), image.alias("image_at"), control.alias("control_at"), data.alias("data_at"), (data + F.col("data") + chunk).alias("rows_at"))
