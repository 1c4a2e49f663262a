"""Headers of views as rows, by offset arithmetic on the bytes in the JVM; no file is decoded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.codec.view import LOOP_HEADER, STAMP, VARIANTS
from tessella.functions.binary import s16, u8, u16, u32




def view_headers(files: DataFrame) -> DataFrame:
    """One row a file; ``variant`` is null where the header is none of a view."""
    at = lambda k: STAMP + k
    size = u16(F.col("content"), at(0))
    variant = F.coalesce(*[F.when(size == v, F.lit(k)) for k, v in VARIANTS.items()])
    return files.select("path", variant.alias("variant"), size.alias("size"), u16(F.col("content"), at(2)).alias("loops"), u16(F.col("content"), at(4)).alias("flags_a"), u16(F.col("content"), at(6)).alias("flags_b"), u32(F.col("content"), at(8)).alias("palette_at"), u8(F.col("content"), at(12)).alias("loop_header"), u8(F.col("content"), at(13)).alias("cel_header"), u16(F.col("content"), at(14)).alias("res_x"), u16(F.col("content"), at(16)).alias("res_y"))


def loop_headers(files: DataFrame) -> DataFrame:
    """One row a loop: whether it mirrors another, its cels, where their headers start, and the stride of those."""
    own = files.select("path", "content", u16(F.col("content"), STAMP).alias("size"), u16(F.col("content"), STAMP + 2).alias("n"), u8(F.col("content"), STAMP + 13).alias("stride")).where("n > 0")
    own = own.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("loop"))
    base = F.lit(STAMP + 2) + F.col("size") + F.col("loop") * LOOP_HEADER
    b0, b1, b2 = u8(F.col("content"), base), u8(F.col("content"), base + 1), u8(F.col("content"), base + 2)
    mirror = (b1 == 1) & (b2 == 0) & (b0 != 0xFF)
    return own.select("path", "content", "stride", "loop", mirror.alias("is_mirror"), F.when(mirror, b0).alias("mirror_of"), F.when(mirror, 0).otherwise(b2).alias("n_cels"), u32(F.col("content"), base + 12).alias("table_at"))


def cel_headers(files: DataFrame) -> DataFrame:
    """One row a cel: size, hot spot, transparent index, byte counts and the bases of its three tables."""
    own = loop_headers(files).where("n_cels > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n_cels") - 1)).alias("cel"))
    at = lambda k: F.lit(STAMP + k) + F.col("table_at").cast("int") + F.col("cel") * F.col("stride")
    return own.select("path", "loop", "cel", u16(F.col("content"), at(0)).alias("w"), u16(F.col("content"), at(2)).alias("h"), s16(F.col("content"), at(4)).alias("x_hot"), s16(F.col("content"), at(6)).alias("y_hot"), u8(F.col("content"), at(8)).alias("transparent"), (u32(F.col("content"), at(12)) - u32(F.col("content"), at(16))).alias("data_bytes"), u32(F.col("content"), at(16)).alias("control_bytes"), u32(F.col("content"), at(24)).alias("control_at"), u32(F.col("content"), at(28)).alias("data_at"), u32(F.col("content"), at(32)).alias("rows_at"))
