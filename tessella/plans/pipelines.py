"""From pixels to files: the two conversions as one plan each.

Pixels are rows (path, x, y, argb), for views with loop and cel too. Colours are quantised and looked up once per distinct
colour and image. A picture, at most a canvas of pixels, is made in one call; pixels of views are only joined, packed and
written.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.codec import picture
from tessella.codec.errors import need
from tessella.functions import binary, color
from tessella.operators import lookup, quantize, resample
from tessella.shipping import ship
from tessella.sources import build

_RGB = ("r", "g", "b")


def _with_rgb(pixels: DataFrame) -> DataFrame:
    r, g, b = color.unpack(F.col("argb"))
    return pixels.select("*", F.col("argb").bitwiseAND(0xFFFFFF).alias("rgb"), r.alias("r"), g.alias("g"), b.alias("b"))


def _table(colors: np.ndarray, form: str, merge_radius: int | None) -> np.ndarray:
    """The 256 entries for distinct colours (n, 3) in first-seen order."""
    table = (quantize.picture_palette if form == "picture" else quantize.view_palette)(colors)
    return table if merge_radius is None else np.array(quantize.merge_near([tuple(c) for c in table], radius=merge_radius))


def _closest(colors: np.ndarray, table: np.ndarray, slice_: int = 4096) -> np.ndarray:
    """For each of ``colors`` (n, 3) the nearest of the first 255 entries; of equals the lowest."""
    own = table[: lookup.MATCHED].astype(np.int64)
    parts = [((colors[k : k + slice_, None] - own) ** 2).sum(axis=2).argmin(axis=1) for k in range(0, len(colors), slice_)]
    return np.concatenate(parts).astype(np.uint8)


def _palettes(colors: DataFrame, form: str, merge_radius: int | None) -> DataFrame:
    """(path, palette, rgb as hex) of distinct colours (path, r, g, b, ord); a group is one image's colours."""
    ship(colors.sparkSession)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        table = _table(part.sort_values("ord")[list(_RGB)].to_numpy(), form, merge_radius)
        return pd.DataFrame({"path": part["path"].iloc[:1], "table": [bytes(table.astype(np.uint8).tobytes())]})

    return colors.groupBy("path").applyInPandas(of, "path string, table binary")


def _nearest(colors: DataFrame, tables: DataFrame) -> DataFrame:
    """(path, rgb, idx): each distinct colour's nearest entry among the first 255 of its own image's palette."""
    at = F.explode(F.sequence(F.lit(0), F.lit(254)))
    entries = tables.select("path", "table", at.alias("idx")).select("path", "idx", *[binary.u8(F.col("table"), F.col("idx") * 3 + k).alias(f"p{c}") for k, c in enumerate(_RGB)])
    first = entries.groupBy("path", color.pack(F.col("pr"), F.col("pg"), F.col("pb")).alias("rgb")).agg(F.min("idx").alias("hit"))
    seen = colors.select("path", "rgb").distinct().join(first, ["path", "rgb"], "left")
    # only colours that no entry equals are compared, with the entries near their cell
    miss = seen.where("hit is null").withColumn("cell", lookup.cell_of(F.col("rgb")))
    near = lookup.candidates(miss, entries.select("path", "idx", *[F.col(f"p{c}").alias(c) for c in _RGB]), "path")
    miss = miss.join(near, ["path", "cell"])
    miss = miss.groupBy("path", "rgb").agg(F.min(lookup.key_of(F.col("rgb"))).bitwiseAND(255).alias("idx"))
    return seen.where("hit is not null").select("path", "rgb", F.col("hit").alias("idx")).unionByName(miss)


def looked_up(pixels: DataFrame, merge_radius: int | None = None) -> DataFrame:
    """(path, rgb, idx): each distinct colour of pixels (path, pos, r, g, b) in its own image's picture palette."""
    rgb = color.pack(*map(F.col, _RGB)).alias("rgb")
    colors = pixels.groupBy("path", rgb, *_RGB).agg(F.min("pos").alias("ord"))
    return _nearest(colors, _palettes(colors, "picture", merge_radius))


def _packed(order: Column) -> Column:
    return F.unhex(binary.joined(order, F.lpad(F.hex("v"), 2, "0")))


def pictures_from_pixels(pixels: DataFrame, merge_radius: int | None = None, to: tuple[int, int] = resample.CANVAS, cover: bool = False) -> DataFrame:
    """(path, content) of picture files: resized into the canvas, quantised, looked up, centred; alpha is ignored."""
    images = pixels.groupBy("path").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).withColumnRenamed("path", "img")
    small = resample.resized(pixels.select(F.col("path").alias("img"), "x", "y", F.col("argb").bitwiseAND(0xFFFFFF).alias("v")), images, to, cover)
    own = small.select(F.col("img").alias("path"), (F.col("y") * to[0] + F.col("x")).alias("pos"), F.col("v").alias("rgb"))
    ship(pixels.sparkSession)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        at, rgb = part["pos"].to_numpy(), part["rgb"].to_numpy()
        need(len(np.unique(at)) == len(at), "pixels repeat")
        colors, first, place = np.unique(rgb[np.argsort(at)], return_index=True, return_inverse=True)
        channels = np.stack([colors >> 16, colors >> 8 & 255, colors & 255], axis=1).astype(np.int64)
        table = _table(channels[np.argsort(first)], "picture", merge_radius)
        canvas = np.full(to[0] * to[1], picture.TRANSPARENT, dtype=np.uint8)
        canvas[np.sort(at)] = _closest(channels, table)[place]
        return pd.DataFrame({"path": part["path"].iloc[:1], "content": [picture.write(canvas.tobytes(), table.tolist(), *to)]})

    # a few megabytes of small pictures are minutes of Python: partitions are not joined by their size
    parts = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return own.repartition(parts, "path").groupBy("path").applyInPandas(of, "path string, content binary")


def views_from_pixels(pixels: DataFrame, mirrors: DataFrame | None = None, **options) -> DataFrame:
    """(path, content) of view files; the palette is that of the first cel of the first loop, mirrors are (path, loop, mirror_of).

    ``options`` are those of :func:`build.view_files`."""
    own = _with_rgb(pixels).withColumn("opaque", color.is_opaque(F.col("argb")))
    first = own.where("loop = 0 and cel = 0 and opaque").groupBy("path", "rgb", *_RGB).agg(F.min(F.struct("y", "x")).alias("ord"))
    tables = _palettes(first.select("path", *_RGB, (F.col("ord.y") * 65536 + F.col("ord.x")).alias("ord")), "view", None)
    looked = _nearest(own.where("opaque"), tables)
    indexed = own.join(looked, ["path", "rgb"], "left").withColumn("v", F.when(F.col("opaque"), F.col("idx")).otherwise(255))
    frames = indexed.groupBy("path", "loop", "cel").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), _packed(F.struct("y", "x")).alias("pixels"))
    frames = frames.select("*", F.lit("image").alias("kind"), F.lit(None).cast("int").alias("mirror_of"))
    if mirrors is not None:
        blank = {"cel": F.lit(0), "width": F.lit(0), "height": F.lit(0), "pixels": F.lit(None).cast("binary"), "kind": F.lit("mirror")}
        frames = frames.unionByName(mirrors.select("path", "loop", "mirror_of").withColumns(blank))
    made = frames.join(tables.select("path", F.hex("table").alias("palette")), "path").withColumns({"x_hot": F.lit(0), "y_hot": F.lit(0), "transparent": F.lit(255)})
    return build.view_files(made, **options)
