"""Files from rows: the (path, content) pairs that the sink writes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.codec import picture, png, view
from tessella.functions import binary, paths
from tessella.shipping import ship

#: RIFF sizes and version, the block's size and header, as little-endian hex.
RIFF_HEAD = "52494646" + "10040000" + "50414C20" + "64617461" + "04040000" + "0003" + "0001"
BLOCK_HEAD = "0003" + "25040000" + "0000" + "0E" + "47454E50414C000000" + "01" + "0000" + "00" * 10 + "00" + "00" + "0000" + "0001" + "01" + "00" + "00000000"


def _byte(c: str):
    return F.lpad(F.hex(F.col(c).cast("long")), 2, "0")


def riff_files(palettes: DataFrame, key: str) -> DataFrame:
    """(key, content as hex) of whole palettes; 256 rows a group."""
    return palettes.groupBy(key).agg(F.concat(F.lit(RIFF_HEAD), binary.joined(F.col("idx"), F.concat(*map(_byte, ("r", "g", "b", "meta"))))).alias("hex"))


def block_files(palettes: DataFrame, key: str) -> DataFrame:
    return palettes.groupBy(key).agg(F.concat(F.lit(BLOCK_HEAD), binary.joined(F.col("idx"), F.concat(F.lit("00"), *map(_byte, "rgb")))).alias("hex"))


def content(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.unhex("hex")).drop("hex")


def picture_files(canvases: DataFrame) -> DataFrame:
    """(path, content) of (path, pixels binary, palette array<struct<r,g,b>>, width, height): each row by itself."""
    ship(canvases.sparkSession)

    def run(parts):
        for part in parts:
            files = [picture.write(bytes(p), [tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in colors], int(w), int(h)) for p, colors, w, h in zip(part["pixels"], part["palette"], part["width"], part["height"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "content": files})

    return canvases.mapInPandas(run, "path string, content binary")


def view_files(frames: DataFrame, variant: str = view.View.variant, resolution: tuple[int, int] = view.View.resolution, stamp: bytes = view.DEFAULT_STAMP, flags: tuple[int, int] = view.View.flags, cel_header: int = view.View.cel_header, extra: int = view.View.extra) -> DataFrame:
    """(path, content) of frames (path, loop, cel, kind, mirror_of, width, height, x_hot, y_hot, transparent, pixels, palette).

    A group is one view, which is one file; the options are those of its header."""
    ship(frames.sparkSession)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["loop", "cel"])
        loops = []
        for _, own in part.groupby("loop", sort=True):
            if (own["kind"] == "mirror").any():
                loops.append(view.Loop(mirror_of=int(own["mirror_of"].iloc[0])))
            else:
                loops.append(view.Loop([view.Cel(int(r.width), int(r.height), bytes(r.pixels), int(r.x_hot), int(r.y_hot), int(r.transparent)) for r in own.itertuples()]))
        colors = bytes.fromhex(part["palette"].iloc[0])
        v = view.View(loops, [tuple(colors[3 * i : 3 * i + 3]) for i in range(256)], variant, resolution, flags, cel_header, extra)
        return pd.DataFrame({"path": [part["path"].iloc[0]], "content": [view.encode(v, stamp)]})

    return frames.groupBy("path").applyInPandas(of, "path string, content binary")


def _rgba(palette: str, pixels: bytes, transparent: int | None = None) -> bytes:
    """Opaque colours of indices, all zero at the transparent one."""
    table = np.full((256, 4), 255, dtype=np.uint8)
    table[:, :3] = np.frombuffer(bytes.fromhex(palette), dtype=np.uint8).reshape(256, 3)
    if transparent is not None:
        table[transparent] = 0
    return table[np.frombuffer(bytes(pixels), dtype=np.uint8)].tobytes()


def frame_dump(frames: DataFrame) -> DataFrame:
    """(path, content): a PNG for each image, an empty note for each mirror, below ``Cell{i}/Loop{j}/``."""
    ship(frames.sparkSession)

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples():
                if r.kind == "mirror":
                    out.append(b"")
                    continue
                out.append(png.write(int(r.width), int(r.height), _rgba(r.palette, r.pixels, int(r.transparent))))
            yield pd.DataFrame({"path": part["to"], "content": out})

    named = frames.withColumn("to", F.concat(paths.stem(F.col("path")), F.lit("/"), paths.frame_path(F.coalesce("cel", F.lit(0)), F.col("loop"), F.col("mirror_of"))))
    return named.mapInPandas(run, "path string, content binary")


def picture_images(pictures: DataFrame) -> DataFrame:
    """(path, content): the PNG of each decoded picture (path, width, height, pixels, palette as hex)."""
    ship(pictures.sparkSession)

    def run(parts):
        for part in parts:
            out = []
            for r in part.itertuples():
                out.append(png.write(int(r.width), int(r.height), _rgba(r.palette, r.pixels)))
            yield pd.DataFrame({"path": part["path"], "content": out})

    return pictures.select(F.concat(paths.stem(F.col("path")), F.lit(".png")).alias("path"), "width", "height", "pixels", "palette").mapInPandas(run, "path string, content binary")


def image_structs(pixels: DataFrame) -> DataFrame:
    """(path, image): pixels (path, x, y, argb) as Spark's image struct, four channels, BGRA."""
    own = F.col("argb")
    part = lambda shift: F.lpad(F.hex(F.shiftright(own, shift).bitwiseAND(255).cast("long")), 2, "0")
    data = F.unhex(binary.joined(F.struct("y", "x"), F.concat(part(0), part(8), part(16), part(24))))
    made = pixels.groupBy("path").agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), data.alias("data"))
    return made.select("path", F.struct(F.col("path").alias("origin"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit(4).alias("nChannels"), F.lit(24).alias("mode"), "data").alias("image"))
