"""Files as rows. Spark lists and reads them (``binaryFile``); one file is parsed in one call, files in parallel.

Each reader takes ``strict``: broken files raise, or come back as rows with an ``error`` and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.codec import block, picture, riff, view
from tessella.codec.errors import FormatError
from tessella.functions import binary as fields
from tessella.functions import paths
from tessella.shipping import ship

ENTRIES = "array<struct<r:int,g:int,b:int,meta:int>>"


def binary(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, content) of files; only readers that need the content make Spark read it."""
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "content")


def parsed(files: DataFrame, parse: Callable[[bytes], list[dict]], fields: str, strict: bool) -> DataFrame:
    """Rows of ``parse`` for each file, with its path and, if not strict, the reason why there are none."""
    names = [f.split(" ")[0] for f in fields.replace(", ", ",").split(",") if " " in f]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows, error = parse(bytes(content)), None
                except FormatError as e:
                    if strict:
                        raise FormatError(f"{path}: {e}") from e
                    rows, error = [{}], str(e)
                out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
                out.insert(0, "path", path)
                out["error"] = error
                yield out

    return files.mapInPandas(run, f"path string, {fields}, error string")


def _entries(rows: list[tuple]) -> list[dict]:
    return [dict(zip(("idx", "r", "g", "b", "meta"), (i, *e), strict=True)) for i, e in enumerate(rows)]


PALETTE = "idx int, r int, g int, b int, meta int"


def riff_palettes(files: DataFrame, strict: bool = True) -> DataFrame:
    return parsed(files, lambda d: _entries(riff.read(d)), PALETTE, strict)


def block_palettes(files: DataFrame, strict: bool = True) -> DataFrame:
    return parsed(files, lambda d: _entries(block.parse(d)[0]), PALETTE, strict)


def scanned_palettes(files: DataFrame) -> DataFrame:
    """The best palette block anywhere in each file; files without one give no row."""

    def best(d: bytes) -> list[dict]:
        found = block.scan(d)
        return [] if found is None else [r | {"n_colors": found[1], "off": found[2]} for r in _entries(found[0])]

    return parsed(files, best, f"{PALETTE}, n_colors int, off long", True).drop("error")


def pictures(files: DataFrame, strict: bool = True) -> DataFrame:
    """(path, width, height, pixels, palette as hex of r, g, b)."""

    def one(d: bytes) -> list[dict]:
        p = picture.read(d)
        return [{"width": p.width, "height": p.height, "pixels": p.pixels, "palette": b"".join(bytes(c) for c in p.palette).hex().upper()}]

    return parsed(files, one, "width int, height int, pixels binary, palette string", strict)


def frames(files: DataFrame, strict: bool = True, pad: bool = False) -> DataFrame:
    """A row for each cel, and one for each mirror: its pixels stay where they are referred to.

    With ``pad`` every loop has as many rows as the longest: a mirror has its row at each place, and a place that a loop of
    images lacks mirrors the loop itself."""

    def all_of(d: bytes) -> list[dict]:
        v = view.decode(d)
        colors = b"".join(bytes(c) for c in v.palette).hex().upper()
        out, most = [], max([1, *(len(loop.cels) for loop in v.loops)])
        for k, loop in enumerate(v.loops):
            base = {"variant": v.variant, "loop": k, "mirror_of": loop.mirror_of, "palette": colors}
            if pad:
                out += [base | {"kind": "mirror", "cel": j, "mirror_of": k if loop.mirror_of is None else loop.mirror_of} for j in range(len(loop.cels), most)]
            elif loop.mirror_of is not None:
                out.append(base | {"kind": "mirror"})
            out += [base | {"kind": "image", "cel": j, "width": c.width, "height": c.height, "x_hot": c.x_hot, "y_hot": c.y_hot, "transparent": c.transparent, "pixels": c.pixels} for j, c in enumerate(loop.cels)]
        return out

    return parsed(files, all_of, "variant string, loop int, mirror_of int, palette string, kind string, cel int, width int, height int, x_hot int, y_hot int, transparent int, pixels binary", strict)


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data): PNG, JPEG, BMP, TIFF as Spark decodes them; data is BGR or BGRA."""
    return spark.read.format("image").option("dropInvalid", "true").load(path).select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def image_pixels(loaded: DataFrame) -> DataFrame:
    """(path, x, y, argb) of :func:`images`' rows, unpacked in the JVM: images to rows of bytes, and those to pixels."""
    n = F.col("channels")
    rows = loaded.where("width > 0 and height > 0").select("path", "width", "channels", "data", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
    rows = rows.select("path", "width", "channels", "y", F.col("data").substr(F.col("y") * F.col("width") * n + 1, F.col("width") * n).alias("row"))
    own = rows.select("path", "channels", "y", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))
    part = lambda c: fields.u8(F.col("row"), F.col("x") * n + c)
    grey = n == 1
    b, g, r = part(0), F.when(grey, part(0)).otherwise(part(1)), F.when(grey, part(0)).otherwise(part(2))
    a = F.when(n == 4, part(3)).otherwise(F.lit(255))
    pixel = F.shiftleft(a, 24).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)
    return own.select("path", "x", "y", pixel.alias("argb"))


def loop_images(spark: SparkSession, folder: str) -> DataFrame:
    """The images of a folder whose names have a loop's number, like ``102-3-0.bmp``: :func:`images`' columns and ``loop``."""
    return images(spark, folder).withColumn("loop", paths.loop_of(F.col("path"))).where("loop is not null")
