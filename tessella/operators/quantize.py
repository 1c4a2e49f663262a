"""Median cut and near-duplicate merging of palettes.

A few cuts are unrolled as window steps over all images at once. A full cut has as many data-dependent steps as colours
wanted, so it runs in one pandas call per image, on the image's distinct colours; those are at most its pixels.

Two list orders are supported. ``append``: both halves go to the end of the list of boxes. ``in_place``: the first half
keeps the place of the box, the second goes to the end. The widest box is cut; of equals the first in the list.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import color
from tessella.shipping import ship

WHITE = (255, 255, 255)


# -- unrolled


def distinct_colors(pixels: DataFrame) -> DataFrame:
    """(img, r, g, b, ord): ord follows the first pixel of a colour."""
    own = pixels.groupBy("img", "r", "g", "b").agg(F.min("pos").alias("ord"))
    return own.repartition("img")  # every step below is by image


def cut_step(state: DataFrame, step: int, in_place: bool = False) -> DataFrame:
    """Cuts the widest box of each image; ``state`` has (img, r, g, b, ord, box)."""
    box = Window.partitionBy("img", "box")
    d = state
    for c in "rgb":
        d = d.withColumn(f"w{c}", F.max(c).over(box) - F.min(c).over(box))
    d = d.withColumn("n", F.count(F.lit(1)).over(box))
    wide = F.greatest("wr", "wg", "wb")
    rank = F.when(F.col("n") > 1, F.struct(wide.alias("w"), (-F.col("box")).alias("o")))
    d = d.withColumn("pick", F.max(rank).over(Window.partitionBy("img"))).withColumn("hit", F.coalesce(-F.col("pick.o") == F.col("box"), F.lit(False)))
    channel = F.when((F.col("wr") >= F.col("wg")) & (F.col("wr") >= F.col("wb")), F.col("r")).when((F.col("wg") >= F.col("wr")) & (F.col("wg") >= F.col("wb")), F.col("g")).otherwise(F.col("b"))
    tie = ["rgb"] if in_place else ["ord"]
    d = d.withColumn("rgb", color.pack(F.col("r"), F.col("g"), F.col("b"))).withColumn("ch", channel)
    d = d.withColumn("rn", F.row_number().over(box.orderBy("ch", *tie)))
    first, second = (F.col("box"), F.lit(step)) if in_place else (F.lit(2 * step - 1), F.lit(2 * step))
    child = F.when(F.col("rn") <= F.expr("n div 2"), first).otherwise(second)
    return d.select("img", "r", "g", "b", F.when(F.col("hit"), F.col("rn")).otherwise(F.col("ord")).alias("ord"), F.when(F.col("hit"), child).otherwise(F.col("box")).alias("box"))


def cut_boxes(pixels: DataFrame, boxes: int, in_place: bool = False) -> DataFrame:
    """(img, box, n, r, g, b): the means of ``boxes`` boxes of each image, fewer if it has fewer colours."""
    state = distinct_colors(pixels).withColumn("box", F.lit(0))
    for step in range(1, boxes):
        state = cut_step(state, step, in_place)
    return state.groupBy("img", "box").agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"int(sum({c}) div count(*))").alias(c) for c in "rgb"])


# -- in full


def median_cut(colors: np.ndarray, target: int, in_place: bool) -> np.ndarray:
    """Means of at most ``target`` boxes of distinct colours (n, 3) in first-seen order, in list order."""
    if not len(colors):
        return np.zeros((0, 3), dtype=np.int64)
    spans = lambda part: (part.max(axis=0) - part.min(axis=0)).tolist()
    width = lambda part, span: max(span) if len(part) > 1 else -1
    boxes = [colors.astype(np.int64)]
    ranges = [spans(boxes[0])]
    widths = [width(boxes[0], ranges[0])]
    while len(boxes) < target:
        widest = max(widths)
        if widest < 0:
            break
        k = widths.index(widest)
        own = boxes[k]
        by = own[:, ranges[k].index(widest)]
        order = np.lexsort((own[:, 0] << 16 | own[:, 1] << 8 | own[:, 2], by)) if in_place else by.argsort(kind="stable")
        half = len(own) // 2
        parts = [own[order[:half]], own[order[half:]]]
        found = [spans(p) for p in parts]
        wide = [width(p, f) for p, f in zip(parts, found, strict=True)]
        if in_place:
            boxes[k], ranges[k], widths[k] = parts[0], found[0], wide[0]
            boxes.append(parts[1])
            ranges.append(found[1])
            widths.append(wide[1])
        else:
            del boxes[k], ranges[k], widths[k]
            boxes += parts
            ranges += found
            widths += wide
    return np.array([b.sum(axis=0) // len(b) for b in boxes])


def picture_palette(colors: np.ndarray) -> np.ndarray:
    """256 entries: black beyond the boxes' means, the last one white."""
    out = np.zeros((256, 3), dtype=np.int64)
    means = median_cut(colors, 256, in_place=False)
    out[: len(means)] = means
    out[255] = WHITE
    return out


def view_palette(colors: np.ndarray) -> np.ndarray:
    """256 entries: up to 255 colours as they were seen, else means of 255 boxes; black beyond, the last one white."""
    out = np.zeros((256, 3), dtype=np.int64)
    own = colors if len(colors) <= 255 else median_cut(colors, 255, in_place=True)
    out[: len(own)] = own
    out[255] = WHITE
    return out


def _linear(c: float) -> float:
    c /= 255.0
    return c / color.SLOPE if c <= color.SRGB_KNEE else ((c + color.OFFSET) / (1 + color.OFFSET)) ** color.GAMMA


def _byte(x: float) -> int:
    s = x * color.SLOPE if x <= color.LINEAR_KNEE else x ** (1 / color.GAMMA) * (1 + color.OFFSET) - color.OFFSET
    return max(0, min(255, round(s * 255)))


def _chroma(c: tuple[int, int, int]) -> tuple[int, int, int]:
    dot = lambda w: sum(x * y for x, y in zip(c, w, strict=True)) >> 8
    return dot(color.Y_WEIGHTS), dot(color.CB_WEIGHTS) + color.CHROMA_OFFSET, dot(color.CR_WEIGHTS) + color.CHROMA_OFFSET


class _Entry:
    def __init__(self, rgb: tuple[int, int, int], weight: int):
        self.rgb, self.weight = tuple(int(x) for x in rgb), int(weight)
        self.key = _chroma(self.rgb)

    def joined(self, other: _Entry) -> _Entry:
        """The mean in linear light, weighted; it starts again from the rounded colours each time."""
        w = self.weight + other.weight
        mix = tuple(_byte((self.weight * _linear(x) + other.weight * _linear(y)) / w) for x, y in zip(self.rgb, other.rgb, strict=True))
        return _Entry(mix, w)

    def to(self, other: _Entry) -> int:
        return sum((x - y) ** 2 for x, y in zip(self.key, other.key, strict=True))


def merge_near(colors: list[tuple[int, int, int]], weights: list[int] | None = None, wanted: int = 256, radius: int = 6) -> list[tuple[int, int, int]]:
    """Merges entries within ``radius`` in YCbCr in one forward pass, then the closest pairs until ``wanted`` are left.

    Filled up to ``wanted`` with the last entry."""
    own = [_Entry(c, w) for c, w in zip(colors, weights or [1] * len(colors), strict=True)]
    at = 0
    while at < len(own):
        other = at + 1
        while other < len(own):
            if own[at].to(own[other]) <= radius * radius:
                own[at] = own[at].joined(own.pop(other))
            else:
                other += 1
        at += 1
    keys = np.array([e.key for e in own]).reshape(-1, 3)
    far = np.iinfo(np.int64).max
    apart = ((keys[:, None] - keys[None]) ** 2).sum(axis=2)
    apart[np.tril_indices(len(own))] = far
    while len(own) > wanted:
        i, j = divmod(int(apart.argmin()), len(own))  # of equal distances the first pair
        own[i] = own[i].joined(own.pop(j))
        keys = np.delete(keys, j, axis=0)
        apart = np.delete(np.delete(apart, j, axis=0), j, axis=1)
        keys[i] = own[i].key
        d = ((keys - keys[i]) ** 2).sum(axis=1)
        apart[i, i + 1 :], apart[:i, i] = d[i + 1 :], d[:i]
    out = [e.rgb for e in own]
    return out + [out[-1]] * (wanted - len(out)) if out else out


PALETTE = "img int, idx int, r int, g int, b int"


def _as_rows(img: int, table: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"img": np.full(len(table), img, np.int32), "idx": np.arange(len(table), dtype=np.int32), **{c: table[:, k].astype(np.int32) for k, c in enumerate("rgb")}})


def palettes(pixels: DataFrame, form: str = "picture", merge_radius: int | None = None) -> DataFrame:
    """(img, idx, r, g, b), 256 rows an image; ``form`` is ``picture`` or ``view``. Works on distinct colours."""

    ship(pixels.sparkSession)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord")
        table = (picture_palette if form == "picture" else view_palette)(part[["r", "g", "b"]].to_numpy())
        if merge_radius is not None:
            table = np.array(merge_near([tuple(c) for c in table], radius=merge_radius))
        return _as_rows(int(part["img"].iloc[0]), table)

    own = pixels.groupBy("img", "r", "g", "b").agg(F.min("pos").alias("ord"))
    return own.groupBy("img").applyInPandas(of, PALETTE)


def merged_palettes(entries: DataFrame, wanted: int = 256, radius: int = 6) -> DataFrame:
    """Near-duplicate merging of palettes (img, idx, r, g, b, n); a group is a palette."""

    ship(entries.sparkSession)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        table = merge_near([tuple(c) for c in part[["r", "g", "b"]].to_numpy()], part["n"].tolist(), wanted, radius)
        return _as_rows(int(part["img"].iloc[0]), np.array(table).reshape(-1, 3))

    return entries.groupBy("img").applyInPandas(of, PALETTE)


