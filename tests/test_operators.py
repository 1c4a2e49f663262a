import random

import pytest
from pyspark.sql import functions as F

from tessella.codec import view
from tessella.functions import color, paths
from tessella.operators import layout, lookup, palette, quantize, resample, rle


def test_tokens_equal_the_codec(spark):
    rng = random.Random(3)
    rows = [[v for _ in range(rng.randint(1, 6)) for v in [rng.choice([255, 1, 2, rng.randrange(256)])] * rng.choice([1, 1, 2, 3, 62, 63, 64, 66, 128])] for _ in range(40)]
    df = spark.createDataFrame([(k, x, v) for k, r in enumerate(rows) for x, v in enumerate(r)], "img int, x int, v int")
    tokens = rle.tokens(df, ["img"])
    got = {r.img: (bytes.fromhex(r.control), bytes.fromhex(r.data)) for r in rle.streams(tokens, ["img"]).collect()}
    assert got == {k: view.encode_row(bytes(r)) for k, r in enumerate(rows)}
    back = rle.decoded(tokens.withColumnRenamed("start", "ord"), ["img"], width=100)
    assert {(r.img, r.x, r.v) for r in back.collect()} == {(k, x, v) for k, r in enumerate(rows) for x, v in enumerate(r[:100])}


def test_nearest_prefers_the_lowest_index(spark):
    pal = spark.createDataFrame([(0, 10, 0, 0, 0), (1, 0, 0, 0, 0), (2, 10, 0, 0, 0), (255, 5, 0, 0, 0)], "idx int, r int, g int, b int, meta int")
    colors = spark.createDataFrame([(5 << 16,), (10 << 16,), (10 << 16,)], "rgb int")
    assert {(r.rgb >> 16, r.idx, r.d2) for r in lookup.nearest(colors, pal).collect()} == {(5, 0, 25), (10, 0, 0)}
    assert {(r.rgb >> 16, r.idx, r.exact) for r in lookup.exact_then_nearest(colors, pal).collect()} == {(5, 0, False), (10, 0, True)}


def test_byte_curve(spark):
    got = palette.slots(spark).select("idx", color.linear_to_srgb(color.srgb_to_linear(F.col("idx"))).alias("back")).collect()
    assert all(r.idx == r.back for r in got)


def test_median_cut_agrees_with_steps(spark):
    rng = random.Random(5)
    rows = [(i, p, rng.randrange(64), rng.randrange(200), rng.randrange(256)) for i in range(3) for p in range(90)]
    px = spark.createDataFrame(rows, "img int, pos int, r int, g int, b int")
    for in_place in (False, True):
        got = {}
        for r in quantize.cut_boxes(px, 9, in_place).orderBy("img", "box").collect():
            got.setdefault(r.img, []).append([r.r, r.g, r.b])
        for i in range(3):
            seen = list(dict.fromkeys(r[2:] for r in rows if r[0] == i))
            assert quantize.median_cut(__import__("numpy").array(seen), 9, in_place).tolist() == got[i]


def test_few_colors_stay(spark):
    px = spark.createDataFrame([(0, 0, 9, 8, 7), (0, 1, 1, 2, 3), (0, 2, 9, 8, 7)], "img int, pos int, r int, g int, b int")
    got = quantize.palettes(px, "view").orderBy("idx").collect()
    assert [(r.r, r.g, r.b) for r in got[:3]] == [(9, 8, 7), (1, 2, 3), (0, 0, 0)] and (got[255].r, got[255].g) == (255, 255)


def test_merging():
    # linear light: the mean of 0 and 2 / 255 / 12.92 is that of byte 1; weights pull it
    assert quantize.merge_near([(0, 0, 0), (2, 2, 2), (200, 0, 0)], wanted=3) == [(1, 1, 1), (200, 0, 0), (200, 0, 0)]
    assert quantize.merge_near([(0, 0, 0), (4, 4, 4), (200, 0, 0)], [3, 1, 1], wanted=2, radius=9) == [(1, 1, 1), (200, 0, 0)]
    assert len(quantize.merge_near([(k, 255 - k, k) for k in range(0, 250, 10)], wanted=5, radius=0)) == 5
    assert quantize.merge_near([]) == []


@pytest.mark.parametrize("cover", [False, True])
def test_resampling_by_hand(spark, cover):
    w, h, to = 5, 3, (4, 4)
    px = spark.createDataFrame([(1, x, y, 10 * y + x) for x in range(w) for y in range(h)], "img int, x int, y int, v int")
    images = spark.createDataFrame([(1, w, h)], "img int, w int, h int")
    scale = max(to[0] / w, to[1] / h) if cover else min(1, to[0] / w, to[1] / h)
    tw, th = max(1, round(w * scale)), max(1, round(h * scale))
    dx, dy = int((to[0] - tw) / 2), int((to[1] - th) / 2)
    want = {(x + dx, y + dy): 10 * min(h - 1, int((y + 0.5) * h / th)) + min(w - 1, int((x + 0.5) * w / tw)) for x in range(tw) for y in range(th) if 0 <= x + dx < to[0] and 0 <= y + dy < to[1]}
    got = resample.resized(px, images, to, cover)
    assert {(r.x, r.y): r.v for r in got.collect()} == want
    assert resample.on_canvas(got, images, to).count() == 16


def test_sound_mirrors(spark):
    loops = spark.createDataFrame([(0, 0, "image", None, 2), (0, 1, "mirror", 0, 0), (0, 2, "image", None, 1), (0, 3, "mirror", 2, 0)], "view int, lp int, kind string, mirror_of int, n_cels int")
    got = {r.lp: (r.first, r.table_at) for r in layout.cel_tables(loops, "view", 20).collect()}
    assert got == {0: (0, 84), 1: (None, 188), 2: (2, 188), 3: (None, 240)}


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/22.v56",), ("x/102-3-0.bmp",), ("c.V56",)], "p string")
    got = df.select(paths.stem(F.col("p")).alias("s"), paths.is_view(F.col("p")).alias("v"), paths.loop_of(F.col("p")).alias("l")).collect()
    assert [tuple(r) for r in got] == [("22", True, None), ("102-3-0", False, 3), ("c", True, None)]
