import random

from pyspark.sql import functions as F

from tessella.codec import picture, view
from tessella.operators import quantize
from tessella.plans import pipelines
from tessella.sources import build, files, headers

rng = random.Random(21)


def pixel_rows(path, w, h, colors, extra=()):
    return [(path, *extra, x, y, rng.choice(colors)) for y in range(h) for x in range(w)]


def signed(a, rgb):
    v = a << 24 | rgb
    return v - (1 << 32) if v >= 1 << 31 else v


def test_pictures(spark):
    colors = [signed(255, c) for c in (0x102030, 0xF00000, 0x00F000, 0x0000F0)]
    rows = pixel_rows("a", 6, 4, colors) + pixel_rows("b", 3, 3, colors[:2])
    px = spark.createDataFrame(rows, "path string, x int, y int, argb int")
    made = {r.path: picture.read(bytes(r.content)) for r in pipelines.pictures_from_pixels(px, to=(8, 6)).collect()}
    for path, w, h in (("a", 6, 4), ("b", 3, 3)):
        p = made[path]
        dx, dy = (8 - w) // 2, (6 - h) // 2
        want = {(r[1] + dx, r[2] + dy): r[3] & 0xFFFFFF for r in rows if r[0] == path}
        for y in range(6):
            for x in range(8):
                v = p.pixels[8 * y + x]
                if (x, y) in want:
                    c = p.palette[v]
                    assert c[0] << 16 | c[1] << 8 | c[2] == want[x, y]
                else:
                    assert v == 255


def test_views_and_headers(spark):
    many = [signed(255, rng.randrange(1 << 24)) for _ in range(600)] + [signed(10, 0xABCDEF)]
    few = many[:100] + [signed(0, 5)]
    rows = pixel_rows("v", 30, 20, few, (0, 0)) + pixel_rows("v", 9, 7, many, (0, 1)) + pixel_rows("v", 5, 5, few, (2, 0)) + pixel_rows("w", 40, 30, many, (0, 0))
    px = spark.createDataFrame(rows, "path string, loop int, cel int, x int, y int, argb int")
    mirrors = spark.createDataFrame([("v", 1, 0)], "path string, loop int, mirror_of int")
    made = pipelines.views_from_pixels(px, mirrors)
    got = {r.path: view.decode(bytes(r.content)) for r in made.collect()}
    assert got["v"].loops[1].mirror_of == 0 and [len(x.cels) for x in got["v"].loops] == [2, 0, 1]
    for path, loop, cel, x, y, argb in rows:
        c = got[path].loops[loop].cels[cel]
        v = c.pixels[y * c.width + x]
        if argb >> 24 & 255 < 128:
            assert v == 255
            continue
        rgb = (argb >> 16 & 255, argb >> 8 & 255, argb & 255)
        pal = got[path].palette
        want = min(range(255), key=lambda i: (sum((a - b) ** 2 for a, b in zip(pal[i], rgb, strict=True)), i))
        assert v == want
    seen = list(dict.fromkeys((r[5] >> 16 & 255, r[5] >> 8 & 255, r[5] & 255) for r in rows if r[:3] == ("v", 0, 0) and r[5] >> 24 & 255 >= 128))
    assert got["v"].palette[: len(seen)] == seen and len(quantize.view_palette(__import__("numpy").array(seen))) == 256

    h = headers.view_headers(made).where("path = 'v'").first()
    assert (h.variant, h.loops, h.res_x, h.res_y, h.loop_header, h.cel_header) == ("A", 3, 640, 480, 16, 52)
    loops = headers.loop_headers(made).where("path = 'v'").orderBy("loop").collect()
    assert [(r.is_mirror, r.mirror_of, r.n_cels) for r in loops] == [(False, None, 2), (True, 0, 0), (False, None, 1)] and loops[1].table_at == loops[2].table_at
    cels = headers.cel_headers(made).where("path = 'v'").orderBy("loop", "cel").collect()
    assert [(r.w, r.h, r.transparent) for r in cels] == [(30, 20, 255), (9, 7, 255), (5, 5, 255)]
    assert cels[1].control_at == cels[0].control_at + cels[0].control_bytes and cels[1].data_at == cels[0].data_at + cels[0].data_bytes
    read = made.sparkSession.createDataFrame(made.collect(), made.schema)
    assert "Pandas" not in headers.cel_headers(read)._jdf.queryExecution().toString()  # no file is decoded


def test_pictures_out(spark):
    data = picture.write(bytes([0, 1]), [(1, 2, 3), (4, 5, 6)], 2, 1)
    got = build.picture_images(files.pictures(spark.createDataFrame([("x/p.p56", bytearray(data))], "path string, content binary"))).first()
    assert got.path == "p.png" and bytes(got.content).startswith(b"\x89PNG")


def test_image_structs(spark):
    px = spark.createDataFrame([("a", 0, 0, signed(255, 0x010203)), ("a", 1, 0, 0x040506)], "path string, x int, y int, argb int")
    got = build.image_structs(px).select("image.*").first()
    assert (got.width, got.height, got.nChannels, got.mode, bytes(got.data)) == (2, 1, 4, 24, bytes((3, 2, 1, 255, 6, 5, 4, 0)))
    assert px.agg(F.count("*")).first()[0] == 2


def broadcast_grids(df):
    """Lines of the plan as it ran that make rows between a broadcast and the shuffle below it."""
    found, below = [], None
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-*("))
        if below is not None and (depth <= below or "ShuffleQueryStage" in line):
            below = None
        if "BroadcastExchange" in line:
            below = depth
        elif below is not None and "Generate " in line:
            found.append(line)
    return found


def many_small(spark):
    return spark.range(400).selectExpr("cast(id as string) as path", "explode(sequence(0, 3)) as k", "id").selectExpr("path", "cast(k % 2 as int) as x", "cast(k div 2 as int) as y", "cast(id * 7 + k as int) as argb")


def test_no_grid_of_pictures_is_broadcast(spark):
    made = pipelines.pictures_from_pixels(many_small(spark), to=(6, 4))
    got = {r.path: picture.read(bytes(r.content)) for r in made.collect()}
    assert len(got) == 400 and broadcast_grids(made) == []
    for k in (0, 399):
        p = got[str(k)]
        at = {(x, y): p.pixels[6 * y + x] for y in range(4) for x in range(6)}
        assert {q for q, v in at.items() if v != 255} == {(2, 1), (3, 1), (2, 2), (3, 2)}
        assert [p.palette[at[q]][2] for q in ((2, 1), (3, 1), (2, 2), (3, 2))] == [(k * 7 + i) % 256 for i in range(4)]


def test_palette_reads_only_its_own_parts_into_the_driver(spark):
    from tessella.plans import views

    plan = views.palette(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(p_partkey,255)" in plan


def test_no_grid_of_covering_pictures_is_broadcast(spark):
    made = pipelines.pictures_from_pixels(many_small(spark), to=(6, 4), cover=True)
    got = {r.path: picture.read(bytes(r.content)) for r in made.collect()}
    assert len(got) == 400 and broadcast_grids(made) == []
    assert all(255 not in p.pixels for p in got.values())


def below_broadcasts(df):
    """Lines below a broadcast of the plan as it ran, shuffles between them or not."""
    found, below = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines():
        depth = len(line) - len(line.lstrip(" :+-*("))
        if below is not None and depth <= below:
            below = None
        if below is not None:
            found.append(line)
        elif "BroadcastExchange" in line:
            below = depth
    return found


def test_cover_query_broadcasts_only_its_palette(spark):
    from tessella.plans import catalog

    made = catalog.picture_from_pixels_cover(spark, "/root/testdata/sf0.001")
    assert len(made.collect()) == 64 * spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    below = below_broadcasts(made)
    assert any("Range (0, 256" in line for line in below) and not any("Generate " in line or "vec_id" in line for line in below)
