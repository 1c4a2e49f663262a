import pytest
from pyspark.sql import functions as F

from tessella.codec import block, picture, png, riff, view
from tessella.sources import build, files, sink
from tessella.streaming import ingest

COLORS = [(k, 255 - k, k // 2) for k in range(256)]


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a.pal").write_bytes(riff.write([(*c, 1) for c in COLORS]))
    (tmp_path / "bad.pal").write_bytes(b"nothing")
    (tmp_path / "b.blk").write_bytes(block.write([(*c, 1) for c in COLORS]))
    (tmp_path / "c.p56").write_bytes(picture.write(bytes(range(6)), COLORS, 3, 2))
    (tmp_path / "d.v56").write_bytes(view.encode(view.View([view.Loop([view.Cel(2, 2, b"\1\2\xff\3")]), view.Loop(mirror_of=0)], COLORS)))
    return str(tmp_path)


def test_readers(spark, folder):
    bad = files.riff_palettes(files.binary(spark, folder, "*.pal"), strict=False).collect()
    assert len([r for r in bad if r.error is None]) == 256 and [r.error for r in bad if r.error] == ["RIFF header cut off"]
    with pytest.raises(Exception, match="RIFF header"):
        files.riff_palettes(files.binary(spark, folder, "bad.pal")).collect()
    assert [(r.r, r.g, r.b) for r in files.block_palettes(files.binary(spark, folder, "*.blk")).orderBy("idx").collect()] == COLORS
    p = files.pictures(files.binary(spark, folder, "*.p56")).first()
    assert (p.width, p.height, bytes(p.pixels)) == (3, 2, bytes(range(6)))
    got = {r.loop: (r.kind, r.mirror_of, r.pixels) for r in files.frames(files.binary(spark, folder, "*.v56")).collect()}
    assert got == {0: ("image", None, bytearray(b"\1\2\xff\3")), 1: ("mirror", 0, None)}
    assert files.scanned_palettes(files.binary(spark, folder, "*.blk")).count() == 256


def test_rejects_of_every_reader(spark):
    bad = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray())], "path string, content binary")
    for read in (files.riff_palettes, files.block_palettes, files.pictures, files.frames):
        assert {(r.path, r.error is None) for r in read(bad, strict=False).collect()} == {("a", False), ("b", False)}


def test_header_queries_do_not_read_contents(spark, folder):
    plan = spark.read.format("binaryFile").load(folder).select("path", "length")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_sink_and_dump(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    frames = files.frames(files.binary(spark, folder, "*.v56"))
    for _ in range(2):  # writing again replaces
        assert sink.save(build.frame_dump(frames), out) == f"file:{out}"
    assert (tmp_path / "out/d/Cell0/Loop0/view_0_loop0.png").read_bytes() == png.write(2, 2, bytes((1, 254, 0, 255, 2, 253, 1, 255, 0, 0, 0, 0, 3, 252, 1, 255)))
    assert (tmp_path / "out/d/Cell0/Loop1/mirror_of_0.txt").exists()
    assert not list((tmp_path / "out").glob("_job-*"))
    one = spark.createDataFrame([("e.txt", bytearray(b"x"))], "path string, content binary")
    with pytest.raises(Exception, match="whole URI"):
        one.write.format("tessella_files").mode("append").save(out)
    with pytest.raises(Exception, match="not a path below"):
        sink.save(one.unionByName(one.selectExpr("'../y' AS path", "content")), out)
    assert not list((tmp_path / "out").glob("_job-*")) and not (tmp_path / "out/e.txt").exists()
    sink.save(one, out, mode="overwrite")
    assert [p.name for p in (tmp_path / "out").rglob("*")] == ["e.txt"]


def test_image_pixels(spark, tmp_path):
    (tmp_path / "102-4-0.png").write_bytes(png.write(2, 1, b"\1\2\3\xff\4\5\6\xff"))
    got = files.image_pixels(files.images(spark, str(tmp_path))).orderBy("x").collect()
    assert [r.argb & 0xFFFFFF for r in got] == [0x010203, 0x040506]


def test_pixels_of_a_large_image(spark):
    import time

    import numpy as np

    data = np.random.default_rng(3).integers(0, 256, (480, 640, 3), dtype=np.uint8)
    loaded = spark.createDataFrame([("a", 640, 480, 3, bytearray(data.tobytes())), ("none", 0, 0, 3, bytearray())], "path string, width int, height int, channels int, data binary")
    began = time.perf_counter()
    got = files.image_pixels(loaded).groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("argb").bitwiseAND(0xFFFFFF).cast("long") * (1 + F.col("x") + 640 * F.col("y"))).alias("s")).first()
    assert time.perf_counter() - began < 60
    own = data.astype(np.int64)
    rgb = own[:, :, 2] << 16 | own[:, :, 1] << 8 | own[:, :, 0]
    assert (got.n, got.s) == (480 * 640, int((rgb.reshape(-1) * (1 + np.arange(480 * 640))).sum()))


def test_stream_of_files(spark, folder, tmp_path):
    got = files.riff_palettes(ingest.arriving(spark, folder, "a.pal"))
    q = got.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    assert spark.table("arrived").agg(F.count("*")).first()[0] == 256
