"""Every operator as a query over stand-in views, and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import binary, color, paths
from tessella.operators import layout, lookup, measure, palette, quantize, resample, rle
from tessella.plans import pipelines, views
from tessella.sources import build, files, headers, sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_PX, _PXU, _PAL, _ROWS, _LOOPS = views.PX, views.PX_UNORDERED, views.PALETTE_DUCK, views.ROWS, views.LOOPS


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _colors(spark: SparkSession, d: str) -> DataFrame:
    return views.pixels(spark, d, ordered=False).select(palette.rgb_key().alias("rgb"))


_RGB = "(r * 65536 + g * 256 + b)"
_DIST = "(((rgb >> 16) & 255) - r) * (((rgb >> 16) & 255) - r) + (((rgb >> 8) & 255) - g) * (((rgb >> 8) & 255) - g) + ((rgb & 255) - b) * ((rgb & 255) - b)"
_NEAR = f"near AS (SELECT rgb, idx, d2 FROM (SELECT rgb, idx, {_DIST} AS d2, row_number() OVER (PARTITION BY rgb ORDER BY {_DIST}, idx) AS k FROM (SELECT DISTINCT rgb FROM c) c, pal WHERE idx < 255) WHERE k = 1)"
_C = f"pal AS ({_PAL}), c AS (SELECT {_RGB} AS rgb FROM ({_PXU}))"


# -- lookups


@query(f"WITH {_C}, {_NEAR} SELECT CAST(rgb AS INT) AS rgb, CAST(idx AS INT) AS idx, CAST(d2 AS INT) AS d2 FROM near")
def nearest_palette(spark, d):
    return lookup.nearest(_colors(spark, d), views.palette(spark, d))


@query(f"WITH {_C}, {_NEAR}, ex AS (SELECT {_RGB} AS rgb, min(idx) AS i FROM pal WHERE idx < 255 GROUP BY 1) SELECT CAST(near.rgb AS INT) AS rgb, CAST(coalesce(i, idx) AS INT) AS idx, i IS NOT NULL AS exact FROM near LEFT JOIN ex ON ex.rgb = near.rgb")
def exact_then_nearest(spark, d):
    return lookup.exact_then_nearest(_colors(spark, d), views.palette(spark, d))


@query(f"WITH {_C}, {_NEAR} SELECT img, CAST(CASE WHEN a < 128 THEN 255 ELSE near.idx END AS INT) AS idx, count(*) AS n FROM ({_PXU}) p LEFT JOIN near ON near.rgb = (p.r * 65536 + p.g * 256 + p.b) GROUP BY ALL")
def indexed_pixels(spark, d):
    px = views.pixels(spark, d, ordered=False)
    argb = color.argb(F.col("a"), palette.rgb_key())
    return lookup.indexed(px.select("img", argb.alias("argb")), views.palette(spark, d)).groupBy("img", "idx").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH pal AS ({_PAL}), q AS ({views.EMB_DUCK}) SELECT img, x, CAST(CASE WHEN v % 64 = 63 THEN 255 ELSE v END AS INT) AS idx, CAST(CASE WHEN v % 64 = 63 THEN 0 ELSE (r * 65536 + g * 256 + b) - 16777216 END AS INT) AS argb FROM q JOIN pal ON pal.idx = v")
def palette_deref(spark, d):
    own = views.vectors(spark, d).select("img", "x", F.when(F.col("v") % 64 == 63, 255).otherwise(F.col("v")).alias("idx"))
    return lookup.dereferenced(own, views.palette(spark, d))


_YCC = "(77 * r + 150 * g + 29 * b) >> 8 AS y, ((-43 * r - 85 * g + 128 * b) >> 8) + 128 AS cb, ((128 * r - 107 * g - 21 * b) >> 8) + 128 AS cr"
_PAIRS = f"t AS (SELECT idx, {_YCC} FROM ({_PAL})), p AS (SELECT s.idx AS i, u.idx AS j, (s.y - u.y) * (s.y - u.y) + (s.cb - u.cb) * (s.cb - u.cb) + (s.cr - u.cr) * (s.cr - u.cr) AS d2 FROM t s JOIN t u ON s.idx < u.idx)"


@query(f"SELECT idx, CAST(y AS INT) AS y, CAST(cb AS INT) AS cb, CAST(cr AS INT) AS cr FROM (SELECT idx, {_YCC} FROM ({_PAL}))")
def ycbcr(spark, d):
    return lookup.chroma(views.palette(spark, d))


@query(f"WITH {_PAIRS} SELECT i, j, CAST(d2 AS INT) AS d2 FROM p WHERE d2 <= 36 * 36")
def ycbcr_pairs(spark, d):
    return lookup.near_pairs(views.palette(spark, d), 36)


@query(f"WITH {_PAIRS} SELECT i, j, CAST(d2 AS INT) AS d2 FROM p ORDER BY d2, i, j LIMIT 1")
def closest_pair(spark, d):
    return lookup.closest_pair(views.palette(spark, d))


# -- scalars


@query("WITH c AS (SELECT range AS v, range / 255.0::DOUBLE AS s FROM range(256)), l AS (SELECT v, CASE WHEN s <= 0.04045 THEN s / 12.92 ELSE pow((s + 0.055) / 1.055, 2.4) END AS x FROM c) SELECT CAST(v AS INT) AS v, CAST(round_even(x * 1000000, 0) AS BIGINT) AS millionths, CAST(greatest(0, least(255, round_even(255 * CASE WHEN x <= 0.0031308 THEN x * 12.92 ELSE pow(x, 1 / 2.4) * 1.055 - 0.055 END, 0))) AS INT) AS back FROM l")
def srgb_linear_roundtrip(spark, d):
    x = color.srgb_to_linear(F.col("v"))
    return palette.slots(spark).select(F.col("idx").alias("v")).select("v", F.rint(x * 1000000).cast("long").alias("millionths"), color.linear_to_srgb(x).alias("back"))


@query(f"SELECT CAST({_RGB} AS INT) AS rgb, CAST(count(*) AS BIGINT) AS n, CAST(max(r) AS INT) AS r, CAST(max(g) AS INT) AS g, CAST(max(b) AS INT) AS b FROM ({_PXU}) GROUP BY 1")
def rgb_pack(spark, d):
    own = _colors(spark, d).groupBy("rgb").agg(F.count(F.lit(1)).alias("n"))
    return own.select("rgb", "n", *[c.cast("int").alias(n) for c, n in zip(color.unpack(F.col("rgb")), "rgb", strict=True)])


@query(f"SELECT img, a >= 128 AS opaque, count(*) AS n FROM ({_PXU}) GROUP BY ALL")
def opaque_pixels(spark, d):
    px = views.pixels(spark, d, ordered=False).withColumn("argb", color.argb(F.col("a"), palette.rgb_key()))
    return px.groupBy("img", color.is_opaque(F.col("argb")).alias("opaque")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH h AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), b AS (SELECT doc_id, list_transform(range(0, 4), lambda i: TRY_CAST('0x' || nullif(substr(h, CAST(2 * i + 1 AS BIGINT), 2), '') AS BIGINT)) AS v FROM h) SELECT doc_id, CAST(v[1] AS INT) AS u8, CAST(v[1] + 256 * v[2] AS INT) AS u16, CAST(CASE WHEN v[1] + 256 * v[2] >= 32768 THEN v[1] + 256 * v[2] - 65536 ELSE v[1] + 256 * v[2] END AS INT) AS s16, v[1] + 256 * v[2] + 65536 * v[3] + 16777216 * v[4] AS u32 FROM b")
def le_decode(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("c"))
    c = F.col("c")
    return docs.select("doc_id", binary.u8(c, 0).alias("u8"), binary.u16(c, 0).alias("u16"), binary.s16(c, 0).alias("s16"), binary.u32(c, 0).alias("u32"))


@query("SELECT p_partkey AS part, printf('%02X', p_partkey % 251) AS one, printf('%02X%02X', p_partkey * 37 % 65536 & 255, p_partkey * 37 % 65536 >> 8) AS two, printf('%02X%02X%02X%02X', p_partkey * 2654435761 & 255, p_partkey * 2654435761 >> 8 & 255, p_partkey * 2654435761 >> 16 & 255, p_partkey * 2654435761 >> 24 & 255) AS four, rpad(hex(encode(substr('part' || p_partkey % 7, 1, 9))), 18, '0') AS name FROM part")
def le_encode(spark, d):
    v = F.col("p_partkey")
    name = F.coalesce(*[F.when(v % 7 == k, F.lit(binary.fixed_ascii(f"part{k}", 9))) for k in range(7)])
    return spark.read.parquet(f"{d}/part.parquet").select(v.alias("part"), binary.hex_of(v % 251, 1).alias("one"), binary.hex_of(v * 37 % 65536, 2).alias("two"), binary.hex_of((v * F.lit(2654435761)).bitwiseAND(F.lit(0xFFFFFFFF)), 4).alias("four"), name.alias("name"))


_NAMES = "SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN '/a.b/' || n_name || '.x.V56' WHEN 1 THEN '102-' || n_nationkey || '-0.bmp' WHEN 2 THEN 'dir/7-' || n_nationkey || '-' || n_regionkey || '.BMP' ELSE n_name || '.v56.bak' END AS name FROM nation"


@query(f"SELECT k, split_part(split_part(name, '/', -1), '.', 1) AS stem, lower(name) LIKE '%.v56' AS is_view, TRY_CAST(nullif(regexp_extract(name, '(?:^|/)[0-9]+-([0-9]+)-[0-9]+\\.(?:bmp|BMP)$', 1), '') AS INT) AS lp FROM ({_NAMES})")
def file_names(spark, d):
    own = views.sql(spark, d, _NAMES)
    return own.select("k", paths.stem(F.col("name")).alias("stem"), paths.is_view(F.col("name")).alias("is_view"), paths.loop_of(F.col("name")).alias("lp"))


# -- measures


@query(f"SELECT img, CAST({_RGB} AS INT) AS rgb, count(*) AS n FROM ({_PXU}) GROUP BY ALL")
def color_histogram(spark, d):
    return measure.histogram(views.pixels(spark, d, ordered=False))


@query(f"SELECT img, CAST(rgb AS INT) AS rgb, CAST(row_number() OVER (PARTITION BY img ORDER BY p) - 1 AS INT) AS ord FROM (SELECT img, {_RGB} AS rgb, min(pos) AS p FROM ({_PX}) WHERE a >= 128 GROUP BY ALL)")
def distinct_first_seen(spark, d):
    return measure.first_seen(views.pixels(spark, d))


@query("SELECT img, " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in "rgb") + f" FROM ({_PXU}) GROUP BY img")
def box_bounds(spark, d):
    return measure.bounds(views.pixels(spark, d, ordered=False), "img")


@query(f"SELECT img, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b, count(*) AS n FROM (SELECT DISTINCT img, r, g, b FROM ({_PXU})) GROUP BY img")
def box_mean(spark, d):
    return measure.mean_color(views.pixels(spark, d, ordered=False).select("img", "r", "g", "b").distinct(), "img")


@query(f"SELECT img, max(v) AS top, max(v) <= 254 AS usable FROM ({_ROWS}) GROUP BY img")
def highest_index(spark, d):
    return measure.highest_index(views.rows(spark, d).withColumnRenamed("v", "idx"), "img")


@query(f"SELECT CAST(sum(n_cels) AS BIGINT) AS cels, max(n_cels) AS most, count(*) FILTER (kind <> 'mirror') AS images, count(*) AS loops FROM ({_LOOPS})")
def loop_totals(spark, d):
    return measure.loop_totals(views.loops(spark, d))


@query(f"WITH g AS (SELECT CAST(lp // 2 AS INT) AS k, bool_or(kind = 'mirror') AS any_mirror, bool_or(kind = 'image') AS any_image, count(DISTINCT mirror_of) AS targets FROM ({_LOOPS}) GROUP BY 1) SELECT *, NOT (any_mirror AND any_image) AND targets <= 1 AS sound FROM g")
def mirror_consistency(spark, d):
    return measure.mirror_consistency(views.loops(spark, d).withColumn("k", F.expr("int(lp div 2)")), "k")


@query("SELECT source AS f, n, off FROM (SELECT source, CAST(n_chars % 257 AS BIGINT) AS n, doc_id AS off, row_number() OVER (PARTITION BY source ORDER BY n_chars % 257 DESC, doc_id) AS k FROM documents WHERE n_chars % 257 BETWEEN 1 AND 256) WHERE k = 1")
def palette_scan_best(spark, d):
    own = spark.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("f"), (F.col("n_chars") % 257).alias("n"), F.col("doc_id").alias("off"))
    return measure.best_candidate(own.where("n between 1 and 256"), "f")


# -- rows


def _isles(rows: str) -> str:
    return f"""
p AS ({rows}),
a AS (SELECT *, x - row_number() OVER (PARTITION BY img, v ORDER BY x) AS isle FROM p),
o AS (SELECT *, row_number() OVER (PARTITION BY img, v, isle ORDER BY x) - 1 AS off, count(*) OVER (PARTITION BY img, v, isle) AS len FROM a),
k AS (SELECT *, CASE WHEN v = 255 THEN 'T' WHEN len - (off - off % 63) >= 3 THEN 'R' ELSE 'L' END AS kind FROM o),
s AS (SELECT *, x - row_number() OVER (PARTITION BY img, kind ORDER BY x) AS run FROM k),
l AS (SELECT *, row_number() OVER (PARTITION BY img, kind, run ORDER BY x) - 1 AS inside FROM s),
t AS (SELECT img, kind, CASE WHEN kind = 'L' THEN x - inside % 63 ELSE x - off % 63 END AS start, v, x FROM l),
tok AS (SELECT img, CAST(start AS INT) AS start, kind, CAST(count(*) AS INT) AS n, CAST(CASE kind WHEN 'T' THEN 192 WHEN 'R' THEN 128 ELSE 0 END + count(*) AS INT) AS ctl,
 CASE kind WHEN 'T' THEN '' WHEN 'R' THEN lpad(hex(min(v)), 2, '0') ELSE string_agg(lpad(hex(v), 2, '0'), '' ORDER BY x) END AS data FROM t GROUP BY img, start, kind)"""


_ISLES = _isles(_ROWS)


@query(f"WITH {_ISLES} SELECT * FROM tok")
def rle_tokens(spark, d):
    return rle.tokens(views.rows(spark, d), ["img"])


@query(_ROWS)
def rle_roundtrip(spark, d):
    return rle.decoded(rle.tokens(views.rows(spark, d), ["img"]).withColumnRenamed("start", "ord"), ["img"])


@query(f"SELECT * FROM ({_ROWS}) WHERE x < 5")
def rle_clipped(spark, d):
    return rle.decoded(rle.tokens(views.rows(spark, d), ["img"]).withColumnRenamed("start", "ord"), ["img"], width=5)


@query(f"WITH {_ISLES} SELECT img, string_agg(lpad(hex(ctl), 2, '0'), '' ORDER BY start) AS control, string_agg(data, '' ORDER BY start) AS data FROM tok GROUP BY img")
def rle_streams(spark, d):
    return rle.streams(rle.tokens(views.rows(spark, d), ["img"]), ["img"])


_LEN = f"len AS (SELECT img, CAST(img // 10 AS BIGINT) AS frame, sum(1) AS control, CAST(sum(length(data) // 2) AS BIGINT) AS data FROM tok GROUP BY img)"


def _lengths(spark, d):
    own = rle.streams(rle.tokens(views.rows(spark, d), ["img"]), ["img"])
    return own.select("img", F.expr("img div 10").alias("frame"), F.expr("length(control) div 2").alias("control"), F.expr("length(data) div 2").alias("data"))


@query(f"WITH {_ISLES}, {_LEN} SELECT frame, img, CAST(sum(control) OVER (PARTITION BY frame ORDER BY img) - control AS BIGINT) AS control_at, CAST(sum(data) OVER (PARTITION BY frame ORDER BY img) - data AS BIGINT) AS data_at FROM len")
def row_offsets(spark, d):
    return layout.row_offsets(_lengths(spark, d), "frame", "img")


@query(f"WITH {_ISLES}, {_LEN}, f AS (SELECT CAST(frame // 8 AS BIGINT) AS view, frame, CAST(sum(control + data) AS BIGINT) AS size FROM len GROUP BY ALL) SELECT view, frame, CAST(sum(size) OVER (PARTITION BY view ORDER BY frame) - size AS BIGINT) AS at, size FROM f")
def frame_slices(spark, d):
    own = _lengths(spark, d).groupBy(F.expr("frame div 8").alias("view"), "frame").agg(F.sum(F.col("control") + F.col("data")).alias("size"))
    return layout.frame_slices(own, "view", ["frame"])


@query(f"WITH {_ISLES}, r AS (SELECT img, string_agg(data, '' ORDER BY start) AS data FROM tok GROUP BY img) SELECT CAST(img // 10 AS BIGINT) AS frame, string_agg(data, '' ORDER BY img) AS data FROM r GROUP BY 1")
def stream_concat(spark, d):
    own = rle.streams(rle.tokens(views.rows(spark, d), ["img"]), ["img"])
    return own.groupBy(F.expr("img div 10").alias("frame")).agg(binary.joined(F.col("img"), F.col("data")).alias("data"))


# -- loops


@query(f"""WITH l AS (SELECT *, CASE WHEN kind = 'mirror' THEN 0 ELSE n_cels END AS n FROM ({_LOOPS})),
f AS (SELECT *, CASE WHEN kind <> 'mirror' THEN sum(n) OVER (ORDER BY lp) - n END AS first, 20 + 16 * count(*) OVER () AS base, sum(n) OVER () AS cels FROM l)
SELECT view, lp, kind, CAST(coalesce(first, -1) AS BIGINT) AS first, CAST(coalesce(base + 52 * first, (SELECT min(g.base + 52 * g.first) FROM f g WHERE g.lp > f.lp AND g.kind <> 'mirror'), base + 52 * cels) AS BIGINT) AS table_at FROM f""")
def cel_table_offsets(spark, d):
    return layout.cel_tables(views.loops(spark, d), "view", 20).fillna(-1, ["first"])


@query(f"WITH l AS ({_LOOPS}) SELECT m.view, m.lp, m.mirror_of, t.kind AS target_kind, t.n_cels AS target_cels FROM l m LEFT JOIN l t ON t.lp = m.mirror_of WHERE m.kind = 'mirror'")
def mirror_targets(spark, d):
    return layout.mirror_targets(views.loops(spark, d), "view")


_FRAMES = f"fr AS (SELECT view, lp, CAST(unnest(range(greatest(n_cels, 1))) AS INT) AS cel, kind, mirror_of FROM ({_LOOPS}))"


@query(f"WITH {_FRAMES}, g AS (SELECT DISTINCT f.view, CAST(l.i AS INT) AS lp, CAST(c.i AS INT) AS cel FROM fr f, range(25) l(i), range(5) c(i)) SELECT g.view, g.lp, g.cel, coalesce(fr.kind, 'mirror') AS kind, CASE WHEN fr.kind IS NULL THEN g.lp ELSE coalesce(fr.mirror_of, -1) END AS mirror_of FROM g LEFT JOIN fr USING (view, lp, cel)")
def ragged_loops(spark, d):
    return layout.ragged(views.frames(spark, d), "view").fillna(-1, ["mirror_of"])


@query(f"WITH {_FRAMES} SELECT * REPLACE (coalesce(mirror_of, -1) AS mirror_of), CAST(row_number() OVER (ORDER BY lp, cel) - 1 AS INT) AS ord FROM fr")
def loop_major_order(spark, d):
    return layout.transposed(views.frames(spark, d), "view").fillna(-1, ["mirror_of"])


@query("SELECT CAST(n_nationkey AS INT) AS view, 20 + 16 * n_regionkey AS headers, 1061 AS palette, n_nationkey * 11 AS control, n_nationkey * 7 AS data, 20 + 16 * n_regionkey AS palette_at, 1087 + 16 * n_regionkey AS image_at, 1093 + 16 * n_regionkey AS control_at, 1093 + 16 * n_regionkey + n_nationkey * 11 AS data_at, 1099 + 16 * n_regionkey + n_nationkey * 18 AS rows_at FROM nation")
def view_sections(spark, d):
    own = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("int").alias("view"), (F.col("n_regionkey") * 16 + 20).alias("headers"), F.lit(1061).alias("palette"), (F.col("n_nationkey") * 11).alias("control"), (F.col("n_nationkey") * 7).alias("data"))
    return layout.sections(own)


# -- palettes


@query("SELECT CAST(range AS INT) AS idx, CAST(range AS INT) AS r, CAST(range AS INT) AS g, CAST(range AS INT) AS b, 0 AS meta FROM range(256)")
def palette_default(spark, d):
    return palette.grey_ramp(spark)


@query(f"SELECT idx, r, g, b, 7 AS meta FROM ({_PAL})")
def riff_to_block(spark, d):
    return palette.with_meta(views.palette(spark, d), 7)


@query(f"SELECT idx, r, g, b, 0 AS meta FROM ({_PAL})")
def block_to_riff(spark, d):
    return palette.with_meta(views.palette(spark, d).withColumn("meta", F.col("idx")), 0)


@query(f"SELECT CAST(range AS INT) AS idx, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b, coalesce(meta, 0) AS meta FROM range(256) LEFT JOIN (SELECT * FROM ({_PAL}) WHERE idx < 100) ON idx = range")
def palette_pad(spark, d):
    return palette.padded(views.palette(spark, d).where("idx < 100"))


@query("WITH e AS (SELECT n_nationkey AS ord, n_nationkey % 20 + 240 AS idx, CAST(n_nationkey * 9 AS INT) AS r, CAST(n_regionkey AS INT) AS g, 3 AS b FROM nation), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY ord DESC) AS k FROM e WHERE idx < 256) WHERE k = 1) SELECT CAST(range AS INT) AS idx, CAST(coalesce(w.r, range) AS INT) AS r, CAST(coalesce(w.g, range) AS INT) AS g, CAST(coalesce(w.b, range) AS INT) AS b, CASE WHEN w.ord IS NULL THEN 0 ELSE 9 END AS meta FROM range(256) LEFT JOIN w ON w.idx = range")
def sparse_entries(spark, d):
    n = F.col("n_nationkey")
    own = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("ord"), (n % 20 + 240).alias("at"), (n * 9).alias("r"), F.col("n_regionkey").alias("g"), F.lit(3).alias("b"), F.lit(9).alias("meta"))
    return palette.placed(own, 0, palette.grey_ramp(spark))


@query("WITH e AS (SELECT n_nationkey AS ord, n_nationkey * 3 + 200 AS idx, CAST(n_nationkey * 9 AS INT) AS r FROM nation) SELECT CAST(range AS INT) AS idx, coalesce(e.r, 0) AS r, CASE WHEN e.r IS NULL THEN 0 ELSE 5 END AS g, 0 AS b, 0 AS meta FROM range(256) LEFT JOIN e ON e.idx = range")
def sparse_entries_over_black(spark, d):
    n = F.col("n_nationkey")
    own = spark.read.parquet(f"{d}/nation.parquet").select(n.alias("ord"), (n * 3 + 200).alias("at"), (n * 9).alias("r"), F.lit(5).alias("g"), F.lit(0).alias("b"), F.lit(0).alias("meta"))
    return palette.placed(own, 0, palette.slots(spark).select("idx", *[F.lit(0).alias(c) for c in palette.CHANNELS]))


@query(f"SELECT idx, CASE WHEN idx = 17 THEN 1 ELSE r END AS r, CASE WHEN idx = 17 THEN 2 ELSE g END AS g, CASE WHEN idx = 17 THEN 3 ELSE b END AS b, meta FROM ({_PAL})")
def palette_set_color(spark, d):
    return palette.with_color(views.palette(spark, d), 17, 1, 2, 3)


@query(f"SELECT * FROM ({_PAL}) WHERE idx = 17")
def palette_get_color(spark, d):
    return palette.color_at(views.palette(spark, d), 17)


@query(f"SELECT idx, CAST(idx % 16 AS INT) AS x, CAST(idx // 16 AS INT) AS y, CASE WHEN idx = 255 THEN 255 ELSE r END AS r, CASE WHEN idx = 255 THEN 255 ELSE g END AS g, CASE WHEN idx = 255 THEN 255 ELSE b END AS b FROM ({_PAL})")
def palette_grid(spark, d):
    return palette.grid(views.palette(spark, d))


@query(f"SELECT 0 AS img, '524946461004000050414C2064617461040400000003' || '0001' || string_agg(lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0') || lpad(hex(meta), 2, '0'), '' ORDER BY idx) AS hex FROM ({_PAL})")
def riff_bytes(spark, d):
    return build.riff_files(views.palette(spark, d).withColumn("img", F.lit(0)), "img")


@query(f"SELECT 0 AS img, '00032504000000000E47454E50414C0000000100000000000000000000000000000000000101' || '0000000000' || string_agg('00' || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0'), '' ORDER BY idx) AS hex FROM ({_PAL})")
def block_bytes(spark, d):
    return build.block_files(views.palette(spark, d).withColumn("img", F.lit(0)), "img")


# -- resampling


def _images(spark, d):
    own = views.vectors(spark, d)
    return own.select("img").distinct().select("img", F.lit(16).alias("w"), F.lit(4).alias("h"))


def _grid(spark, d):
    return views.vectors(spark, d).select("img", (F.col("x") % 16).alias("x2"), F.expr("int(x div 16)").alias("y"), "v").withColumnRenamed("x2", "x")


_E = f"e AS (SELECT img, CAST(x % 16 AS INT) AS x, CAST(x // 16 AS INT) AS y, v FROM ({views.EMB_DUCK}))"


@query(f"WITH {_E} SELECT DISTINCT e.img, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, v FROM e JOIN range(8) a(cx) ON e.x = cx * 2 + 1 JOIN range(3, 5) b(cy) ON e.y = (cy - 3) * 2 + 1")
def resize_contain(spark, d):
    return resample.resized(_grid(spark, d), _images(spark, d), (8, 8))


@query(f"WITH {_E} SELECT e.img, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, v FROM range(8) a(cx), range(8) b(cy), e WHERE e.x = least(15, CAST(floor((cx + 12 + 0.5) / 2) AS INT)) AND e.y = CAST(floor((cy + 0.5) / 2) AS INT)")
def resize_cover(spark, d):
    return resample.resized(_grid(spark, d), _images(spark, d), (8, 8), cover=True)


@query(f"WITH {_E}, i AS (SELECT DISTINCT img FROM e) SELECT i.img, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, coalesce(v, 255) AS v FROM i, range(20) a(cx), range(9) b(cy) LEFT JOIN e ON e.img = i.img AND e.x = cx - 2 AND e.y = cy - 2")
def canvas_center(spark, d):
    images = _images(spark, d)
    return resample.on_canvas(resample.resized(_grid(spark, d), images, (20, 9)), images, (20, 9))


# -- quantisation


def _cut_sql(boxes: int, in_place: bool) -> str:
    parts = [f"s0 AS (SELECT img, r, g, b, min(pos) AS ord, 0 AS box FROM ({_PX}) GROUP BY img, r, g, b)"]
    for k in range(1, boxes):
        order = "s.r * 65536 + s.g * 256 + s.b" if in_place else "ord"
        one, two = ("box", str(k)) if in_place else (str(2 * k - 1), str(2 * k))
        parts.append(f"""q{k} AS (SELECT img, box, count(*) AS n, max(r) - min(r) AS wr, max(g) - min(g) AS wg, max(b) - min(b) AS wb FROM s{k - 1} GROUP BY img, box),
h{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY img ORDER BY greatest(wr, wg, wb) DESC, box) AS p FROM q{k} WHERE n > 1) WHERE p = 1),
t{k} AS (SELECT s.*, h.n AS n, row_number() OVER (PARTITION BY s.img, s.box ORDER BY CASE WHEN h.wr >= h.wg AND h.wr >= h.wb THEN s.r WHEN h.wg >= h.wr AND h.wg >= h.wb THEN s.g ELSE s.b END, {order}) AS rn FROM s{k - 1} s LEFT JOIN h{k} h ON h.img = s.img AND h.box = s.box),
s{k} AS (SELECT img, r, g, b, CASE WHEN n IS NULL THEN ord ELSE rn END AS ord, CASE WHEN n IS NULL THEN box WHEN rn <= n // 2 THEN {one} ELSE {two} END AS box FROM t{k})""")
    return "WITH " + ",\n".join(parts) + f" SELECT img, CAST(box AS INT) AS box, count(*) AS n, CAST(sum(r) // count(*) AS INT) AS r, CAST(sum(g) // count(*) AS INT) AS g, CAST(sum(b) // count(*) AS INT) AS b FROM s{boxes - 1} GROUP BY img, box"


@query(_cut_sql(2, False))
def median_cut_step(spark, d):
    return quantize.cut_boxes(views.pixels(spark, d), 2)


@query(_cut_sql(8, False))
def median_cut_k8_append(spark, d):
    return quantize.cut_boxes(views.pixels(spark, d), 8)


@query(_cut_sql(8, True))
def median_cut_k8_in_place(spark, d):
    return quantize.cut_boxes(views.pixels(spark, d), 8, in_place=True)


def _full_cut_sql(target: int, in_place: bool, where: str = "TRUE") -> str:
    """CTEs: ``colors`` (img, r, g, b, ord), and ``boxes`` (img, idx, r, g, b), the means in list order after target - 1 cuts."""
    tie = "r * 65536 + g * 256 + b" if in_place else "ord"
    one, two = ("box", "step + 1") if in_place else ("2 * step + 1", "2 * step + 2")
    return f"""colors AS (SELECT CAST(img AS BIGINT) AS img, CAST(r AS BIGINT) AS r, CAST(g AS BIGINT) AS g, CAST(b AS BIGINT) AS b, CAST(min(pos) AS BIGINT) AS ord FROM ({_PX}) WHERE {where} GROUP BY img, r, g, b),
cut(img, r, g, b, ord, box, step) USING KEY (img, r, g, b) AS (
 SELECT img, r, g, b, ord, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM colors
 UNION
 SELECT img, r, g, b, CASE WHEN hit THEN rn ELSE ord END, CASE WHEN NOT hit THEN box WHEN rn <= n // 2 THEN {one} ELSE {two} END, step + 1
 FROM (SELECT *, CASE WHEN hit THEN row_number() OVER (PARTITION BY img, box ORDER BY ch, {tie}) END AS rn FROM (
  SELECT *, coalesce(worth = max(worth) OVER (PARTITION BY img), FALSE) AS hit, CASE WHEN wr >= wg AND wr >= wb THEN r WHEN wg >= wr AND wg >= wb THEN g ELSE b END AS ch FROM (
   SELECT *, CASE WHEN n > 1 THEN greatest(wr, wg, wb) * 100000 - box END AS worth FROM (
    SELECT *, count(*) OVER w AS n, max(r) OVER w - min(r) OVER w AS wr, max(g) OVER w - min(g) OVER w AS wg, max(b) OVER w - min(b) OVER w AS wb FROM cut WHERE step < {target - 1} WINDOW w AS (PARTITION BY img, box)))))),
boxes AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY box) - 1 AS idx, CAST(sum(r) // count(*) AS BIGINT) AS r, CAST(sum(g) // count(*) AS BIGINT) AS g, CAST(sum(b) // count(*) AS BIGINT) AS b FROM cut GROUP BY img, box)"""


def _filled_sql(source: str) -> str:
    """256 entries an image: those of ``source``, black, and white at the end."""
    one = lambda c: f"CAST(CASE WHEN i.idx = 255 THEN 255 ELSE coalesce(s.{c}, 0) END AS INT) AS {c}"
    return f"SELECT CAST(m.img AS INT) AS img, CAST(i.idx AS INT) AS idx, {one('r')}, {one('g')}, {one('b')} FROM (SELECT DISTINCT img FROM colors) m CROSS JOIN (SELECT range AS idx FROM range(256)) i LEFT JOIN {source} s ON s.img = m.img AND s.idx = i.idx"


def _merge_sql(wanted: int, radius: int) -> str:
    """CTEs: ``merged`` (img, e), from ``start`` (img, e): lists of (r, g, b, w). A step is one merge, or the next entry's turn."""
    linear = lambda x: f"CASE WHEN {x} / 255.0::DOUBLE <= 0.04045 THEN {x} / 255.0::DOUBLE / 12.92 ELSE pow(({x} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
    mix = lambda c: f"((e[i].w * ({linear(f'e[i].{c}')}) + e[k].w * ({linear(f'e[k].{c}')})) / (e[i].w + e[k].w))"
    byte = lambda x: f"CAST(greatest(0, least(255, round_even((CASE WHEN {x} <= 0.0031308 THEN {x} * 12.92::DOUBLE ELSE pow({x}, 1 / 2.4::DOUBLE) * 1.055::DOUBLE - 0.055::DOUBLE END) * 255, 0))) AS BIGINT)"
    weighted = lambda x, w: f"(({x}.r * {w[0]} + {x}.g * {w[1]} + {x}.b * {w[2]}) >> 8)"
    d2 = lambda x, y: " + ".join(f"({weighted(x, w)} - {weighted(y, w)}) * ({weighted(x, w)} - {weighted(y, w)})" for w in (color.Y_WEIGHTS, color.CB_WEIGHTS, color.CR_WEIGHTS))
    return f"""m(img, e, i, j) USING KEY (img) AS (
 SELECT img, e, CAST(1 AS BIGINT), CAST(2 AS BIGINT) FROM start
 UNION
 SELECT img, CASE WHEN k IS NULL THEN e ELSE list_concat(e[1:i - 1], [{{'r': {byte(mix('r'))}, 'g': {byte(mix('g'))}, 'b': {byte(mix('b'))}, 'w': e[i].w + e[k].w}}], e[i + 1:k - 1], e[k + 1:]) END,
  CASE WHEN forward AND k IS NULL THEN i + 1 WHEN forward THEN i ELSE len(e) END, CASE WHEN k IS NULL THEN i + 2 ELSE k END
 FROM (SELECT img, e, forward, CASE WHEN forward THEN i ELSE pick.i END AS i, CASE WHEN forward THEN list_filter(range(j, len(e) + 1), lambda q: {d2('e[i]', 'e[q]')} <= {radius * radius})[1] ELSE pick.j END AS k
  FROM (SELECT *, i <= len(e) AND j <= len(e) + 1 AND i < len(e) AS forward, CASE WHEN i >= len(e) THEN list_min(flatten(list_transform(range(1, len(e)), lambda a: list_transform(range(a + 1, len(e) + 1), lambda q: {{'d': {d2('e[a]', 'e[q]')}, 'i': a, 'j': q}})))) END AS pick FROM m WHERE i < len(e) OR len(e) > {wanted}))),
merged AS (SELECT img, e FROM m)"""


_MERGED = "SELECT CAST(img AS INT) AS img, CAST(q AS INT) AS idx, CAST(c.r AS INT) AS r, CAST(c.g AS INT) AS g, CAST(c.b AS INT) AS b FROM (SELECT img, q, e[least(q + 1, len(e))] AS c FROM merged, range({0}) t(q))"
_OPAQUE = f"a >= {color.OPAQUE}"


@query(f"WITH RECURSIVE {_full_cut_sql(256, False)} {_filled_sql('boxes')}")
def median_cut_full_picture(spark, d):
    return quantize.palettes(views.pixels(spark, d), "picture")


@query(f"WITH RECURSIVE {_full_cut_sql(255, True, _OPAQUE)}, few AS (SELECT img, count(*) <= 255 AS exact FROM colors GROUP BY img), seen AS (SELECT img, row_number() OVER (PARTITION BY img ORDER BY ord) - 1 AS idx, r, g, b FROM colors), own AS (SELECT seen.* FROM seen JOIN few USING (img) WHERE exact UNION ALL SELECT boxes.* FROM boxes JOIN few USING (img) WHERE NOT exact) {_filled_sql('own')}")
def median_cut_full_view(spark, d):
    return quantize.palettes(views.pixels(spark, d).where(F.col("a") >= color.OPAQUE), "view")


@query(f"WITH RECURSIVE {_full_cut_sql(256, False)}, whole AS ({_filled_sql('boxes')}), start AS (SELECT img, list({{'r': CAST(r AS BIGINT), 'g': CAST(g AS BIGINT), 'b': CAST(b AS BIGINT), 'w': CAST(1 AS BIGINT)}} ORDER BY idx) AS e FROM whole GROUP BY img), {_merge_sql(256, 6)} {_MERGED.format(256)}")
def median_cut_merged(spark, d):
    return quantize.palettes(views.pixels(spark, d), "picture", merge_radius=6)


@query(f"WITH RECURSIVE start AS (SELECT 0 AS img, list({{'r': CAST(r AS BIGINT), 'g': CAST(g AS BIGINT), 'b': CAST(b AS BIGINT), 'w': CAST(1 + idx % 3 AS BIGINT)}} ORDER BY idx) AS e FROM ({_PAL})), {_merge_sql(64, 12)} {_MERGED.format(64)}")
def palette_dedupe(spark, d):
    return quantize.merged_palettes(views.palette(spark, d).select(F.lit(0).alias("img"), "idx", "r", "g", "b", (1 + F.col("idx") % 3).alias("n")), 64, 12)


@query(f"WITH RECURSIVE {_full_cut_sql(256, False)}, whole AS ({_filled_sql('boxes')}) SELECT CAST(img AS INT) AS img, CAST(rgb AS INT) AS rgb, CAST(idx AS INT) AS idx FROM (SELECT c.img, c.r * 65536 + c.g * 256 + c.b AS rgb, w.idx, row_number() OVER (PARTITION BY c.img, c.r, c.g, c.b ORDER BY (c.r - w.r) * (c.r - w.r) + (c.g - w.g) * (c.g - w.g) + (c.b - w.b) * (c.b - w.b), w.idx) AS k FROM colors c JOIN whole w ON w.img = c.img AND w.idx < 255) WHERE k = 1")
def picture_lookup(spark, d):
    """Every colour's entry in its own image's palette."""
    return pipelines.looked_up(views.pixels(spark, d).select(F.col("img").cast("string").alias("path"), "pos", "r", "g", "b")).select(F.col("path").cast("int").alias("img"), "rgb", "idx")


# all pixels of all images, in tones so few (8 of red, a line number's blue) that every palette is exact
_TONE = "((r >> 5) * 32 * 65536 + b)"


@query(f"WITH seen AS (SELECT img, rgb, row_number() OVER (PARTITION BY img ORDER BY p) - 1 AS ord FROM (SELECT img, {_TONE} AS rgb, min(pos) AS p FROM ({_PX}) WHERE a >= 128 GROUP BY 1, 2)) SELECT i.img, CAST(range AS INT) AS idx, CAST(CASE WHEN range = 255 THEN 255 ELSE coalesce((rgb >> 16) & 255, 0) END AS INT) AS r, CAST(CASE WHEN range = 255 THEN 255 ELSE coalesce((rgb >> 8) & 255, 0) END AS INT) AS g, CAST(CASE WHEN range = 255 THEN 255 ELSE coalesce(rgb & 255, 0) END AS INT) AS b FROM (SELECT DISTINCT img FROM seen) i CROSS JOIN range(256) LEFT JOIN seen ON seen.img = i.img AND ord = range")
def view_palette_exact_tones(spark, d):
    tones = F.shiftleft(F.shiftright("r", 5), 5).alias("r"), F.lit(0).alias("g"), "b"
    return quantize.palettes(views.pixels(spark, d).where(F.col("a") >= color.OPAQUE).select("img", "pos", *tones), "view")


# -- files


def _packed(spark, d):
    """(img, pixels, palette): each vector as a 16 x 4 picture."""
    pal = views.palette(spark, d).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b"))), lambda p: F.struct(p.r.alias("r"), p.g.alias("g"), p.b.alias("b"))).alias("palette"))
    px = views.vectors(spark, d).groupBy("img").agg(F.unhex(binary.joined(F.col("x"), F.lpad(F.hex("v"), 2, "0"))).alias("pixels"))
    return px.crossJoin(F.broadcast(pal))


_HEX = f"SELECT img, string_agg(lpad(hex(v), 2, '0'), '' ORDER BY x) AS pixels FROM ({views.EMB_DUCK}) GROUP BY img"


@query(f"SELECT img, pixels, 16 AS width, 4 AS height FROM ({_HEX})")
def picture_roundtrip(spark, d):
    made = build.picture_files(_packed(spark, d).select(F.col("img").cast("string").alias("path"), "pixels", "palette", F.lit(16).alias("width"), F.lit(4).alias("height")))
    return files.pictures(made).select(F.col("path").cast("long").alias("img"), F.hex("pixels").alias("pixels"), "width", "height")


@query(f"SELECT img, CASE WHEN img % 4 = 1 THEN 'mirror' ELSE 'image' END AS kind, CASE WHEN img % 4 = 1 THEN NULL ELSE pixels END AS pixels FROM ({_HEX})")
def view_roundtrip(spark, d):
    img = F.col("img")
    mirror = img % 4 == 1
    own = _packed(spark, d).select(F.expr("string(img div 4)").alias("path"), (img % 4).cast("int").alias("loop"), F.lit(0).alias("cel"), F.when(mirror, "mirror").otherwise("image").alias("kind"), F.when(mirror, 0).alias("mirror_of"), F.lit(16).alias("width"), F.lit(4).alias("height"), F.lit(0).alias("x_hot"), F.lit(-1).alias("y_hot"), F.lit(255).alias("transparent"), "pixels", F.array_join(F.transform("palette", lambda c: F.concat(*[F.lpad(F.hex(c[k].cast("long")), 2, "0") for k in "rgb"])), "").alias("palette"))
    got = files.frames(build.view_files(own))
    return got.select((F.col("path").cast("long") * 4 + F.col("loop")).alias("img"), "kind", F.hex("pixels").alias("pixels"))


@query(f"SELECT idx, r, g, b, meta FROM ({_PAL})")
def riff_roundtrip(spark, d):
    made = build.content(build.riff_files(views.palette(spark, d).withColumn("path", F.lit("p")), "path"))
    return files.riff_palettes(made).select("idx", "r", "g", "b", "meta")


@query(f"SELECT idx, r, g, b, CAST(256 AS INT) AS n_colors, CAST(3 AS BIGINT) AS off FROM ({_PAL})")
def block_scan(spark, d):
    made = build.content(build.block_files(views.palette(spark, d).withColumn("path", F.lit("p")), "path").withColumn("hex", F.concat(F.lit("FF0003"), F.col("hex"))))
    return files.scanned_palettes(made).select("idx", "r", "g", "b", "n_colors", "off")


# -- pictures and views, from pixels to files and back


def _colored(spark, d):
    """(img, x, y, argb): each vector as 16 x 4 pixels in palette colours."""
    pal = F.broadcast(views.palette(spark, d).select(F.col("idx").alias("v"), color.argb(F.lit(255), palette.rgb_key()).alias("argb")))
    return _grid(spark, d).join(pal, "v").select("img", "x", "y", "argb")


_COLORED = f"pal AS ({_PAL}), {_E}, px AS (SELECT e.img, e.x, e.y, r, g, b, {_RGB} AS rgb FROM e JOIN pal ON pal.idx = e.v)"


@query(f"WITH pal AS ({_PAL}) SELECT DISTINCT vec_id AS img, idx, CASE WHEN idx = 255 THEN 0 ELSE r END AS r, CASE WHEN idx = 255 THEN 0 ELSE g END AS g, CASE WHEN idx = 255 THEN 0 ELSE b END AS b FROM embeddings, pal")
def picture_palette_roundtrip(spark, d):
    made = build.picture_files(_packed(spark, d).select(F.col("img").cast("string").alias("path"), "pixels", "palette", F.lit(16).alias("width"), F.lit(4).alias("height")))
    own = files.pictures(made).select(F.col("path").cast("long").alias("img"), F.unhex("palette").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(255))).alias("idx"))
    return own.select("img", "idx", *[binary.u8(F.col("t"), F.col("idx") * 3 + k).alias(c) for k, c in enumerate("rgb")])


def _drawn(made, to):
    """(img, x, y, rgb) of picture files; -1 where nothing is drawn."""
    own = files.pictures(made).select(F.col("path").cast("long").alias("img"), "pixels", F.unhex("palette").alias("t"), F.explode(F.sequence(F.lit(0), F.lit(to[0] * to[1] - 1))).alias("k"))
    own = own.select("img", F.expr(f"int(k % {to[0]})").alias("x"), F.expr(f"int(k div {to[0]})").alias("y"), "t", binary.u8(F.col("pixels"), F.col("k")).alias("idx"))
    rgb = color.pack(*[binary.u8(F.col("t"), F.col("idx") * 3 + k) for k in range(3)])
    return own.select("img", "x", "y", F.when(F.col("idx") == 255, -1).otherwise(rgb).alias("rgb"))


@query(f"WITH {_COLORED}, i AS (SELECT DISTINCT img FROM e) SELECT i.img, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, CAST(coalesce(rgb, -1) AS INT) AS rgb FROM i, range(20) a(cx), range(9) b(cy) LEFT JOIN px ON px.img = i.img AND px.x = cx - 2 AND px.y = cy - 2")
def picture_from_pixels(spark, d):
    own = _colored(spark, d).select(F.col("img").cast("string").alias("path"), "x", "y", "argb")
    return _drawn(pipelines.pictures_from_pixels(own, to=(20, 9)), (20, 9))


@query(f"WITH {_COLORED} SELECT px.img, CAST(cx AS INT) AS x, CAST(cy AS INT) AS y, CAST(rgb AS INT) AS rgb FROM range(8) a(cx), range(8) b(cy), px WHERE px.x = least(15, CAST(floor((cx + 12 + 0.5) / 2) AS INT)) AND px.y = CAST(floor((cy + 0.5) / 2) AS INT)")
def picture_from_pixels_cover(spark, d):
    own = _colored(spark, d).select(F.col("img").cast("string").alias("path"), "x", "y", "argb")
    return _drawn(pipelines.pictures_from_pixels(own, to=(8, 8), cover=True), (8, 8))


# eight vectors are a view: loops of two cels (16 x 4 and 32 x 2), of which the fourth mirrors the second
_FR = f"""fr AS (SELECT vec_id AS img, vec_id // 8 AS view, CAST(vec_id % 8 // 2 AS INT) AS lp, CAST(vec_id % 2 AS INT) AS cel, CAST(16 + vec_id % 2 * 16 AS INT) AS w, CAST(4 - vec_id % 2 * 2 AS INT) AS h,
 CAST(vec_id % 50 - 25 AS INT) AS x_hot, CAST(vec_id * 7 % 40 - 20 AS INT) AS y_hot, CAST(CASE WHEN vec_id % 2 = 0 THEN 255 ELSE 17 END AS INT) AS tr FROM embeddings WHERE vec_id % 8 < 6),
lo AS (SELECT view, lp, count(*) AS n_cels, FALSE AS mirror FROM fr GROUP BY view, lp UNION ALL SELECT DISTINCT vec_id // 8, 3, 0, TRUE FROM embeddings WHERE vec_id % 8 = 6),
vw AS (SELECT view, CASE WHEN view % 2 = 0 THEN 'A' ELSE 'B' END AS variant, CASE WHEN view % 2 = 0 THEN 18 ELSE 16 END AS size, count(*) AS loops, sum(n_cels) AS cels FROM lo GROUP BY view),
hd AS (SELECT *, 2 + size + 16 * loops AS tables, 2 + size + 16 * loops + (CASE WHEN variant = 'A' THEN 52 ELSE 36 END) * cels AS palette_at, CASE WHEN variant = 'A' THEN 52 ELSE 36 END AS stride FROM vw)"""
_VIEW_ROWS = f"SELECT vec_id * 8 + i // (16 + vec_id % 2 * 16) AS img, CAST(i % (16 + vec_id % 2 * 16) AS INT) AS x, CASE WHEN v = CASE WHEN vec_id % 2 = 0 THEN 255 ELSE 17 END THEN 255 ELSE v END AS v FROM (SELECT img AS vec_id, x AS i, v FROM ({views.EMB_DUCK})) WHERE vec_id % 8 < 6"


def _view_files(spark, d):
    """(path, content): views of several loops and cels, a mirror, hot spots, both variants and both strides."""
    own = _packed(spark, d).withColumnRenamed("img", "id").where("id % 8 < 7")
    i = F.col("id")
    mirror, odd = i % 8 == 6, (i % 2).cast("int")
    frames = own.select(
        F.expr("id div 8").alias("view"), F.expr("int(id % 8 div 2)").alias("loop"), odd.alias("cel"), F.when(mirror, "mirror").otherwise("image").alias("kind"), F.when(mirror, 1).alias("mirror_of"), (16 + odd * 16).alias("width"), (4 - odd * 2).alias("height"),
        (i % 50 - 25).cast("int").alias("x_hot"), (i * 7 % 40 - 20).cast("int").alias("y_hot"), F.when(odd == 0, 255).otherwise(17).alias("transparent"), "pixels", F.array_join(F.transform("palette", lambda c: F.concat(*[F.lpad(F.hex(c[k].cast("long")), 2, "0") for k in "rgb"])), "").alias("palette"),
    )
    frames = frames.withColumn("path", F.col("view").cast("string")).drop("view")
    even = F.col("path").cast("long") % 2 == 0
    one = build.view_files(frames.where(even))
    return one.unionByName(build.view_files(frames.where(~even), variant="B", resolution=(320, 200), flags=(0x0101, 0x31), cel_header=0x24, stamp=bytes(range(26))))


@query(f"WITH {_FR}, p AS ({_HEX}), c AS (SELECT string_agg(lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0'), '' ORDER BY idx) AS t FROM ({_PAL})), a AS (SELECT view, lp, cel, 'image' AS kind, -1 AS mirror_of, w, h, x_hot, y_hot, tr, pixels FROM fr JOIN p USING (img) UNION ALL SELECT view, lp, -1, 'mirror', 1, -1, -1, 0, 0, -1, '' FROM lo WHERE mirror) SELECT view, CASE WHEN view % 2 = 0 THEN 'A' ELSE 'B' END AS variant, lp, cel, kind, mirror_of, w, h, x_hot, y_hot, tr, pixels, md5(t) AS palette FROM a, c")
def view_frames_roundtrip(spark, d):
    got = files.frames(_view_files(spark, d))
    own = [F.coalesce(a, F.lit(z)).alias(b) for a, b, z in (("cel", "cel", -1), ("mirror_of", "mirror_of", -1), ("width", "w", -1), ("height", "h", -1), ("x_hot", "x_hot", 0), ("y_hot", "y_hot", 0), ("transparent", "tr", -1))]
    return got.select(F.col("path").cast("long").alias("view"), "variant", F.col("loop").alias("lp"), "kind", *own, F.coalesce(F.hex("pixels"), F.lit("")).alias("pixels"), F.md5(F.col("palette").cast("binary")).alias("palette"))


@query(f"WITH {_FR}, n AS (SELECT view, greatest(1, max(n_cels)) AS most FROM lo GROUP BY view) SELECT lo.view, lo.lp, CAST(q AS INT) AS cel, CASE WHEN mirror OR q >= n_cels THEN 'mirror' ELSE 'image' END AS kind, CASE WHEN mirror THEN 1 WHEN q >= n_cels THEN lo.lp ELSE -1 END AS mirror_of FROM lo JOIN n USING (view), range(2) t(q) WHERE q < most")
def view_frames_padded(spark, d):
    got = files.frames(_view_files(spark, d), pad=True)
    return got.select(F.col("path").cast("long").alias("view"), F.col("loop").alias("lp"), "cel", "kind", F.coalesce("mirror_of", F.lit(-1)).alias("mirror_of"))


@query(f"WITH {_FR} SELECT view, variant, size, CAST(loops AS INT) AS loops, CASE WHEN variant = 'A' THEN 65281 ELSE 257 END AS flags_a, CASE WHEN variant = 'A' THEN 48 ELSE 49 END AS flags_b, CAST(palette_at AS BIGINT) AS palette_at, 16 AS loop_header, stride AS cel_header, CASE WHEN variant = 'A' THEN 640 ELSE 320 END AS res_x, CASE WHEN variant = 'A' THEN 480 ELSE 200 END AS res_y FROM hd")
def view_header_rows(spark, d):
    return headers.view_headers(_view_files(spark, d)).withColumn("view", F.col("path").cast("long")).drop("path")


@query(f"WITH {_FR}, b AS (SELECT *, sum(n_cels) OVER (PARTITION BY view ORDER BY lp) - n_cels AS first FROM lo) SELECT view, lp, mirror AS is_mirror, CASE WHEN mirror THEN 1 ELSE -1 END AS mirror_of, CAST(n_cels AS INT) AS n_cels, CAST(tables + stride * first AS BIGINT) AS table_at, stride FROM b JOIN hd USING (view)")
def loop_header_rows(spark, d):
    got = headers.loop_headers(_view_files(spark, d))
    return got.select(F.col("path").cast("long").alias("view"), F.col("loop").alias("lp"), "is_mirror", F.coalesce("mirror_of", F.lit(-1)).alias("mirror_of"), "n_cels", "table_at", "stride")


_BEFORE = "sum({0}) OVER (PARTITION BY view ORDER BY lp, cel) - {0}"


@query(f"WITH {_isles(_VIEW_ROWS)}, {_FR}, sz AS (SELECT img // 8 AS img, CAST(count(*) AS BIGINT) AS control, CAST(sum(length(data) // 2) AS BIGINT) AS data FROM tok GROUP BY 1), pl AS (SELECT fr.*, control, data, palette_at + 1073 AS base, {_BEFORE.format('control')} AS c0, {_BEFORE.format('data')} AS d0, {_BEFORE.format('8 * h')} AS r0, sum(control) OVER (PARTITION BY view) AS cs, sum(data) OVER (PARTITION BY view) AS ds FROM fr JOIN sz USING (img) JOIN hd USING (view)) SELECT view, lp, cel, w, h, x_hot, y_hot, tr AS transparent, data AS data_bytes, control AS control_bytes, CAST(base + c0 AS BIGINT) AS control_at, CAST(base + cs + d0 AS BIGINT) AS data_at, CAST(base + cs + ds + 6 + r0 AS BIGINT) AS rows_at FROM pl")
def cel_header_rows(spark, d):
    return headers.cel_headers(_view_files(spark, d)).withColumn("view", F.col("path").cast("long")).withColumnRenamed("loop", "lp").drop("path")


@query(f"WITH {_FR}, c AS (SELECT '000325040000' || '0000' || '0E' || repeat('00', 9) || '01' || '0000' || repeat('00', 10) || '0000' || '0000' || '0001' || '01' || '00' || '00000000' || string_agg('01' || lpad(hex(r), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(b), 2, '0'), '' ORDER BY idx) AS chunk FROM ({_PAL})) SELECT view, chunk FROM hd, c")
def view_palette_chunk(spark, d):
    made = _view_files(spark, d)
    at = headers.view_headers(made).select("path", "palette_at")
    return made.join(at, "path").select(F.col("path").cast("long").alias("view"), F.hex(F.col("content").substr((F.col("palette_at") + headers.STAMP + 1).cast("int"), F.lit(1067))).alias("chunk"))


@query(f"WITH {_FR}, a AS (SELECT view, lp, cel, FALSE AS mirror, w, h FROM fr UNION ALL SELECT view, lp, 0, TRUE, 0, 0 FROM lo WHERE mirror) SELECT view || '/Cell' || cel || '/Loop' || lp || '/' || CASE WHEN mirror THEN 'mirror_of_1.txt' ELSE 'view_' || cel || '_loop' || lp || '.png' END AS path, w, h FROM a")
def view_dump(spark, d):
    c = F.col("content")
    side = lambda k: F.coalesce(*[binary.u8(c, k + 2) * 256 + binary.u8(c, k + 3)], F.lit(0))
    return build.frame_dump(files.frames(_view_files(spark, d))).select("path", side(16).alias("w"), side(20).alias("h"))


# colours in scan order of the first cel; every other pixel takes the nearest of them or of the black beyond
@query(f"""WITH {_COLORED}, q AS (SELECT img // 8 AS view, CAST(img % 8 // 2 AS INT) AS lp, CAST(img % 2 AS INT) AS cel, x, y, rgb FROM px),
first AS (SELECT view, rgb, row_number() OVER (PARTITION BY view ORDER BY min(y * 65536 + x)) - 1 AS idx FROM q WHERE lp = 0 AND cel = 0 GROUP BY view, rgb),
entry AS (SELECT view, rgb, idx FROM first UNION ALL SELECT view, 0, count(*) FROM first GROUP BY view),
c AS (SELECT DISTINCT view, rgb FROM q),
near AS (SELECT view, rgb, idx FROM (SELECT c.view, c.rgb, idx, row_number() OVER (PARTITION BY c.view, c.rgb ORDER BY ((c.rgb >> 16) - (t.rgb >> 16)) * ((c.rgb >> 16) - (t.rgb >> 16)) + ((c.rgb >> 8 & 255) - (t.rgb >> 8 & 255)) * ((c.rgb >> 8 & 255) - (t.rgb >> 8 & 255)) + ((c.rgb & 255) - (t.rgb & 255)) * ((c.rgb & 255) - (t.rgb & 255)), idx) AS k FROM c JOIN entry t ON t.view = c.view) WHERE k = 1)
SELECT q.view, lp, cel, string_agg(lpad(hex(idx), 2, '0'), '' ORDER BY y, x) AS pixels FROM q JOIN near ON near.view = q.view AND near.rgb = q.rgb GROUP BY q.view, lp, cel""")
def view_from_pixels(spark, d):
    own = _colored(spark, d).select(F.expr("string(img div 8)").alias("path"), F.expr("int(img % 8 div 2)").alias("loop"), (F.col("img") % 2).cast("int").alias("cel"), "x", "y", "argb")
    got = files.frames(pipelines.views_from_pixels(own))
    return got.select(F.col("path").cast("long").alias("view"), F.col("loop").alias("lp"), "cel", F.hex("pixels").alias("pixels"))


@query(f"SELECT idx, r, g, b, 0 AS meta FROM ({_PAL})")
def block_read(spark, d):
    made = build.content(build.block_files(views.palette(spark, d).withColumn("path", F.lit("p")), "path"))
    return files.block_palettes(made).select("idx", "r", "g", "b", "meta")


_SEEN = "CASE WHEN (x + y) % 5 = 0 THEN 0 ELSE 255 END"


def _seen_pixels(spark, d):
    own = _colored(spark, d)
    return own.select(F.col("img").cast("string").alias("path"), "x", "y", F.when((F.col("x") + F.col("y")) % 5 == 0, F.col("argb").bitwiseAND(0xFFFFFF)).otherwise(F.col("argb")).alias("argb"))


@query(f"WITH {_COLORED} SELECT img, 4 AS height, 16 AS width, 4 AS channels, 24 AS mode, string_agg(lpad(hex(b), 2, '0') || lpad(hex(g), 2, '0') || lpad(hex(r), 2, '0') || lpad(hex({_SEEN}), 2, '0'), '' ORDER BY y, x) AS data FROM px GROUP BY img")
def image_bytes(spark, d):
    got = build.image_structs(_seen_pixels(spark, d))
    return got.select(F.col("path").cast("long").alias("img"), "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.mode", F.hex("image.data").alias("data"))


@query(f"WITH {_COLORED} SELECT img, x, y, CAST(rgb + CASE WHEN {_SEEN} = 255 THEN -16777216 ELSE 0 END AS INT) AS argb FROM px")
def image_pixels_roundtrip(spark, d):
    made = build.image_structs(_seen_pixels(spark, d)).select("path", "image.height", "image.width", F.col("image.nChannels").alias("channels"), "image.data")
    return files.image_pixels(made).select(F.col("path").cast("long").alias("img"), "x", "y", "argb")


@query(f"WITH {_COLORED} SELECT img, CAST(img % 8 AS INT) AS lp, x, y, CAST(rgb - 16777216 AS INT) AS argb FROM px")
def image_files(spark, d):
    """Pictures exported as images, written, and loaded again by the numbers in their names."""
    made = build.picture_images(files.pictures(build.picture_files(_packed(spark, d).select(F.format_string("%d", "img").alias("path"), "pixels", "palette", F.lit(16).alias("width"), F.lit(4).alias("height")))))
    stem = paths.stem(F.col("path"))
    at = sink.save(made.select(F.concat(stem, F.lit("-"), (stem.cast("long") % 8).cast("string"), F.lit("-0.bmp")).alias("path"), "content"), sink.scratch(spark))
    got = files.loop_images(spark, at)
    lp = got.select("path", "loop")
    own = files.image_pixels(got.drop("loop")).join(lp, "path")
    return own.select(F.regexp_extract("path", r"(\d+)-\d+-0\.bmp$", 1).cast("long").alias("img"), F.col("loop").alias("lp"), "x", "y", "argb")


@query("SELECT n_name || '.bin' AS name, hex(encode(n_name || '/' || n_regionkey)) AS content FROM nation")
def whole_files(spark, d):
    own = spark.read.parquet(f"{d}/nation.parquet").select(F.concat("n_name", F.lit(".bin")).alias("path"), F.encode(F.concat_ws("/", "n_name", "n_regionkey"), "UTF-8").alias("content"))
    got = files.binary(spark, sink.save(own, sink.scratch(spark)), "*.bin")
    return got.select(F.replace(F.element_at(F.split("path", "/"), -1), F.lit("%20"), F.lit(" ")).alias("name"), F.hex("content").alias("content"))


# -- broken files: one fault a file, by the nation's number; reasons instead of rows

_FAULTS = {
    "riff": ((1, "524946", "000000", "not a RIFF file"), (17, "50414C20", "50415820", "not a palette"), (0, None, 20, "RIFF header cut off"), (0, None, 200, "entries cut off")),
    "block": ((1, "0003", "0004", "no palette block"), (0, None, 4, "block cut off"), (0, None, 30, "header cut off"), (0, None, 400, "entries cut off")),
    "picture": ((1, "8181", "8281", "wrong tag"), (9, "0E00", "0F00", "wrong header size"), (0, None, 100, "file too short"), (0, None, 1800, "pixels cut off")),
    "view": ((53, "1200", "1100", "unknown view header"), (0, None, 60, "file too short"), (0, None, 232, "palette cut off"), (57, "0100", "0000", "no loops")),
}


def _faulty(made, form):
    """(path, content): ``made``'s one file (hex) for each nation, four of five of them broken."""
    own, kind = F.col("hex"), F.expr("int(k % 5)")
    cases = F.when(F.lit(False), own)
    for n, (at, old, new, _) in enumerate(_FAULTS[form], 1):
        cut = F.substring(own, 1, new) if old is None else F.concat(F.substring(own, 1, at - 1), F.lit(new), own.substr(F.lit(at + len(new)), F.length(own)))
        cases = cases.when(kind == n, cut)
    return made.select(F.col("k").cast("string").alias("path"), F.unhex(cases.otherwise(own)).alias("content"))


@query("SELECT n_nationkey AS k, form, " + "CASE form " + " ".join(f"WHEN '{f}' THEN CASE n_nationkey % 5 " + " ".join(f"WHEN {n} THEN '{c[3]}'" for n, c in enumerate(cases, 1)) + " ELSE '' END" for f, cases in _FAULTS.items()) + " END AS error, CASE WHEN n_nationkey % 5 > 0 THEN 1 WHEN form IN ('riff', 'block') THEN 256 ELSE 1 END::BIGINT AS n FROM nation, (VALUES ('riff'), ('block'), ('picture'), ('view')) t(form)")
def broken_files(spark, d):
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("k"))
    pal = views.palette(spark, d)
    whole = pal.withColumn("img", F.lit(0))
    packed = spark.range(1).select(F.lit("0").alias("path"), F.unhex(F.lit("01" * 64)).alias("pixels")).crossJoin(F.broadcast(pal.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "r", "g", "b"))), lambda p: F.struct(p.r.alias("r"), p.g.alias("g"), p.b.alias("b"))).alias("palette"))))
    frame = packed.select("path", F.lit(0).alias("loop"), F.lit(0).alias("cel"), F.lit("image").alias("kind"), F.lit(None).cast("int").alias("mirror_of"), F.lit(16).alias("width"), F.lit(4).alias("height"), F.lit(0).alias("x_hot"), F.lit(0).alias("y_hot"), F.lit(255).alias("transparent"), "pixels", F.lit("00" * 768).alias("palette"))
    made = {
        "riff": build.riff_files(whole, "img").select("hex"),
        "block": build.block_files(whole, "img").select("hex"),
        "picture": build.picture_files(packed.select("path", "pixels", "palette", F.lit(16).alias("width"), F.lit(4).alias("height"))).select(F.hex("content").alias("hex")),
        "view": build.view_files(frame).select(F.hex("content").alias("hex")),
    }
    read = {"riff": files.riff_palettes, "block": files.block_palettes, "picture": files.pictures, "view": files.frames}
    parts = [read[f](_faulty(nations.crossJoin(F.broadcast(made[f])), f), strict=False).select(F.col("path").cast("int").alias("k"), F.lit(f).alias("form"), F.coalesce("error", F.lit("")).alias("error")) for f in _FAULTS]
    own = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return own.groupBy("k", "form", "error").agg(F.count(F.lit(1)).alias("n"))
