"""Stand-in pixels, palettes, rows and loops, projected from business tables; SQL text for both engines where they differ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: No shorter key orders lineitem uniquely.
SCAN = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
_RGB = "CAST(l_partkey % 256 AS INT) AS r, CAST(l_suppkey * 7 % 256 AS INT) AS g, CAST(l_linenumber * 31 % 256 AS INT) AS b, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 255 END AS a"

PX_UNORDERED = f"SELECT CAST(l_suppkey % 8 AS INT) AS img, {_RGB} FROM lineitem"
PX = f"SELECT CAST(l_suppkey % 8 AS INT) AS img, CAST(row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY {SCAN}) - 1 AS INT) AS pos, {_RGB} FROM lineitem"
_PAL = "SELECT CAST(i.idx AS INT) AS idx, coalesce(CAST(p_partkey * 37 % 256 AS INT), 0) AS r, coalesce(CAST(p_partkey * 91 % 256 AS INT), 0) AS g, coalesce(CAST(p_partkey * 53 % 256 AS INT), 0) AS b, 0 AS meta FROM (SELECT {0} AS idx FROM range(256)) i LEFT JOIN part ON p_partkey = i.idx"
#: Other parts match nothing: they are left out before the join, whose right side Spark may send to the driver whole.
PALETTE, PALETTE_DUCK = _PAL.format("id") + " AND p_partkey BETWEEN 0 AND 255", _PAL.format("range")
ROWS = "SELECT user_id AS img, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS x, CAST(CASE event_type WHEN 'error' THEN 255 ELSE length(event_type) END AS INT) AS v FROM events"
LOOPS = "SELECT CAST(0 AS INT) AS view, n_nationkey AS lp, CASE WHEN n_nationkey % 3 = 1 THEN 'mirror' ELSE 'image' END AS kind, CASE WHEN n_nationkey % 3 = 1 THEN n_nationkey - 1 END AS mirror_of, CASE WHEN n_nationkey % 3 = 1 THEN 0 ELSE 1 + n_regionkey END AS n_cels FROM nation"
EMB = "SELECT vec_id AS img, pos AS x, CAST(least(254, greatest(0, floor((CAST(e AS DOUBLE) + 1D) * 127.5D))) AS INT) AS v FROM embeddings LATERAL VIEW posexplode(embedding) AS pos, e WHERE pos < 64"
EMB_DUCK = "SELECT vec_id AS img, CAST(i AS INT) AS x, CAST(least(254, greatest(0, floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5))) AS INT) AS v FROM embeddings, range(64) t(i)"

TABLES = ("nation", "part", "lineitem", "events", "embeddings", "documents")


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's rows: only the tables that its text names are read, without names left behind in the session."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text}
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(text, **used)


def pixels(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    return sql(spark, sf_dir, PX if ordered else PX_UNORDERED)


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, PALETTE)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, ROWS)


def loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, LOOPS)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, EMB)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(view, lp, cel, kind, mirror_of): the cels of image loops, and mirrors as one row."""
    own = loops(spark, sf_dir)
    return own.select("view", "lp", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n_cels"), F.lit(1)) - 1)).alias("cel"), "kind", "mirror_of")
