"""Run-length coding of pixel rows as gaps and islands: no row is ever held by one function call.

Tokens of a row: ``T`` runs of the transparent index, ``R`` runs of one value, ``L`` literals; at most 63 pixels each. A
run needs three pixels, counted in pieces of 63. Control bytes are 192, 128 or 0 plus the length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST = 63
RUN = 3
BASE = {"T": 192, "R": 128, "L": 0}


def tokens(rows: DataFrame, keys: list[str], transparent: int = 255) -> DataFrame:
    """(keys, start, kind, n, ctl, data) of pixel rows (keys, x, v); ``data`` is hex. One exchange, on the keys."""
    row = Window.partitionBy(*keys).orderBy("x")
    d = rows.withColumn("isle", F.col("x") - F.row_number().over(Window.partitionBy(*keys, "v").orderBy("x")))
    isle = Window.partitionBy(*keys, "v", "isle")
    d = d.withColumn("off", F.row_number().over(isle.orderBy("x")) - 1).withColumn("len", F.count(F.lit(1)).over(isle))
    left = F.col("len") - (F.col("off") - F.col("off") % MOST)
    d = d.withColumn("kind", F.when(F.col("v") == transparent, "T").when(left >= RUN, "R").otherwise("L"))
    # literals that follow each other are one stretch, in pieces of 63
    d = d.withColumn("stretch", F.sum(F.when(F.lag("kind").over(row) == F.col("kind"), 0).otherwise(1)).over(row))
    inside = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("x")) - 1
    d = d.withColumn("start", F.when(F.col("kind") == "L", F.col("x") - inside % MOST).otherwise(F.col("x") - F.col("off") % MOST))
    out = d.groupBy(*keys, "start", "kind").agg(F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: F.lpad(F.hex(p.v), 2, "0")), "").alias("all"))
    base = F.when(F.col("kind") == "T", BASE["T"]).when(F.col("kind") == "R", BASE["R"]).otherwise(BASE["L"])
    data = F.when(F.col("kind") == "T", "").when(F.col("kind") == "R", F.substring("all", 1, 2)).otherwise(F.col("all"))
    return out.select(*keys, F.col("start").cast("int").alias("start"), "kind", "n", (base + F.col("n")).alias("ctl"), data.alias("data"))


def streams(tokens_: DataFrame, keys: list[str]) -> DataFrame:
    """The control and data bytes of each row as hex, in order."""
    parts = F.array_sort(F.collect_list(F.struct("start", F.lpad(F.hex("ctl"), 2, "0").alias("c"), F.col("data").alias("d"))))
    return tokens_.groupBy(*keys).agg(parts.alias("p")).select(*keys, F.array_join(F.transform("p", lambda t: t.c), "").alias("control"), F.array_join(F.transform("p", lambda t: t.d), "").alias("data"))


def decoded(tokens_: DataFrame, keys: list[str], width: int | None = None, transparent: int = 255) -> DataFrame:
    """Pixels (keys, x, v) of tokens (keys, ord, ctl, data): places are prefix sums of lengths; what lies past ``width`` goes."""
    n = F.col("ctl").bitwiseAND(63)
    kind = F.when(F.col("ctl") >= BASE["T"], "T").when(F.col("ctl") >= BASE["R"], "R").otherwise("L")
    length = F.when(kind == "L", F.col("ctl").bitwiseAND(127)).otherwise(n)
    d = tokens_.withColumn("kind", kind).withColumn("n", length)
    d = d.withColumn("x0", F.sum("n").over(Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    d = d.select(*keys, "kind", "data", "x0", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("k"))
    at = F.when(F.col("kind") == "L", F.col("k") * 2 + 1).otherwise(F.lit(1))
    value = F.when(F.col("kind") == "T", F.lit(transparent)).otherwise(F.conv(F.col("data").substr(at, F.lit(2)), 16, 10).cast("int"))
    out = d.select(*keys, (F.col("x0") + F.col("k")).cast("int").alias("x"), value.alias("v"))
    return out if width is None else out.where(F.col("x") < width)
