"""Connected components of an edge table by alternating large and small stars; every step is a join and an aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: Steps double what a path shortens by; this many would join paths longer than any table.
MOST_ROUNDS = 64


def _edges(df: DataFrame) -> DataFrame:
    return df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node in ``edges`` (a, b): the smallest id reachable. Nodes without an edge are absent.

    Null ends and loops are ignored; edges may repeat and go either way."""
    own = cut(_edges(edges))
    seen = None
    for _ in range(MOST_ROUNDS):
        state = own.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if not state.n or (state.n, state.x) == seen:
            break
        seen = state.n, state.x
        both = own.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(own.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"), F.col("m").alias("a")).where("a < b").select("a", "b").distinct()
        own = cut(small)
    return own.select(F.col("b").alias("id"), F.col("a").alias("component")).unionByName(own.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
