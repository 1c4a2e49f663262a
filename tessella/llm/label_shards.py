"""Sharding by balanced label propagation. DataFrame operations only.

Documents of equal text are linked. A vertex is the documents of one text that start on one shard (of large groups, those
of one salt too, so that a vertex is small against a shard); vertices of one text are neighbours. Each round

1. counts, by joins on the text, how much of a group lies on which shard;
2. lets a vertex want the shard with room on which most of its group lies (ties by a hash), or one of the few such shards
   if its group fills several;
3. deals the vertices that want a shard to buckets and admits whole buckets, in order, while the shard's quota holds.

So every round cuts fewer links and no shard passes its quota. Documents without a copy, and what a shard holds beyond its
quota from the start, then fill the shards up exactly, by distributed ranks (prefix sums of bucket counts, and row numbers
within small buckets).

Defined results (law ``rows``)
------------------------------
* counts of any two shards differ by at most one; slots count from 0 in every shard without gaps;
* null text: size 1, checksum 0, linked with nothing; empty texts are equal texts; null keys are documents like others;
* repeated rows are equal texts and each gets a slot; an empty table gives an empty result; extra columns are ignored;
* where documents start depends on the rows' places in the input, so that repeated rows spread: the same files, split alike,
  give the same layout.

What reaches the driver: 16 counts a round, and sums by bucket that are few by construction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut

SHARDS = 16
ROUNDS = 5
#: Parts of a shard's initial documents of one text that are vertices of their own.
SALTS = 32
#: Buckets of the vertices that want one shard.
BUCKETS = 256
#: Documents of a bucket in which rows are numbered, and buckets whose counts are summed up by one task.
RANKED, SPAN = 4096, 4096
#: Documents of a group from which on its vertices meet its homes by salt, not all in one place.
HOT = 256


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def by_shard(shard: Column, values: list[int]) -> Column:
    """The value of a shard; one of few, so a literal table."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), shard + 1)


def propagate(vertices: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """``vertices`` (grp, start, salt, n, group_size, shard, ...) with other shards."""
    shards = len(quota)
    for k in range(rounds):
        load = [0] * shards
        for r in vertices.groupBy("shard").agg(F.sum("n").alias("n")).collect():
            load[r.shard] = r.n
        room = [max(0, q - x) for q, x in zip(quota, load, strict=True)]
        cells = vertices.groupBy("grp", "shard").agg(F.sum("n").alias("c"))
        # a group's homes: the shards that hold most of it, as many as it fills and, if that is many, more from round to round
        fills = cells.groupBy("grp").agg(F.ceil(F.sum("c") / max(1, min(quota))).cast("int").alias("fills"), F.sum("c").alias("size"))
        place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("c"), F.xxhash64("grp", "shard")))
        homes = cells.withColumn("place", place).join(fills, "grp").where(F.col("place") <= F.col("fills") + F.when(F.col("fills") > 1, k // 2).otherwise(0))
        want = homes.groupBy("grp").agg(F.array_sort(F.collect_list(F.when(by_shard(F.col("shard"), room) > 0, F.col("shard")))).alias("targets"), F.collect_set("shard").alias("homes"), F.first("fills").alias("fills"), F.first("size").alias("size"))
        want = want.withColumn("j", F.explode(F.when(F.col("size") < HOT, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))).drop("size")
        by_salt = F.when(F.col("group_size") < HOT, F.lit(-1)).otherwise(F.col("salt"))
        moves = vertices.withColumn("j", by_salt).join(want, ["grp", "j"]).where(~F.array_contains("homes", F.col("shard")) & (F.size("targets") > 0))
        # a small group moves as a whole; a large one by its vertices
        whole = F.when(F.col("fills") > 1, F.xxhash64("start", "salt")).otherwise(F.lit(0))
        to = F.element_at("targets", (F.pmod(F.xxhash64("grp", whole, F.lit(k)), F.size("targets")) + 1).cast("int"))
        moves = moves.select("grp", "start", "salt", "n", to.alias("to"), F.pmod(F.xxhash64("grp", whole, F.lit(-k - 1)), F.lit(BUCKETS)).cast("int").alias("bucket"))
        sums = moves.groupBy("to", "bucket").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(Window.partitionBy("to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        admitted = sums.withColumn("upto", before).where(F.col("upto") <= by_shard(F.col("to"), room)).select("to", "bucket")
        moved = moves.join(F.broadcast(admitted), ["to", "bucket"]).select("grp", "start", "salt", "to")  # at most shards * BUCKETS rows
        vertices = cut(vertices.join(moved, ["grp", "start", "salt"], "left").select(*[c for c in vertices.columns if c != "shard"], F.coalesce("to", "shard").alias("shard")))
    return vertices


def ranked(df: DataFrame, within: list[str], buckets: int, name: str) -> DataFrame:
    """``df`` with a rank from 0, without gaps, within the columns ``within``; no task numbers more than a bucket."""
    df = df.withColumn("__bucket", F.pmod(F.xxhash64("spread"), F.lit(buckets)).cast("int"))
    sums = df.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    # counts of buckets are summed up by spans, and those of spans by one task: rows / (RANKED * SPAN) of them
    sums = sums.withColumn("__span", F.expr(f"__bucket div {SPAN}"))
    spans = sums.groupBy(*within, "__span").agg(F.sum("__n").alias("__all"))
    order = Window.partitionBy(*within).orderBy("__span") if within else Window.orderBy("__span")
    spans = spans.withColumn("__base", F.sum("__all").over(order) - F.col("__all")).drop("__all")
    inner = Window.partitionBy(*within, "__span").orderBy("__bucket")
    sums = sums.withColumn("__upto", F.sum("__n").over(inner) - F.col("__n"))
    before = sums.join(spans, [*within, "__span"]).select(*within, "__bucket", (F.col("__base") + F.col("__upto")).alias("__before"))
    row = F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy("doc_id", "crc", "size", "spread"))
    return df.withColumn("__row", row).join(before, [*within, "__bucket"]).withColumn(name, F.col("__before") + F.col("__row") - 1).drop("__bucket", "__before", "__row")


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size) of each row."""
    t = F.col("text")
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    own = own.select("doc_id", (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(t.cast("binary")), F.lit(0)).cast("long").alias("crc"), F.unhex(F.md5(t.cast("binary"))).alias("grp"))
    # one row's own number tells repeated rows apart when they are dealt out
    own = own.withColumn("spread", F.xxhash64("doc_id", "crc", F.monotonically_increasing_id()))
    own = own.withColumn("start", F.pmod(F.xxhash64("doc_id", "spread"), F.lit(shards)).cast("int")).withColumn("salt", F.pmod(F.xxhash64("spread", F.lit(1)), F.lit(SALTS)).cast("int"))
    own = cut(own)
    total = own.count()
    quota = quotas(total, shards)
    # a group's vertices: its documents by start, and by salt too
    parts = own.where("grp is not null").groupBy("grp", "start", "salt").agg(F.count(F.lit(1)).alias("n"))
    groups = parts.groupBy("grp").agg(F.sum("n").alias("group_size")).where("group_size > 1")
    linked = cut(parts.join(groups, "grp"))
    placed = propagate(linked.withColumn("shard", F.col("start")), quota, rounds)
    own = cut(own.join(placed.select("grp", "start", "salt", "shard", "group_size"), ["grp", "start", "salt"], "left"))

    buckets = max(1, -(-total // RANKED))
    load = [0] * shards
    for r in own.where("shard is not null").groupBy("shard").count().collect():
        load[r.shard] = r["count"]
    if any(x > q for x, q in zip(load, quota, strict=True)):  # more than the quota from the start
        over = ranked(own.where("shard is not null"), ["shard"], max(1, buckets // shards), "rank")
        over = over.withColumn("shard", F.when(F.col("rank") < by_shard(F.col("shard"), quota), F.col("shard"))).drop("rank")
        own = cut(over.unionByName(own.where("shard is null")))
        load = [min(x, q) for x, q in zip(load, quota, strict=True)]
    gaps = [q - x for q, x in zip(quota, load, strict=True)]
    edges = [sum(gaps[: s + 1]) for s in range(shards)]
    free = ranked(own.where("shard is null"), [], buckets, "rank")
    fill = reduce(lambda c, s: c.when(F.col("rank") < edges[s], F.lit(s)), range(1, shards), F.when(F.col("rank") < edges[0], F.lit(0)))
    own = own.where("shard is not null").unionByName(free.withColumn("shard", fill).drop("rank"))
    out = ranked(cut(own), ["shard"], max(1, buckets // shards), "slot")
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
