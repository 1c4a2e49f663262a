"""N-gram Jaccard join over a token-group matrix. Exact: every pair at or above the threshold is linked.

Sets are of 64-bit shingle hashes. Two sets can only reach the threshold if they share a token among the rarest tokens of
each (their prefixes, under one global order); how deep depends on both sizes.

1. A table of counts over all documents orders the tokens, rare ones first. It has a cell for about every 2 KB of text,
   from 2**18 to 2**24 cells, so the order tells common tokens from rare ones at any size.
2. Documents of equal sets form a class; one of each class goes on.
3. Groups of similar documents: each token's leader is the document in whose order it comes first; a document is verified
   against the leaders of its tokens, and those that link are one group. A group of any size costs its members, not pairs.
4. The token-group matrix holds, for each token and group, the union of its members' prefixes with the bounds of their
   sizes and places. A document asks for all its tokens in groups larger than its own (of equal ones, those of a larger
   number). The first token that linked sets share has a place of its own: it is among the leading tokens of the smaller
   set, about the first half of its prefix, and early enough in both for their sizes. Only such meetings make rows, so copies
   of one text that differ by a little too much, and share no token but later ones, do not meet in pairs.
   Then the overlap with a group's union is counted before the group is looked into. Linked sets have a least number of
   tokens in common in their prefixes, so a group whose union holds fewer is not opened. Members of the qualifying groups
   are verified.
5. Links of both rounds are united to components.

Verification first counts what the prefixes have in common, which rules out chance meetings, then the sets' common
shingles. One set of each pair travels to the other; a document in very many pairs is a skewed key of those joins, which
adaptive execution splits. Sets are computed again from the texts for the documents in question, picked by a bitmap of about
16 bits for each of them and at most 2**27: beyond some 16 M such documents it lets others pass too, whose sets are
shuffled and dropped.

Defined results
---------------
* null or wordless text: an empty set, linked with nothing, its own component; fewer words than a shingle: one shingle;
* rows that repeat are one document each with the same component; a null key links nothing but is returned;
* an empty table gives an empty result; extra columns are ignored by :func:`join` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.components import components


class Rule(NamedTuple):
    """Sets of ``shingle``-word shingles are linked when parts * intersection >= least * union."""

    shingle: int
    least: int
    parts: int

    def prefix_length(self, n: Column | int):
        """Tokens of a set of ``n`` that any partner must meet: n - ceil(n * least / parts) + 1."""
        return n - -(-self.least * n // self.parts) + 1

    def need(self, n: Column, m: Column) -> Column:
        """Common tokens that sets of these sizes need."""
        return ((self.least * (n + m) + self.least + self.parts - 1) / (self.least + self.parts)).cast("long")

    def may_link(self, n: Column, i: Column, m: Column, j: Column) -> Column:
        """Whether sets of sizes n and m that share a token at places i and j may reach the threshold by what that tells."""
        return (self.parts * F.least(n, m) >= self.least * F.greatest(n, m)) & (i <= n - self.need(n, m)) & (j <= m - self.need(n, m))

    def leads(self, n: Column, i: Column) -> Column:
        """Whether place i of n is one that the first token shared with a linked set of as many tokens or more may have."""
        return i <= n - self.need(n, n)

    def shared_in_prefixes(self, n: Column, m: Column) -> Column:
        """Tokens that the prefixes of linked sets of these sizes have in common at least: those the rest of either can't hold."""
        size = lambda k: k - F.ceil(self.least * k / self.parts) + 1
        return F.least(self.need(n, m) - n + size(n), self.need(n, m) - m + size(m))

    def least_overlap(self, n: Column, low: Column, high: Column) -> Column:
        """The least of :meth:`shared_in_prefixes` for partners of ``low`` to ``high`` tokens.

        The first of its two bounds rises with the partner's size; the second falls, but for a rounding of one."""
        first = self.need(n, low) - F.ceil(self.least * n / self.parts) + 1
        second = self.need(n, high) - F.ceil(self.least * high / self.parts)
        return F.greatest(F.lit(1), F.least(first, second))


#: The contract of op6: three words at 0.9.
CONTRACT = Rule(3, 9, 10)
#: The pipeline's stage: five words at 0.8.
CORPUS = Rule(5, 4, 5)
SHINGLE = CONTRACT.shingle
#: Cells of the table of counts, as powers of two, and the bytes of text for each.
LEAST_BITS, MOST_BITS, BYTES_PER_CELL = 18, 24, 2048
SKETCH_SLICES = 16
#: Bits of the map that picks documents whose sets are needed: for each document, and the powers of two at least and most.
MAP_SHARE, LEAST_MAP, MOST_MAP = 16, 20, 27
CACHE = 60_000

FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
A, B, C, D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


class Shingler:
    """Shingle hashes of texts; words are hashed once and remembered."""

    def __init__(self, n: int = SHINGLE):
        self.n = n
        self.known: dict[bytes, int] = {}

    def hashes(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Shingles of all texts, one after another with repeats, and where each text's begin and end."""
        import xxhash

        split = [t.translate(FOLD).split() if t else [] for t in texts]
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for w in set().union(*split).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        words = np.array([known[w] for ws in split for w in ws], dtype=np.uint64)
        lengths = np.array([len(ws) for ws in split])
        ends = np.cumsum(lengths)
        n = self.n
        m = max(0, len(words) - n + 1)
        h = np.full(m, D, dtype=np.uint64)
        for k in range(n):
            h = (h ^ words[k : k + m]) * (A if k % 2 == 0 else B)
            h ^= h >> np.uint64(29)
        h *= C
        h ^= h >> np.uint64(32)
        # windows that reach into the next text go; short texts are one shingle
        keep = np.ones(m, dtype=bool)
        for back in range(1, n):
            at = ends - back
            at = at[(at >= 0) & (at < m)]
            keep[at] = False
        counts = np.maximum(lengths - n + 1, 0)
        h = h[keep]
        short = np.flatnonzero((lengths > 0) & (lengths < n))
        if not len(short):
            return h, np.concatenate([[0], np.cumsum(counts)])
        edges = np.concatenate([[0], np.cumsum(counts)])
        parts, last = [], 0
        for k in short:
            parts += [h[last : edges[k]], np.array([xxhash.xxh3_64_intdigest(b" ".join(split[k]), seed=len(split[k]))], dtype=np.uint64)]
            last = edges[k]
            counts[k] = 1
        return np.concatenate([*parts, h[last:]]), np.concatenate([[0], np.cumsum(counts)])

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        h, edges = self.hashes(texts)
        return [np.unique(h[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def _bytes(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def power(n: float, least: int, most: int) -> int:
    """The power of two that is at least ``n``, within bounds."""
    return min(most, max(least, math.ceil(math.log2(max(1, n)))))


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in the smallest type that holds them."""
    return counts.astype(next(t for t in ("<u1", "<u2", "<u4", "<u8") if not len(counts) or counts.max() <= np.iinfo(t).max))


def levels(counts: np.ndarray) -> np.ndarray:
    """The order of the counts in 16 bits: themselves, or of larger ones how many of 65,536 even steps lie below."""
    if counts.max(initial=0) < 1 << 16:
        return counts.astype(np.uint16)
    steps = np.sort(counts)[np.linspace(0, len(counts) - 1, 1 << 16).astype(np.int64)]
    return (np.searchsorted(steps, counts, "right") - 1).astype(np.uint16)


def sketch(docs: DataFrame, rule: Rule = CONTRACT) -> np.ndarray:
    """Levels of occurrence of all shingles by the top bits of their hash; at most 2**MOST_BITS of 16 bits each."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = power(size / BYTES_PER_CELL, LEAST_BITS, MOST_BITS)
    each = (1 << bits) // SKETCH_SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = Shingler(rule.shingle), np.zeros(1 << bits, dtype=np.int64)
        for batch in common.slices(batches, "text"):
            h, _ = own.hashes(_bytes(batch))
            np.add.at(total, (h >> np.uint64(64 - bits)).astype(np.int64), 1)
        parts = [narrow(total[k * each : (k + 1) * each]) for k in range(SKETCH_SLICES)]
        yield pa.record_batch([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array([x.itemsize for x in parts], pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["slice", "width", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, w, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums.setdefault(k, np.zeros(each, dtype=np.int64))
                sums[k] += np.frombuffer(c, f"<u{w}").astype(np.int64)
        for k, x in sums.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([8], pa.int32()), pa.array([x.astype("<u8").tobytes()], pa.binary())], names=["slice", "width", "counts"])

    ddl = "slice int, width int, counts binary"
    parts = docs.select("text").mapInArrow(run, ddl).repartition(SKETCH_SLICES, "slice").mapInArrow(add, ddl).toLocalIterator()
    total = np.zeros(1 << bits, dtype=np.int64)
    for r in parts:
        total[r.slice * each : (r.slice + 1) * each] += np.frombuffer(r.counts, "<u8").astype(np.int64)
    return levels(total)


def signed(sets: np.ndarray) -> np.ndarray:
    return sets.view(np.int64)


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*parts, np.zeros(0, dtype=np.uint64)]) if parts else np.zeros(0, dtype=np.uint64)
    edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.view(np.int64)))


def prefixes(docs: DataFrame, counts: np.ndarray, rule: Rule = CONTRACT) -> DataFrame:
    """(doc_id, n, sig, prefix): the set's size, a digest of it, and its rarest tokens in order."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    shift = np.uint64(64 - (len(counts).bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(rule.shingle)
        for batch in common.slices(batches, "text"):
            sets = own.sets(_bytes(batch))
            sigs, firsts = [], []
            for s in sets:
                sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                k = rule.prefix_length(len(s)) if len(s) else 0
                c = shared.value[(s >> shift).astype(np.int64)]
                if k < len(s):
                    near = np.flatnonzero(c <= np.partition(c, k - 1)[k - 1])
                    s, c = s[near], c[near]
                firsts.append(s[np.lexsort((s, c))[:k]])
            yield pa.record_batch([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()), long_lists(firsts)], names=["doc_id", "n", "sig", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, sig binary, prefix array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """(id, tokens) of the documents in ``ids`` (distinct). A bitmap picks rows before their texts are worked on."""
    bits = power(MAP_SHARE * ids.count(), LEAST_MAP, MOST_MAP)
    place = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    size = 32768
    maps = ids.select(place.alias("p")).groupBy(F.expr(f"int(p div {size})").alias("k")).agg(F.bitmap_construct_agg(F.expr(f"p % {size}")).alias("bits")).toLocalIterator()
    marks = np.zeros((1 << bits) // 8, dtype=np.uint8)
    for r in maps:
        marks[r.k * size // 8 : (r.k + 1) * size // 8] = np.frombuffer(r.bits, dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(marks)
    own = docs.withColumnRenamed("doc_id", "id").where("id is not null").withColumn("p", place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Shingler(rule.shingle)
        for batch in batches:
            p = batch.column("p").to_numpy()
            batch = batch.filter(pa.array(shared.value[p >> 3] >> (p & 7).astype(np.uint8) & 1 == 1))
            for part in common.slices(iter([batch]), "text"):
                yield pa.record_batch([part.column("id"), long_lists(work.sets(_bytes(part)))], names=["id", "tokens"])

    return own.select("id", "text", "p").mapInArrow(run, "id long, tokens array<long>").dropDuplicates(["id"])  # rows may repeat


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule = CONTRACT) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets reach the threshold. Their prefixes, a tenth of the sets, rule out most others."""
    x, y = classes.alias("x"), classes.alias("y")
    near = pairs.join(x, F.col("x.id") == F.col("a")).join(y, F.col("y.id") == F.col("b"))
    near = common.cut(near.where(F.size(F.array_intersect("x.prefix", "y.prefix")) >= rule.shared_in_prefixes(F.col("x.n"), F.col("y.n"))).select("a", "b"))
    sets = sets_of(docs, near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), rule)
    x, y = sets.alias("x"), sets.alias("y")
    both = near.join(x, F.col("x.id") == F.col("a")).join(y, F.col("y.id") == F.col("b"))
    same = F.size(F.array_intersect("x.tokens", "y.tokens"))
    return both.where(rule.parts * same >= rule.least * (F.size("x.tokens") + F.size("y.tokens") - same)).select("a", "b")


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    common.ready(docs)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    every = common.cut(prefixes(own, sketch(own, rule), rule))
    classes = common.cut(every.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix")))
    rows = classes.where("id is not null").select("id", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token"))
    met = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("token")
    rows = common.cut(rows.join(met, "token"))  # of tokens that more than one document has
    sized = classes.select("id", "n", "prefix")

    pair = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    leaders = rows.groupBy("token").agg(F.min(F.struct("pos", "id", "n")).alias("l")).select("token", F.col("l.id").alias("lid"), F.col("l.n").alias("ln"), F.col("l.pos").alias("lpos"))
    near = common.cut(rows.join(leaders, "token").where((F.col("id") != F.col("lid")) & rule.may_link(F.col("n"), F.col("pos"), F.col("ln"), F.col("lpos"))).select(*pair(F.col("id"), F.col("lid"))).distinct())
    links = common.cut(verified(near, sized, own, rule))
    groups = components(links)

    own_group = sized.select("id", "n").join(groups.select("id", "component"), "id", "left").withColumn("grp", F.coalesce("component", "id")).drop("component")
    members = common.cut(own_group.join(own_group.groupBy("grp").agg(F.count(F.lit(1)).alias("g"), F.min("n").alias("low"), F.max("n").alias("high")), "grp"))
    grouped = rows.join(members.select("id", "grp", "g", "low", "high"), "id")
    cells = grouped.groupBy("token", "grp", "g", "low", "high").agg(F.min("pos").alias("first"), F.max(rule.leads(F.col("n"), F.col("pos"))).alias("leads"))
    split = cells.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.max(F.struct("g", "grp")).alias("top")).where("c > 1").select("token", F.col("top.grp").alias("top"))
    cells = common.cut(cells.join(split, "token"))  # of tokens in more than one group
    asking = common.cut(grouped.join(split, "token").where("grp != top").select("token", F.col("g").alias("q_g"), F.col("grp").alias("q_grp"), F.col("id").alias("q"), F.col("n").alias("qn"), F.col("pos").alias("q_pos"), rule.leads(F.col("n"), F.col("pos")).alias("q_leads")))
    # the sizes of partners that the group may hold; the smallest asks for least
    low = F.greatest(F.col("low"), F.ceil(rule.least * F.col("qn") / rule.parts))
    high = F.least(F.col("high"), F.floor(rule.parts * F.col("qn") / rule.least))
    fits = (F.col("q_pos") <= F.col("qn") - rule.need(F.col("qn"), low)) & (F.col("first") <= F.col("high") - rule.need(F.col("qn"), F.col("high")))
    larger = (F.col("g") > F.col("q_g")) | ((F.col("g") == F.col("q_g")) & (F.col("grp") > F.col("q_grp")))
    # the first token that a linked pair shares is among the leading ones of the smaller set, and fits; other meetings make no row
    may = larger & (low <= high) & fits
    meets = lambda q, c: q.join(c, (q["token"] == c["token"]) & may).select("q", "qn", "grp", rule.least_overlap(F.col("qn"), low, high).alias("least"))
    hopeful = common.cut(meets(asking.where("q_leads"), cells).unionByName(meets(asking.where("not q_leads"), cells.where("leads"))).distinct())
    shared = hopeful.join(asking.select("q", "token"), "q").join(cells.select("token", "grp"), ["token", "grp"])
    opened = common.cut(shared.groupBy("q", "qn", "grp", "least").agg(F.count(F.lit(1)).alias("c")).where("c >= least").select("q", "qn", "grp"))
    alike = rule.parts * F.least("qn", "n") >= rule.least * F.greatest("qn", "n")
    met = opened.join(members.select("grp", "id", "n"), "grp").where(alike).select(*pair(F.col("q"), F.col("id")))
    more = verified(common.cut(met.join(near, ["a", "b"], "left_anti")), sized, own, rule)
    found = components(links.unionByName(more))

    named = classes.select("sig", "id").join(found.select("id", "component"), "id", "left").select("sig", F.coalesce("component", "id").alias("component"))
    return every.select("doc_id", "n", "sig").join(named, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", rule: Rule = CONTRACT) -> DataFrame:
    """``docs`` with one row of each component only, that of the smallest key, in its own columns.

    Rows are told apart by key and text, so those of a null or repeated key are compared like all others; null keys come last,
    rows that repeat stay once, and wordless rows all stay."""
    common.ready(docs)
    number, words = F.col(key).cast("long"), F.col(text).cast("string")
    i, gone, k = common.unused(docs, "id", "null", "key")
    own = docs.withColumns({i: F.xxhash64(number, words), gone: number.isNull(), k: number})
    worded = F.coalesce(words.rlike(r"[^\x09-\x0d\x20]"), F.lit(False))
    some = own.where(worded)
    plain = some.select(F.col(i).alias("id"), words.alias("text"), F.struct(F.col(gone).alias("gone"), F.col(k).alias("k")).alias("place"))
    named = join(plain.select("id", "text"), "id", "text", rule).groupBy("doc_id").agg(F.first("component_id").alias("component"))
    keys = plain.groupBy("id").agg(F.min("place").alias("place"))
    stay = keys.join(named, F.col("id") == F.col("doc_id")).groupBy("component").agg(F.min(F.struct("place", "id")).alias("s")).select(F.col("s.id").alias(i))
    once = some.dropDuplicates([i]).join(stay, i, "left_semi")
    return once.select(*docs.columns).unionByName(own.where(~worded).select(*docs.columns))


def brute_force(rows: list[tuple[int | None, str | None]], rule: Rule = CONTRACT) -> dict[int, tuple[int, int]]:
    """The same by comparing all pairs of a small table: {doc_id: (n_shingles, component_id)}."""
    import re

    sets = {}
    for k, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + rule.shingle]) for i in range(len(w) - rule.shingle + 1)} if len(w) >= rule.shingle else {tuple(w)} if w else set()
    up = {k: k for k in sets}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(sets)
    for x in keys:
        for y in keys:
            if x < y and sets[x] and rule.parts * len(sets[x] & sets[y]) >= rule.least * len(sets[x] | sets[y]):
                a, b = root(x), root(y)
                up[max(a, b)] = min(a, b)
    return {k: (len(s), root(k)) for k, s in sets.items()}


#: DuckDB SQL for join(documents).
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') END AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + {SHINGLE} - 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {SHINGLE} + 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least.component_id FROM d LEFT JOIN n USING (doc_id) JOIN least ON least.a = d.doc_id"""
