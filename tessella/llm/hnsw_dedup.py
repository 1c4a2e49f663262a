"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

1. Equal vectors of a label form a class; one of each class goes on, with the number of its vectors.
2. A label's classes are dealt to shards of bounded size by a hash. Each shard builds a graph: nested levels, each node
   linked to near nodes that are not nearer to each other (so clusters do not close in on themselves), the links back, and
   a few far links.
3. Every shard is queried with every shard of its label, shard against shard, by batched beam search down the levels.
   Queries whose whole beam lies over the threshold get a beam as wide as the shard. Then an audit compares a sample of
   queries with all of the shard: while it finds too few of the true links, beams are doubled and all is searched again.
4. Found pairs are verified by cosine in double precision. A task returns the number of links of each class and a
   spanning forest of its links, never all pairs; forests are united to components.
5. A fixed set of a label's classes, at least ``AUDITED`` or all, and at least one in ``AUDIT_STEP``, is compared with all
   of every shard. What was found of their verified links, over all pairs of shards, is the label's recall
   (:func:`audits`); labels below ``RECALL`` are searched again with beams twice as wide, in the end with all of them.

Defined results
---------------
* vectors that are null, empty, zero, or hold null or non-finite components, and null labels: no links, own component;
* vectors of different lengths have no cosine and link with nothing of another length; a row without a
  vec_id links with nothing, counts for none, has no component and is kept;
* rows that repeat a vec_id are vectors of their own and linked if their vectors are; an empty table: an empty result;
* extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common
from tessella.llm.components import components

THRESHOLD = 0.98
#: Components (numbers) of a shard's vectors.
SHARD_NUMBERS = 1 << 18
LEAST_ROWS, MOST_ROWS = 256, 4096
NEAR, BACK, FAR = 12, 6, 2
CANDIDATES = 24
BEAM, UPPER_BEAM = 48, 8
#: A beam that would be wider than this is as wide as the shard: comparing with all of it costs less.
WIDEST = 192
BLOCK = 1024
#: Queries of an audit, and the share of their true links that must have been found.
AUDIT, RECALL = 128, 0.99
#: Classes of a label in its pooled audit: at least so many, and at least one in so many.
AUDITED, AUDIT_STEP = 1024, 100
#: Room for single precision in the search; verification is in double.
SLACK = 1e-4


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def neighbours(u: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Links of each row of ``u`` within it, -1 where there are fewer."""
    n = len(u)
    out = np.full((n, NEAR + BACK + FAR), -1, dtype=np.int32)
    if n < 2:
        return out
    k = min(CANDIDATES, n - 1)
    near = np.empty((n, k), dtype=np.int32)
    sims = np.empty((n, k), dtype=np.float32)
    for lo in range(0, n, BLOCK):
        s = u[lo : lo + BLOCK] @ u.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -2
        part = np.argpartition(-s, k - 1, axis=1)[:, :k]
        own = np.take_along_axis(s, part, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        near[lo : lo + BLOCK], sims[lo : lo + BLOCK] = np.take_along_axis(part, order, axis=1), np.take_along_axis(own, order, axis=1)
    count = np.zeros(n, dtype=np.int64)
    closest = np.full((n, k), -2, dtype=np.float32)  # of each candidate to a link taken before
    passed = np.ones((n, k), dtype=bool)
    for r in range(k):
        take = np.flatnonzero((count < NEAR) & (closest[:, r] < sims[:, r]))
        out[take, count[take]] = near[take, r]
        count[take] += 1
        passed[take, r] = False
        if r + 1 < k and len(take):
            for lo in range(0, len(take), BLOCK):
                t = take[lo : lo + BLOCK]
                to = np.einsum("ad,akd->ak", u[near[t, r]], u[near[t, r + 1 :]])
                closest[t, r + 1 :] = np.maximum(closest[t, r + 1 :], to)
    for r in range(k):  # places left go to the nearest that were passed over, which hold a cluster together
        take = np.flatnonzero((count < NEAR) & passed[:, r])
        out[take, count[take]] = near[take, r]
        count[take] += 1
    a, slot = np.nonzero(out[:, :NEAR] >= 0)
    b = out[a, slot]
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    rank = np.arange(len(b)) - np.searchsorted(b, b, "left")
    keep = rank < BACK
    out[b[keep], NEAR + rank[keep]] = a[keep]
    out[:, NEAR + BACK :] = rng.integers(0, n, (n, FAR))
    return out


class Graph:
    def __init__(self, vectors: np.ndarray, seed: int):
        self.u = unit(vectors).astype(np.float32)
        rng = np.random.default_rng(seed)
        n = len(self.u)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(NEAR)).astype(np.int64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # members and their links, the lowest first
        for k in range(int(level.max(initial=0)) + 1):
            own = np.flatnonzero(level >= k).astype(np.int32)
            self.levels.append((own, neighbours(self.u[own], rng)))
            if len(own) <= UPPER_BEAM:
                break

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nodes in each query's beam and their similarities; -1 where it is not full."""
        members, _ = self.levels[-1]
        start = np.tile(members[:UPPER_BEAM], (len(q), 1))
        for k in range(len(self.levels) - 1, -1, -1):
            members, links = self.levels[k]
            place = np.full(len(self.u) + 1, -1, dtype=np.int32)
            place[members] = np.arange(len(members))
            found, sims = self._beam(self.u[members], links, q, place[start], beam if k == 0 else UPPER_BEAM)
            start = np.where(found >= 0, members[found], -1)
        return start, sims

    @staticmethod
    def _beam(u: np.ndarray, links: np.ndarray, q: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(u)
        beam = min(beam, n)
        seen = np.zeros((len(q), n + 1), dtype=bool)
        ids = np.full((len(q), beam), -1, dtype=np.int32)
        sims = np.full((len(q), beam), -np.inf, dtype=np.float32)
        done = np.ones((len(q), beam), dtype=bool)

        def offer(rows: np.ndarray, new: np.ndarray) -> None:
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new = np.where(seen[rows[:, None], new], -1, new)
            seen[rows[:, None], new] = True
            seen[:, n] = False  # place -1
            s = np.einsum("amd,ad->am", u[new], q[rows])
            s[new < 0] = -np.inf
            every, of, old = np.concatenate([sims[rows], s], axis=1), np.concatenate([ids[rows], new], axis=1), np.concatenate([done[rows], new < 0], axis=1)
            best = np.argpartition(-every, beam - 1, axis=1)[:, :beam]
            sims[rows], ids[rows], done[rows] = (np.take_along_axis(x, best, axis=1) for x in (every, of, old))

        offer(np.arange(len(q)), start.copy())
        while True:
            open_ = np.where(done, -np.inf, sims)
            at = open_.argmax(axis=1)
            rows = np.flatnonzero(open_[np.arange(len(q)), at] > -np.inf)
            if not len(rows):
                return ids, sims
            done[rows, at[rows]] = True
            offer(rows, links[ids[rows, at[rows]]])


def exact(graph: Graph, q: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs over the threshold, up to SLACK, of some ``rows`` of ``q``: all of them."""
    least = np.float32(THRESHOLD - SLACK)
    parts = []
    for lo in range(0, len(rows), BLOCK):
        a, b = np.nonzero(q[rows[lo : lo + BLOCK]] @ graph.u.T >= least)
        parts.append((rows[lo + a], b))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, dtype=np.int64),) * 2


def hits(graph: Graph, q: np.ndarray, seed: int, stats: dict | None = None, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs over the threshold, up to SLACK; the first beam is ``beam`` wide."""
    n, least = len(graph.u), np.float32(THRESHOLD - SLACK)
    rng = np.random.default_rng(seed)
    while True:
        if beam >= min(n, WIDEST + 1):
            return exact(graph, q, np.arange(len(q)))
        found, wide = [], []
        for lo in range(0, len(q), BLOCK):
            ids, sims = graph.search(q[lo : lo + BLOCK], beam)
            full = sims.min(axis=1) >= least
            wide.append(lo + np.flatnonzero(full))
            a, k = np.nonzero((sims >= least) & ~full[:, None])
            found.append((lo + a, ids[a, k].astype(np.int64)))
        found.append(exact(graph, q, np.concatenate(wide)))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        some = np.unique(a)
        sample = np.unique(np.concatenate([rng.permutation(len(q))[:AUDIT], some[rng.permutation(len(some))[:AUDIT]]]))
        x, y = exact(graph, q, sample)
        true = set(zip(x.tolist(), y.tolist(), strict=True))
        got = true & set(zip(a.tolist(), b.tolist(), strict=True))
        if stats is not None:
            stats.setdefault("audits", []).append((beam, len(got), len(true)))
        if len(got) >= RECALL * len(true):
            return a, b
        beam *= 2


def verified(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of rows of x and y reach the threshold in double precision."""
    out = np.zeros(len(a), dtype=bool)
    for lo in range(0, len(a), 1 << 16):
        i, j = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
        out[lo : lo + len(i)] = np.einsum("nd,nd->n", x[i], y[j]) >= THRESHOLD
    return out


def forest(ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """Edges that hold together what all the given ones do."""
    up: dict[int, int] = {}
    out = []
    for a, b in zip(ids_a.tolist(), ids_b.tolist(), strict=True):
        x, y = a, b
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        while up.setdefault(y, y) != y:
            up[y] = up[up[y]]
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _build(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("id")
    x = np.stack([np.asarray(v, dtype=np.float64) for v in part["emb"]])
    seed = int(part["id"].iloc[0]) & 0x7FFFFFFF
    blob = pickle.dumps((part["id"].to_numpy(np.int64), part["copies"].to_numpy(np.int64), part["audited"].to_numpy(bool), x, Graph(x, seed)))
    return pd.DataFrame({"label": part["label"].iloc[:1], "dim": part["dim"].iloc[:1], "shard": part["shard"].iloc[:1], "blob": [blob]})


def paired(i: np.ndarray, j: np.ndarray, width: int, same: bool) -> np.ndarray:
    """Different pairs of places as one number each; within one shard a pair has no order, and no place is its own partner."""
    if same:
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
    return np.unique(i * width + j)


#: Links of a class (``n``), an edge of the forest (``other``), or an audit (``id`` is null): links found of ``n`` true ones.
FOUND = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("id", pa.int64()), ("other", pa.int64()), ("n", pa.int64()), ("got", pa.int64())])
FOUND_DDL = "label string, dim int, id long, other long, n long, got long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            label, dim, beam, a, b = (batch.column(c)[k].as_py() for c in ("label", "dim", "beam", "a", "b"))
            ids, copies, audited, x, graph = pickle.loads(batch.column("x")[k].as_py())
            u = unit(x)
            if a == b:
                other_ids, other_copies, v, width = ids, copies, u, len(x)
                keys = paired(*hits(graph, graph.u, a, beam=beam), width, True)
                true = paired(*exact(graph, graph.u, np.flatnonzero(audited)), width, True)
            else:
                other_ids, other_copies, other_audited, y, other = pickle.loads(batch.column("y")[k].as_py())
                v, width = unit(y), len(y)
                i, j = hits(other, graph.u, a, beam=beam)
                q, p = hits(graph, other.u, b, beam=beam)
                keys = paired(np.concatenate([i, p]), np.concatenate([j, q]), width, False)
                i, j = exact(other, graph.u, np.flatnonzero(audited))
                q, p = exact(graph, other.u, np.flatnonzero(other_audited))
                true = paired(np.concatenate([i, p]), np.concatenate([j, q]), width, False)
            keys = keys[verified(u, v, keys // width, keys % width)]
            true = true[verified(u, v, true // width, true % width)]
            got = int(np.isin(true, keys, assume_unique=True).sum())
            i, j = keys // width, keys % width
            n_i = np.bincount(i, other_copies[j], len(ids)).astype(np.int64)
            n_j = np.bincount(j, copies[i], len(other_ids)).astype(np.int64)
            edges = forest(ids[i], other_ids[j])
            some_i, some_j = np.flatnonzero(n_i), np.flatnonzero(n_j)
            left = [None, *ids[some_i].tolist(), *other_ids[some_j].tolist(), *(e[0] for e in edges)]
            right = [None] * (1 + len(some_i) + len(some_j)) + [e[1] for e in edges]
            count = [len(true), *n_i[some_i].tolist(), *n_j[some_j].tolist()] + [0] * len(edges)
            more = [None] * (len(left) - 1)
            columns = ([label] * len(left), [dim] * len(left), left, right, count, [got, *more])
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, FOUND, strict=True)], schema=FOUND)


def searched(graphs: DataFrame, compare=_compare) -> tuple[DataFrame, DataFrame]:
    """FOUND's rows of every pair of a label's shards but audits, and (label, dim, beam, got, n) of the pooled audits.

    Labels whose audit fails are searched again, alone; of a label only the last search counts."""
    own, found, audits, beam = graphs, None, None, BEAM
    while True:
        meta = own.select("label", "dim", F.col("shard").alias("a"))
        pairs = meta.join(meta.withColumnRenamed("a", "b"), ["label", "dim"]).where("a <= b")
        first = pairs.join(own.select("label", "dim", F.col("shard").alias("a"), F.col("blob").alias("x")), ["label", "dim", "a"])
        second = first.join(own.select("label", "dim", F.col("shard").alias("b"), F.col("blob").alias("y")), ["label", "dim", "b"])
        asked = second.select("label", "dim", F.lit(beam).alias("beam"), "a", "b", "x", F.when(F.col("a") != F.col("b"), F.col("y")).alias("y"))
        now = common.cut(asked.mapInArrow(compare, FOUND_DDL))
        audit = common.cut(now.where("id is null").groupBy("label", "dim").agg(F.lit(beam).alias("beam"), F.sum("got").alias("got"), F.sum("n").alias("n")))
        now, poor = now.where("id is not null"), audit.where(F.col("got") < RECALL * F.col("n")).select("label", "dim")
        done = poor.isEmpty()
        if not done:
            now, audit = now.join(poor, ["label", "dim"], "left_anti"), audit.join(poor, ["label", "dim"], "left_anti")
            own = graphs.join(poor, ["label", "dim"], "left_semi")
        found = now if found is None else found.unionByName(now)
        audits = audit if audits is None else audits.unionByName(audit)
        if done:
            return found, audits
        beam *= 2


def prepared(vectors: DataFrame, key: str, embedding: str, label: str, shard_rows: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows, the classes of equal vectors, and a graph for each shard of a label."""
    common.ready(vectors)
    emb = F.col(embedding).cast("array<double>")
    own = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("string").alias("label"), emb.alias("emb"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("emb").isNotNull() & F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("emb", lambda v: v != 0)
    own = own.withColumn("ok", F.coalesce(sound, F.lit(False)))
    own = own.withColumn("h1", F.when(F.col("ok"), F.xxhash64("label", "emb"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit("second"), "emb", "label")))
    classes = own.where("ok").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("emb").alias("emb")).withColumn("dim", F.size("emb"))
    classes = common.cut(classes)
    graphed = classes.where("id is not null")
    sizes = graphed.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("total"))
    rows = F.greatest(F.lit(LEAST_ROWS), F.least(F.lit(MOST_ROWS), F.floor(F.lit(SHARD_NUMBERS) / F.col("dim")))) if shard_rows is None else F.lit(shard_rows)
    dealt = graphed.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("id"), F.ceil(F.col("total") / rows)).cast("int"))
    step = F.greatest(F.lit(1), F.least(F.lit(AUDIT_STEP), F.floor(F.col("total") / AUDITED)))
    dealt = dealt.withColumn("audited", F.pmod(F.xxhash64(F.lit("audit"), "id"), step) == 0)
    graphs = common.cut(dealt.select("label", "dim", "shard", "id", "copies", "emb", "audited").groupBy("label", "dim", "shard").applyInPandas(_build, "label string, dim int, shard int, blob binary"))
    return own, classes, graphs


def dedup(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_rows: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    own, classes, graphs = prepared(vectors, key, embedding, label, shard_rows)
    found, _ = searched(graphs)
    degree = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = classes.select("label", "h1", "h2", "id", "copies").join(degree, "id", "left").join(groups, "id", "left")
    named = named.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "id").alias("component"))
    out = own.select("vec_id", "label", "h1", "h2").join(named, ["label", "h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def audits(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", shard_rows: int | None = None) -> DataFrame:
    """(label, dim, beam, got, n) of each label's last search: links found of the ``n`` true ones of its audited classes."""
    return searched(prepared(vectors, key, embedding, label, shard_rows)[2])[1]


#: DuckDB SQL for dedup(embeddings): all pairs.
ORACLE = f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM ok x JOIN ok y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= {THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least.component_id, e.vec_id = least.component_id AS kept FROM e LEFT JOIN n ON n.a = e.vec_id JOIN least ON least.a = e.vec_id"""
