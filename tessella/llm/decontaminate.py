"""Benchmark decontamination: normalised test n-grams in a broadcast hash set, scanned over training token windows.

A word is a run of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. An item's windows are its runs of
``WINDOW`` words, or all its words if it has fewer. Windows are looked up by a 64-bit rolling hash and every hit is
verified word by word.

Defined results
---------------
* null or wordless text: no words, no hits, not contaminated; null or wordless items have no windows;
* items of equal text are all reported; document rows that repeat are all returned;
* empty documents or benchmark: an empty result, or no hits;
* extra columns are ignored by :func:`scan` and kept by :func:`clean`.

The benchmark is broadcast in blocks of about half of ``BLOCK_BYTES`` of text; the driver holds one at a time, and so does a
worker, which indexes a block in sorted arrays once and keeps the index for its next task. With several blocks a task keeps
its rows in a temporary file and reads it once for each block, so every row is judged alone, by all blocks, and no key is
needed.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

WINDOW = 13
#: Most bytes of benchmark text held by a worker at once.
BLOCK_BYTES = 32 << 20
#: A document is contaminated when hit words are at least a SHARE-th of its words.
SHARE = 20

#: Every byte that is not part of a word becomes a space, A-Z become a-z; bytes of non-ASCII characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Odd multipliers of the rolling hash.
FACTORS = np.random.default_rng(13).integers(1 << 61, 1 << 63, WINDOW, dtype=np.uint64) | np.uint64(1)


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text).translate(FOLD).split()


def mixed(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hash of the run of ``n`` ids at each of ``starts``."""
    out = np.zeros(len(starts), dtype=np.uint64)
    for k in range(n):
        out += (ids[starts + k].astype(np.uint64) + np.uint64(1)) * FACTORS[k]
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x9E3779B97F4A7C15)


class Index:
    """Different windows of a block of benchmark items by length: sorted hashes, where each is found, and whose it is."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        place = {x: k for k, x in enumerate(self.names)}
        parts, owner = [], []
        for item, text in items:
            own = words(text)
            for w in set(own).difference(self.vocabulary):
                self.vocabulary[w] = len(self.vocabulary)
            if own:
                parts.append(np.array([self.vocabulary[w] for w in own], dtype=np.int32))
                owner.append(place[item])
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        self.ids = np.concatenate([*parts, np.zeros(0, dtype=np.int32)])
        self.tables = {}
        for n in sorted(set(np.minimum(sizes, WINDOW).tolist())):
            some = np.flatnonzero(np.minimum(sizes, WINDOW) == n)
            counts = sizes[some] - n + 1
            starts = np.repeat(first[some] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            owners = np.repeat(np.array(owner, dtype=np.int64)[some], counts)
            self.tables[n] = self.table(starts, owners, n)

    def table(self, starts: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, ...]:
        """(hashes, start of a window, edges of its owners, owners), a row for each different window."""
        hashes = mixed(self.ids, starts, n)
        order = np.lexsort((owners, hashes))
        hashes, starts, owners = hashes[order], starts[order], owners[order]
        new = np.ones(len(starts), dtype=bool)
        new[1:] = hashes[1:] != hashes[:-1]
        for k in range(n):  # of equal hashes, different words: windows of their own
            new[1:] |= self.ids[starts[1:] + k] != self.ids[starts[:-1] + k]
        at = np.flatnonzero(new)
        return hashes[at], starts[at], np.append(at, len(starts)), owners

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, int, np.ndarray, tuple[np.ndarray, ...]]]:
        """(starts, length, rows of the table, table) of the verified windows in ``ids``; -1 stands for a word of no item."""
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for n, table in self.tables.items():
            if len(ids) < n:
                continue
            whole = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(whole):
                continue
            hashes, starts, *_ = table
            own = mixed(ids, whole, n)
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            many = hi - lo
            at = np.repeat(whole, many)
            rows = np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())
            for k in range(n):
                same = self.ids[starts[rows] + k] == ids[at + k]
                at, rows = at[same], rows[same]
            if len(at):
                yield at, n, rows, table


_held: tuple[object, Index] | None = None


def index_of(block) -> Index:
    """The index of a broadcast block. A worker keeps the last one, and not the block."""
    global _held
    if _held is None or _held[0] is not block:
        _held = None
        _held = block, Index(block.value)
        vars(block).pop("_value", None)
    return _held[1]


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])
RESULT_DDL = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def find(index: Index, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """Number of words, merged hit spans and items of each text."""
    look = index.vocabulary.get
    parts, counts = [], []
    for text in texts:
        own = words(text)
        counts.append(len(own))
        parts += [np.fromiter((look(w, -1) for w in own), dtype=np.int32, count=len(own)), np.full(1, -1, dtype=np.int32)]  # no window spans two documents
    starts = np.cumsum(counts) - counts + np.arange(len(counts))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for at, n, rows, (_, _, edges, owners) in index.hits(np.concatenate([*parts, np.zeros(0, dtype=np.int32)])):
        docs = np.searchsorted(starts, at, "right") - 1
        for doc in np.unique(docs).tolist():
            own = docs == doc
            begin = np.unique(at[own] - starts[doc])
            gaps = np.flatnonzero(np.diff(begin) > n)  # windows that overlap or touch are one stretch
            spans[doc] += zip(begin[np.append(0, gaps + 1)].tolist(), (begin[np.append(gaps, len(begin) - 1)] + n).tolist(), strict=True)
            for r in np.unique(rows[own]).tolist():
                items[doc].update(owners[edges[r] : edges[r + 1]].tolist())
    return [(n, merged(s), [index.names[k] for k in sorted(i)]) for n, s, i in zip(counts, spans, items, strict=True)]


def is_contaminated(n_words: int, spans: list[tuple[int, int]]) -> bool:
    n_hit = sum(b - a for a, b in spans)
    return n_hit > 0 and SHARE * n_hit >= n_words


def found_in(batches: Iterator[pa.RecordBatch], text: str, shared: list) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, list[tuple[int, int]], list[str]]]]]:
    """Slices of ``batches`` and what :func:`find` gives for their texts over all blocks; one index is held at a time."""
    texts = lambda batch: batch.column(text).cast(pa.binary()).to_pylist()
    if len(shared) == 1:
        for batch in common.slices(batches, text):
            yield batch, find(index_of(shared[0]), texts(batch))
        return
    with tempfile.TemporaryFile() as kept:
        writer = None
        for batch in common.slices(batches, text):
            writer = writer or pa.ipc.new_stream(kept, batch.schema)
            writer.write_batch(batch)
        if writer is None:
            return
        writer.close()
        spans: dict[int, list[tuple[int, int]]] = {}  # of the rows that have hits, by their place
        items: dict[int, set[str]] = {}
        for block in shared:
            index = index_of(block)
            kept.seek(0)
            at = 0
            for batch in pa.ipc.open_stream(kept):
                for k, (_, s, i) in enumerate(find(index, texts(batch)), at):
                    if s:
                        spans.setdefault(k, []).extend(s)
                        items.setdefault(k, set()).update(i)
                at += batch.num_rows
        kept.seek(0)
        at = 0
        for batch in pa.ipc.open_stream(kept):
            yield batch, [(len(words(t)), merged(spans.get(k, [])), sorted(items.get(k, ()))) for k, t in enumerate(texts(batch), at)]
            at += batch.num_rows


def _scanner(shared: list):
    def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in found_in(batches, "text", shared):
            spans = [[{"start": a, "stop": b} for a, b in s] for _, s, _ in found]
            yield pa.record_batch([batch.column("doc_id"), pa.array([n for n, _, _ in found], pa.int64()), pa.array(spans, RESULT.field("spans").type), pa.array([i for _, _, i in found], pa.list_(pa.string()))], schema=RESULT)

    return scan_batches


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of bounded size, read one block at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.coalesce(F.sum(F.length("text") + F.length("item_id")), F.lit(0))).first()[0]
    n = max(1, -(-2 * total // block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r.item_id, bytes(r.text)) for r in part.toLocalIterator()]


def scan(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, spans, items) of each row: merged word spans that occur in items, and those items."""
    common.ready(docs)
    sc = docs.sparkSession.sparkContext
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_scanner([sc.broadcast(b) for b in blocks(benchmark, block_bytes)]), RESULT_DDL)


def judge(hits: DataFrame) -> DataFrame:
    """Digest columns of :func:`scan`'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.stop - s.start)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated documents, in its own columns; one pass without a shuffle."""
    common.ready(docs)
    sc = docs.sparkSession.sparkContext
    shared = [sc.broadcast(b) for b in blocks(benchmark, block_bytes)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in found_in(batches, text, shared):
            yield batch.filter(pa.array([not is_contaminated(n, spans) for n, spans, _ in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remove_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words in ``spans``, for callers that cut passages instead of dropping documents."""
    if text is None or not spans:
        return text
    import re

    at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return "".join([*out, text[last:]])


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


#: DuckDB SQL for judge(scan(documents, benchmark)).
ORACLE = rf"""
WITH d AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bn AS (SELECT item, w, least({WINDOW}, len(w)) AS n FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens)),
hit AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN win ON dw.n = win.n AND dw.g = win.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""
