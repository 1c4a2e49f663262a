"""Token counts that follow edits: a segment tree of pre-tokens per document.

A byte-level BPE encodes every pre-token by itself, so a document's count is the sum over its pre-tokens. The tree's leaves
are stretches of pre-tokens, its nodes hold their characters and tokens. An edit re-encodes

* the pre-tokens it touches, and those to the left whose match had read a changed character (the pattern reads at most
  ``AHEAD`` characters past a pre-token), and
* to the right as far as a new pre-token ends where an old one ended: from there on the pattern sees what it saw before.

Only the touched leaves and the sums above them change. Counts equal those of a full encoding of the edited text.

Trees are kept with their documents: :func:`trees` adds them as bytes (two for a pre-token: its characters and tokens, larger
numbers apart), and :func:`count` and :func:`edited` load them and encode only what edits touch; :func:`edited` returns
texts and trees for the next edits.

Defined results
---------------
* null text is empty; null or no edits leave it as it is; edits apply one after another, each to the text the former left;
* an edit's start and stop are clipped to the text and a stop before the start is the start; a null replacement is empty;
* repeated rows are counted each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tessella.llm import common

#: Characters past its end that a pre-token's match may read.
AHEAD = 2
#: Pre-tokens of a leaf.
LEAF = 32
#: Pre-tokens whose counts a worker remembers.
CACHE = 300_000


class Counter:
    """Pre-tokens and their token counts under a byte-level BPE."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coding = tiktoken.Encoding("counts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def count(self, parts: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = len(self.coding.encode_ordinary(p))
        return [known[p] for p in parts]

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)


class Tree:
    """Pre-tokens of a text in leaves under a binary tree of (characters, tokens) sums."""

    def __init__(self, counter: Counter, text: str):
        self.counter, self.text, self.reencoded = counter, text, 0
        parts = counter.split(text)
        self.build(list(map(len, parts)), counter.count(parts))

    def dump(self) -> bytes:
        """The leaves: how many pre-tokens each has, then all characters and tokens, in bytes; numbers of 255 and more at the end."""
        out = [struct.pack("<I", len(self.leaves))]
        sizes = [len(a) for a, _ in self.leaves]
        for numbers in (sizes, [n for a, _ in self.leaves for n in a], [n for _, b in self.leaves for n in b]):
            x = np.array(numbers, dtype=np.int64)
            large = x[x >= 255].astype("<u4")
            out += [struct.pack("<II", len(x), len(large)), np.minimum(x, 255).astype(np.uint8).tobytes(), large.tobytes()]
        return b"".join(out)

    @classmethod
    def load(cls, counter: Counter, text: str, data: bytes) -> Tree:
        """A tree as it was dumped; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.text, tree.reencoded = counter, text, 0
        at, parts = 4, []
        for _ in range(3):
            n, m = struct.unpack_from("<II", data, at)
            x = np.frombuffer(data, np.uint8, n, at + 8).astype(np.int64)
            x[x == 255] = np.frombuffer(data, "<u4", m, at + 8 + n)
            at += 8 + n + 4 * m
            parts.append(x)
        ends = np.cumsum(parts[0])
        lengths, counts = parts[1].tolist(), parts[2].tolist()
        if sum(lengths) != len(text):
            raise ValueError("the tree is of another text")
        tree.raise_up([(lengths[a:b], counts[a:b]) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)])
        return tree

    def build(self, lengths: list[int], counts: list[int]) -> None:
        self.raise_up([(lengths[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(lengths), LEAF)])

    def raise_up(self, leaves: list[tuple[list[int], list[int]]]) -> None:
        self.leaves = leaves or [([], [])]
        n = 1
        while n < len(self.leaves):
            n *= 2
        self.n = n
        self.chars, self.tokens = [0] * (2 * n), [0] * (2 * n)
        for k, (a, b) in enumerate(self.leaves):
            self.chars[n + k], self.tokens[n + k] = sum(a), sum(b)
        for k in range(n - 1, 0, -1):
            self.sum(k)

    def sum(self, k: int) -> None:
        self.chars[k], self.tokens[k] = self.chars[2 * k] + self.chars[2 * k + 1], self.tokens[2 * k] + self.tokens[2 * k + 1]

    def total(self) -> int:
        return self.tokens[1]

    def pretokens(self) -> int:
        return sum(len(a) for a, _ in self.leaves)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at ``place`` (the last one beyond the end), and where it starts."""
        k, start = 1, 0
        while k < self.n:
            left = self.chars[2 * k]
            if place < start + left or not self.chars[2 * k + 1]:
                k = 2 * k
            else:
                start += left
                k = 2 * k + 1
        return k - self.n, start

    def edit(self, start: int | None, stop: int | None, new: str | None) -> None:
        new = new or ""
        start = min(max(0, start or 0), len(self.text))
        stop = min(max(start, start if stop is None else stop), len(self.text))
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        # the first pre-token whose match may have read a changed character
        leaf, at = self.leaf_at(max(0, start - AHEAD))
        while leaf and at > max(0, start - AHEAD):
            leaf -= 1
            at -= self.chars[self.n + leaf]
        kept = 0
        for kept, n in enumerate(self.leaves[leaf][0]):
            if at + n + AHEAD > start:
                break
            at += n
        else:
            kept = len(self.leaves[leaf][0])
        first, begin = leaf, at
        # old ends from the edit on, leaf by leaf, until one is met by a new pre-token's end
        k, i, old = leaf, kept, at
        parts: list[str] = []
        end = begin
        matches = self.counter.pattern.finditer(text, begin)
        while True:
            while k < len(self.leaves) and (old < stop or old + shift < end):
                if i < len(self.leaves[k][0]):
                    old += self.leaves[k][0][i]
                    i += 1
                elif k + 1 < len(self.leaves):
                    k, i = k + 1, 0
                else:
                    break
            if old >= stop and old + shift == end and end >= start + len(new):
                break
            m = next(matches, None)
            if m is None:
                break
            parts.append(m[0])
            end = m.end()
        counts = self.counter.count(parts)
        self.reencoded += len(parts)
        head, tail = self.leaves[first], self.leaves[k]
        self.text = text
        lengths, sums = head[0][:kept] + list(map(len, parts)) + tail[0][i:], head[1][:kept] + counts + tail[1][i:]
        if len(lengths) > 8 * LEAF:
            before, after = self.leaves[:first], self.leaves[k + 1 :]
            self.build([n for a, _ in before for n in a] + lengths + [n for a, _ in after for n in a], [n for _, b in before for n in b] + sums + [n for _, b in after for n in b])
            return
        self.leaves[first] = lengths, sums
        for j in range(first + 1, k + 1):
            self.leaves[j] = [], []
        touched = {self.n + j for j in range(first, k + 1)}
        for j in touched:
            self.chars[j], self.tokens[j] = sum(self.leaves[j - self.n][0]), sum(self.leaves[j - self.n][1])
        while touched := {j // 2 for j in touched if j > 1}:
            for j in touched:
                self.sum(j)


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


EDITS = "array<struct<start:long,stop:long,replacement:string>>"
RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_tokens_before", "n_tokens", "n_pretokens", "n_reencoded", "n_chars"))])


def attach(docs: DataFrame, edits: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` with an ``edits`` column from rows (doc_id, seq, start, stop, replacement), in the order of seq."""
    of, own = common.unused(docs, "of", "edits")
    listed = edits.select(F.col("doc_id").alias(of), F.struct("seq", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.col("replacement").cast("string").alias("replacement")).alias("e"))
    listed = listed.groupBy(of).agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: F.struct(e.start.alias("start"), e.stop.alias("stop"), e.replacement.alias("replacement"))).alias(own))
    return docs.drop("edits").join(listed, docs[key] == F.col(of), "left").withColumnRenamed(own, "edits").drop(of)


def trees(docs: DataFrame, ranks: str, text: str = "text", tree: str = "tree") -> DataFrame:
    """``docs`` with the tree of each text, as bytes, in column ``tree``; one pass, no shuffle."""
    common.ready(docs)
    own = docs.drop(tree)
    schema = StructType([*own.schema.fields, StructField(tree, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, text):
            made = [Tree(counter(ranks), t or "").dump() for t in batch.column(text).cast(pa.string()).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(made, pa.binary())], names=[*batch.schema.names, tree])

    return own.mapInArrow(run, schema)


def _applied(own: DataFrame, ranks: str, whole: bool) -> DataFrame:
    """Edits applied to rows (doc_id, text, edits[, tree]); with ``whole``, edited texts and their trees too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            rows, texts, dumps = [], [], []
            stored = batch.column("tree").to_pylist() if "tree" in batch.schema.names else [None] * batch.num_rows
            for key, text, edits, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "edits")), stored, strict=True):
                tree = Tree(counter(ranks), text or "") if data is None else Tree.load(counter(ranks), text or "", data)
                before = tree.total()
                for e in edits or ():
                    if e is not None:
                        tree.edit(e["start"], e["stop"], e["replacement"])
                rows.append((key, before, tree.total(), tree.pretokens(), tree.reencoded, len(tree.text)))
                if whole:
                    texts.append(tree.text)
                    dumps.append(tree.dump())
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            more = [pa.array(texts, pa.string()), pa.array(dumps, pa.binary())] if whole else []
            yield pa.record_batch([*columns, *more], names=[*RESULT.names, *["text", "tree"][: len(more)]])

    return own.mapInArrow(run, ", ".join(f"{c} long" for c in RESULT.names) + ", text string, tree binary" * whole)


def _own(docs: DataFrame, key: str, text: str, edits: str, tree: str) -> DataFrame:
    common.ready(docs)
    kept = [F.col(tree).cast("binary").alias("tree")] if tree in docs.columns and dict(docs.dtypes)[tree] == "binary" else []
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(edits).cast(EDITS).alias("edits"), *kept)


def count(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", edits: str = "edits", tree: str = "tree") -> DataFrame:
    """(doc_id, n_tokens_before, n_tokens, n_pretokens, n_reencoded, n_chars) of each row; one pass, no shuffle.

    Trees in a binary column ``tree`` are loaded; rows without one are encoded whole."""
    return _applied(_own(docs, key, text, edits, tree), ranks, False)


def edited(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", edits: str = "edits", tree: str = "tree") -> DataFrame:
    """:func:`count`'s columns, and the edited text and its tree."""
    return _applied(_own(docs, key, text, edits, tree), ranks, True)


def trial_edits(text: Column) -> Column:
    """Three edits that depend on the text's length alone: an insertion, a deletion and a new opening."""
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    one = lambda a, b, s: F.struct(a.cast("long").alias("start"), b.cast("long").alias("stop"), F.lit(s).alias("replacement"))
    third, half = F.floor(n / 3), F.floor(n / 2)
    return F.array(one(third, third, " it's (revised) "), one(half, half + 40, ""), one(F.lit(0), F.lit(5), "Edited: "))
