"""SentencePiece encoding and decoding with a max-plus parallel scan over the chunks of giant documents.

A BPE segmentation is the one sequence of pieces in which every piece is stable (it encodes to itself) and every adjacent
pair is (the two encode to just those two). So it is the one finite path of a max-plus system whose step from piece to
piece scores 0 if the pair is stable and minus infinity otherwise:

* a document of two or more chunks is cut at fixed places, in the middle of words or not;
* the state at a cut is the piece that holds the character before it. Each chunk, by itself, yields the transfer matrix
  of its left states to its right states;
* matrices combine by max-plus products, associatively, in a tree: FAN neighbours become one matrix, level by level, until a
  document has at most FAN. From the top down, the states on the path are then found at the cuts between the matrices of
  each node, given those at its two ends. No task holds more than FAN matrices, however long the document;
* each chunk is then worked on by itself between its two known piece boundaries. No back-pointers are kept: what lies
  between two boundaries of the path is encoded by the library (words once, then remembered), and by the same law its
  pieces are those of the path.

A document of one chunk has known boundaries and needs no matrix. Results equal the library's on the whole text.

Defined results
---------------
* null or empty text: no ids, and decodes to the empty text;
* a literal U+2581 in a text is a space to the model, and decodes as one; texts otherwise decode to themselves;
* repeated rows are all returned; an empty table gives an empty result; extra columns are ignored.

``ids`` columns hold unsigned 32-bit little-endian ids as bytes.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

SPACE = "▁"
#: Characters of a chunk; a document of twice as many is giant.
CHUNK = 16384
#: Matrices that one task combines.
FAN = 64
#: Words whose ids a worker remembers.
CACHE = 100_000
#: Stability of pairs that a worker remembers.
PAIRS = 500_000
NEVER = np.float32(-np.inf)
UNJOINED = "\n"


class Pieces:
    """The model: its pieces with their scores, and stability."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces or not model.normalizer_spec.add_dummy_prefix or not model.trainer_spec.byte_fallback or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("only BPE models with the identity normaliser, a dummy prefix, byte fallback and no user-defined pieces")
        self.score = {p.piece: p.score for p in model.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)}
        self.longest = max(map(len, self.score))
        if any(SPACE in p.lstrip(SPACE) or UNJOINED in p for p in self.score):
            raise ValueError("pieces may hold spaces at their start only")
        self.space = struct.pack("<I", self.library.piece_to_id(SPACE))
        self.bytes_of = []
        for i, p in enumerate(model.pieces):
            kind = p.type
            self.bytes_of.append(bytes([int(p.piece[3:5], 16)]) if kind == kinds.BYTE else b"" if kind == kinds.CONTROL else " ⁇ ".encode() if self.library.is_unknown(i) else p.piece.replace(SPACE, " ").encode())
        self.known: dict[str, bytes] = {"": self.space}
        self.stable_pair: dict[tuple[str, str], bool] = {}
        self.stable_piece: dict[str, bool] = {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short string: the best-scored adjacent pair first, the leftmost of equals."""
        own = list(text)
        while True:
            best, at = None, -1
            for k in range(len(own) - 1):
                s = self.score.get(own[k] + own[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return own
            own[at : at + 2] = [own[at] + own[at + 1]]

    def is_piece(self, text: str) -> bool:
        if len(text) == 1:
            return True
        if text not in self.score:
            return False
        if (r := self.stable_piece.get(text)) is None:
            r = self.stable_piece[text] = self.merged(text) == [text]
        return r

    def fits(self, a: str, b: str) -> bool:
        if (r := self.stable_pair.get((a, b))) is None:
            if len(self.stable_pair) > PAIRS:
                self.stable_pair.clear()
            r = self.stable_pair[a, b] = self.merged(a + b) == [a, b]
        return r

    # -- encoding between known boundaries

    def start(self, text: str) -> bytes:
        """Ids of text that follows a boundary of the path and holds no seam."""
        return np.array(self.library.encode(UNJOINED + text)[2:], dtype="<u4").tobytes() if text else b""

    def words(self, text: str) -> list[str]:
        """The words of ``text``, which starts with a space; each without its first space."""
        if "  " not in text:
            return text.split(" ")[1:]
        return [w[1:] for w in re.findall(" +[^ ]*", text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a text starts with a space or follows a boundary."""
        heads, split = [], []
        for t in texts:
            k = 0 if t[:1] == " " else (re.search("[^ ](?= )", t).end() if re.search("[^ ](?= )", t) else len(t))
            heads.append(self.start(t[:k]))
            split.append(self.words(t[k:]) if k < len(t) else [])
        known = self.known
        if len(known) > CACHE:
            known.clear()
            known[""] = self.space
        new = [w for w in set().union(*split) if w not in known]
        for w, ids in zip(new, self.library.encode(new, num_threads=1) if new else [], strict=True):
            known[w] = struct.pack(f"<{len(ids)}I", *ids)
        return [h + b"".join([known[w] for w in ws]) for h, ws in zip(heads, split, strict=True)]

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")[1:]

    # -- the scan

    def around(self, text: str, cut: int) -> list[tuple[int, int]]:
        """The states at ``cut``: pieces that hold the character before it."""
        if cut == 0:
            return [(0, 0)]
        n, top = len(text), self.longest
        return [(s, e) for s in range(max(0, cut - top), cut) for e in range(cut, min(n, s + top) + 1) if self.is_piece(text[s:e])]

    def transfer(self, text: str, a: int, b: int, last: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], np.ndarray]:
        """Left states, right states and the matrix of the stretch [a, b) of ``text``."""
        seams = [a + m.end() for m in re.finditer("[^ ](?= )", text[a:b])]
        text = text.replace(" ", SPACE)
        left, right = self.around(text, a), self.around(text, b)
        if last:
            right = [x for x in right if x[1] == b]
        place = {x: j for j, x in enumerate(right)}
        matrix = np.full((len(left), len(right)), NEVER, dtype=np.float32)
        ends: dict[int, list[tuple[int | None, int]]] = {}
        for i, (s, e) in enumerate(left):
            if e >= b:
                if (s, e) in place:
                    matrix[i, place[s, e]] = 0
            else:
                ends.setdefault(e, []).append((s if e else None, 1 << i))
        first = next((s for s in seams if not ends or s >= max(ends)), None)
        p = min(ends, default=b)
        while p < b:
            here = ends.pop(p, None)
            if here is not None:
                if p == first and p < seams[-1]:
                    # no piece spans a seam, and what lies between two seams always has a path
                    mask = 0
                    for _, m in here:
                        mask |= m
                    p, first = seams[-1], None
                    ends = {p: [(None, mask)]}
                    continue
                for q in range(p + 1, min(len(text), p + self.longest) + 1):
                    if not self.is_piece(own := text[p:q]):
                        continue
                    mask = 0
                    for s, m in here:
                        if s is None or m | mask != mask and self.fits(text[s:p], own):
                            mask |= m
                    if not mask:
                        continue
                    if q >= b:
                        if (j := place.get((p, q))) is not None:
                            for i in range(len(left)):
                                if mask >> i & 1:
                                    matrix[i, j] = 0
                    else:
                        ends.setdefault(q, []).append((p, mask))
            p += 1
        return left, right, matrix


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1, initial=NEVER)


def boundaries(matrices: list[np.ndarray], first: int = 0, last: int = -1) -> list[int]:
    """The state at each inner cut: the one on a finite path from state ``first`` to state ``last``, or to any if that is -1."""
    end = matrices[-1].shape[1]
    after = [np.zeros((end, 1), dtype=np.float32) if last < 0 else np.where(np.arange(end)[:, None] == last, 0, NEVER).astype(np.float32)]
    before = []
    for m in matrices[:-1]:
        before.append(product(before[-1], m) if before else m[first : first + 1])
    for m in matrices[:0:-1]:
        after.append(product(m, after[-1]))
    found = []
    for f, b in zip(before, after[:0:-1], strict=True):
        on = np.flatnonzero(f[0] + b[:, 0] > NEVER)
        if len(on) != 1:
            raise AssertionError(f"{len(on)} states at a cut")
        found.append(int(on[0]))
    return found


def cuts(n: int, chunk: int) -> list[int]:
    """Where a text of ``n`` characters is cut; no chunk is shorter than ``chunk``."""
    return [k * chunk for k in range(max(1, n // chunk))] + [n]


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def prepared(text: str | None) -> str:
    """What the model sees: the dummy prefix, spaces for U+2581."""
    return " " + text.replace(SPACE, " ") if text else ""


WHOLE = "doc_id long, n_chunks int, ids binary"
#: A giant document goes by two hashes of its key and text, so that its chunks are the same whenever they are made again.
KEY = ("h1", "h2")
PART = "h1 long, h2 long, k int, n int, lo long, a long, b long, text string"


def _whole(path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            ids = pieces(path).encode([prepared(t) for t in batch.column("text").to_pylist()])
            columns = {"doc_id": batch.column("doc_id"), "n_chunks": pa.array([1] * len(ids), pa.int32()), "ids": pa.array(ids, pa.binary())}
            if back:
                columns["decoded"] = pa.array([pieces(path).decode(x) for x in ids], pa.string())
            yield pa.record_batch(list(columns.values()), names=list(columns))

    return run


def _cut(chunk: int, margin: int):
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("k", pa.int32()), ("n", pa.int32()), ("lo", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            for r in batch.to_pylist():
                t = prepared(r["text"])
                at = cuts(len(t), chunk)
                for k in range(len(at) - 1):
                    lo = max(0, at[k] - margin)
                    yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in KEY}, "k": k, "n": len(at) - 1, "lo": lo, "a": at[k], "b": at[k + 1], "text": t[lo : at[k + 1] + margin]}], schema=schema)

    return run


def _matrices(path: str):
    schema = pa.schema([(c, pa.int64()) for c in KEY] + [("k", pa.int32()), ("n_left", pa.int32()), ("left", pa.list_(pa.int64())), ("right", pa.list_(pa.int64())), ("matrix", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                left, right, m = pieces(path).transfer(r["text"], r["a"] - r["lo"], r["b"] - r["lo"], r["k"] == r["n"] - 1)
                yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in KEY}, "k": r["k"], "n_left": len(left), "left": [r["lo"] + e for _, e in left], "right": [r["lo"] + e for _, e in right], "matrix": m.tobytes()}], schema=schema)

    return run


def _loaded(part: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(m, dtype=np.float32).reshape(n, -1) for m, n in zip(part["matrix"], part["n_left"], strict=True)]


def _multiplied(part: pd.DataFrame) -> pd.DataFrame:
    """One matrix for those of a node."""
    part = part.sort_values("k")
    m = reduce(product, _loaded(part))
    return pd.DataFrame({**{c: part[c].iloc[:1] for c in KEY}, "k": part["k"].iloc[:1] // FAN, "n_left": [len(m)], "matrix": [m.tobytes()]})


def _placed(part: pd.DataFrame) -> pd.DataFrame:
    """The states at both ends of each matrix of a node, from those at the node's ends."""
    part = part.sort_values("k")
    own = boundaries(_loaded(part), int(part["first"].iloc[0]), int(part["last"].iloc[0]))
    return pd.DataFrame({**{c: part[c] for c in KEY}, "k": part["k"], "from_state": [int(part["first"].iloc[0]), *own], "to_state": [*own, int(part["last"].iloc[0])]})


def states(matrices: DataFrame, most: int) -> DataFrame:
    """(h1, h2, k, from_state, to_state) of each matrix (h1, h2, k, n_left, matrix); -1 at a document's end.

    ``most``: how many matrices a document has at most."""
    node = F.expr(f"int(k div {FAN})")
    levels = [matrices.select(*KEY, "k", "n_left", "matrix")]
    while most > FAN:
        levels.append(common.cut(levels[-1].groupBy(*KEY, node.alias("node")).applyInPandas(_multiplied, "h1 long, h2 long, k int, n_left int, matrix binary")))
        most = -(-most // FAN)
    ends = None
    for level in reversed(levels):
        if ends is None:
            own = level.withColumns({"node": F.lit(0), "first": F.lit(0), "last": F.lit(-1)})
        else:
            own = level.withColumn("node", node).join(ends.select(*KEY, F.col("k").alias("node"), F.col("from_state").alias("first"), F.col("to_state").alias("last")), [*KEY, "node"])
        ends = own.groupBy(*KEY, "node").applyInPandas(_placed, "h1 long, h2 long, k int, from_state int, to_state int")
    return ends


def _joined(path: str, back: bool):
    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        ids = b"".join(part["ids"])
        return pd.DataFrame({**{c: part[c].iloc[:1] for c in KEY}, "n_chunks": [len(part)], "ids": [ids]} | ({"decoded": [pieces(path).decode(ids)]} if back else {}))

    return of


def _between(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = pieces(path).encode([r["text"][r["from"] - r["lo"] : r["to"] - r["lo"] if r["to"] >= 0 else None] for r in rows])
            yield pa.record_batch([*(batch.column(c) for c in KEY), batch.column("k"), pa.array(ids, pa.binary())], names=[*KEY, "k", "ids"])

    return run


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, back: bool = False) -> DataFrame:
    """(doc_id, n_chunks, ids) of each row. Only giant documents are shuffled, chunk by chunk; equal ones are encoded once.
    A document's ids come together in one row, so they must fit one (some 500 million).

    With ``back`` the ids are decoded too, by the worker that made them where it can."""
    common.ready(docs)
    margin = pieces(model).longest
    chunk = max(chunk, 4 * margin)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    giant = F.coalesce(F.length("text") + 1 >= 2 * chunk, F.lit(False))
    small = own.where(~giant).mapInArrow(_whole(model, back), WHOLE + ", decoded string" * back)
    large = own.where(giant).select("doc_id", F.xxhash64("doc_id", "text").alias("h1"), F.xxhash64(F.lit("second"), "text", "doc_id").alias("h2"), "text")
    parts = common.cut(large.select(*KEY, "text").mapInArrow(_cut(chunk, margin), PART).dropDuplicates([*KEY, "k"]))
    most = parts.agg(F.max("n")).first()[0] or 0
    matrices = parts.mapInArrow(_matrices(model), "h1 long, h2 long, k int, n_left int, left array<long>, right array<long>, matrix binary")
    matrices = common.cut(matrices)
    ends = states(matrices, most).join(matrices.select(*KEY, "k", "left", "right"), [*KEY, "k"])
    spans = ends.select(*KEY, "k", F.col("left")[F.col("from_state")].alias("from"), F.when(F.col("to_state") >= 0, F.get("right", F.col("to_state"))).otherwise(-1).alias("to"))
    coded = parts.join(spans, [*KEY, "k"]).mapInArrow(_between(model), "h1 long, h2 long, k int, ids binary")
    whole = coded.groupBy(*KEY).applyInPandas(_joined(model, back), "h1 long, h2 long, n_chunks int, ids binary" + ", decoded string" * back)
    rows = large.select("doc_id", *KEY).join(whole, [*KEY]).select("doc_id", "n_chunks", "ids", *["decoded"] * back)
    return small.unionByName(rows)


def round_trip(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chunks, ids, decoded) of each row."""
    return encode(docs, model, key, text, chunk, back=True)


def decode(coded: DataFrame, model: str) -> DataFrame:
    """``coded`` with its ``ids`` decoded as ``decoded``; no shuffle."""
    common.ready(coded)
    names = [c for c in coded.columns if c != "decoded"]
    shape = coded.select(*names).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "ids"):
            texts = [pieces(model).decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return coded.select(*names).mapInArrow(run, shape.add("decoded", "string"))


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, n_chunks, n_chars, text_crc32): the ids', then the decoded text's."""
    return decoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "n_chunks", F.length("decoded").cast("long").alias("n_chars"), F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"))
