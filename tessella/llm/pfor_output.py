"""Token-ID output: patched frame-of-reference blocks in files that are ordered by document.

File format (little endian)::

    "PFR1"
    blocks     u16 ids in it, u8 width, u8 zero, u32 minimum, u16 exceptions, u16 zero,
               ids minus minimum packed at the width (lowest bits first, in 64-bit words, padded to BLOCK ids),
               exceptions: u16 places, then u32 values minus minimum
    documents  i64 keys, u8 key-is-null flags, u32 lengths, u32 checksums of the ids written
    starts     u64 offset of each block
    footer     u64 ids, u64 blocks, u64 documents, u64 offset of documents, "PFR1"

A block's width is the one that holds ``PERCENTILE`` % of its values; larger values are exceptions and are patched in.

Defined results
---------------
* null or empty text: the end id alone; null keys come first and stay null; equal keys are ordered by the
  first START characters of their texts, then by a hash of them, and all kept;
* an empty table: no file and an empty result; extra columns are ignored.

A task writes a file of a name of its own and reports it; files of failed or repeated attempts are reported by nobody, never
read, and removed when the job is done. Readers check every document's checksum. The folder lies below ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

BLOCK = 256
PERCENTILE = 90
MAGIC = b"PFR1"
HEAD = struct.Struct("<HBBIHH")
FOOT = struct.Struct("<QQQQ4s")
END_ID = 1
#: Words whose ids a worker remembers.
CACHE = 600_000
#: Letter runs encoded in one call.
CALL = 500
#: Bytes of text whose words are looked up together: each different one once.
TOGETHER = 2 << 20
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MARKS = b".,!?;:&*#$%"
#: Classes of bytes: marks, plain letters of one byte, second bytes of plain letters that begin with LEAD.
MARK, LETTER, SECOND, LEAD = 1, 2, 3, 0xC3
CLASS = np.zeros(256, dtype=np.uint8)
CLASS[list(MARKS)], CLASS[97:123] = MARK, LETTER
CLASS[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = SECOND

#: Rows of one key are dealt out by so many first characters of their texts, and equal ones to so many places.
START, APART = 64, 256
#: Bytes of text that go into one file.
FILE_BYTES = 64 << 20


# -- blocks


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values under 2**width as rows of 64-bit words; 64 values fill ``width`` words."""
    n = len(values)
    out = np.zeros((n, BLOCK // 64, width), dtype=np.uint64)
    lanes = values.reshape(n, BLOCK // 64, 64).astype(np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= lanes[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - shift)
    return out.reshape(n, -1)


def unpack(rows: np.ndarray, width: int) -> np.ndarray:
    n = len(rows)
    out = np.zeros((n, BLOCK // 64, 64), dtype=np.uint64)
    words = rows.reshape(n, BLOCK // 64, width) if width else rows
    mask = np.uint64((1 << width) - 1)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        x = words[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | words[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = x & mask
    return out.reshape(n, BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """The blocks of ``ids`` (the last may be short), each as bytes."""
    if not len(ids):
        return []
    n = -(-len(ids) // BLOCK)
    grid = np.full(n * BLOCK, ids[-1], dtype=np.uint32)
    grid[: len(ids)] = ids
    grid = grid.reshape(n, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    bound = np.partition(rest, BLOCK * PERCENTILE // 100, axis=1)[:, BLOCK * PERCENTILE // 100]
    width = np.ceil(np.log2(bound.astype(np.float64) + 1)).astype(np.int64)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    over = rest >= limit
    body = np.where(over, 0, rest)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        for k, row in zip(own, pack(body[own], int(w)), strict=True):
            packed[k] = row.tobytes()
    counts = over.sum(axis=1)
    rows, places = np.nonzero(over)
    values, edges = rest[rows, places], np.concatenate([[0], np.cumsum(counts)])
    places = places.astype(np.uint16)
    out = []
    for k in range(n):
        a, b = edges[k], edges[k + 1]
        size = BLOCK if k < n - 1 else len(ids) - (n - 1) * BLOCK
        out.append(HEAD.pack(size, int(width[k]), 0, int(low[k]), b - a, 0) + packed[k] + places[a:b].tobytes() + values[a:b].tobytes())
    return out


def decode_blocks(data: bytes | memoryview) -> np.ndarray:
    """The ids of whole blocks that lie one after another."""
    view, at = memoryview(data), 0
    heads = []
    while at < len(view):
        size, width, _, low, over, _ = HEAD.unpack_from(view, at)
        body = at + HEAD.size
        tail = body + BLOCK * width // 8
        heads.append((size, width, low, over, body, tail))
        at = tail + 6 * over
    if not heads:
        return np.zeros(0, dtype=np.uint32)
    grid = np.zeros((len(heads), BLOCK), dtype=np.uint32)
    widths = np.array([h[1] for h in heads])
    for w in np.unique(widths):
        own = np.flatnonzero(widths == w)
        rows = np.stack([np.frombuffer(view[heads[k][4] : heads[k][5]], dtype="<u8") for k in own])
        grid[own] = unpack(rows, int(w))
    sizes, _, lows, overs, _, tails = zip(*heads, strict=True)
    rows = np.repeat(np.arange(len(heads)), overs)
    places = np.frombuffer(b"".join([view[a : a + 2 * n] for a, n in zip(tails, overs, strict=True)]), dtype="<u2")
    grid[rows, places] = np.frombuffer(b"".join([view[a + 2 * n : a + 6 * n] for a, n in zip(tails, overs, strict=True)]), dtype="<u4")
    grid += np.array(lows, dtype=np.uint32)[:, None]
    return grid.reshape(-1)[: (len(heads) - 1) * BLOCK + heads[-1][0]] if all(n == BLOCK for n in sizes[:-1]) else np.concatenate([g[:n] for g, n in zip(grid, sizes, strict=True)])


# -- files


class Writer:
    """Streams documents' ids into one file; holds a stretch of blocks and the indexes only."""

    STRETCH = 512 * BLOCK

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.parts: list[bytes] = []
        self.held = self.n_ids = 0
        self.starts: list[int] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        self.sums: list[int] = []
        sink.write(MAGIC)

    def add(self, key: int | None, ids: bytes) -> None:
        """``ids``: unsigned 32-bit, little endian."""
        self.keys.append(key)
        self.lengths.append(len(ids) // 4)
        self.sums.append(zlib.crc32(ids))
        self.parts.append(ids)
        self.held += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self.held >= self.STRETCH:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), dtype="<u4")
        n = len(ids) if last else len(ids) // BLOCK * BLOCK
        for block in encode_blocks(ids[:n]):
            self.starts.append(self.at)
            self.sink.write(block)
            self.at += len(block)
        self.parts, self.held = ([], 0) if last else ([ids[n:].tobytes()], len(ids) - n)

    def close(self) -> None:
        self.flush(True)
        nulls = np.array([k is None for k in self.keys], dtype=np.uint8)
        self.sink.write(np.array([k or 0 for k in self.keys], dtype="<i8").tobytes() + nulls.tobytes() + np.array(self.lengths, dtype="<u4").tobytes() + np.array(self.sums, dtype="<u4").tobytes())
        self.sink.write(np.array(self.starts, dtype="<u8").tobytes())
        self.sink.write(FOOT.pack(self.n_ids, len(self.starts), len(self.keys), self.at, MAGIC))


class Reader:
    """Reads a file by its indexes, a stretch of blocks at a time."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOT.size)
        self.n_ids, blocks, docs, at, magic = FOOT.unpack(source.read(FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        table = source.read(17 * docs)
        self.keys = np.frombuffer(table, dtype="<i8", count=docs)
        self.nulls = np.frombuffer(table, dtype=np.uint8, offset=8 * docs, count=docs).astype(bool)
        self.lengths = np.frombuffer(table, dtype="<u4", offset=9 * docs, count=docs).astype(np.int64)
        self.sums = np.frombuffer(table, dtype="<u4", offset=13 * docs, count=docs)
        self.starts = np.append(np.frombuffer(source.read(8 * blocks), dtype="<u8").astype(np.int64), at)

    def ids(self, first: int, n: int) -> np.ndarray:
        """``n`` ids from the place ``first``: only the blocks that hold them are read."""
        if not n:
            return np.zeros(0, dtype=np.uint32)
        a, b = first // BLOCK, (first + n - 1) // BLOCK + 1
        self.source.seek(int(self.starts[a]))
        return decode_blocks(self.source.read(int(self.starts[b] - self.starts[a])))[first - a * BLOCK : first - a * BLOCK + n]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(key, first place, ids) of each document, in order."""
        edges = np.concatenate([[0], np.cumsum(self.lengths)])
        k, docs = 0, len(self.lengths)
        while k < docs:
            stop = max(k + 1, int(np.searchsorted(edges, edges[k] + Writer.STRETCH, "right")) - 1)
            ids = self.ids(int(edges[k]), int(edges[stop] - edges[k])).astype("<u4", copy=False)
            for j in range(k, stop):
                own = ids[edges[j] - edges[k] : edges[j + 1] - edges[k]].tobytes()
                if zlib.crc32(own) != self.sums[j]:
                    raise ValueError(f"document {j} does not match its checksum")
                yield (None if self.nulls[j] else int(self.keys[j])), int(edges[j]), own
            k = stop


# -- tokenising


class WordEncoder:
    """Ids of texts as bytes. The tokenizer never joins what ASCII white space parts, so words are encoded once and remembered.

    To have fewer different words, A-Z are lower-cased beforehand, as the tokenizer does (but not in texts with combining
    marks, where composing comes first, or with what may be a special token, which has but one spelling), and marks at the end of a word are parted from it, as its pre-tokens are. New
    letter runs go to the tokenizer many to a call, parted by spaces; ids that end a pre-token tell them apart again.

    Words are cut, numbered and their ids strung together in arrays; Python sees each different word of a call once. What is
    remembered has two halves: when the newer one is full, words of the older one that were not met since go."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for piece, i in vocabulary.items():
            self.ends[i] = piece.endswith("</w>")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def direct(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def add(self, new: list[bytes]) -> None:
        texts = b"\n".join(new).decode("utf-8").split("\n")
        alone = [t.isalpha() for t in texts]
        runs, others = list(compress(zip(new, texts, strict=True), alone)), [(w, t) for w, t, a in zip(new, texts, alone, strict=True) if not a]
        for lo in range(0, len(runs), CALL):
            words, part = zip(*runs[lo : lo + CALL], strict=True)
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if len(stops) != len(part):  # a letter whose lower case is none, or a vocabulary without ends of words
                others += runs[lo : lo + CALL]
                continue
            data, stops = ids.tobytes(), (4 * stops).tolist()
            self.known.update(zip(words, [data[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))
        for lo in range(0, len(others), 4096):
            some = others[lo : lo + 4096]
            self.known.update(zip([w for w, _ in some], self.direct([t for _, t in some]), strict=True))

    def _new(self, words: list[bytes]) -> list[bytes]:
        """Those of ``words`` that are not known; what the older half has of them goes to the newer one."""
        known, older = self.known, self.older
        if older:
            known.update([(w, older[w]) for w in words if w in older])
        return [w for w in words if w not in known]

    def ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of different ``words``."""
        if len(self.known) > CACHE // 2:
            self.known, self.older = {}, self.known
        found = list(map(self.known.get, words))
        places = [k for k, ids in enumerate(found) if ids is None]
        if new := self._new([words[k] for k in places]):
            self.add(new)
        for k in places:
            found[k] = self.known[words[k]]
        return found

    def lower(self, text: bytes | None) -> bytes:
        if not text:
            return b""
        return text if b"\xcc" in text or b"\xcd" in text or b"<|" in text else text.translate(LOWER)

    def words(self, texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
        """The words of all texts, and how many lie before each text's first and in all. Marks behind a plain letter are a word."""
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pa.array([self.lower(t) for t in texts], pa.large_binary()).view(pa.large_string()))
        n, (_, places, letters) = len(split.values), split.values.buffers()
        if not letters:
            return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, dtype=np.int64)
        data, at, edges = np.frombuffer(letters, dtype=np.uint8), np.frombuffer(places, dtype=np.int64, count=n + 1), split.offsets.to_numpy()
        own = np.flatnonzero((CLASS[data[np.maximum(at[1:], 1) - 1]] == MARK) & (at[1:] > at[:-1]))
        first, cut = at[own], at[own + 1] - 1
        for k in np.flatnonzero((cut > first) & (CLASS[data[cut - 1]] == MARK)).tolist():  # more than one mark
            cut[k] = first[k] + len(data[first[k] : cut[k]].tobytes().rstrip(MARKS))
        before = CLASS[data[cut - 1]]
        parted = (cut > first) & ((before == LETTER) | (before == SECOND) & (cut - 1 > first) & (data[cut - 2] == LEAD))
        own, cut = own[parted], cut[parted]
        at = np.insert(at, own + 1, cut)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n + len(own), [None, pa.py_buffer(at), letters]), edges + np.searchsorted(own, edges)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        words, edges = self.words(texts)
        words = words.dictionary_encode()
        ids = pa.array(self.ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        del words
        _, places, data = ids.buffers()
        if not data:  # no words, or none with ids
            return [b""] * len(texts)
        cuts = np.frombuffer(places, dtype=np.int64, count=len(ids) + 1)[edges].tolist()
        data = memoryview(data)
        return [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One for each worker process, so that tasks share what it remembers."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _drop_others(folder: str, reported: set[str]) -> None:
    """What failed or repeated attempts have left goes; one that still writes leaves a file that nobody reads."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder)
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.type == fs.FileType.File and f.path not in reported:
            system.delete_file(f.path)


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes | None]]]:
    """Keys and texts of slices, until there are TOGETHER bytes of text."""
    keys, texts, size = [], [], 0
    for batch in common.slices(batches, "text"):
        own = batch.column("text").cast(pa.binary()).to_pylist()
        keys += batch.column("doc_id").to_pylist()
        texts += own
        size += sum(len(t) + 8 for t in own if t) + 8 * len(own)
        if size >= TOGETHER:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


MANIFEST = pa.schema([("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("low", pa.int64()), ("part", pa.int32())])


def write(docs: DataFrame, tokenizer: str, folder: str, key: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> list[tuple[str, int, int]]:
    """Writes the files and returns (path, ids in it, ids before it) of each, in order. One shuffle, of keys and texts."""
    common.ready(docs)
    own = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    total = own.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    if not total.n:
        return []
    # rows of one key, null or not, are split too, and so are equal ones
    begin, hashed, apart = F.col("text").substr(1, START), F.xxhash64("text"), F.pmod(F.monotonically_increasing_id(), F.lit(APART))
    dealt = own.repartitionByRange(max(12, -(-total.size // file_bytes)), "doc_id", begin, hashed, apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        writer = sink = encoder = None
        end = struct.pack("<I", END_ID)
        for keys, texts in _together(batches):
            if writer is None:
                system, root = fs.FileSystem.from_uri(folder)
                system.create_dir(root, recursive=True)
                path = f"{root}/ids-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.pfr"
                sink = system.open_output_stream(path)
                writer, encoder = Writer(sink), encoder_of(tokenizer)
            for k, ids in zip(keys, encoder.encode(texts), strict=True):
                writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.record_batch([[path], [writer.n_ids], [len(writer.keys)], [next((k for k in writer.keys if k is not None), None)], [TaskContext.get().partitionId()]], schema=MANIFEST)

    files = dealt.sortWithinPartitions("doc_id", begin, hashed, "text").mapInArrow(run, "path string, n_ids long, n_docs long, low long, part int").collect()
    _drop_others(folder, {f.path for f in files})
    out, before = [], 0
    for f in sorted(files, key=lambda f: f.part):
        out.append((f.path, f.n_ids, before))
        before += f.n_ids
    return out


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def read(spark, folder: str, files: list[tuple[str, int, int]], digest: bool = False) -> DataFrame:
    """(doc_id, start, ids as bytes) of each document in ``files``; with ``digest``, (doc_id, start, n_tokens, ids_crc32)."""
    schema = READ if not digest else pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    ddl = "doc_id long, start long, ids binary" if not digest else "doc_id long, start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for f in batch.to_pylist():
                system, _ = fs.FileSystem.from_uri(folder)
                with system.open_input_file(f["path"]) as source:
                    rows, size = [], 0
                    for k, at, ids in Reader(source, source.size()).documents():
                        rows.append((k, f["before"] + at, len(ids) // 4, zlib.crc32(ids)) if digest else (k, f["before"] + at, ids))
                        size += len(ids)
                        if len(rows) >= 4096 or not digest and size >= common.SLICE_BYTES:
                            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, size = [], 0
                    if rows:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    if not files:
        return spark.createDataFrame([], ddl)
    listed = spark.createDataFrame([(k, p, b) for k, (p, _, b) in enumerate(files)], "k int, path string, before long")
    return listed.repartitionById(len(files), F.col("k")).mapInArrow(run, ddl)
