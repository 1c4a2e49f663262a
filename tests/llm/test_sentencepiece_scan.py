import random
import struct
import zlib

import numpy as np
import pytest

from tessella.llm import common, sentencepiece_scan as sps

MODEL = common.tokenizer_file("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return sps.Pieces(MODEL)


def scanned(p, text, chunk):
    """Ids by transfer matrices and independent backtraces."""
    t = sps.prepared(text)
    at = sps.cuts(len(t), chunk)
    steps = [p.transfer(t, a, b, b == len(t)) for a, b in zip(at, at[1:], strict=False)]
    ends = [0, *(s[1][j][1] for s, j in zip(steps, sps.boundaries([s[2] for s in steps]), strict=False)), len(t)]
    return np.frombuffer(b"".join(p.encode([t[a:b]])[0] for a, b in zip(ends, ends[1:], strict=False)), "<u4").tolist()


TEXTS = [
    "Hello world, this is a test.\nNew  line   and\ttabs",
    "x" * 700,
    "internationalization" * 40,
    "a b" * 200,
    " " * 333,
    "▁ ▁▁x" * 60,
    "日本語のテキスト と \U0001f600\U0001f600 émigré" * 20,
    "<s></s><unk><0x0A>" * 20,
]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("chunk", [64, 101])
def test_scan_equals_library(pieces, text, chunk):
    if len(text) + 1 >= 2 * chunk:
        assert scanned(pieces, text, chunk) == pieces.library.encode(text)
    assert list(np.frombuffer(pieces.encode([sps.prepared(text)])[0], "<u4")) == pieces.library.encode(text)


def test_random_texts(pieces):
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["the", "ing", " ", "  ", "q", "é", "\n", "ation", "zz", "\x00", "1", "ß"]) for _ in range(rng.randint(150, 400)))
        want = pieces.library.encode(text)
        assert scanned(pieces, text, 64) == want
        assert pieces.decode(np.array(want, "<u4").tobytes()) == text.replace("▁", " ")


def test_products_are_associative():
    rng = np.random.default_rng(3)
    a, b, c = (np.where(rng.random((4, 4)) < 0.5, 0, sps.NEVER).astype(np.float32) for _ in range(3))
    assert (sps.product(sps.product(a, b), c) == sps.product(a, sps.product(b, c))).all()


def test_operator(spark, pieces):
    texts = [None, "", "one", "one", "word " * 900, "nospace" * 400, *TEXTS]
    docs = spark.createDataFrame([(k // 2, t, k, "z") for k, t in enumerate(texts)], "doc_id long, text string, ids long, n_chunks string")
    got = sps.digests(sps.decode(sps.encode(docs, MODEL, chunk=200), MODEL)).collect()
    want = []
    for k, t in enumerate(texts):
        ids = pieces.library.encode(t or "")
        back = (t or "").replace("▁", " ")
        want.append((k // 2, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), len(back), zlib.crc32(back.encode())))
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.n_chars, r.text_crc32) for r in got) == sorted(want)
    assert max(r.n_chunks for r in got) > 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sps.digests(sps.decode(sps.encode(docs, MODEL), MODEL)).count() == 0


def test_repeated_giants(spark):
    text = "giant words here " * 300
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text)], "doc_id long, text string")
    got = sps.digests(sps.round_trip(docs, MODEL, chunk=500)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, sps.digests(sps.decode(sps.encode(docs, MODEL, chunk=500), MODEL)).collect()))
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 1, 2]
    assert {r.text_crc32 for r in got} == {zlib.crc32(text.encode())} and all(r.n_chunks > 5 for r in got)


def test_a_tree_of_matrices(spark, pieces, monkeypatch):
    monkeypatch.setattr(sps, "FAN", 3)  # the workers keep theirs, which is larger than any node here
    rng = random.Random(8)
    texts = ["".join(rng.choice(["the", "ing", " ", "q", "é", "ation", "zz"]) for _ in range(n)) for n in (400, 3000, 9000)]
    t = sps.prepared(texts[1])
    at = sps.cuts(len(t), 64)
    matrices = [pieces.transfer(t, a, b, b == len(t))[2] for a, b in zip(at, at[1:], strict=False)]
    flat = sps.boundaries(matrices)
    for fan in (2, 3, 7):  # the same states from products of products
        tops = [sps.reduce(sps.product, matrices[k : k + fan]) for k in range(0, len(matrices), fan)]
        ends = [0, *sps.boundaries(tops), -1]
        got = []
        for k, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
            got += [*sps.boundaries(matrices[k * fan : (k + 1) * fan], a, b), b]
        assert got[:-1] == flat
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {k: struct.pack(f"<{len(i)}I", *i) for k, i in enumerate(map(pieces.library.encode, texts))}
    monkeypatch.setattr(sps, "FAN", 64)
    assert {r.doc_id: bytes(r.ids) for r in sps.encode(docs, MODEL, chunk=64).collect()} == want  # over 64 chunks: two levels


def test_a_text_of_megabytes(spark, pieces):
    text = "Giant words, here and there; " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sps.encode(docs, MODEL).first()
    assert got.n_chunks > 2 * sps.FAN and list(np.frombuffer(bytes(got.ids), "<u4")) == pieces.library.encode(text)
