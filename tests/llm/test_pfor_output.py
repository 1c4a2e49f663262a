import io
import struct
import zlib

import numpy as np
import pytest

from tessella.llm import common, pfor_output as po


@pytest.mark.parametrize("ids", [[], [7], [0] * 600, list(range(1000)), [5, 2**32 - 1] * 300, [2**32 - 1] * 256, list(np.random.default_rng(1).integers(0, 49408, 3000))])
def test_blocks_round_trip(ids):
    x = np.array(ids, dtype=np.uint32)
    assert po.decode_blocks(b"".join(po.encode_blocks(x))).tolist() == x.tolist()


def test_outliers_do_not_widen_a_block():
    x = np.arange(256, dtype=np.uint32) % 16
    x[::50] = 2**31
    assert len(b"".join(po.encode_blocks(x))) < 4 * 256 // 2


def test_file_is_read_by_its_index():
    rng = np.random.default_rng(2)
    docs = [(k if k else None, rng.integers(0, 60000, int(rng.integers(0, 900))).astype("<u4").tobytes()) for k in range(200)]
    sink = io.BytesIO()
    w = po.Writer(sink)
    for k, ids in docs:
        w.add(k, ids)
    w.close()
    r = po.Reader(io.BytesIO(sink.getvalue()), len(sink.getvalue()))
    assert [(k, ids) for k, _, ids in r.documents()] == docs
    whole = b"".join(ids for _, ids in docs)
    assert r.ids(1000, 700).tobytes() == whole[4000:6800]


def test_documents_in_order_with_ends(spark):
    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [(3, "Hello  wörld\n\tdon't STOP"), (1, None), (2, ""), (2, "x"), (None, "á ́b <|endoftext|> z"), (9, "word " * 5000 + "è" * 400), (4, "   ΣΑΣ 12345 \U0001f600\x0b!?"), (4, "   ΣΑΣ 12345 \U0001f600\x0b!?")]
    docs = spark.createDataFrame([(k, x, k, 0) for k, x in texts], "doc_id long, text string, start long, n_tokens int")
    folder = common.shared_dir(spark)
    files = po.write(docs, path, folder, file_bytes=1000)
    got = sorted(((r.doc_id, r.start, bytes(r.ids)) for r in po.read(spark, folder, files).collect()), key=lambda r: r[1])
    want, at = [], 0
    for k, x in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        want.append((k, at, struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert got == want
    digests = {(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in po.read(spark, folder, files, digest=True).collect()}
    assert digests == {(k, s, len(ids) // 4, zlib.crc32(ids)) for k, s, ids in want}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = common.shared_dir(spark)
    assert po.read(spark, folder, po.write(docs, common.tokenizer_file("word_bpe_49k.json"), folder), digest=True).count() == 0


def test_words_equal_whole_texts():
    import random

    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    t, encoder = Tokenizer.from_file(path), po.WordEncoder(path)
    rng = random.Random(4)
    letters = "ahHJTWYbcxyzABCXYZéÉüÜßøÿÀÿµªº×sStT" + "'.,!?;:&*#$%-_1٣ΣςİжЖ日İ…\u0301\u0331"
    fixed = "Ab <|ENDOFTEXT|> <|endoftext|>x, <|StartOfText|>. Y!"
    assert encoder.encode([fixed.encode()])[0] == struct.pack(f"<{len(ids := t.encode(fixed, add_special_tokens=False).ids)}I", *ids)
    for k in range(300):
        text = "".join(rng.choice(letters if k % 2 else letters[:-2] + "      \n\t\xa0") for _ in range(300))
        assert encoder.encode([text.encode()])[0] == struct.pack(f"<{len(ids := t.encode(text, add_special_tokens=False).ids)}I", *ids)


def test_one_key_is_split(spark, tmp_path):
    docs = spark.range(3000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CASE WHEN id < 1500 THEN concat('text ', id) ELSE 'the same text' END AS text")
    folder = f"file://{tmp_path}"
    (tmp_path / "ids-left-behind.pfr").write_bytes(b"x")
    files = po.write(docs.repartition(6), common.tokenizer_file("word_bpe_49k.json"), folder, file_bytes=4000)
    assert len(files) >= 10 and sorted(p.name for p in tmp_path.iterdir()) == sorted(f.rsplit("/", 1)[-1] for f, _, _ in files)
    got = po.read(spark, folder, files).collect()
    assert len(got) == 3000 and max(n for _, n, _ in files) < 0.5 * sum(n for _, n, _ in files)
    got.sort(key=lambda r: r.start)
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(got, got[1:], strict=False))


def test_frequent_words_are_encoded_once(monkeypatch):
    monkeypatch.setattr(po, "CACHE", 40)
    encoder, asked = po.WordEncoder(common.tokenizer_file("word_bpe_49k.json")), []
    add = encoder.add
    monkeypatch.setattr(encoder, "add", lambda new: (asked.extend(new), add(new)))
    for k in range(30):
        encoder.encode([f"Common, {chr(97 + k % 26) * 3}{'xyz'[k % 3]}{'q' * j} COMMON".encode() for j in range(5)])
    assert asked.count(b"common") == 1 and len(encoder.known) + len(encoder.older) <= 60


def test_cut_words_equal_whole_texts():
    from tokenizers import Tokenizer

    path = common.tokenizer_file("word_bpe_49k.json")
    t, encoder = Tokenizer.from_file(path), po.WordEncoder(path)
    texts = ["a", ".b", "", None, " \n", "word", "...", "x.,!", "É,", "×,", "÷. ÿ. ÷a.", "don't.", "3.", "a.b.,", "'s.", "<|endoftext|>.", "<|ENDOFTEXT|>,", "  lead", "trail \t", "é", ",", "." * 3000, "z" + "!" * 3000, "́.", "Ω."]
    want = [struct.pack(f"<{len(ids := t.encode(x or '', add_special_tokens=False).ids)}I", *ids) for x in texts]
    assert encoder.encode([x if x is None else x.encode() for x in texts]) == want
    assert encoder.encode([None, b"", b" \t"]) == [b"", b"", b""] and encoder.encode([]) == []
