import random
import struct
import zlib

import pytest

import corpus_pipeline
from tessella.llm import common, decontaminate, jaccard_join, sentencepiece_scan

rng = random.Random(12)
EN, DE = "the and of that with this from which their there".split(), "der die und nicht sich mit auch wurde einem über".split()


def prose(words, n):
    return " ".join(rng.choice(words) + rng.choice(["", "", "ing", "en", "s"]) for _ in range(n))


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [(k, prose(EN if k % 2 else DE, 60), "en" if k % 2 else "de") for k in range(60)]
    item = prose(EN, 30)
    rows += [(100, rows[3][1], "en"), (101, rows[4][1] + " neu", "de"), (102, f"{item} {prose(EN, 20)}", "en"), (103, "12 34 !!", "en"), (104, None, None)]
    spark.createDataFrame([(k, t, y, "s", len(t or "")) for k, t, y in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return tmp_path, rows, item


def test_stages_against_brute_force(spark, folder):
    path, rows, item = folder
    got = {r.doc_id: (r.n_tokens, r.ids_crc32, r.text_crc32) for r in corpus_pipeline.run(spark, str(path)).collect()}
    texts = {k: t for k, t, _ in rows if k not in (103, 104)}
    first = jaccard_join.brute_force(list(texts.items()))
    kept = [k for k in texts if first[k][1] == k]
    assert 100 not in kept and 101 not in kept
    kept.remove(102)
    model = sentencepiece_scan.Pieces(common.tokenizer_file("piece_bpe_32k.model"))
    want = {}
    for k in kept:
        ids = model.library.encode(texts[k])
        want[k] = len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), zlib.crc32(texts[k].encode())
    assert got == want
    assert len(decontaminate.words(item)) == 30


def test_stage_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    assert len(corpus_pipeline.STAGES) in (4, 5)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(folder[0])).columns == docs.columns


def test_near_copies_of_the_stage(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = [*base], [*base]
    near[30] = near[70] = "other"  # 86 of 106 five-word shingles, 92 of 104 of three words: linked at 0.8, not at 0.9
    far[20] = far[50] = far[80] = "other"  # 81 of 111
    docs = spark.createDataFrame([(k, " ".join(w), "en") for k, w in enumerate((base, near, far))], "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {0, 2}


def test_odd_tables(spark, folder):
    import os

    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, some in (("empty", docs.limit(0)), ("odd", docs.where("doc_id < 60").unionByName(docs.where("doc_id < 6")).selectExpr("nullif(doc_id, 1) AS doc_id", "text", "lang", "source", "n_chars", "1 AS ids", "2 AS __id", "'x' AS component_id"))):
        some.write.parquet(f"{path}/{name}/documents.parquet")
        os.symlink(f"{path}/benchmark.parquet", f"{path}/{name}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{path}/empty").collect() == []
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in corpus_pipeline.run(spark, f"{path}/odd").collect())
    assert got == sorted((k != 1, k if k != 1 else 0, zlib.crc32(t.encode())) for k, t, _ in rows[:60])
    odd = spark.read.parquet(f"{path}/odd/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, f"{path}/odd").columns == odd.columns
