import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 150
    assert sum(r.lang_pred == r.truth for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in held} == {r.doc_id for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).collect()}


def toy():
    return langid.fit([("the cat and the dog are with them " * 8, "en"), ("der Hund und die Katze sind nicht da " * 8, "de")] * 40)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 -- !!"), (4, "the dog"), (4, "the dog"), (5, "die Katze " * 20000), (None, "der Hund")]
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in rows], "doc_id long, text string, score int, lang_pred string")
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, toy()).collect()]
    assert got[:3] == [(1, "und", True), (2, "und", True), (3, "und", True)]
    assert [g[1] for g in got[3:]] == ["en", "en", "de", "de"]


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def test_label_is_no_input(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog" if k % 2 else "der Hund und die Katze", "en" if k % 2 else "de") for k in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(langid.sample(docs))
    one = langid.predict(docs, model).collect()
    other = langid.predict(docs.withColumn("lang", F.lit("xx")), model).collect()
    assert one == other


def test_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog " * 9 if k % 2 else "der Hund und die Katze " * 9, "en" if k % 2 else "de", "s") for k in range(80)] + [(100, "12 !", "en", "s"), (101, None, None, None)], "doc_id long, text string, lang string, source string")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(80))


def test_held_out_labels_have_no_part(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"))
    other = docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    assert langid.sample(docs, rows=60) == langid.sample(other, rows=60) != []


def test_languages_of_long_texts_alone_are_learned(spark):
    docs = spark.createDataFrame([(k, "the cat and the dog " * 3 if k % 2 else "der Hund und die Katze " * 2000, "en" if k % 2 else "de") for k in range(40)], "doc_id long, text string, lang string")
    rows = langid.sample(docs)
    assert {y for _, y in rows} == {"en", "de"} and max(len(t) for t, _ in rows) <= langid.TRAIN_CHARS
    assert {t in "der Hund und die Katze " * 2000 for t, y in rows if y == "de"} == {True}


def test_rejects_what_is_no_learned_language(spark):
    model = langid.fit(langid.sample(spark.read.parquet(f"{SF}/documents.parquet")))
    rng = random.Random(4)
    own = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where(langid.held_out("doc_id") & (F.length("text") > 400)).collect()]
    junk = ["".join(rng.sample(t, len(t))) for t in own] + ["".join(rng.choice("абвгдежзийклмнопрстуфхцчшщъыьэюя ") for _ in range(400)) for _ in range(40)] + ["".join(rng.choice("bcdfghjklmnpqrstvwxz ") for _ in range(400)) for _ in range(40)]
    passed = sum(not r for _, _, r in model.predict(junk)) / len(junk)
    lost = sum(r for _, _, r in model.predict(own)) / len(own)
    assert lost <= 0.002 and passed <= 0.1
    assert len(model.errors) == len(model.thresholds) and all(a <= 2 * langid.CLEAN_LOSS for a, _ in model.errors)


def test_pieces_add_up():
    model = toy()
    text = "der Hund, und die 12 Katze? " * 50 + "the dog"
    for piece in (1, 2, 3, 7, 64, 1000):
        got, want = model.raw(["x", text, ""], piece), model.raw(["x", text, ""])
        assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))


def plain(model, text):
    """One text by the definition: every subword's logits averaged."""
    t, out, n = f" {text.lower()} ", np.zeros(len(model.langs)), 0
    for size in langid.ORDERS:
        for i in range(len(t) - size + 1):
            inner = t[i : i + 2] if size == 2 else t[i + 1 : i + size - 1]
            if any(c.isalpha() for c in inner) if size == 2 else all(c.isalpha() for c in inner):
                h = size
                for c in t[i : i + size]:
                    h = (h ^ (ord(c) if c.isalpha() else 32)) * 0x01000193 & 0xFFFFFFFF
                    h ^= h >> 15
                out, n = out + model.table[h & langid.BUCKETS - 1, :-1], n + 1
    e = np.exp((out / max(n, 1) + model.bias) / model.temperature)
    return model.langs[int(e.argmax())], float(e.max() / e.sum())


def test_prediction_equals_a_plain_version():
    model = toy()
    texts = ["the dog and", "Die Katze!", "a1b der", "x", "Über-Hund the\n\tdog " * 7]
    for text, (lang, score, _) in zip(texts, model.predict(texts), strict=True):
        want = plain(model, text)
        assert lang == want[0] and abs(score - want[1]) < 1e-9


def test_a_very_long_text_is_worked_on_in_pieces():
    import tracemalloc

    text = "der Hund und die Katze " * 400_000
    tracemalloc.start()
    assert toy().predict([text])[0][0] == "de"
    assert tracemalloc.get_traced_memory()[1] < 6 * len(text)
    tracemalloc.stop()
