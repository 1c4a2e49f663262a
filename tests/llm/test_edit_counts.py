import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import common, edit_counts as ec

RANKS = common.tokenizer_file("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def counter():
    return ec.Counter(RANKS)


def test_edits_equal_full_counts(counter):
    rng = random.Random(9)
    bits = ["the", " ", "  ", "\n", "'re", "'", "s", "x1", "é", "12", "!?", "\t ", "ing", "\U0001f600", "   "]
    for n in (0, 1, 5, 60, 900):
        for _ in range(25):
            text = "".join(rng.choice(bits) for _ in range(n))
            tree = ec.Tree(counter, text)
            assert tree.total() == len(counter.coding.encode_ordinary(text))
            for _ in range(6):
                a = rng.randint(0, len(text) + 2)
                b = a + rng.choice([0, 0, 1, 3, 50])
                new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 8, 300])))
                text = text[:a] + new + text[b:]
                tree.edit(a, b, new)
                assert tree.text == text
                assert tree.total() == len(counter.coding.encode_ordinary(text))
                assert tree.pretokens() == len(counter.split(text))
                assert tree.chars[1] == len(text)


def test_small_edits_touch_little(counter):
    text = "some words of prose, again and again. " * 2000
    tree = ec.Tree(counter, text)
    tree.edit(40000, 40003, "new ")
    assert tree.reencoded < 10


def test_operator(spark, counter):
    texts = [None, "", "a", "hello world again", "hello world again", "x" * 5000]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r for r in ec.count(docs.withColumn("edits", ec.trial_edits(F.col("text"))), RANKS).collect()}
    for k, t in enumerate(texts):
        t = t or ""
        n = len(t)
        new = t[: n // 3] + " it's (revised) " + t[n // 3 :]
        new = new[: n // 2] + new[n // 2 + 40 :]
        new = "Edited: " + new[5:]
        assert (got[k].n_tokens_before, got[k].n_tokens, got[k].n_chars) == (len(counter.coding.encode_ordinary(t)), len(counter.coding.encode_ordinary(new)), len(new))


def test_edit_rows(spark, counter):
    docs = spark.createDataFrame([(1, "abc def"), (2, "zz"), (None, "q")], "doc_id long, text string")
    edits = spark.createDataFrame([(1, 2, 0, 1, "X"), (1, 1, None, None, "Y "), (1, 3, 99, 5, None), (7, 1, 0, 0, "w")], "doc_id long, seq int, start int, stop int, replacement string")
    got = {r.doc_id: r.n_chars for r in ec.count(ec.attach(docs, edits), RANKS).collect()}
    assert got == {1: 9, 2: 2, None: 1}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ec.count(docs.withColumn("edits", ec.trial_edits(F.col("text"))), RANKS).count() == 0


def test_trees_are_kept(spark, counter):
    rng = random.Random(10)
    for n in (0, 1, 40, 3000):
        tree = ec.Tree(counter, "".join(rng.choice(["the ", "x" * 400, "\n", " é", "12"]) for _ in range(n)))
        for _ in range(3):
            tree.edit(rng.randint(0, n), rng.randint(0, n + 9), "new " * rng.randint(0, 90))
            again = ec.Tree.load(counter, tree.text, tree.dump())
            assert (again.leaves, again.total(), again.chars[1]) == (tree.leaves, tree.total(), len(tree.text))
    with pytest.raises(ValueError, match="another text"):
        ec.Tree.load(counter, "abc", ec.Tree(counter, "ab").dump())

    docs = spark.createDataFrame([(1, "some words, more words. " * 400, "e"), (2, None, "f"), (None, "x", "g")], "doc_id long, text string, edits string").drop("edits")
    kept = ec.trees(docs, RANKS)
    cut = kept.withColumn("edits", F.array(F.struct(F.lit(10).alias("start"), F.lit(12).alias("stop"), F.lit("NEW").alias("replacement"))))
    first = ec.edited(cut, RANKS)
    second = ec.count(first.withColumn("edits", F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), F.lit("a ").alias("replacement")))), RANKS).collect()
    for r in second:
        text = {1: "some words, more words. " * 400, 2: "", None: "x"}[r.doc_id]
        text = "a " + text[:10] + "NEW" + text[12:]
        assert r.n_tokens == len(counter.coding.encode_ordinary(text)) and r.n_chars == len(text) and r.n_reencoded < 8
