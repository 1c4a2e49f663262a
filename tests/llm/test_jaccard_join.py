import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import jaccard_join as jj
from tessella.llm.components import components


def check(spark, rows):
    docs = spark.createDataFrame([(k, t, 0, "s") for k, t in rows], "doc_id long, text string, n int, sig string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(docs).collect()}
    assert got == jj.brute_force(rows)
    return got


def test_against_all_pairs(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    rows, k = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 12, 30, 80, 200]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = own[: int(len(own) * rng.choice([0.9, 0.93, 0.97]))]
            rows.append((k, rng.choice([" ", "\n", " \t "]).join(own)))
            k += 1
    passage = " ".join(rng.choice(vocabulary) for _ in range(40))
    rows += [(k + i, passage + " " + " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4, 40])))) for i in range(30)]
    rng.shuffle(rows)
    got = check(spark, rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_chain_of_links(spark):
    words = [f"t{i}" for i in range(400)]
    # each is near the next alone: a chain whose ends have little in common
    check(spark, [(i, " ".join(words[4 * i : 4 * i + 120])) for i in range(30)])


def test_large_group_with_stragglers(spark):
    rng = random.Random(7)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for k in range(150):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            own[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE\ttwo"), (8, "a b c"), (9, "a b c"), (10, "é É à"), (11, "word " * 3000)]
    check(spark, rows)


def test_repeated_rows_and_null_keys(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (3, "a b c d"), (None, "q r s")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in jj.join(docs).collect()), key=str)
    assert got == sorted([(5, 3), (5, 3), (None, 3), (3, 3), (None, None)], key=str)


def test_empty_table(spark):
    assert jj.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one_keeps_columns(spark):
    docs = spark.createDataFrame([(2, "a b c d e", "x"), (1, "A b c d e", "y"), (9, "other words here", "z")], "doc_id long, text string, component_id string")
    out = jj.keep_one(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {1, 9}


def test_five_words_at_four_fifths(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(14):
        base = [f"w{rng.randrange(200)}" for _ in range(rng.choice([3, 4, 5, 30, 60, 120]))]
        for _ in range(rng.randint(1, 8)):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                own[rng.randrange(len(own))] = f"x{rng.randrange(50)}"
            rows.append((len(rows), " ".join(own[: int(len(own) * rng.choice([1, 1, 0.85, 0.78]))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.join(docs, rule=jj.CORPUS).collect()}
    assert got == jj.brute_force(rows, jj.CORPUS)
    assert {k: c for k, (_, c) in got.items()} != {k: c for k, (_, c) in jj.brute_force(rows).items()}


def test_keep_one_of_null_and_repeated_keys(spark):
    base = [f"w{i}" for i in range(100)]
    text, near = " ".join(base), " ".join([*base[:99], "last"])
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "A b c d"), (None, "q r s"), (None, "q r s"), (None, text), (None, near), (9, near), (7, "one text here"), (7, "and quite another"), (None, None), (None, " "), (4, "x y z"), (4, "x y z"), (6, "")]
    kept = sorted((tuple(r) for r in jj.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert kept == sorted([(5, "a b c d"), (None, "q r s"), (9, near), (7, "one text here"), (7, "and quite another"), (None, None), (None, " "), (4, "x y z"), (6, "")], key=str)


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (3, 4), (9, 8), (8, 8), (4, 1)], [(i, i + 1) for i in range(40)], [(100, i) for i in range(20)]])
def test_components(spark, edges):
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    assert got == {k: root(k) for k in up}


def test_a_star_of_thousands_and_a_passage_of_thousands(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(110)]
    rows = [(k, " ".join(base[:j] + [f"x{k}"] + base[j + 1 :])) for k in range(5000) for j in [rng.randrange(110)]]
    passage = " ".join(f"p{i}" for i in range(40))
    rows += [(10_000 + k, " ".join(f"o{rng.randrange(10**9)}" for _ in range(25)) + " " + passage) for k in range(5000)]
    got = {r.doc_id: r.component_id for r in jj.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert len(got) == 10_000 and all(c == k for k, c in got.items() if k >= 10_000)
    # two of the star link unless both changes are far apart; through copies near both all hang together
    assert {c for k, c in got.items() if k < 5000} == {0}


def test_least_overlap_is_a_bound(spark):
    for rule in (jj.CONTRACT, jj.CORPUS):
        sizes = spark.range(1, 90).select(F.col("id").alias("n")).crossJoin(spark.range(1, 120).select(F.col("id").alias("m"))).where(rule.parts * F.least("n", "m") >= rule.least * F.greatest("n", "m"))
        n, m = F.col("n"), F.col("m")
        worst = sizes.select("n", "m", rule.shared_in_prefixes(n, m).alias("s"))
        ranges = worst.select("n", F.col("m").alias("low")).join(worst.select("n", F.col("m").alias("high")), "n").where("low <= high").withColumn("bound", rule.least_overlap(n, F.col("low"), F.col("high")))
        assert ranges.join(worst, "n").where("m between low and high and bound > greatest(s, 1)").count() == 0


def test_levels_keep_the_order():
    import numpy as np

    counts = np.random.default_rng(1).integers(0, 1 << 40, 200_000)
    got = jj.levels(counts)[np.argsort(counts, kind="stable")]
    assert got.dtype == np.uint16 and (np.diff(got.astype(int)) >= 0).all() and got.max() > 60_000
    assert jj.levels(np.array([3, 0, 70])).tolist() == [3, 0, 70]
    assert [jj.narrow(np.array([k])).itemsize for k in (255, 256, 65536, 1 << 33)] == [1, 2, 4, 8]


def test_keep_one_beside_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c d e", 7, 8, 9, 0), (2, "A b c d e", 7, 8, 9, 0)], "doc_id long, text string, __id int, __null int, __key_ int, component long")
    assert [tuple(r) for r in jj.keep_one(docs).collect()] == [(1, "a b c d e", 7, 8, 9, 0)]


def test_a_family_below_the_threshold_does_not_meet_in_pairs(spark, monkeypatch):
    rng = random.Random(10)
    base, rows = [f"b{i}" for i in range(150)], []
    for k in range(300):  # four changes each: two of them mostly share less than nine tenths
        own = list(base)
        for j in rng.sample(range(3, 147, 4), 4):
            own[j] = f"x{k}_{j}"
        rows.append((k, " ".join(own)))
    met, cut = [], jj.common.cut

    def counted(df):
        made = cut(df)
        if made.columns == ["q", "qn", "grp", "least"]:
            met.append(made.count())
        return made

    monkeypatch.setattr(jj.common, "cut", counted)
    assert len(set(check(spark, rows).values())) > 250
    assert len(met) == 1 and met[0] < 1000
