import random
import re

from tessella.llm import decontaminate as dc

WORDS = [f"w{i}" for i in range(60)]


def split(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items):
    out = {}
    for k, t in docs:
        w = split(t)
        hit, found = set(), set()
        for name, text in items:
            b = split(text)
            n = min(13, len(b))
            for i in range(len(b) - n + 1) if n else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == b[i : i + n]:
                        hit |= set(range(j, j + n))
                        found.add(name)
        out[k] = (len(w), len(hit), len(found), dc.digest(list(found)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def tables(spark):
    rng = random.Random(2)
    items = [(f"i{k}", " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for k in range(12)]
    items += [("same", items[0][1]), ("none", None), ("blank", " .-! ")]
    docs = []
    for k in range(40):
        own = [rng.choice(WORDS) for _ in range(rng.choice([0, 5, 40, 300]))]
        if k % 2:
            own[len(own) // 2 : len(own) // 2] = split(rng.choice(items)[1])[: rng.choice([5, 13, 20, 99])]
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.2 else w for w in own)))
    docs += [(100, None), (101, ""), (102, "É é 日本 " * 3000), (103, "-- ..")]
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id long, text string, n_words int, item_id string")
    b = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id string, text string, doc_id int")
    return docs, items, d, b


def test_against_brute_force(spark):
    docs, items, d, b = tables(spark)
    want = brute(docs, items)
    for size in (dc.BLOCK_BYTES, 200):  # one block, and several
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in dc.judge(dc.scan(d, b, block_bytes=size)).collect()}
        assert got == want
        kept = dc.clean(d, b, block_bytes=size)
        assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if not v[4]}


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id string, text string")
    assert dc.scan(d, b).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [r.n_hit for r in dc.judge(dc.scan(one, b)).collect()] == [0]


def test_spans_are_cut_out():
    text = "Keep this, but THAT goes - all of it. End"
    assert dc.remove_spans(text, [(3, 6)]) == "Keep this, but  of it. End"
    assert dc.remove_spans(None, [(0, 1)]) is None


def test_every_row_is_judged_alone(spark):
    items = [(f"i{k}", " ".join(f"k{k}x{j}" for j in range(14))) for k in range(30)]
    clean, bad, worse = "quite clean words " * 10, items[3][1] + " more of it", " ".join(items[k][1] for k in range(30))
    texts = [(None, clean), (None, bad), (None, worse), (7, clean), (7, bad), (7, bad), (8, f"{bad} end"), (8, "other words " * 8 + "a"), (None, None), (7, "")]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(((k, *v) for k, t in texts for v in brute([(k, t)], items).values()), key=str)
    for size in (dc.BLOCK_BYTES, 400):  # one block, and several
        assert sorted((tuple(r) for r in dc.judge(dc.scan(d, b, block_bytes=size)).collect()), key=str) == want
        kept = [tuple(r) for r in dc.clean(d, b, block_bytes=size).collect()]
        assert sorted(kept, key=str) == sorted([(k, t) for k, t in texts if not brute([(k, t)], items)[k][4]], key=str)


def test_hashes_that_collide_are_told_apart(monkeypatch):
    monkeypatch.setattr(dc, "mixed", lambda ids, starts, n: ids[starts].astype("uint64") % 2)
    rng = random.Random(5)
    items = [(f"i{k % 9}", " ".join(rng.choice("abcd") for _ in range(rng.choice([1, 2, 13, 15, 20])))) for k in range(30)]
    docs = [(k, " ".join(rng.choice("abcde") for _ in range(200)) + " " + items[k][1]) for k in range(20)]
    found = dc.find(dc.Index([(i, t.encode()) for i, t in items]), [t.encode() for _, t in docs])
    want = brute(docs, items)
    assert {k: (n, sum(b - a for a, b in s), len(i)) for (k, _), (n, s, i) in zip(docs, found, strict=True)} == {k: v[:3] for k, v in want.items()}


def test_index_of_a_large_benchmark():
    import time
    import tracemalloc

    rng = random.Random(6)
    vocabulary = [f"{rng.randrange(10**6):x}" for _ in range(30000)]
    items = [(str(k), " ".join(rng.choices(vocabulary, k=300)).encode()) for k in range(4000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    began = time.perf_counter()
    index = dc.Index(items)
    assert time.perf_counter() - began < 4 * size / 1e6
    assert tracemalloc.get_traced_memory()[0] < 10 * size
    tracemalloc.stop()
    text = b"some words before " + items[7][1] + b" and after"
    assert dc.find(index, [text]) == [(305, [(3, 303)], ["7"])]


def test_one_very_long_text(spark):
    d = spark.createDataFrame([(1, "plain words only " * 200_000 + "one two three")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "one two three")], "item_id string, text string")
    assert [(r.n_words, [tuple(s) for s in r.spans]) for r in dc.scan(d, b).collect()] == [(600_003, [(600_000, 600_003)])]
