import zlib
from collections import Counter, defaultdict

import pytest

from tessella.llm import label_shards as ls


def shards_of(spark, rows, **how):
    docs = spark.createDataFrame([(k, t, 5, "x", 0) for k, t in rows], "doc_id long, text string, shard int, grp string, size int")
    got = ls.assign(docs, **how).collect()
    assert len(got) == len(rows)
    text = dict(rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) <= set(range(16))
    sizes = [counts.get(s, 0) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        t = text[r.doc_id]
        assert (r.size, r.text_crc32) == ((len(t.encode()) + 1, zlib.crc32(t.encode())) if t is not None else (1, 0))
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in got:
        if text[r.doc_id] is not None:
            where[text[r.doc_id]].add(r.shard)
    return where


def test_groups_come_together(spark):
    rows = [(k, f"text {k % 40}") for k in range(120)] + [(200 + k, f"single {k}") for k in range(700)]
    where = shards_of(spark, rows)
    split = sum(len(s) > 1 for s in where.values())
    assert split <= 4


def test_a_third_of_all_rows_is_one_text(spark):
    rows = [(k, "hot") for k in range(400)] + [(1000 + k, f"pair {k // 2}") for k in range(300)] + [(2000 + k, f"single {k}") for k in range(500)]
    where = shards_of(spark, rows)
    # 1200 rows are 75 a shard: the hot text needs 6 shards at least
    assert len(where["hot"]) <= 12
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") <= 20


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None), (2, None), (3, ""), (4, ""), (None, "x"), (5, "é" * 9000)], [(k, "same") for k in range(40)]])
def test_odd_tables(spark, rows):
    shards_of(spark, rows)


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(7, "a")] * 33, "doc_id long, text string")
    got = ls.assign(docs).collect()
    assert max(Counter(r.shard for r in got).values()) == 3
    assert len({(r.shard, r.slot) for r in got}) == 33


def test_plan_is_native(spark):
    plan = ls.assign(spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_few_edges_are_cut(spark):
    import random

    rng = random.Random(12)
    rows = [(k, f"text {rng.choice([rng.randrange(40), rng.randrange(4000), 5000 + k])}") for k in range(1600)]
    got = ls.assign(spark.createDataFrame(rows, "doc_id long, text string"), shards=4).collect()
    placed, sizes, groups = {r.doc_id: r.shard for r in got}, [0] * 4, {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    cut = lambda place: sum(place[a] != place[b] for g in groups.values() for i, a in enumerate(g) for b in g[:i])
    greedy = {}  # largest groups first, each to the emptiest shard, split only where it does not fit
    for g in sorted(groups.values(), key=len, reverse=True):
        for k in g:
            s = greedy[g[0]] if g[0] in greedy and sizes[greedy[g[0]]] < 400 else sizes.index(min(sizes))
            greedy[k] = s
            sizes[s] += 1
    links = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
    by_chance = cut({k: k % 4 for k, _ in rows})
    assert cut(greedy) <= cut(placed) <= cut(greedy) + 0.1 * links < by_chance
    assert sorted(list(placed.values()).count(s) for s in range(4)) == [400] * 4


def test_ranks_by_spans(spark, monkeypatch):
    monkeypatch.setattr(ls, "SPAN", 3)
    df = spark.range(2000).selectExpr("id AS doc_id", "xxhash64(id) AS spread", "0 AS crc", "1 AS size", "id % 3 AS shard")
    assert sorted(r["rank"] for r in ls.ranked(df, [], 40, "rank").collect()) == list(range(2000))
    got = {}
    for r in ls.ranked(df, ["shard"], 17, "rank").collect():
        got.setdefault(r.shard, []).append(r["rank"])
    assert {k: sorted(v) == list(range(len(v))) for k, v in got.items()} == {0: True, 1: True, 2: True}
