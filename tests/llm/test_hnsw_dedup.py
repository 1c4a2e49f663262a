import numpy as np

from tessella.llm import hnsw_dedup as hd


def brute(rows):
    ok = {}
    for k, v, label in rows:
        if label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            ok[k] = x / np.sqrt((x * x).sum()), label
    links = {k: set() for k, _, _ in rows}
    keys = sorted(ok)
    for a in keys:
        for b in keys:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= hd.THRESHOLD:
                links[a].add(b)
                links[b].add(a)
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[k] = len(links[k]), min(seen), k == min(seen)
    return out


def rows_of(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    while len(rows) < n:
        base = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 6))):
            noise = rng.choice([0, 0.05, 0.12, 0.2, 0.25])
            rows.append((len(rows), (base + noise * rng.normal(size=dim)).astype(np.float32).tolist(), int(rng.integers(0, 3) == 0)))
    return rows


def run(spark, rows, **how):
    df = spark.createDataFrame([(k, v, y, 1, "a") for k, v, y in rows], "vec_id long, embedding array<float>, label int, id int, shard string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in hd.dedup(df, **how).collect()}


def test_shards_and_odd_rows(spark):
    rows = rows_of(400, 16)
    rows += [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [1.0] * 15 + [float("nan")], 1), (1003, [1.0, None] * 8, 1), (1004, [1.0] * 16, None), (1005, [1.0] * 16, None), (1006, [], 0), (1007, [1.0] * 8, 0), (1008, [1.0] * 16, 0), (1009, [2.0] * 16, 0), (1010, [float("inf")] * 16, 0)]
    rows += [(2000 + i, rows[7][1], rows[7][2]) for i in range(40)]
    assert run(spark, rows, shard_rows=60) == brute(rows)


def test_recall_of_a_large_shard():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1200, 64))
    x = np.concatenate([base, base[:600] + 0.1 * rng.normal(size=(600, 64)), base[:1] + 0.05 * rng.normal(size=(200, 64))])
    graph = hd.Graph(x, 5)
    stats = {}
    a, b = hd.hits(graph, graph.u, 1, stats)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    p, q = np.nonzero(graph.u @ graph.u.T >= np.float32(hd.THRESHOLD - hd.SLACK))
    true = set(zip(p.tolist(), q.tolist(), strict=True))
    assert found <= true and len(found) >= 0.97 * len(true), (len(found), len(true), stats)


def test_empty_table(spark):
    assert run(spark, []) == {}


def test_rows_without_a_key(spark):
    v = [1.0, 2.0, 3.0]
    df = spark.createDataFrame([(None, v, 1), (None, v, 1), (3, v, 1), (4, v, 1)], "vec_id long, embedding array<float>, label int")
    got = sorted((tuple(r) for r in hd.dedup(df).collect()), key=str)
    assert got == sorted([(None, 0, None, True), (None, 0, None, True), (3, 1, 3, True), (4, 1, 3, False)], key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_pooled_audit_counts_the_links_of_all_shards(spark):
    rows = list({(tuple(v), y): (k, v, y) for k, v, y in rows_of(300, 16, seed=8)}.values())  # audits are by different vectors
    links = brute(rows)
    got = {r.label: (r.beam, r.got, r.n) for r in hd.audits(frame(spark, rows), shard_rows=40).collect()}
    for label in (0, 1):  # labels this small are audited whole
        n = sum(links[k][0] for k, _, own in rows if own == label) // 2
        assert n > 0 and got[str(label)] == (hd.BEAM, n, n)


def test_labels_that_fail_the_audit_are_searched_again(spark):
    rows = rows_of(300, 16, seed=8)
    _, _, graphs = hd.prepared(frame(spark, rows), "vec_id", "embedding", "label", 40)

    def loses_label_1(batches, first=hd.BEAM):
        import pyarrow as pa
        import pyarrow.compute as pc

        from tessella.llm import hnsw_dedup

        for batch in batches:
            beam = batch.column("beam")[0].as_py() if batch.num_rows else 0
            for out in hnsw_dedup._compare(iter([batch])):
                if beam == first and out.column("label")[0].as_py() == "1":
                    out = out.filter(pc.is_null(out.column("id")))  # the audit stays, and says that nothing was found
                    out = out.set_column(5, "got", pa.array([0] * out.num_rows, pa.int64()))
                yield out

    found, audits = hd.searched(graphs, loses_label_1)
    assert {r.label: r.beam for r in audits.collect()} == {"0": hd.BEAM, "1": 2 * hd.BEAM}
    whole, _ = hd.searched(graphs)
    assert sorted(map(str, found.collect())) == sorted(map(str, whole.collect()))


def test_empty_audit(spark):
    assert hd.audits(frame(spark, [])).collect() == []
