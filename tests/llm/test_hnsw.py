import numpy as np

from ledgerlens.llm import hnsw

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.93):
    links, comp = {}, {}
    ids = [r[0] for r in rows]
    good = [i for i, (v, e, lab) in enumerate(rows) if lab is not None and v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    x = {i: np.array(rows[i][1], dtype=np.float64) for i in good}
    for i in good:
        x[i] = x[i] / np.abs(x[i]).max()
        x[i] = x[i] / np.linalg.norm(x[i])
    near = {i: [j for j in good if j != i and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold] for i in good}
    comp = {v: v for v in ids}
    while True:
        before = dict(comp)
        for i in good:
            for j in near[i]:
                comp[ids[i]] = min(comp[ids[i]], comp[ids[j]])
        if comp == before:
            return [(ids[i], len(near.get(i, [])), comp[ids[i]]) for i in range(len(rows))]


def clustered(rng, n, labels, spread=0.05):
    rows, centres = [], rng.normal(size=(12, 24))
    for i in range(n):
        v = centres[rng.integers(12)] + spread * rng.normal(size=24) * rng.choice([1, 1, 3, 8]) if i % 2 else rng.normal(size=24)
        rows.append((int(i * 3 + 1), [float(a) for a in v.astype(np.float32)], int(rng.integers(labels))))
    return rows


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_matches_brute_force_over_several_shards(spark):
    rows = clustered(np.random.default_rng(5), 700, 2)
    got = hnsw.near_duplicates(spark.createDataFrame(rows, SCHEMA), shard=100).collect()
    want = brute(rows)
    links, found = sum(w[1] for w in want), sum(r.n_links for r in got)
    assert 0.995 * links <= found <= links and links > 1000
    assert sorted((r.vec_id, r.component) for r in got) == sorted((w[0], w[2]) for w in want)


def test_graph_reaches_every_node():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(100, 16)), 5 + 0.01 * rng.normal(size=(60, 16)), -9 + 0.01 * rng.normal(size=(3, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x, np.zeros(len(x), dtype=np.int64))
    seen = np.isfinite(g.search(x[:1].astype(np.float32), len(x), 0.9))
    assert seen.all()


def test_odd_cases(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, v, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 2.0], 1),
            (8, [float("nan"), 0.0, 2.0], 1), (9, [float("inf"), 0.0, 2.0], 1), (None, v, 1), (10, v, 2), (11, [2.0, 0.0], 1),
            (12, [3e38, 0.0, 3e38], 1), (13, [1e-40, 0.0, 2e-40], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", hnsw.F.lit(1)).withColumn("shard", hnsw.F.lit(1))
    got = sorted(((r.vec_id, r.n_links, r.component) for r in hnsw.near_duplicates(df).collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert hnsw.near_duplicates(df.limit(0)).count() == 0
