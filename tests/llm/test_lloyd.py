import hashlib
import math

from ledgerlens.llm import lloyd, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=8, rounds=10, dims=64, scale=1024, seed=3):
    """rows: [(id, vector)] -> [(id, cluster, distance, cluster inertia, inertia, hash)], in Python's integers."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    x = [[math.floor(scale * c) for c in v] for _, v in kept]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, hashlib.sha256(f"{seed}:{kept[r][0]}".encode()).hexdigest()
                                                    if kept[r][0] is not None else "", kept[r][1]))
    centroids = [x[r] for r in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        who = [nearest(v)[1] for v in x]
        for j in range(len(centroids)):
            own = [v for v, w in zip(x, who) if w == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    last = [nearest(v) for v in x]
    inertia = [sum(d for d, w in last if w == j) for j in range(len(centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, w, d, inertia[w], sum(inertia), names[w]) for (i, _), (d, w) in zip(kept, last)]


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def clustered(df, **more):
    return sorted((tuple(r) for r in lloyd.cluster(df, **more).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=key)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op13_lloyd(spark, sf).collect())
    assert got == sorted(brute(rows))


def test_odd_cases(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "WIDTH", 2)
    monkeypatch.setattr(lloyd, "CHUNK", 3)
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (2, [0.5, -0.25, 1.0]), (2, [9.0, 9.5, -9.0]), (None, [1.5, 1.0, 1.0]),
            (None, [0.001, -0.001, 0.0]), (3, [nan, 1.0, 1.0]), (4, [inf, 1.0, 1.0]), (5, [-inf, 0.0, 0.0]), (6, None), (7, []), (8, [1.0, 2.0]),
            (9, [1.0, 2.0, None]), (10, [-1.0, -1.0, -1.0]), (11, [-1.0, -1.1, -1.0]), (12, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    for name in ("chunk", "place", "block", "cluster", "distance", "id", "vector", "data"):
        df = df.withColumn(name, df.label)
    for k in (1, 3, 8, 40):
        assert clustered(df, k=k, rounds=3, dims=3) == sorted(brute(rows, k, 3, 3), key=key)
    assert lloyd.cluster(spark.createDataFrame([], SCHEMA)).count() == 0
    assert clustered(df, dims=7) == []


def test_components_beyond_a_long(spark, monkeypatch):
    monkeypatch.setattr(lloyd, "WIDTH", 2)
    rows = [(i, [1e30 * (i % 3), 5.0 * i, -1e18 if i % 2 else 3.5]) for i in range(12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA)
    want = [(i, w, d if d < 2 ** 63 else None, c if c < 2 ** 63 else None, t if t < 2 ** 63 else None, h)
            for i, w, d, c, t, h in brute(rows, 4, 4, 3)]
    assert clustered(df, k=4, rounds=4, dims=3) == sorted(want, key=key)


def test_slices_by_a_shuffle_are_the_same(spark, monkeypatch):
    rows = [(i, [math.sin(i * j) for j in range(6)]) for i in range(60)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).repartition(4)
    monkeypatch.setattr(lloyd, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lloyd, "WIDTH", 4)
    assert clustered(df, k=5, rounds=4, dims=6) == sorted(brute(rows, 5, 4, 6))
