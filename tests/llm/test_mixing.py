from collections import defaultdict

import pytest

from ledgerlens.llm import mixing, queries

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def water_fill(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target = {s: 0.0 for s in names}
    left, open_ = share * sum(sizes.values()), set(names)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


def check(rows, docs):
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += len((d.text or "").encode().split())
    want = water_fill(dict(sizes))
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        if r.size:
            largest[r.source] = min(largest[r.source] or r.size, r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 2 * largest[s] + 1), (s, taken[s], want[s])


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {d.doc_id: d.source for d in docs}
    rows = queries.op1_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(source)
    check([type("R", (), {**r.asDict(), "source": source[r.doc_id]}) for r in rows], docs)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op1_mixing(spark, SF).collect()))


def test_odd_cases(spark):
    docs = odd_docs(spark)
    rows = mixing.mix(clashing(docs)).collect()
    assert len(rows) == docs.count()
    check(rows, docs.collect())
    assert all(r.taken == 0 for r in rows if r.size == 0)


def test_empty_and_wordless(spark):
    assert mixing.mix(no_docs(spark)).count() == 0
    rows = mixing.mix(spark.createDataFrame([(1, " ", "a"), (2, None, None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in rows] == [(0.0, 0)] * 2


def test_one_size_is_dealt_evenly(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 3 else "t") for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    check(rows, docs.collect())
