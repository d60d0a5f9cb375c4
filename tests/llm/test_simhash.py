import random

import numpy as np
import xxhash

from ledgerlens.llm import queries, simhash
from ledgerlens.llm.components import connected_components, joined_components

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(nodes, near):
    """Smallest id reachable; nodes: {id: value}."""
    root = {i: i for i in nodes}

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v
    ids = sorted(nodes)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if near(nodes[i], nodes[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table(spark):
    prints = {d.doc_id: fingerprint(d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    rows = queries.op10_simhash(spark, SF).collect()
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == want


def test_pairs_lose_no_link(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = set(base)
    for b in base:
        for _ in range(40):
            x = b
            for p in rng.sample(range(64), rng.randrange(1, 7)):
                x ^= 1 << p
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, simhash._signed(x)) for i, x in enumerate(fps)], "rep long, fp long")
    got = sorted(tuple(sorted((r.u, r.v))) for r in simhash.linked_pairs(df, 4).distinct().collect())
    a = np.array(fps, dtype=np.uint64)
    want = sorted((i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 4).tolist() if i < j)
    assert got == want


def test_odd_cases(spark):
    docs = odd_docs(spark)
    rows = simhash.near_duplicates(clashing(docs)).collect()
    assert len(rows) == docs.count()
    got = {(r.doc_id, r.fp != 0): r.component for r in rows}
    assert got[(1, True)] == got[(2, True)] == got[(None, True)] == 1
    assert got[(3, False)] == got[(4, False)] == got[(5, False)] == got[(None, False)] == 3
    assert got[(6, True)] == 6
    assert simhash.near_duplicates(no_docs(spark)).count() == 0
    alone = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert [r.component for r in simhash.near_duplicates(alone).collect()] == [None]


def test_links_through_a_row_without_an_id(spark):
    """Three texts, the middle one without an id and near both others."""
    rng = random.Random(1)
    words, found = [f"w{i}" for i in range(60)], None
    base = " ".join(rng.choices(words, k=400))
    for _ in range(4000):
        a, b = base.split(), base.split()
        a[rng.randrange(200)] = rng.choice(words)
        b[200 + rng.randrange(200)] = rng.choice(words)
        p, q, r = (fingerprint(x) for x in (" ".join(a), base, " ".join(b)))
        if 0 < (p ^ q).bit_count() <= 4 and 0 < (q ^ r).bit_count() <= 4 < (p ^ r).bit_count():
            found = " ".join(a), " ".join(b)
            break
    docs = spark.createDataFrame([(1, found[0]), (None, base), (2, found[1])], "doc_id long, text string")
    assert sorted(r.component for r in simhash.near_duplicates(docs).collect()) == [1, 1, 1]
    assert [r.doc_id for r in simhash.one_of_each_group(docs).collect()] == [1]


def test_one_of_each_group(spark):
    docs = odd_docs(spark)
    odd = clashing(docs)
    for name in ("row", "place", "fp", "group", "first", "_n", "none"):
        odd = odd.withColumn(name, odd.lang)
    out = simhash.one_of_each_group(odd)
    assert out.columns == odd.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 6, 7, 8]
    assert simhash.one_of_each_group(no_docs(spark)).count() == 0
    same_id = spark.createDataFrame([(5, "one text of a few words here"), (5, "and quite another one of the same id"), (None, "no id at all but words"),
                                     (None, "no id at all but words")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each_group(same_id).collect()) == sorted({r.text for r in same_id.collect()})


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 7), (None, 1), (1, None)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 500 for i in range(501, 700)}}


def test_more_edges_join_components(spark):
    rng = random.Random(4)
    nodes = list(range(60))
    edges = [tuple(rng.sample(nodes, 2)) for _ in range(25)]
    more = [tuple(rng.sample(nodes, 2)) for _ in range(12)] + [(200, 201), (5, 202)]
    df = lambda e: spark.createDataFrame(e, "u long, v long")
    found = connected_components(df(edges))
    want = {r.node: r.component for r in connected_components(df(edges + more)).collect()}
    assert {r.node: r.component for r in joined_components(found, df(more)).collect()} == want
    assert joined_components(found, df(more).limit(0)).collect() == found.collect()


def test_components_end_with_the_round_that_leaves_stars(spark, monkeypatch):
    from ledgerlens.llm import components
    rounds, plain = [], components._large_star
    monkeypatch.setattr(components, "_large_star", lambda e: rounds.append(1) or plain(e))
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40, 2)] + [(100, 101), (100, 102), (101, 102)], "u long, v long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i + 1: i for i in range(0, 40, 2)} | {101: 100, 102: 100}
    assert len(rounds) == 1
