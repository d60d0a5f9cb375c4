"""Few-shot overlap: a task's memory does not go with the matches of its batch."""
import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerlens.operators import overlap


def _batch(rows):
    return pa.RecordBatch.from_pydict({"e_id": pa.array([i for i, _ in rows], pa.int64()), "tokens": pa.array([t for _, t in rows], pa.list_(pa.string()))})


def test_matches_are_scored_in_bounded_groups():
    words, n_questions = [f"w{i}" for i in range(60)], 100
    block = ({w: i for i, w in enumerate(words)}, np.arange(61, dtype=np.int64) * n_questions,
             np.tile(np.arange(n_questions, dtype=np.int64), 60), np.arange(n_questions, dtype=np.int64) + 7)
    rows = [(i, words[:1 + i % 60]) for i in range(3_000)]          # 9 million matches
    tracemalloc.start()
    out = pa.Table.from_batches(overlap._running_best(block, 2)(iter([_batch(rows)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert sorted(zip(*out.to_pydict().values())) == [(q + 7, e, 60) for q in range(n_questions) for e in (59, 119)]


def test_groups_give_the_same_rows(spark, monkeypatch):
    q = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 40}" for j in range(i % 9))) for i in range(30)], "q long, t string")
    e = spark.createDataFrame([(i, None if i % 11 == 0 else " ".join(f"w{(i * 3 + j) % 50}" for j in range(i % 13))) for i in range(200)], "e long, t string")
    want = {}
    for i, t in q.collect():
        every = sorted((-len(set(t.split()) & set(u.split())), k) for k, u in e.collect() if u is not None)
        want |= {(i, r): (k, -s) for r, (s, k) in enumerate(every[:2], 1) if s < 0}
    for at_once, matches in ((250, 1_000_000), (7, 5), (1, 1)):
        monkeypatch.setattr(overlap, "AT_ONCE", at_once)
        monkeypatch.setattr(overlap, "MATCHES", matches)
        got = {(r.question_id, r["rank"]): (r.example_id, r.score) for r in overlap.overlap_top_k(q, e, "q", "t", "e", "t").collect()}
        assert got == want
