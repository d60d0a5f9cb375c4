import random

import numpy as np

from ledgerlens.llm import decontam, queries

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def naive(text, item, min_words=decontam.MIN_WORDS):
    """Longest run of at least ``min_words`` equal words anywhere."""
    a, b = decontam.words_of(text), decontam.words_of(item)
    need = min(min_words, len(b))
    runs = {tuple(b[i:i + need]) for i in range(len(b) - need + 1)} if b else set()
    return any(tuple(a[i:i + need]) in runs for i in range(len(a) - need + 1))


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id): r for r in queries.op4_decontamination(spark, SF).collect()}
    whole = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert whole and whole <= set(got)
    assert all(got[k].coverage == 1.0 for k in whole)
    texts, tests = {d.doc_id: d.text for d in docs}, {i.item_id: i.text for i in items}
    for (d, i), r in got.items():
        assert r.matched >= decontam.MIN_WORDS and r.identity >= decontam.MIN_IDENTITY
        words = decontam.words_of(texts[d])[r.first_word:r.end_word]
        assert sum(w in set(decontam.words_of(tests[i])) for w in words) >= r.matched


def test_runs_of_twelve_words_are_found(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(400)]
    items = [(k, " ".join(rng.choices(vocab, k=rng.choice([4, 8, 11, 12, 30, 60])))) for k in range(30)]
    docs = []
    for n in range(200):
        text = rng.choices(vocab, k=rng.choice([0, 5, 40, 200]))
        if n % 2:
            words = items[rng.randrange(30)][1].split()
            part = words if len(words) < 13 else words[(s := rng.randrange(len(words) - 11)):s + 12]
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        docs.append((n, " ".join(text)))
    index = decontam.Index(items)
    got = {(r[0], r[1]) for r in index.overlaps([t for _, t in docs])}
    for n, t in docs:
        for k, item in items:
            if naive(t, item, 12):
                assert (n, k) in got, (t, item)


def test_substitutions_are_tolerated():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(1000)]
    item = rng.choices(vocab, k=40)
    found = 0
    for n in range(100):
        copy = list(item)
        for p in rng.sample(range(40), 3):
            copy[p] = "other"
        text = " ".join(rng.choices(vocab, k=50) + copy + rng.choices(vocab, k=50))
        found += bool(decontam.Index([(7, " ".join(item))]).overlaps([text]))
    assert found == 100
    assert not decontam.Index([(7, " ".join(item))]).overlaps([" ".join(rng.sample(item, 40))] * 3)


def test_best_stretch_against_all_stretches():
    rng = random.Random(6)
    for n in range(200):
        same = np.array([rng.random() > rng.choice([0.1, 0.2, 0.25, 0.5]) for _ in range(rng.randrange(60))], dtype=bool)
        want = max((int(same[a:b].sum()) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                    if same[a:b].sum() >= 0.8 * (b - a) - 1e-9), default=0)
        got, a, b = decontam.best_stretch(same, 0.8)
        assert got == want == same[a:b].sum() and got >= 0.8 * (b - a) - 1e-9


def test_random_substitutions_and_runs_of_ten_words():
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    there = found = 0
    for n in range(600):
        item = rng.choices(vocab, k=rng.choice([11, 15, 60, 150]))
        rate = rng.choice([0.15, 0.2, 0.25])
        same = np.array([rng.random() > rate for _ in item])
        text = [w if s else "other" for w, s in zip(item, same)]
        hit = bool(decontam.Index([(1, " ".join(item))]).overlaps([" ".join(rng.choices(vocab, k=20) + text)]))
        if decontam.best_stretch(same, 0.8)[0] >= 10:
            there, found = there + 1, found + hit
        at = rng.randrange(len(item) - 9)
        run = rng.choices(vocab, k=20) + item[at:at + 10] + rng.choices(vocab, k=20)
        assert decontam.Index([(1, " ".join(item))]).overlaps([" ".join(run)])
    assert there > 200 and found >= 0.97 * there, (found, there)


def test_blocks_and_odd_cases(spark):
    docs = odd_docs(spark)
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and"), (2, None), (3, ""), (None, "line two has five words"),
                                   (4, "quick brown fox jumps over the lazy dog again and")], "item_id long, text string")
    one = decontam.overlaps(clashing(docs), clashing(bench)).collect()
    many = decontam.overlaps(docs, bench, block_chars=20).collect()
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(one, key=key) == sorted(many, key=key)
    assert sorted({r.doc_id for r in one}, key=lambda x: (x is None, x or 0)) == [1, 2, 8, None]
    left = decontam.clean(docs, bench)
    assert sorted((r.doc_id for r in left.collect()), key=lambda x: (x is None, x or 0)) == [3, 4, 5, 6, 7, None]
    assert left.columns == docs.columns
    assert decontam.overlaps(no_docs(spark), bench).count() == 0
    assert decontam.overlaps(docs, bench.limit(0)).count() == 0
    assert decontam.clean(docs, bench.limit(0)).count() == docs.count()
