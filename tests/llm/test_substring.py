import random

from ledgerlens.llm import arrays, queries, substring
from ledgerlens.llm.substring import _cut_spans

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def brute(docs, window=20):
    """docs: [(id, text)] -> [(id, kept words, words, removed)], every window held against all places of it."""
    first, split = {}, [(i, (t or "").encode("utf-8").split()) for i, t in docs]
    rank = lambda i: (i is not None, i if i is not None else 0)
    for i, w in split:
        for s in range(len(w) - window + 1):
            k = tuple(w[s:s + window])
            first[k] = min(first.get(k, (rank(i), s)), (rank(i), s))
    out = []
    for i, w in split:
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] < (rank(i), s):
                gone.update(range(s, s + window))
        out.append((i, b" ".join(x for n, x in enumerate(w) if n not in gone).decode(), len(w), len(gone)))
    return out


def key(r):
    return (r[0] is not None, r[0] if r[0] is not None else 0, *r[1:])


def deduped(docs, **more):
    return sorted(((r.doc_id, r.text or "", r.n_words, r.n_removed) for r in substring.dedup(docs, **more).collect()), key=key)


def test_whole_table(spark):
    import hashlib
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, n, gone, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, gone in brute(docs))
    assert sorted(tuple(r) for r in queries.op12_substring(spark, SF).collect()) == want


def random_docs(rng, n=60):
    """Passages that begin and end anywhere, repeats inside a text, loops, edited copies."""
    words = ["a", "b", "c", "dd", "Ü", "0"]
    passages = [[rng.choice(words) for _ in range(rng.randrange(1, 40))] for _ in range(8)]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            w += p[rng.randrange(len(p)):] if rng.random() < 0.3 else p
            w += [rng.choice(words)] * rng.randrange(12)
        docs.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    return docs


def test_random_texts(spark):
    rng = random.Random(5)
    for window in (3, 7, 20):
        docs = random_docs(rng)
        df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
        assert deduped(df, window=window) == sorted(brute(docs, window), key=key)


def test_sets_too_large_for_a_bitmap(spark, monkeypatch):
    monkeypatch.setattr(arrays, "BITS_EACH", 1 << 40)
    docs = random_docs(random.Random(6), 40)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert deduped(df, window=6) == sorted(brute(docs, 6), key=key)


def test_odd_cases(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    odd = clashing(docs)
    for name in ("rest", "th", "starts", "windows", "checks", "done", "text_", "n_words", "n_removed", "gram", "sig", "at", "start"):
        odd = odd.withColumn(name, odd.lang)
    out = substring.dedup(odd, window=5)
    assert out.columns == [c for c in odd.columns if c not in ("n_words", "n_removed")] + ["n_words", "n_removed"]
    got = sorted(((r.doc_id, r.text or "", r.n_words, r.n_removed) for r in out.collect()), key=key)
    assert got == sorted(brute(rows, 5), key=key)
    assert {r.text for r in out.filter("doc_id = 3").collect()} == {None}
    assert {r.th for r in out.filter("doc_id = 8").collect()} == {"de"}
    assert substring.dedup(no_docs(spark)).count() == 0
    named = docs.withColumn("doc_id", docs.doc_id.cast("string"))
    assert substring.dedup(named, window=5).filter("n_removed > 0").count() > 0


def test_a_span_that_is_not_the_paths_words_stays():
    text = " ".join("abcdefgh")
    t = substring.Chains([text], 3)
    check = 0
    for d in t.digests(t.at, t.n).view("int64").tolist():
        check ^= d
    n = int(t.n.sum())
    own = [t.start[:1].tolist(), [n], [check]]
    assert list(_cut_spans([text, text], [own, [[0], [n], [check + 1]]], 3)) == [("", 8, 8), (text, 8, 0)]
