import re
from collections import Counter, defaultdict

import numpy as np

from ledgerlens.llm import divergence as D

from .cases import clashing, no_docs, odd_docs

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, min_docs=3, top=200):
    """docs: [(lang, source, text)]. All rows, in Python's integers."""
    df, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    kept = {lang: [t for t, n in c.items() if n >= min_docs] for lang, c in df.items()}
    out = []

    def share(c, lang, total):
        return 1 + 10 ** 9 * (c + 1) // (total + len(kept.get(lang, [])))
    for lang, source in groups:
        terms = kept.get(lang, [])
        sources = [s for g, s in groups if g == lang]
        n = {s: sum(counts[lang, s][t] for t in terms) for s in sources}
        p = {s: {t: share(counts[lang, s][t], lang, n[s]) for t in terms} for s in sources}
        pairs = [(-sum((p[source][t] - p[s][t]) ** 2 // p[s][t] for t in terms), s.encode(), s) for s in sources if s != source]
        words = []
        for t in terms:
            a, q = p[source][t], share(sum(counts[lang, s][t] for s in sources), lang, sum(n.values()))
            if counts[lang, source][t] and a > q:
                words.append((-((a - q) ** 2 // q), t.encode(), t))
        for part, rows in (("pair", sorted(pairs)), ("term", sorted(words)[:top])):
            out += [(lang, source, part, name, -v, r) for r, (v, _, name) in enumerate(rows, 1)]
    return sorted(out)


def audited(docs, **more):
    return sorted(tuple(r) for r in D.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_odd_cases(spark):
    docs = odd_docs(spark)
    rows = [(r.lang, r.source, r.text) for r in docs.collect()]
    for n in (1, 2, 3):
        got = audited(clashing(docs).withColumn("term", docs.lang).withColumn("df", docs.doc_id), min_docs=n)
        assert got == brute(rows, n)
    assert audited(no_docs(spark)) == []
    bare = spark.createDataFrame([("1 2", "x", "a"), ("3", "x", "b"), (None, None, None)], "text string, lang string, source string")
    assert audited(bare) == [("x", "a", "pair", "b", 0, 1), ("x", "b", "pair", "a", 0, 1)]


def test_spills_blocks_and_pieces_change_nothing(spark, monkeypatch):
    docs = [("en", f"s{i % 7}", " ".join(f"w{chr(97 + (i * j) % 23)}É{chr(65 + j % 5)}" for j in range(i % 40))) for i in range(200)]
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(5)
    want = brute(docs, top=4)
    monkeypatch.setattr(D, "STRIPE_ENTRIES", 10)
    monkeypatch.setattr(D, "PIECE", 50)
    monkeypatch.setattr(D, "BLOCK", 3)
    monkeypatch.setattr(D, "TERMS_AT_ONCE", 4)
    assert audited(df, top=4) == want


def test_a_term_cut_in_no_piece(monkeypatch):
    monkeypatch.setattr(D, "PIECE", 5)
    text = "aé" * 30 + " b cc ddd " + "x" * 11 + "9yy"
    assert [t for piece in D.pieces_of(text) for t in piece] == [("aé" * 30).encode(), b"b", b"cc", b"ddd", b"x" * 11, b"yy"]


def test_shares_are_exact():
    rng = np.random.default_rng(3)
    total = rng.integers(1, 10 ** 14, 2000)
    count = (total * rng.random(2000)).astype(np.int64).clip(0, total - 1)
    assert D.share(count, total).tolist() == [1 + 10 ** 9 * (c + 1) // n for c, n in zip(count.tolist(), total.tolist())]
