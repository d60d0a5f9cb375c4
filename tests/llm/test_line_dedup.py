import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import line_dedup as L
from ledgerlens.llm import queries

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.001"


def words(line):
    return line.lower().encode("utf-8", "replace").translate(L.SPACED).split()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def brute(docs, near=True):
    """docs: [(id, text)] with distinct ids. Text of each after dedup, all pairs of lines compared by edit
    similarity alone, and the pairs of near lines; without ``near`` only equal lines are alike."""
    nodes = {}
    for i, t in sorted(docs):
        for k, line in enumerate((t or "").split("\n")):
            w = words(line)
            if w:
                nodes.setdefault(tuple(w), (i, k))
    keys = sorted(nodes, key=len) if near else []
    root = {w: w for w in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v
    pairs = []
    bags = [Counter(w) for w in keys]
    for a in range(len(keys)):
        n = len(keys[a])
        for b in range(a - 1, -1, -1):
            if n - len(keys[b]) > n // 5:
                break
            if n - sum((bags[a] & bags[b]).values()) <= n // 5 and edits(keys[a], keys[b]) <= n // 5:
                pairs.append((keys[a], keys[b]))
                root[find(keys[a])] = find(keys[b])
    first = {}
    for w in nodes:
        g = find(w)
        first[g] = min(first.get(g, nodes[w]), nodes[w])
    keep = set(first.values())
    return {i: t if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if not words(line) or (i, k) in keep)
            for i, t in docs}, pairs


def kept_lines(texts):
    return {(i, w) for i, t in texts.items() for w in (tuple(words(line)) for line in (t or "").split("\n")) if w}


def assert_deduplicated(docs, got, least=0.9):
    """``got``: {id: text}. No line stays that has an equal one before it, none goes that brute force keeps, and of
    those that go for a near line alone at least this share goes."""
    want, exact = brute(docs)[0], brute(docs, near=False)[0]
    kept, must, may = kept_lines(got), kept_lines(want), kept_lines(exact)
    assert must <= kept <= may
    near = len(may) - len(must)
    assert len(may) - len(kept) >= least * near, (len(may) - len(kept), near)
    for i, t in docs:      # what has no word stays
        assert (t is None) == (got[i] is None) and [x for x in (t or "").split("\n") if not words(x)] == [
            x for x in (got[i] or "").split("\n") if not words(x)] or got[i] == ""


def test_recall_of_candidates_on_the_table(spark):
    """Pairs that meet in a block, of all pairs of edit similarity 0.8."""
    lines = {tuple(words(x)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() for x in (r.text or "").split("\n")}
    pairs = brute([(i, b" ".join(w).decode()) for i, w in enumerate(sorted(lines)) if w])[1]
    t = L.Lines([b"\n".join(b" ".join(w) for p in pairs for w in p).decode()])
    some = np.arange(2 * len(pairs))
    key, at, *_ = t.blocks(some)
    sim, keys = t.simhash(some), [set() for _ in some]
    for k, i in zip(key.tolist(), at.tolist()):
        keys[i].add(k)
    met = [bool(keys[i] & keys[i + 1]) and int(sim[i] ^ sim[i + 1]).bit_count() <= L.MAX_BITS for i in range(0, len(some), 2)]
    assert len(pairs) > 10 and np.mean(met) >= 0.9, (len(pairs), np.mean(met))


def test_whole_table(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: r for r in queries.op6_line_dedup(spark, SF).collect()}
    assert_deduplicated(docs, {i: r.text for i, r in got.items()})
    assert all(got[i].lines_removed == 0 for i, t in docs if got[i].text == t)


def test_simhash_by_vote():
    rng = np.random.default_rng(1)
    count = np.concatenate((rng.integers(1, 40, 200), [L.MANY, L.MANY + 1, 5000]))
    first = np.cumsum(count) - count
    h = rng.integers(0, 1 << 63, count.sum(), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    got = L.majority(h, first, count)
    for f, n, x in zip(first.tolist(), count.tolist(), got.tolist()):
        own = h[f:f + n].tolist()
        assert x == sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in own) > n)


def test_simhash_of_a_line_is_of_its_different_words():
    t = L.Lines(["a b b b c\nc b a\na b c d e f g"])
    got = t.simhash(np.arange(3)).tolist()
    first = [int(t.word[i]) for i in (0, 1, 4)]
    assert got[0] == got[1] == sum(1 << b for b in range(64) if 2 * sum(w >> b & 1 for w in first) > 3) != got[2]


def test_fuzzy_lines(spark):
    rng = random.Random(2)
    vocab = [f"word{i}" for i in range(500)]
    line = rng.choices(vocab, k=120)
    docs = []
    for i in range(40):
        copy = list(line)
        copy[rng.randrange(120)] = f"new{i}"
        docs.append((i, "\n".join([f"short {i}", " ".join(copy), " ".join(rng.choices(vocab, k=30))])))
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert_deduplicated(docs, got)
    assert sum(t.count("\n") == 1 for t in got.values()) > 10      # fuzzy copies were found


def test_lines_of_ordinary_length(spark):
    """Brute force by edit similarity alone: lines of 5 to 40 words, up to a fifth of them edited."""
    rng = random.Random(8)
    vocab = [f"longer{i}" for i in range(2000)] + ["a", "of", "the", "to"] * 50
    docs = []
    for i in range(150):
        line = rng.choices(vocab, k=rng.choice([5, 6, 9, 10, 14, 15, 25, 40]))
        copy = list(line)
        for p in sorted(rng.sample(range(len(line)), rng.randint(1, len(line) // 5)), reverse=True):
            copy[p:p + 1] = rng.choice([[], ["new%d" % rng.randrange(9)], [copy[p], rng.choice(vocab)]])
        docs += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(copy))]
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(brute(docs)[1]) > 100
    assert_deduplicated(docs, got)


@pytest.mark.parametrize("most_open", [L.OPEN_PAIRS, 10])
def test_a_block_that_many_lines_share(spark, monkeypatch, most_open):
    """Hundreds of unlike lines under common words, with near pairs among them."""
    monkeypatch.setattr(L, "OPEN_PAIRS", most_open)
    rng = random.Random(3)
    docs = []
    for i in range(300):
        line = ["of", "the", "to", "in", "and", "the"] + [f"w{rng.randrange(10 ** 6)}" for _ in range(rng.choice([4, 8, 14]))]
        rng.shuffle(line)
        docs.append((2 * i, " ".join(line)))
        line[rng.randrange(len(line))] = "other"
        docs.append((2 * i + 1, " ".join(line)))
    got = {r.doc_id: r.text for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert_deduplicated(docs, got)


def test_keys_of_two_parts_lose_no_pair(spark):
    """Lines with the same block and any fifth of their words edited share a key of two parts."""
    rng = random.Random(12)
    docs, pairs = [], []
    for i in range(60):
        line = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))]
        copy = list(line)
        for _ in range(rng.randint(1, len(line) // 5)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(9)}"
        docs += [(2 * i, " ".join(line)), (2 * i + 1, " ".join(copy))]
        pairs.append((tuple(words(docs[-2][1])), tuple(words(docs[-1][1]))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    df = df.withColumnRenamed("doc_id", "id").withColumn("th", F.xxhash64("text"))
    lines = L.lines_of(df)
    keys = L.shared_keys(lines)
    under, split = L.members_under(lines, keys).collect(), L.members_split(df, keys).collect()
    t = L.Lines(["\n".join(d for _, d in docs)])
    name = {tuple(words(d)): int(h) for (_, d), h in zip(docs, t.h.view(np.int64).tolist())}
    by = lambda rows: {h: {r.key for r in rows if r.h == h} for h in name.values()}
    blocks, parts = by(under), by(split)
    meet = [(a, b) for a, b in pairs if a != b and blocks[name[a]] & blocks[name[b]]]
    assert len(meet) > 30 and all(parts[name[a]] & parts[name[b]] for a, b in meet)


def test_short_lines_and_scripts_without_blanks(spark):
    long = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\u8dd1\u6b65"
    docs = [(1, f"Home\n}}\nShare this\none two three four\n{long}"),
            (2, f"home\n}}\nshare this!\none two three four five\n{long[:-1]}\u5427"), (3, "Home page\none two tree\none two three")]
    got = {r.doc_id: (r.text, r.lines_removed) for r in L.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (docs[0][1], 0), 2: ("}", 4), 3: (docs[2][1], 0)}


def test_similarity_matches_full_table():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcdef").encode() for _ in range(rng.randrange(0, 30))]
        b = list(a)
        for _ in range(rng.randrange(0, 6)):
            p = rng.randrange(len(b) + 1)
            b[p:p + rng.randrange(2)] = [rng.choice("abcdef").encode()] * rng.randrange(2)
        want = 1 - edits(a, b) / max(1, len(a), len(b))
        got = L.similarity(b" ".join(a), b" ".join(b))
        assert abs(got - (want if want >= L.MIN_SIMILARITY - 1e-12 else 0)) < 1e-9, (a, b)
    long = [b"w%d" % i for i in range(20_000)]
    other = [b"x" if i % 1000 == 5 else w for i, w in enumerate(long)]
    assert abs(L.similarity(b" ".join(long), b" ".join(other)) - 0.999) < 1e-9


def test_odd_cases(spark):
    docs = odd_docs(spark)
    odd = clashing(docs)
    for name in ("_ld", "_ld_id", "_ld_kept", "_ld_h", "th", "kept", "rest", "done", "lines_removed", "line", "sim"):
        odd = odd.withColumn(name, odd.lang)
    out = L.dedup(odd)
    assert out.columns == [c for c in odd.columns if c != "lines_removed"] + ["lines_removed"]
    rows = out.collect()
    assert len(rows) == docs.count() and {r._ld_kept for r in rows if r.doc_id == 8} == {"de"}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].text is None and by[4][0].text == "" and by[5][0].text == "  \n\t "
    assert by[8][0].lines_removed == 1 and by[8][0].text.count("line two") == 1
    fox = [r for r in rows if r.text and r.text.startswith("the quick")]
    assert [r.doc_id for r in fox] == [None]      # null comes first
    assert L.dedup(no_docs(spark)).count() == 0
    gone = L.dedup(docs, drop_emptied=True)
    assert 1 not in [r.doc_id for r in gone.collect()] and gone.count() == docs.count() - 3


class _Counted(np.ndarray):
    """Counts the array operations that it and what is made of it take part in."""
    steps = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kwargs):
        _Counted.steps += 1
        plain = [x.view(np.ndarray) if isinstance(x, _Counted) else x for x in inputs]
        if out is not None:
            kwargs["out"] = tuple(x.view(np.ndarray) if isinstance(x, _Counted) else x for x in out)
        made = getattr(ufunc, method)(*plain, **kwargs)
        return made.view(_Counted) if isinstance(made, np.ndarray) else made


def test_votes_take_few_steps_whatever_the_number_of_words():
    rng = np.random.default_rng(8)
    count = np.concatenate((np.arange(300), [511, 512, 600]))
    words = rng.integers(0, 1 << 63, int(count.sum()), dtype=np.uint64) * np.uint64(5)
    first = np.cumsum(count) - count
    _Counted.steps = 0
    got = L.majority(words.view(_Counted), first, count)
    assert _Counted.steps < 1000        # one word of every stretch after the other: over 2,000
    for f, n, value in zip(first.tolist(), count.tolist(), got.view(np.ndarray).tolist()):
        votes = [sum(int(w) >> b & 1 for w in words[f:f + n]) for b in range(64)]
        assert value == sum(1 << b for b in range(64) if 2 * votes[b] > n)


def test_keys_travel_in_few_rows_and_none_is_lost(spark, monkeypatch):
    """The keys of two different lines or more, as by grouping them; a task sends rows of many keys, and two lines at most of one."""
    monkeypatch.setattr(L, "KEYS_AT_ONCE", 500)
    monkeypatch.setattr(L, "LINES_A_PART", 50)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "text").withColumn("th", F.xxhash64("text"))
    lines = L.lines_of(docs)
    rows = [(h, k) for r in lines.select("h", "keys").collect() for h in [r.h] for k in np.frombuffer(r["keys"], dtype=np.int64).tolist()]
    of = {}
    for h, k in rows:
        of.setdefault(k, set()).add(h)
    keys = L.shared_keys(lines)
    got = [r.key for r in keys.collect()]
    assert len(got) == len(set(got)) and set(got) == {k for k, hs in of.items() if len(hs) > 1} and len(got) > 10
    under = {(r.key, r.h) for r in L.members_under(lines, keys).collect() if r.key in set(got)}
    assert under == {(k, h) for k in got for h in of[k]}
    key, low, high = L._extremes(np.array([5, -1, 5, 5], dtype=np.int64), np.array([2, 7, -3, 1], dtype=np.int64))
    assert (key.tolist(), low.tolist(), high.tolist()) == ([5, -1], [-3, 7], [2, 7])
    assert L.shared_keys(lines.limit(0)).count() == 0
