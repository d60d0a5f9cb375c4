import random

import numpy as np
import pytest

from ledgerlens.llm import langid, queries

from .cases import clashing, no_docs, odd_docs

SF = "/root/testdata/sf0.01"


def brute_phrases(text, sample):
    """(phrases, symbols the sample lacks): longest match of the rest of each window with the sample, one after the other."""
    count = lacking = 0
    for w in range(0, len(text), langid.WINDOW):
        rest = text[w:w + langid.WINDOW]
        while len(rest):
            n = 1
            while n < len(rest) and rest[:n + 1] in sample:
                n += 1
            count, lacking = count + 1, lacking + (rest[0] not in sample)
            rest = rest[n:]
    return count, lacking


@pytest.mark.parametrize("table", [langid.TABLE, 0])
def test_phrases_match_brute_force(monkeypatch, table):
    monkeypatch.setattr(langid, "TABLE", table)
    langid.Model._built.clear()
    rng = random.Random(1)
    pieces = {"a": ["abracadabra abba cab dab grab " * 3], "b": ["this is other text, with words of its own " * 2],
              "c": ["\u4e00\u4e01\u4e03 \u4e08\u4e09\u4e0a" * 3], "none": ["12 34 !"]}
    model = langid.Model(pieces)
    alphabet, parsers, phrase, letter = model.automata()
    assert list(model.samples) == ["a", "b", "c"]
    texts = ["abra cadabra", "this word", "zzz", "", "a", "x" * 600, "abba " * 200, "\u4e00\u4e01 abba \u4e0b",
             "".join(rng.choice("abcdr histowr.,\u4e08") for _ in range(2000))]
    bits, n = model.bits(texts)
    text = lambda s: "".join(map(chr, s.tolist()))
    for i, t in enumerate(texts):
        symbols = alphabet.symbols(t)
        assert n[i] == len(symbols)
        for j, lang in enumerate(model.samples):
            count, lacking = brute_phrases(text(symbols), "".join(text(alphabet.symbols(p)) for p in pieces[lang]))
            assert np.isclose(bits[i, j], (count * phrase + lacking * letter) / max(1, len(symbols))), (t, lang)
    langid.Model._built.clear()


def test_a_language_without_letters_takes_no_text(spark):
    """One more label whose texts hold no letter, and one of a single short text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").limit(600).collect()
    rows = [tuple(r) for r in docs] + [(10 ** 6 + i, "12 345 -- !", "numbers") for i in range(40)] + [(2 * 10 ** 6 + i, "ok", "tiny") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.Model(langid.sample_texts(langid.learnable(df)))
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert {got[10 ** 6 + i] for i in range(40)} == {"und"}
    assert np.mean([got[r.doc_id] == r.lang for r in docs if r.text and len(r.text) > 20]) > 0.98


def test_many_letters_of_their_own(spark):
    """Four scripts of 3,000 letters each, of which any text uses few."""
    rng = random.Random(5)
    rows = []
    for k in range(4):
        letters = [chr(c) for c in range(0x4e00 + 3000 * k, 0x4e00 + 3000 * (k + 1))]
        rows += [(1000 * k + i, " ".join("".join(rng.choices(letters, k=6)) for _ in range(40)), f"script{k}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.Model(langid.sample_texts(langid.learnable(df)))
    assert len(model.letters) > 9000
    got = langid.identify(df, model).collect()
    assert all(r.lang_pred == r.lang for r in got)


def test_held_out_accuracy(spark):
    lang = {d.doc_id: d.lang for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_language(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    held = [r for r in rows if r.held_out]
    assert len(held) > 100 and np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_cases(spark):
    docs = odd_docs(spark)
    model = langid.Model(langid.sample_texts(langid.learnable(clashing(docs))))
    rows = langid.identify(clashing(docs), model).collect()
    assert len(rows) == docs.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 7)} == {"und"}
    assert langid.identify(no_docs(spark), model).count() == 0
    nothing = langid.Model(langid.sample_texts(langid.learnable(no_docs(spark))))
    assert {(r.lang_pred, r.lang_score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
