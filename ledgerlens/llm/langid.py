"""Language identification by cross-parsing entropy.

Per language a suffix automaton of sampled labelled text. A text is parsed
against it into phrases, each the longest match with the sample from where the
last one ended; coding a phrase costs log2(sample length) bits, with the longest
sample's length for all languages, so that a small sample is no cheaper, and a letter that the
sample lacks costs one of the whole alphabet more. The language whose sample
needs the fewest bits a symbol wins. A language without a letter in its sample takes no part.

Parsing goes window by window (``WINDOW`` symbols, each starting a new phrase):
all windows of a batch step through the automaton together as one array, so a
text of any length costs the same per symbol and is parsed whole.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, renamed, small_batches, top_by_hash

WINDOW = 256
#: Symbols parsed at once in a task.
SYMBOLS_AT_ONCE = 2_000_000
#: Bounds of the training sample of each language: documents, and symbols in all.
SAMPLE_DOCS = 200
SAMPLE_SYMBOLS = 30_000
UNKNOWN = "und"
#: Entries of a transition table; an automaton that needs more (a script of very many letters) keeps its transitions sorted.
TABLE = 16_000_000


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, dtype=bool)
    table[:0x30000] = [chr(c).isalpha() for c in range(0x30000)]
    return table


class Alphabet:
    """Lower-case letters to symbols: 0 is any run of other characters, the last one any letter of no sample."""

    def __init__(self, letters: str):
        self.size = len(letters) + 2
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.table = np.where(_letters(), self.size - 1, 0).astype(self.kind)
        self.table[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1, dtype=self.kind)

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of the text with one 0 around each run of letters."""
        code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        s = self.table[np.minimum(code, 0x10FFFF)]
        if not s.any():
            return s[:0]
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton; state 0 is the start."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[cur] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        last = cur
    return nxt


class Parser:
    """The automaton of one sample over the letters it has: as a table where these are few, else as sorted transitions."""

    def __init__(self, symbols: np.ndarray, size: int):
        own = np.unique(symbols)
        self.k = len(own) + 1                                   # the last one: a symbol the sample lacks
        self.local = np.full(size, len(own), dtype=np.uint16 if self.k <= 1 << 16 else np.uint32)
        self.local[own] = np.arange(len(own))
        nxt = suffix_automaton(self.local[symbols].tolist())
        at = np.array([s * self.k + c for s, t in enumerate(nxt) for c in t], dtype=np.int64)
        to = np.array([n for t in nxt for n in t.values()], dtype=np.int32)
        if len(nxt) * self.k <= TABLE:
            self.table = np.zeros(len(nxt) * self.k, dtype=np.uint16 if len(nxt) < 1 << 16 else np.int32)
            self.table[at] = to
            self.at = None
        else:
            order = np.argsort(at)
            self.at, self.to = np.append(at[order], np.int64(1) << 62), np.append(to[order], np.int32(0))

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next states; 0 for none."""
        key = state.astype(np.int64) * self.k + c
        if self.at is None:
            return self.table[key]
        place = np.searchsorted(self.at, key)
        return np.where(self.at[place] == key, self.to[place], 0)

    def count(self, columns: np.ndarray, active: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases, and letters the sample lacks, of each window. ``columns``: [step, window] symbols, windows by
        falling length; ``active``: how many windows reach each step."""
        n = columns.shape[1]
        state, count, lacking = (np.zeros(n, dtype=np.int32) for _ in range(3))
        for t, m in enumerate(active):
            c = self.local[columns[t, :m]]
            s = state[:m]
            to = self.step(s, c)
            at = np.flatnonzero(to == 0)
            if len(at):
                count[at] += s[at] != 0          # the phrase so far ends here
                again = self.step(np.zeros(len(at), dtype=np.int32), c[at])      # and the next one starts with this symbol
                count[at] += again == 0          # a symbol the sample lacks is a phrase by itself
                lacking[at] += again == 0
                to[at] = again
            state[:m] = to
        return count + (state != 0), lacking


class Model:
    """Samples of each language; automata are built once per Python process, where they are used."""

    _built: dict[int, tuple] = {}

    def __init__(self, samples: dict[str, list[str]]):
        letter = _letters()
        has = {lang: {c for p in pieces for c in p.lower() if letter[ord(c)]} for lang, pieces in samples.items()}
        self.samples = {lang: samples[lang] for lang in sorted(samples) if has[lang]}
        self.letters = "".join(sorted(set().union(*has.values())))
        self.key = hash((self.letters, tuple((a, tuple(b)) for a, b in self.samples.items())))

    def automata(self) -> tuple[Alphabet, list[Parser], float, float]:
        """Alphabet, a parser for each language, bits of a phrase, and of a letter that a sample lacks beside it."""
        if self.key not in Model._built:
            Model._built.clear()
            alphabet = Alphabet(self.letters)
            symbols = [np.concatenate([alphabet.symbols(p) for p in pieces])[:SAMPLE_SYMBOLS] for pieces in self.samples.values()]
            parsers = [Parser(s, alphabet.size) for s in symbols]
            Model._built[self.key] = alphabet, parsers, math.log2(max([len(s) for s in symbols], default=0) + 2), math.log2(alphabet.size)
        return Model._built[self.key]

    def bits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """([text, language] bits a symbol, symbols of each text; 0 symbols: no letter)."""
        alphabet, parsers, phrase, letter = self.automata()
        syms = [alphabet.symbols(t) if t else np.zeros(0, alphabet.kind) for t in texts]
        lengths = np.array([len(s) for s in syms], dtype=np.int64)
        cost = np.zeros((len(texts), len(parsers)))
        windows = (lengths + WINDOW - 1) // WINDOW
        owner = np.repeat(np.arange(len(texts)), windows)
        if len(owner):
            rank = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            size = np.minimum(WINDOW, lengths[owner] - rank * WINDOW)
            flat = np.concatenate(syms)
            start = np.repeat(np.cumsum(lengths) - lengths, windows) + rank * WINDOW
            order = np.argsort(-size, kind="stable")
            size, start, owner = size[order], start[order], owner[order]
            padded = np.concatenate([flat, np.zeros(WINDOW, alphabet.kind)])
            columns = np.ascontiguousarray(padded[start[None, :] + np.arange(WINDOW)[:, None]])
            active = [int(x) for x in len(size) - np.searchsorted(size[::-1], np.arange(int(size[0])), side="right")]
            for j, parser in enumerate(parsers):
                phrases, lacking = parser.count(columns, active)
                cost[:, j] = np.bincount(owner, phrases * phrase + lacking * letter, len(texts))
        return cost / np.maximum(lengths, 1)[:, None], lengths

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; ties go to the first language by name."""
        langs = list(self.samples)
        out, scores = [], np.zeros(len(texts))
        group, room = [], 0
        marks = []
        for i, t in enumerate(texts):
            group.append(i)
            room += len(t) if t else 0
            if room >= SYMBOLS_AT_ONCE or i + 1 == len(texts):
                marks.append(group)
                group, room = [], 0
        for g in marks:
            part = [texts[i] for i in g]
            if not langs:
                out += [UNKNOWN] * len(g)
                continue
            bits, n = self.bits(part)
            best = bits.argmin(axis=1)
            # coding the text with each sample, as odds; long texts stay below certainty
            odds = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * np.minimum(n, 64)[:, None] / 4)
            conf = 1.0 / odds.sum(axis=1)
            out += [langs[b] if m else UNKNOWN for b, m in zip(best, n)]
            scores[g] = np.where(n > 0, conf, 0.0)
        return out, scores


def sample_texts(labelled: DataFrame, docs: int = SAMPLE_DOCS, symbols: int = SAMPLE_SYMBOLS) -> dict[str, list[str]]:
    """Bounded training sample: per language up to ``docs`` documents (by hash of
    the id), from each a piece of its share of ``symbols`` at a place set by the
    hash. ``labelled``: ``id``, ``lang``, ``text``, none null."""
    ids = top_by_hash(labelled.select("id", "lang"), "lang", "id", docs)
    per = ids.groupBy("lang").agg(F.greatest(F.lit(150), F.ceil(F.lit(symbols) / F.count("*"))).alias("per"))
    chosen = ids.join(per, "lang")   # at most docs rows for each language
    room = F.greatest(F.lit(1), F.length("text") - F.col("per"))
    piece = F.expr("substring(text, cast(1 + pmod(_h, greatest(1, length(text) - per)) as int), cast(per as int))")
    rows = (labelled.join(F.broadcast(chosen), ["id", "lang"]).filter(room > 0)
            .select("lang", "id", "_h", piece.alias("piece")).collect())
    out: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r._h, r.id, r.piece)):
        out.setdefault(r.lang, []).append(r.piece)
    return out


def learnable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    d = renamed(docs, id=id_col, lang=lang_col, text=text_col)
    return d.filter("id is not null and lang is not null and text is not null").filter(crc_mod(F.col("id"), 4) != 2)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (0 to 1) added.

    A text that is null, empty or has no letter is ``und`` with score 0, and so
    is every text when there was nothing to learn from; languages of whose sample no letter
    is known are never predicted. Equal texts get equal
    results; ties go to the language first by name."""
    schema = "lang_pred string, lang_score double"

    @F.pandas_udf(schema)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lang, score = model.predict([t if isinstance(t, str) else None for t in texts])
            yield pd.DataFrame({"lang_pred": lang, "lang_score": score})

    got = small_batches(docs).withColumn("_lid", of(F.col(text_col)))
    return got.select(*[c for c in docs.columns if c not in ("lang_pred", "lang_score")], "_lid.lang_pred", "_lid.lang_score")
