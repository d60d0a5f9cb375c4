"""Benchmark decontamination by spaced-seed hashing.

A seed is a window of words hashed under a fixed mask that ignores some of its
positions, so a substituted word there does not hide the overlap. The hashes of
the benchmark are joined with those of every window of the corpus, and around
each hit the item is laid along the text word by word: of the stretches that are
alike enough that with the most matches is taken, and must be long enough.

The benchmark side of the join is handed to the tasks in blocks of at most
``BLOCK_CHARS`` characters of text, so what is broadcast has a fixed bound; a
larger benchmark takes more passes over the corpus. The corpus side is never
shuffled.
"""
from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, renamed, small_batches, words_of

#: Fixed masks: 1 is hashed, 0 ignored. Those over twelve words; those over ten, by which no run of ten words is missed;
#: and shorter ones for substitutions close together (a stretch of 10 words and more at 0.8 holds an equal run of 3 or 4).
MASKS = ("111010010111", "110110101011", "101101110101", "1101100111", "1110101011", "11101011", "110111", "11111")
SPAN = max(map(len, MASKS))
MIN_WORDS = 10
MIN_IDENTITY = 0.8
BLOCK_CHARS = 8_000_000
#: Characters of text laid out at once in a task.
CHARS_AT_ONCE = 2_000_000
_FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * i + 3) ** 5 | 1) % (1 << 64) for i in range(SPAN)], dtype=np.uint64)
_BITS = 20


def _window_hashes(ids: np.ndarray, span: int, places: list[int]) -> np.ndarray:
    """Hash of each window's masked words; 0 where one of them is not a word of the benchmark."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    ok = np.ones(n, dtype=bool)
    for j, p in enumerate(places):
        part = ids[p:p + n]
        ok &= part != 0
        h += part * _FACTORS[j]
    h ^= h >> np.uint64(29)
    h *= _FACTORS[-1]
    h[~ok] = 0
    return h


def best_stretch(same: np.ndarray, min_identity: float) -> tuple[int, int, int]:
    """Matches, first and end place of the stretch with the most matches among those
    of at least ``min_identity``; it begins and ends with a match."""
    part = Fraction(min_identity).limit_denominator(1000)
    # a stretch is alike enough where its sum of these is not negative
    total = np.concatenate(([0], np.cumsum(np.where(same, part.denominator - part.numerator, -part.numerator))))
    count = np.concatenate(([0], np.cumsum(same)))
    first = np.searchsorted(-np.minimum.accumulate(total), -total)     # for each end, the first place it may begin
    matched = count - count[first]
    end = int(matched.argmax())
    at = np.flatnonzero(same[first[end]:end]) + first[end]
    return (len(at), int(at[0]), int(at[-1]) + 1) if len(at) else (0, 0, 0)


class Index:
    """Seeds of one block of benchmark items. Items shorter than a seed are looked up whole."""

    def __init__(self, items: list[tuple[int, str]], min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY):
        self.min_words, self.min_identity = min_words, min_identity
        self.vocab: dict[bytes, int] = {}
        self.items, self.ids = [], []
        for item, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item)
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], dtype=np.uint64))
        shapes = [(len(m), [i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
        short = sorted({len(i) for i in self.items if len(i) <= min_words})    # nothing but the whole item counts
        self.seeds = []
        for whole, span, places in [(False, *x) for x in shapes] + [(True, n, list(range(n))) for n in short]:
            found = []
            for k, ids in enumerate(self.items):
                if len(ids) == span if whole else len(ids) > min_words and len(ids) >= span:
                    h = _window_hashes(ids, span, places)
                    found.append((h, np.full(len(h), k), np.arange(len(h))))
            if found:
                h, k, at = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(h, kind="stable")
                bitmap = np.zeros(1 << _BITS, dtype=bool)
                bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
                self.seeds.append((span, places, h[order], k[order], at[order], bitmap))

    def overlaps(self, texts: list[str | None]) -> list[tuple[int, int, int, float, float, int, int]]:
        """(text, item id, matched words, identity, coverage, first word, end word) of each
        text and item with a verified overlap; of several the best, then the first."""
        out: list[tuple[int, int, int, float, float, int, int]] = []
        part, room, base = [], 0, 0
        for i, t in enumerate(texts):
            part.append(t or "")
            room += len(part[-1])
            if room >= CHARS_AT_ONCE or i + 1 == len(texts):
                out += self._some(part, base)
                base, part, room = i + 1, [], 0
        return out

    def _some(self, texts: list[str], base: int):
        get = self.vocab.get
        arrays, starts, at = [], [], SPAN
        arrays.append(np.zeros(SPAN, dtype=np.uint64))
        sizes = []
        for t in texts:
            w = words_of(t)
            starts.append(at)
            sizes.append(len(w))
            arrays.append(np.fromiter(map(get, w, repeat(0)), dtype=np.uint64, count=len(w)))
            arrays.append(np.zeros(SPAN, dtype=np.uint64))      # no window reaches over two texts
            at += len(w) + SPAN
        ids = np.concatenate(arrays)
        starts, sizes = np.array(starts), np.array(sizes)
        keys = []
        for span, places, hashes, item, place, bitmap in self.seeds:
            h = _window_hashes(ids, span, places)
            pos = np.flatnonzero(bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)] & (h != 0))
            lo, hi = np.searchsorted(hashes, h[pos], "left"), np.searchsorted(hashes, h[pos], "right")
            n = hi - lo
            if n.sum():
                pos, lo, n = np.repeat(pos, n), np.repeat(lo, n), n
                inner = np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
                j = lo + inner
                keys.append(np.stack([np.searchsorted(starts, pos, "right") - 1, item[j], pos - place[j]]))
        if not keys:
            return []
        best: dict[tuple[int, int], tuple] = {}
        for doc, k, diagonal in np.unique(np.concatenate(keys, axis=1), axis=1).T.tolist():
            ref = self.items[k]
            a, b = max(diagonal, int(starts[doc])), min(diagonal + len(ref), int(starts[doc] + sizes[doc]))
            same = ids[a:b] == ref[a - diagonal:b - diagonal]
            if np.count_nonzero(same) < min(self.min_words, len(ref)):
                continue
            matched, first, end = best_stretch(same, self.min_identity)
            if matched < min(self.min_words, len(ref)):
                continue
            row = (matched, matched / (end - first), matched / len(ref), a - int(starts[doc]) + first, a - int(starts[doc]) + end)
            key = (base + doc, self.ids[k])
            if key not in best or (row[0], row[1], -row[3]) > (best[key][0], best[key][1], -best[key][3]):
                best[key] = row
        return [(*key, *row) for key, row in best.items()]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_chars: int = BLOCK_CHARS):
    """The benchmark's items in blocks of about ``block_chars`` characters, one after the other."""
    b = cut(renamed(benchmark, id=id_col, text=text_col).filter("text is not null").select("id", "text"))
    total = b.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = b.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        yield sorted(((r.id, r.text) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text_col: str = "text", block_chars: int = BLOCK_CHARS,
             min_words: int = MIN_WORDS, min_identity: float = MIN_IDENTITY) -> DataFrame:
    """One row per input row and benchmark item that overlaps it: the ids,
    ``matched`` words, ``identity`` (of the stretch), ``coverage`` (of the item),
    ``first_word``, ``end_word`` (in the text).

    Null and empty texts and items overlap nothing. Repeated rows and rows
    sharing an id are each looked at; a null id stays null. An empty table on
    either side gives an empty result."""
    d = small_batches(renamed(docs, id=id_col, text=text_col))
    id_type = d.schema["id"].dataType.simpleString()
    item_type = "string" if benchmark.schema[item_col].dataType.simpleString() == "string" else "bigint"
    schema = (f"`{id_col}` {id_type}, `{item_col}` {item_type}, matched int, identity double, coverage double, "
              "first_word int, end_word int")
    names = [id_col, item_col, "matched", "identity", "coverage", "first_word", "end_word"]
    kinds = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
    item_arrow = pa.string() if item_type == "string" else pa.int64()
    out = None
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        index = Index(items, min_words, min_identity)

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = index.overlaps(batch.column("text").to_pylist())
                text, *rest = zip(*found) if found else [()] * 7
                ids = batch.column("id").take(pa.array(text, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(rest[0], item_arrow), *[pa.array(c, kind) for c, kind in zip(rest[1:], kinds)]],
                    names=names) if found else pa.RecordBatch.from_arrays(
                    [ids, pa.array([], item_arrow), *[pa.array([], kind) for kind in kinds]], names=names)

        part = d.mapInArrow(find, schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", block_chars: int = BLOCK_CHARS, min_words: int = MIN_WORDS,
          min_identity: float = MIN_IDENTITY) -> DataFrame:
    """The rows of ``docs`` that no benchmark item overlaps, unchanged (null and empty texts stay)."""
    for items in blocks(benchmark, item_col, item_text_col, block_chars):
        index = Index(items, min_words, min_identity)
        docs = small_batches(docs).filter(~_overlapping(index)(F.col(text_col)))
    return docs


def _overlapping(index: Index):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        found = {r[0] for r in index.overlaps([t if isinstance(t, str) else None for t in texts])}
        return pd.Series([i in found for i in range(len(texts))], dtype=bool)
    return hit
