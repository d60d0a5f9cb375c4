"""Toxicity by nearest labelled examples.

A bounded sample of labelled texts becomes TF-IDF vectors over the features
(words and word beginnings) that tell the labels apart. For a text the nearest
examples by exact cosine are found through a block-max inverted index: examples
stand in blocks, each feature knows its largest weight in each block, and blocks
whose bound cannot reach the k-th best cosine are skipped. The neighbours vote
with weights that grow with the cosine; votes are calibrated on the examples
themselves, each left out of its own vote.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, small_batches, top_by_hash, words_of

#: Bounds of the fitted model: examples of each label, features.
EXAMPLES = 3000
FEATURES = 2000
MIN_CHI2 = 25.0
PREFIXES = range(4, 10)     # word beginnings, in bytes
NEIGHBOURS = 25
BLOCK = 64
PRIOR_WEIGHT = 0.5


def features_of(word: bytes) -> list[bytes]:
    """The word itself (marked) and its beginnings."""
    return [b"=" + word] + [word[:n] for n in PREFIXES if n <= len(word)]


class Votes:
    """Block-max inverted index over the examples, and the calibrated vote."""

    def __init__(self, vocab: list[bytes], examples: list[tuple[int, int, dict[int, int]]], weight: dict[int, float]):
        """``examples``: (id, label, feature counts); ``weight`` of a label: rows it stands for."""
        self.vocab = {f: i for i, f in enumerate(vocab)}
        self.heads = {(f[1:] if f[:1] == b"=" else f)[:4] for f in vocab}
        self.weight = weight
        filled = sorted((e for e in examples if e[2]), key=lambda e: (sorted(e[2].items()), e[0]))   # like examples share blocks
        n = len(filled)
        self.ids = np.array([e[0] for e in filled], dtype=np.int64)
        self.labels = np.array([e[1] for e in filled], dtype=np.int64)
        df = np.zeros(len(vocab))
        for _, _, counts in examples:
            df[list(counts)] += 1
        self.idf = np.log((len(examples) + 1) / (df + 1)) + 1
        self.blocks = -(-n // BLOCK)
        self.bound = np.zeros((len(vocab), self.blocks))
        postings: list[list[tuple[int, float]]] = [[] for _ in vocab]
        self.vectors = [self.vector(e[2]) for e in filled]
        for i, (terms, values) in enumerate(self.vectors):
            for t, v in zip(terms, values):
                postings[t].append((i, v))
                self.bound[t, i // BLOCK] = max(self.bound[t, i // BLOCK], v)
        self.post = [np.array([i for i, _ in p], dtype=np.int64) for p in postings]
        self.value = [np.array([v for _, v in p]) for p in postings]
        self.cuts = [np.searchsorted(p, np.arange(self.blocks + 1) * BLOCK) for p in self.post]
        total = {y: sum(weight[e[1]] for e in examples if e[1] == y) for y in (0, 1)}
        self.prior = total[1] / max(total[0] + total[1], 1e-9)
        empty = {y: sum(weight[e[1]] for e in examples if e[1] == y and not e[2]) for y in (0, 1)}
        self.blank = (empty[1] + PRIOR_WEIGHT * self.prior) / (empty[0] + empty[1] + PRIOR_WEIGHT)
        self.knots = None
        if examples:
            raw = [self.vote(self.nearest(v, skip=i)) for i, v in enumerate(self.vectors)]
            y = self.labels.tolist()
            w = [weight[a] for a in y]
            self.knots = _isotonic(raw + [self.blank] * 2, y + [0, 1], w + [empty[0], empty[1]])

    def vector(self, counts: dict[int, int]) -> tuple[list[int], np.ndarray]:
        terms = sorted(counts)
        v = np.array([1 + np.log(counts[t]) for t in terms]) * self.idf[terms]
        return terms, v / np.linalg.norm(v)

    def counts(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        if text:
            vocab, heads = self.vocab, self.heads
            for w in words_of(text):
                if w[:4] in heads:
                    for f in features_of(w):
                        t = vocab.get(f)
                        if t is not None:
                            out[t] = out.get(t, 0) + 1
        return out

    def nearest(self, vector, skip: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the nearest by exact cosine, ties by example; cosine 0 is none."""
        terms, q = vector
        bound = q @ self.bound[terms] if self.blocks else np.zeros(0)
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            # a bound equal to the k-th cosine (up to rounding) may still hold a tie
            if bound[b] <= 0 or len(best) == NEIGHBOURS and bound[b] < best[-1][0] - 1e-9:
                break
            score = np.zeros(BLOCK)
            for t, x in zip(terms, q):
                a, z = self.cuts[t][b], self.cuts[t][b + 1]
                if a < z:
                    score[self.post[t][a:z] - b * BLOCK] += x * self.value[t][a:z]
            least = best[-1][0] if len(best) == NEIGHBOURS else 0.0
            for i in np.flatnonzero((score > 0) & (score >= least)).tolist():
                if b * BLOCK + i != skip:
                    best.append((float(score[i]), int(b * BLOCK + i)))
            best = sorted(best, key=lambda x: (-round(x[0], 12), x[1]))[:NEIGHBOURS]
        return best

    def vote(self, near: list[tuple[float, int]]) -> float:
        if not near:
            return self.blank
        w = [cos ** 2 * self.weight[int(self.labels[i])] for cos, i in near]
        yes = sum(x for x, (_, i) in zip(w, near) if self.labels[i] == 1)
        share = PRIOR_WEIGHT * min(self.weight.values())
        return (yes + share * self.prior) / (sum(w) + share)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, float, int]]]:
        """Calibrated score and the evidence: (example id, cosine, label) of the nearest."""
        if self.knots is None:
            return self.prior, []
        counts = self.counts(text)
        near = self.nearest(self.vector(counts)) if counts else []
        s = float(np.interp(self.vote(near), *self.knots))
        return min(1.0, max(0.0, s)), [(int(self.ids[i]), cos, int(self.labels[i])) for cos, i in near]


def _isotonic(x: list[float], y: list[int], w: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """Weighted isotonic fit as knots for interpolation: mean vote and mean label of each pooled block."""
    pooled: list[list[float]] = []    # weight, weighted label, weighted vote
    for i in np.argsort(np.array(x), kind="stable"):
        if w[i] <= 0:
            continue
        pooled.append([w[i], w[i] * y[i], w[i] * x[i]])
        while len(pooled) > 1 and pooled[-2][1] * pooled[-1][0] >= pooled[-1][1] * pooled[-2][0]:
            last = pooled.pop()
            pooled[-1] = [a + b for a, b in zip(pooled[-1], last)]
    p = np.array(pooled)
    xs, ys = p[:, 2] / p[:, 0], (p[:, 1] + 1e-3) / (p[:, 0] + 2e-3)
    # unequal votes keep unequal scores: a little of the vote itself is mixed in
    return xs, 0.98 * ys + 0.02 * xs


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        examples: int = EXAMPLES, features: int = FEATURES) -> Votes:
    """Model from labelled rows whose crc32(id as text) mod 5 is not 0.

    At most ``examples`` rows of each label (by hash of the id) and ``features``
    features (largest chi-square) are used. Rows without id, label or text are
    left out; of several labels for one id the largest counts."""
    known = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
             .filter("id is not null and y in (0, 1)").filter(crc_mod(F.col("id"), 5) != 0)
             .groupBy("id").agg(F.max("y").alias("y")))
    stands = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = top_by_hash(known, "y", "id", examples).select("id", "y")
    sample = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
                 .join(F.broadcast(chosen), "id").dropDuplicates(["id"]))     # at most 2 * examples rows

    def distinct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[bytes, list[int]] = {}
            for text, y in zip(b["text"], b["y"]):
                for f in {f for w in set(words_of(text)) if len(w) >= 4 for f in features_of(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pd.DataFrame({"f": list(seen), "neg": [v[0] for v in seen.values()], "pos": [v[1] for v in seen.values()]})

    got = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = got.get(0, 0), got.get(1, 0)
    if not n0 or not n1:
        return Votes([], [], {0: 1.0, 1: 1.0})
    per = sample.select("text", "y").mapInPandas(distinct, "f binary, neg long, pos long").groupBy("f").agg(
        F.sum("neg").alias("a"), F.sum("pos").alias("b"))
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    chi2 = n * F.pow(a * (n1 - b) - b * (n0 - a), F.lit(2)) / ((a + b) * (n - a - b) * float(n0) * float(n1))
    vocab = sorted(bytes(r.f) for r in per.filter(a + b < n).withColumn("chi2", chi2).filter(F.col("chi2") >= MIN_CHI2)
                   .orderBy(F.desc("chi2"), "f").limit(features).select("f").collect())
    empty = Votes(vocab, [], {0: 1.0, 1: 1.0})

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            counts = [empty.counts(t) for t in part["text"]]
            yield pd.DataFrame({"id": part["id"], "y": part["y"], "f": [list(c) for c in counts], "n": [list(c.values()) for c in counts]})

    rows = sample.mapInPandas(vectors, "id long, y int, f array<int>, n array<int>").collect()
    found = sorted((r.id, r.y, dict(zip(r.f, r.n))) for r in rows)
    return Votes(vocab, found, {0: stands[0] / n0, 1: stands[1] / n1})


def score(docs: DataFrame, model: Votes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``score`` (0 to 1), ``evidence`` (nearest
    examples: id, cosine, label; nearest first, ties by example).

    A text without any known feature, a null or an empty one among them, gets the
    share of toxic rows among the examples without one. Without examples of both
    labels every score is 0. Equal texts get equal scores; an empty table gives
    an empty result."""
    @F.pandas_udf("score double, evidence array<struct<id:bigint,cosine:double,label:int>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [model.score(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame({"score": [s for s, _ in found],
                             "evidence": [[dict(id=i, cosine=c, label=y) for i, c, y in e[:5]] for _, e in found]})

    return small_batches(docs).select(F.col(id_col), of(F.col(text_col)).alias("_s")).select(id_col, "_s.score", "_s.evidence")
