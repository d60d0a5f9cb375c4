"""Isolation forest: trees grown on bounded subsamples, scored by column expressions.

A row that few random cuts separate from a subsample is unusual. Every tree takes
its own ``sample`` rows (by a seeded hash of the id, so reruns agree), a task
grows one tree of them, and the trees come back as arrays of nodes. Rows are
scored where they are: the forest is one value, and a row's path through a tree is
an ``aggregate`` over its depth. No row leaves the JVM for it.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import attach_scalars

TREES, SAMPLE = 100, 256
#: Score from which a row counts as an anomaly.
UNUSUAL = 0.6
NODE = "tree int, feature array<int>, cut array<double>, low array<int>, high array<int>, length array<double>"


def mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows, by which paths are judged."""
    if n <= 1:
        return 0.0
    return 2.0 * sum(1.0 / i for i in range(1, int(n))) - 2.0 * (n - 1) / n


def subsamples(df: DataFrame, id_col: str, features: list[str], trees: int, sample: int, seed: int) -> DataFrame:
    """``tree``, ``x`` (features as doubles, null as 0): at most ``sample`` rows for each tree, those with its smallest hashes."""
    n = df.count()
    below = min(1 << 31, math.ceil((2.0 * sample + 64) / max(n, 1) * (1 << 31)))      # about twice as many, then the smallest of them

    def hashed(t: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(id_col), t, F.lit(seed)), F.lit(1 << 31))

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    picked = df.select(id_col, x.alias("x"), F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: hashed(t) < below)).alias("tree"))
    place = Window.partitionBy("tree").orderBy(hashed(F.col("tree")), id_col)
    return picked.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= sample).select("tree", "place", "x")


def grow(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, low, high, length) of one tree over rows ``x``; feature -1 and a length at leaves."""
    nodes: list[tuple[int, float, int, int, float]] = []

    def node(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + mean_path(len(rows))))
        spread = np.flatnonzero(np.ptp(rows, axis=0) > 0) if len(rows) > 1 and depth < most else []
        if len(spread):
            f = int(rng.choice(spread))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left = rows[:, f] < cut
            low = node(rows[left], depth + 1)
            nodes[at] = (f, cut, low, node(rows[~left], depth + 1), 0.0)
        return at

    node(x, 0)
    return nodes


def fit_forest(df: DataFrame, id_col: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """One row per tree: ``tree`` and its nodes as arrays."""
    most = max(1, math.ceil(math.log2(sample)))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.array(rows.sort_values("place")["x"].tolist(), dtype=float)
        columns = list(zip(*grow(x, np.random.default_rng([seed, int(key[0])]), most)))
        return pd.DataFrame({"tree": [int(key[0])]} | {n: [list(c)] for n, c in zip(("feature", "cut", "low", "high", "length"), columns)})

    return subsamples(df, id_col, features, trees, sample, seed).groupBy("tree").applyInPandas(one, NODE)


def path_length(tree: Column, x: Column, depth: int) -> Column:
    """Length of the path of ``x`` through ``tree`` (a struct of arrays)."""
    def step(node: Column, _: Column) -> Column:
        f = tree["feature"][node]
        inner = F.when(x[F.greatest(f, F.lit(0))] < tree["cut"][node], tree["low"][node]).otherwise(tree["high"][node])
        return F.when(f < 0, node).otherwise(inner)

    return tree["length"][F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)]


def score_forest(df: DataFrame, forest: DataFrame, id_col: str, features: list[str], sample_rows: int, depth: int = 8) -> DataFrame:
    """``id_col``, ``path`` (mean length over the trees), ``score`` (2 ** -path / mean path of ``sample_rows`` rows), ``is_anomaly``.

    The forest is a bounded table (a row per tree, at most 2 * ``SAMPLE`` nodes each) and goes along as one value."""
    held = forest.agg(F.array_sort(F.collect_list(F.struct(*[c.split()[0] for c in NODE.split(", ")]))).alias("_forest"))
    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])
    rows = attach_scalars(df.select(id_col, x.alias("_x")), held)
    paths = F.aggregate(F.transform("_forest", lambda t: path_length(t, F.col("_x"), depth)), F.lit(0.0), lambda a, v: a + v)
    path = paths / F.size("_forest")
    score = F.pow(F.lit(2.0), -F.col("path") / F.lit(mean_path(sample_rows) or 1.0))
    return rows.select(id_col, path.alias("path")).withColumn("score", score).withColumn("is_anomaly", F.col("score") >= UNUSUAL)


def isolation_forest(df: DataFrame, id_col: str, features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Scores of all rows by a forest grown on them. An empty table gives an empty result; rows that share an id are
    rows each, null features count as 0."""
    rows = min(sample, df.count())
    forest = fit_forest(df, id_col, features, trees, sample, seed)
    return score_forest(df, forest, id_col, features, rows, max(1, math.ceil(math.log2(sample))))


def tree_rows(trees: list[list[tuple[int, float, int, int, float]]]) -> Iterator[tuple]:
    """Trees given as lists of nodes, as rows of ``NODE``."""
    for i, nodes in enumerate(trees):
        yield (i, *[list(c) for c in zip(*nodes)])
