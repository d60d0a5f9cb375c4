"""Mixing sources to token targets by entropy balancing.

Every document gets a rate r in (0, 2]: among all rates whose words add up to
the source's target, those of least relative entropy to "take each document
once". The dual of that convex problem has one multiplier per source, and its
solution tilts the documents exponentially by their size,
``r = min(2, exp(lambda * size))``. The multipliers are found by Newton steps,
all sources at once: a step is one distributed aggregate over the histogram
(source, size, documents), which is all the problem depends on. The expected
copies are then rounded per histogram cell, passing the rounding error on to the
next smaller size, and dealt to the cell's documents by hash rank.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import global_row_number
from .common import WORD_RE, cut, join_on, renamed

#: Weights of the sources by code point, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
MAX_COPIES = 2
SLICES = 256
MAX_STEPS = 200


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes``: ``source``, ``size``. Returns per source ``source_size`` (words),
    ``target``: shares of ``share`` times all words by weight, none above
    ``max_copies`` times its source; what such a source cannot take is shared
    again by weight among the others until none is above."""
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = global_row_number(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    t = cut(ranked.select("source", "source_size", weight.alias("weight"),
                          (F.col("source_size") * float(max_copies)).alias("most")))
    total = t.agg(F.sum("source_size")).first()[0]
    if not total:
        return t.select("source", "source_size", F.lit(0.0).alias("target"))
    level = 0.0    # the common level: target = min(most, weight * level); it only rises, so few rounds are needed
    while True:
        full = F.col("weight") * level >= F.col("most")
        row = t.agg(F.sum(F.when(full, F.col("most")).otherwise(0.0)).alias("given"),
                    F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not row.open:
            break
        after = (share * total - row.given) / row.open
        if after <= level * (1 + 1e-15):
            break
        level = after
    return t.select("source", "source_size", F.least(F.col("most"), F.col("weight") * level).alias("target"))


def tilt(histogram: DataFrame, targets: DataFrame, max_copies: int = MAX_COPIES, tol: float = 1e-9) -> DataFrame:
    """Newton iterations for the multiplier of each source.

    ``histogram``: ``source``, ``size`` > 0, ``docs``. Returns ``source``,
    ``lambda``. Newton is done on log(words) and kept inside a bracket that
    halves whenever a step leaves it, so it always ends; a source whose target
    is all it can give has the bracket's upper end as its multiplier."""
    cap = math.log(max_copies)
    state = cut(targets.filter("source_size > 0").select(
        "source", "target",
        F.lit(0.0).alias("lambda"),
        # exp(lo * size) * size adds up to less than the target; at hi every document is at the cap
        (F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size"))) - 1.0).alias("lo"),
        F.lit(cap).alias("hi"),
        (F.col("target") >= F.col("source_size") * float(max_copies) * (1 - 1e-12)).alias("all")))
    for _ in range(MAX_STEPS):
        at = join_on(histogram, state, ["source"])
        free = F.col("lambda") * F.col("size") < cap
        words = F.col("docs") * F.col("size") * F.least(F.lit(float(max_copies)), F.exp(F.col("lambda") * F.col("size")))
        sums = at.groupBy("source", "target", "lambda", "lo", "hi", "all").agg(
            F.sum(words).alias("got"), F.sum(F.when(free, words * F.col("size")).otherwise(0.0)).alias("slope"))
        gap = F.log(F.col("got") / F.col("target"))
        lo = F.when(gap < 0, F.col("lambda")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lambda")).otherwise(F.col("hi"))
        newton = F.col("lambda") - gap * F.col("got") / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > lo) & (newton < hi)
        done = F.col("all") | (F.abs(gap) <= tol) | ((hi - lo) <= 1e-15)
        state = cut(sums.select(
            "source", "target",
            F.when(F.col("all"), cap).when(done, F.col("lambda")).when(inside, newton).otherwise((lo + hi) / 2)
            .alias("lambda"),
            lo.alias("lo"), hi.alias("hi"), "all", done.alias("done")))
        if state.filter(~F.col("done")).isEmpty():
            return state.select("source", "lambda")
        state = state.drop("done")
    raise RuntimeError(f"entropy balancing has not converged in {MAX_STEPS} steps")


def round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies for the cells of one source, largest size first; the words that a
    cell is rounded off by are made up for in the next cells."""
    cells = cells.sort_values("size", ascending=False, kind="stable")
    owed, copies = 0.0, []
    for size, docs, rate in zip(cells["size"], cells["docs"], cells["rate"]):
        want = docs * rate + owed / size
        n = min(MAX_COPIES * docs, max(0, math.floor(want + 0.5)))
        owed = (want - n) * size
        copies.append(n)
    return cells.assign(copies=pd.Series(copies, index=cells.index, dtype="int64"))[["source", "size", "docs", "copies"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """One row per input row: id, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``rate``, ``copies`` (0 to 2), ``taken``.

    Null or empty texts have size 0 and no copies; null is a source of its own,
    last in order. Repeated rows and rows that share an id are told apart by
    their rank only, so equal rows are interchangeable. All words zero: every
    target is 0. An empty table gives an empty result. The same input gives the
    same result on every run: ties of the hash are settled by the id."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long")
    d = renamed(docs, id=id_col, source=source_col, text=text_col)
    sized = cut(d.select("id", "source", size.alias("size")))
    targets = cut(source_targets(sized, weights, share))
    slice_of = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(SLICES))
    hist = cut(sized.filter("size > 0").groupBy("source", "size").agg(F.count("*").alias("docs")))
    lam = tilt(hist, targets)
    rated = (join_on(hist, lam, ["source"])
             .select("source", "size", "docs",
                     F.least(F.lit(float(MAX_COPIES)), F.exp(F.col("lambda") * F.col("size"))).alias("rate")))
    # one source's distinct sizes: no more than its longest document has words
    cells = cut(rated.groupBy("source").applyInPandas(
        round_cells, "source string, size long, docs long, copies long"))
    # rank of a document in its cell: offset of its slice, then the rank inside the slice
    slices = (sized.filter("size > 0").withColumn("slice", slice_of).groupBy("source", "size", "slice")
              .agg(F.count("*").alias("n")))
    order = Window.partitionBy("source", "size").orderBy("slice")
    offsets = slices.withColumn("offset", F.sum("n").over(order) - F.col("n")).drop("n")
    dealt = join_on(offsets, cells, ["source", "size"])
    in_slice = Window.partitionBy("source", "size", "slice").orderBy(F.xxhash64(F.col("id").cast("string"), F.lit(1)), "id")
    ranked = sized.withColumn("slice", slice_of).withColumn("_r", F.row_number().over(in_slice))
    joined = join_on(ranked, dealt, ["source", "size", "slice"], "left")
    extra = (F.col("offset") + F.col("_r") <= F.col("copies") % F.col("docs")).cast("long")
    copies = F.coalesce(F.floor(F.col("copies") / F.col("docs")) + extra, F.lit(0)).cast("long")
    out = join_on(joined.select("id", "source", "size", copies.alias("copies")), targets, ["source"], "left")
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies",
                      (F.col("copies") * F.col("size")).alias("taken"))
