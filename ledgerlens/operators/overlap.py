"""Keyword-overlap top-k between a question table and an example table.

score(q, e) = number of distinct lower-cased whitespace tokens shared; keep
score > 0, best k per question, ties by example id. Tokenisation runs in the
JVM. The questions go to the tasks in blocks of at most ``block_tokens``
distinct (question, token) rows, so what is broadcast has a fixed bound; more
questions take more passes over the examples. A task scores one Arrow batch of
whole examples at a time against the block and keeps the running best k of each
question, so it holds and shuffles k rows per question, however many examples
share a word with it; of a batch it works on a bounded number of examples and matches
at a time.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Characters Python's str.split() treats as whitespace (ASCII and common Unicode).
WHITESPACE = "[\\s\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
BLOCK_TOKENS = 250_000
#: Examples whose tokens a task turns into Python strings at once, and matches (an example's token in a question)
#: it scores at once; one example has at most as many as a block has rows.
AT_ONCE, MATCHES = 250, 1_000_000


def distinct_tokens(df: DataFrame, id_col: str, text_col: str, out_id: str) -> DataFrame:
    toks = F.array_distinct(F.split(F.lower(F.col(text_col)), WHITESPACE))
    return (df.select(F.col(id_col).alias(out_id), F.explode(toks).alias("token"))
            .filter(F.col("token") != ""))


def token_blocks(qtok: DataFrame, block_tokens: int):
    """The (q_id, token) rows in blocks of about ``block_tokens``, whole questions
    together: (token -> position, offsets, question positions, question ids)."""
    n_blocks = max(1, -(-qtok.count() // block_tokens))
    for k in range(n_blocks):
        pdf = qtok.filter(F.pmod(F.xxhash64("q_id"), F.lit(n_blocks)) == k).toPandas()   # at most about one block
        ids = np.sort(pdf["q_id"].unique()).astype(np.int64)
        pdf = pdf.assign(q=np.searchsorted(ids, pdf["q_id"].to_numpy(np.int64))).sort_values(["token", "q"])
        tokens, first = np.unique(pdf["token"].to_numpy(dtype=str), return_index=True)
        yield ({t: i for i, t in enumerate(tokens.tolist())}, np.append(first, len(pdf)).astype(np.int64),
               pdf["q"].to_numpy(np.int64), ids)


def _running_best(block, k: int):
    index, offsets, questions, ids = block

    def score(e_id, sizes, at, best):
        """``best`` after some whole examples: their ids, how many known tokens each has, and these tokens."""
        lens = offsets[at + 1] - offsets[at]
        within = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)
        q = questions[np.repeat(offsets[at], lens) + within]
        doc = np.repeat(np.repeat(np.arange(len(sizes)), sizes), lens)
        pair, shared = np.unique(doc * max(1, len(ids)) + q, return_counts=True)
        new = pd.DataFrame({"q": pair % max(1, len(ids)), "e_id": e_id[pair // max(1, len(ids))], "score": shared})
        return (pd.concat([best, new]).sort_values(["q", "score", "e_id"], ascending=[True, False, True])
                .groupby("q").head(k))

    def run(batches):
        best = pd.DataFrame({"q": pd.Series(dtype="int64"), "e_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        for b in batches:
            for first in range(0, b.num_rows, AT_ONCE):
                part = b.slice(first, AT_ONCE)
                tokens = [[index[t] for t in row if t in index] for row in part.column("tokens").to_pylist()]
                e_id = part.column("e_id").to_numpy()
                sizes = np.array([len(t) for t in tokens], dtype=np.int64)
                at = np.array([i for t in tokens for i in t], dtype=np.int64)
                upto = np.append(0, np.cumsum(sizes))
                matches = np.append(0, np.cumsum(offsets[at + 1] - offsets[at]))[upto]      # before each example
                group = (matches[1:] - 1).clip(0) // MATCHES
                for own in np.split(np.arange(len(tokens)), np.flatnonzero(np.diff(group)) + 1):
                    best = score(e_id[own], sizes[own], at[upto[own[0]]:upto[own[-1] + 1]], best)
        yield pa.RecordBatch.from_arrays([pa.array(ids[best["q"].to_numpy(np.int64)]), pa.array(best["e_id"].to_numpy(np.int64)),
                                          pa.array(best["score"].to_numpy(np.int64))], names=["q_id", "e_id", "score"])
    return run


def overlap_top_k(questions: DataFrame, examples: DataFrame, q_id: str, q_text: str, e_id: str,
                  e_text: str, k: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    qtok = distinct_tokens(questions, q_id, q_text, "q_id")
    cores = examples.sparkSession.sparkContext.defaultParallelism
    if examples.rdd.getNumPartitions() < cores:
        # few input splits (large row groups): spread the texts before the
        # tokenizer, which is the expensive step
        examples = examples.select(e_id, e_text).repartition(cores)
    toks = F.array_distinct(F.split(F.lower(F.col(e_text)), WHITESPACE))
    etok = examples.select(F.col(e_id).cast("long").alias("e_id"), toks.alias("tokens")).filter("e_id is not null and tokens is not null")
    cand = None
    for block in token_blocks(qtok, block_tokens):
        part = etok.mapInArrow(_running_best(block, k), "q_id long, e_id long, score long")
        cand = part if cand is None else cand.unionByName(part)
    w = Window.partitionBy("q_id").orderBy(F.col("score").desc(), F.col("e_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
            .select(F.col("q_id").alias("question_id"), F.col("e_id").alias("example_id"), "score", "rank"))
