"""SimHash near-duplicates found through one-wildcard segment variants.

Fingerprint: bit b of 64 is set when it is set in over half of the XXH64 values
(seed 42) of the text's word shingles, repeats counted. Two fingerprints are
linked when they differ in at most ``max_bits`` bits. Cut into
``max_bits // 2 + 1`` segments, such a pair has a segment that differs in at
most one bit; that segment with the bit left out is equal in both. So each
distinct fingerprint is indexed under its segments with one position wildcarded
(64 keys in all), an equality join brings the candidates together, and the
whole fingerprint is verified inside the join condition, which only lets linked
pairs out. A pair that agrees in a segment meets at every position of it; the
condition takes it at the first one only.

Exact copies share a fingerprint and are one node of the join, however many
they are.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, renamed, small_batches
from .components import connected_components

#: Shingles whose bits are counted at once: bounds the memory for one very long text.
SHINGLES_AT_ONCE = 1 << 15


def fingerprint(text: str | None, shingle: int) -> int:
    """64-bit fingerprint of one text as a signed integer (null, empty or blank: 0)."""
    if text is None:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()   # bytes: only A-Z, only ASCII space
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    stops = (ends[shingle - 1:] if len(words) >= shingle else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at:at + SHINGLES_AT_ONCE],
                                                             stops[at:at + SHINGLES_AT_ONCE])], dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):   # sums of 255 bits fit a byte
            votes += bits[part:part + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


def fingerprints(shingle: int):
    """Arrow-batched column function: texts to signed 64-bit fingerprints."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
    return of


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments, so few that one differs in at most one bit."""
    n = max_bits // 2 + 1
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(df: DataFrame, max_bits: int) -> DataFrame:
    """``df`` (with ``fp``) once for each wildcarded position: ``pos``, ``seg_mask``, ``first``, ``key``."""
    rows = []
    for low, width in segments(max_bits):
        mask = ((1 << width) - 1) << low
        for pos in range(low, low + width):
            rows.append(F.struct(F.lit(pos).alias("pos"), F.lit(_signed(mask)).alias("seg_mask"),
                                 F.lit(pos == low).alias("first"), F.lit(_signed(mask & ~(1 << pos))).alias("keep")))
    v = df.withColumn("_v", F.explode(F.array(*rows)))
    return v.select(*df.columns, F.col("_v.pos").alias("pos"), F.col("_v.seg_mask").alias("seg_mask"),
                    F.col("_v.first").alias("first"), F.col("fp").bitwiseAND(F.col("_v.keep")).alias("key"))


def linked_pairs(nodes: DataFrame, max_bits: int) -> DataFrame:
    """All pairs of rows of ``nodes`` (``fp`` distinct, ``rep``) within ``max_bits``: ``u``, ``v``."""
    v = variants(nodes, max_bits)
    a = v.select("key", "pos", "seg_mask", "first", F.col("fp").alias("fp_a"), F.col("rep").alias("u"))
    b = v.select("key", "pos", F.col("fp").alias("fp_b"), F.col("rep").alias("v"))
    x = F.col("fp_a").bitwiseXOR(F.col("fp_b"))
    in_segment = x.bitwiseAND(F.col("seg_mask"))
    met_here = (in_segment != 0) | F.col("first")
    return (a.join(b, ["key", "pos"])
            .filter((F.col("fp_a") < F.col("fp_b")) & met_here & (F.bit_count(x) <= max_bits))
            .select("u", "v"))


def fingerprint_groups(prints: DataFrame, max_bits: int, same_id: bool = True) -> DataFrame:
    """``id``, ``fp`` to one row for each fingerprint: ``fp``, ``group`` (the smallest fingerprint reachable over links),
    ``rep`` (its smallest id; null if it has none). With ``same_id`` fingerprints of one id are linked, too."""
    nodes = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    links = linked_pairs(nodes.select("fp", F.col("fp").alias("rep")), max_bits)
    if same_id:
        spread = (prints.filter("id is not null").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                  .filter("lo <> hi").select("id", "lo"))
        links = links.union(prints.join(spread, "id").select(F.col("lo").alias("u"), F.col("fp").alias("v")))
    found = connected_components(links)
    return nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("group"), "rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """One row per input row: the id, ``fp`` (signed long), ``component`` (the
    smallest id reachable over links, its own included).

    Null, empty and blank texts have fingerprint 0 and link like any other.
    Repeated rows come back as often as they went in; rows that share an id are
    linked with one another. Rows with a null id link like others and pass links on; they get
    the component of their group, or null if no id is in it, and never name one. An
    empty table gives an empty result; further columns are not touched."""
    d = small_batches(renamed(docs, id=id_col, text=text_col))
    prints = cut(d.select("id", fingerprints(shingle)(F.col("text")).alias("fp")))
    grouped = cut(fingerprint_groups(prints, max_bits))
    of_fp = grouped.join(grouped.groupBy("group").agg(F.min("rep").alias("component")), "group").select("fp", "component")
    return prints.join(of_fp, "fp", "left").select(F.col("id").alias(id_col), "fp", "component")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                      max_bits: int = 4) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, unchanged: that with the smallest id (a null id is
    larger than any other), of several the one with the smallest hash of its columns.

    Groups are of texts alone: rows that share an id but not their text are told apart, and rows with null ids
    take part. An empty table gives an empty result; further columns, whatever they are called, pass through."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h"))
    packed = small_batches(docs).select(row.alias("row"), place.alias("place"), fingerprints(shingle)(F.col(text_col)).alias("fp"))
    prints = cut(packed.select(F.col("place.id").alias("id"), "fp", "place"))
    grouped = fingerprint_groups(prints.select("id", "fp"), max_bits, same_id=False).select("fp", "group")
    first = cut(prints.groupBy("fp").agg(F.min("place").alias("place")).join(grouped, "fp").groupBy("group")
                .agg(F.min(F.struct("place", "fp")).alias("first")).select("first.fp"))
    kept = packed.join(first, "fp", "left_semi").groupBy("fp").agg(F.min_by("row", "place").alias("row"))
    return kept.select(*[F.col(f"row.`{c}`") for c in docs.columns])
