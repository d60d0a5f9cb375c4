"""Deterministic de-duplication that aggregates map-side (a key with many copies
never lands whole in one task)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_first(df: DataFrame, key: str, order_cols: list[str]) -> DataFrame:
    """Keep one row per ``key``: the one with the smallest ``order_cols`` (then the
    smallest remaining columns), via ``min(struct)`` in a grouped aggregate.
    Rows with a NULL key are kept as they are (pandas keeps one of them; a NULL
    key is dropped by every cleaner right after)."""
    rest = [c for c in df.columns if c != key and c not in order_cols]
    packed = F.struct(*[F.col(c).alias(c) for c in order_cols + rest])
    kept = (df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(packed).alias("_row"))
            .select(key, *[F.col(f"_row.{c}").alias(c) for c in order_cols + rest]))
    return kept.select(*df.columns)
