"""Top-k rows per group that stays balanced when one group holds a large share
of the rows: rank inside (group, salt) sub-groups first, keep k candidates per
sub-group, then rank the few candidates per group."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: list[str], order_by: list[Column], k: int,
                    salt_col: Column, salt_buckets: int = 64, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group by ``order_by`` (which must be a total order
    inside the group). ``salt_col`` is any well-spread column of the row (e.g. a
    unique id); the row's sub-group is its hash modulo ``salt_buckets``."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_col), F.lit(salt_buckets)))
    inner = Window.partitionBy(*group_cols, "_salt").orderBy(*order_by)
    cand = salted.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= k).drop("_r", "_salt")
    outer = Window.partitionBy(*group_cols).orderBy(*order_by)
    return cand.withColumn(rank_col, F.row_number().over(outer)).filter(F.col(rank_col) <= k)
