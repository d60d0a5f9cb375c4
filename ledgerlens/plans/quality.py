"""Data-quality checks: null profile, rule validation, orphan keys, row counts.

A profile is one grouped aggregate per table (``count`` + ``sum(isnull)`` per
column, all in one scan); results are small frames with one row per table.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio_round

# Fixed rule tables (minimum rows, required columns) of the two validators.
RAW_RULES = {
    "orders": {"min_rows": 1000, "required_cols": ["order_id", "user_id", "status", "created_at"]},
    "order_items": {"min_rows": 1000, "required_cols": ["id", "order_id", "user_id", "product_id", "sale_price"]},
    "users": {"min_rows": 100, "required_cols": ["id", "first_name", "last_name", "email"]},
    "products": {"min_rows": 100, "required_cols": ["id", "name", "category", "retail_price"]},
}
STAR_RULES = {
    "fact_orders": {"min_rows": 1000, "required_cols": ["order_id", "customer_id", "product_id", "sale_price", "order_date"]},
    "dim_customers": {"min_rows": 100, "required_cols": ["customer_id", "email"]},
    "dim_products": {"min_rows": 100, "required_cols": ["product_id", "name", "category"]},
    "dim_date": {"min_rows": 365, "required_cols": ["date_id", "full_date", "year", "month"]},
}
RAW_MAX_NULL_PCT = 30   # percent
STAR_MAX_NULL_PCT = 20  # percent
ORPHAN_WARN_PCT = 5     # percent


class ValidationError(Exception):
    pass


def null_profile(df: DataFrame, name: str) -> DataFrame:
    """table, rows, columns, null_cells, null_pct (share of all cells, 6 decimals)."""
    ncols = len(df.columns)
    nulls = [F.sum(F.col(c).isNull().cast("long")) for c in df.columns]
    total = reduce(lambda a, b: a + b, nulls) if nulls else F.lit(0)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(total, F.lit(0)).alias("null_cells")).select(
        F.lit(name).alias("table"), "rows", F.lit(ncols).cast("long").alias("columns"),
        F.col("null_cells").cast("long").alias("null_cells"),
        F.coalesce(ratio_round(F.col("null_cells"), F.col("rows") * ncols, 6), F.lit(0.0)).alias("null_pct"))


def validate_tables(tables: dict[str, DataFrame], rules: dict, max_null_pct: int) -> DataFrame:
    """One row per table: rows, null_cells, missing required columns and the
    three checks (min rows, required columns, null share <= max)."""
    rows = []
    for name, df in tables.items():
        rule = rules.get(name, {})
        missing = [c for c in rule.get("required_cols", []) if c not in df.columns]
        ncols = len(df.columns)
        p = null_profile(df, name).select(
            "table", "rows", "null_cells", "null_pct",
            F.lit(",".join(missing)).alias("missing_columns"),
            (F.col("rows") >= F.lit(rule.get("min_rows", 1))).alias("rows_ok"),
            F.lit(not missing).alias("columns_ok"),
            ((F.col("rows") == 0) | (F.col("null_cells") * 100 <= F.col("rows") * ncols * max_null_pct)).alias("nulls_ok"))
        rows.append(p)
    out = reduce(DataFrame.unionByName, rows)
    return out.withColumn("passed", F.col("rows_ok") & F.col("columns_ok") & F.col("nulls_ok"))


def validate_raw(raw: dict[str, DataFrame]) -> DataFrame:
    return validate_tables(raw, RAW_RULES, RAW_MAX_NULL_PCT)


def validate_star(star: dict[str, DataFrame]) -> DataFrame:
    return validate_tables(star, STAR_RULES, STAR_MAX_NULL_PCT)


def raise_on_failure(result: DataFrame, stop_at_first: bool = False) -> None:
    """Raise when any table failed. The result has one row per table (bounded)."""
    failed = [r["table"] for r in result.filter(~F.col("passed")).select("table").collect()]
    if failed:
        if stop_at_first:
            raise ValidationError(f"validation failed for table {failed[0]}")
        raise ValidationError(f"validation failed for tables {sorted(failed)}")


def anti_orphans(fact: DataFrame, dim: DataFrame, key: str = "customer_id") -> DataFrame:
    """Distinct fact keys missing from the dimension and their share."""
    keys = fact.select(key).filter(F.col(key).isNotNull()).distinct()
    orphans = keys.join(dim.select(key), key, "left_anti")
    from ..operators.ranking import attach_scalars
    stats = attach_scalars(keys.agg(F.count(F.lit(1)).alias("fact_keys")),
                           orphans.agg(F.count(F.lit(1)).alias("orphan_keys")))
    return stats.select(
        "fact_keys", "orphan_keys",
        F.coalesce(ratio_round(F.col("orphan_keys") * 100, F.col("fact_keys"), 2), F.lit(0.0)).alias("orphan_pct"),
        (F.col("orphan_keys") * 100 > F.col("fact_keys") * ORPHAN_WARN_PCT).alias("warn"))


def verify_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table (union of one-row counts); a table that is None (not
    there) is reported with NULL rows and does not stop the others."""
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    parts = [spark.range(1).select(F.lit(n).alias("table"), F.lit(None).cast("long").alias("rows"))
             for n, df in tables.items() if df is None]
    parts += [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n, df in tables.items()
              if df is not None]
    return reduce(DataFrame.unionByName, parts)
