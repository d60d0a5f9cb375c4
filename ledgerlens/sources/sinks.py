"""Sinks: full replace and star load in one transaction (published tables),
high-water incremental append, row-count verification, versioned outputs and exports.

Paths are expected on shared storage (the cluster's file system or object
store); nothing is written to machine-local folders by these helpers.
"""
from __future__ import annotations

import datetime as _dt
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.quality import verify_counts
from .paths import read_if_exists
from .published import folders_of, publish, read_published, stage


def sink_full_replace(df: DataFrame, table: str, base_path: str, partition_by: list[str] | None = None) -> None:
    """Replace the published ``table`` by ``df`` in one transaction: readers see the old rows until
    the new ones are written and counted, and the old ones for good if that fails."""
    publish(df.sparkSession, table, [stage(df, base_path, table, partition_by)], df.columns)


def high_water_mark(spark: SparkSession, path: str, col: str = "order_date"):
    """max(col) of the existing table, or None when it does not exist."""
    table = read_if_exists(spark, path)
    return None if table is None else table.agg(F.max(col)).first()[0]


def incremental_new_rows(existing: DataFrame | None, batch: DataFrame, col: str = "order_date") -> DataFrame:
    """Rows of ``batch`` strictly after the existing maximum of ``col`` (all rows
    when there is no existing table). Late rows (<= max) are not loaded and
    rows equal to the maximum are skipped, as the reference's loader does."""
    if existing is None:
        return batch
    from ..operators.ranking import attach_scalars
    hwm = existing.agg(F.max(col).alias("_hwm"))
    j = attach_scalars(batch, hwm)
    return j.filter(F.col("_hwm").isNull() | (F.col(col) > F.col("_hwm"))).drop("_hwm")


def sink_incremental(df: DataFrame, path: str, col: str = "order_date") -> int:
    """Append only new rows; full load when the table is missing. Returns the
    number of rows written, counted in the table itself. Nothing is ever
    overwritten: a table that is there but cannot be read raises."""
    spark = df.sparkSession
    before = read_if_exists(spark, path)
    if before is None:
        df.write.mode("append").parquet(path)
        return spark.read.parquet(path).count()
    row = before.agg(F.max(col).alias("hwm"), F.count(F.lit(1)).alias("n")).first()
    new = df if row.hwm is None else df.filter(F.col(col) > F.lit(row.hwm))
    new.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - row.n


LOAD_ORDER = ["dim_customers", "dim_products", "dim_date", "fact_orders"]
#: Folders of one table after which an incremental load writes it anew into one.
MOST_FOLDERS = 50


def load_all(tables: dict[str, DataFrame], base_path: str, mode: str = "full", prefix: str = "") -> DataFrame:
    """Load the star into published tables (``prefix`` + name) in one transaction.
    Dimensions are always replaced; the fact is, too, or with ``mode="incremental"``
    takes its rows after the last day it has. Everything is written and counted
    before anything is published; then dimensions, calendar and at last the fact
    are switched, by one catalog statement each. A load that fails while it writes
    leaves all tables as they were. Returns rows per table."""
    spark = next(iter(tables.values())).sparkSession
    states = {}
    for name in [n for n in LOAD_ORDER if n in tables]:
        df, table = tables[name], prefix + name
        held = read_published(spark, table) if mode == "incremental" and name == "fact_orders" else None
        if held is None:
            states[table] = [stage(df, base_path, table)], df.columns
            continue
        mark = held.agg(F.max("order_date")).first()[0]
        new = (df if mark is None else df.filter(F.col("order_date") > F.lit(mark))).select(*held.columns)
        folders = folders_of(spark, table)
        states[table] = ([stage(held.union(new), base_path, table)] if len(folders) >= MOST_FOLDERS
                         else [*folders, stage(new, base_path, table)]), held.columns
    for table, (folders, columns) in states.items():
        publish(spark, table, folders, columns)
    return verify_counts({n: read_published(spark, prefix + n) for n in LOAD_ORDER if n in tables})


def versioned_output(df: DataFrame, base_path: str, name: str = "features", metadata: dict | None = None) -> str:
    """Write to ``<base>/<name>_v<N>`` with the next free N and a one-row
    metadata table next to it. Returns the data path."""
    spark = df.sparkSession
    n = 1
    while read_if_exists(spark, os.path.join(base_path, f"{name}_v{n}")) is not None:
        n += 1
    out = os.path.join(base_path, f"{name}_v{n}")
    df.write.mode("errorifexists").parquet(out)
    meta = {"version": f"v{n}", "created_at": _dt.datetime.now(_dt.timezone.utc).isoformat(), "columns": df.columns}
    meta.update(metadata or {})
    spark.createDataFrame([(json.dumps(meta),)], "metadata string").write.mode("overwrite").parquet(out + "_meta")
    return out


def export_scores(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Feature / score tables for downstream tools (CSV with header, or Parquet)."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
