"""Scans of the source tables (one Parquet file or folder per table).

Reads are lazy; Catalyst prunes columns and pushes filters into the Parquet
scan, so callers select what they need and nothing else is read.
"""
from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .paths import is_missing, read_if_exists

TABLE_NAMES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def read_table(spark: SparkSession, base_dir: str, name: str, fmt: str = "parquet",
               options: dict | None = None, schema=None) -> DataFrame:
    """``scan_table``: full-table read of one source table.

    Parquet files under ``base_dir`` by default; any other Spark source
    (``csv``, ``json``, ``orc``, ``jdbc`` with ``dbtable``/``query`` options)
    goes through the same reader with its options and an explicit schema."""
    reader = spark.read.format(fmt).options(**(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "jdbc":
        return reader.option("dbtable", (options or {}).get("dbtable", name)).load()
    if fmt == "parquet":     # <name>.parquet, or else a folder of that name
        try:
            return reader.load(os.path.join(base_dir, f"{name}.parquet"))
        except AnalysisException as e:
            if not is_missing(e):
                raise
    return reader.load(os.path.join(base_dir, name))


def extract_all(spark: SparkSession, base_dir: str, names: list[str], fmt: str = "parquet",
                options: dict | None = None) -> dict[str, DataFrame]:
    """Lazy handles on several source tables; a missing table is skipped with
    a warning (the extract step of the pipeline), any other error raises."""
    import warnings
    out = {}
    for n in names:
        try:
            out[n] = read_table(spark, base_dir, n, fmt, options)
        except AnalysisException as e:
            if not is_missing(e):
                raise
            warnings.warn(f"table {n} skipped: nothing there")
    return out


@dataclass
class Tables:
    """Lazy handle on all source tables under one directory."""
    spark: SparkSession
    base_dir: str
    _cache: dict = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = read_table(self.spark, self.base_dir, name)
        return self._cache[name]


def read_staged(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """``scan_parquet_stage``: read a staged table; a missing table gives None and
    a warning."""
    import warnings
    table = read_if_exists(spark, os.path.join(path, name))
    if table is None:
        warnings.warn(f"staged table {name} skipped: nothing there")
    return table


def write_staged(df: DataFrame, path: str, name: str) -> str:
    out = os.path.join(path, name)
    df.write.mode("overwrite").parquet(out)
    return out
