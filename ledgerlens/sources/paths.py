"""Reading a table that may not be there yet.

Whether a table exists is asked of the reader itself, so any file system Spark
knows will do. Only "no such path" and "a folder without files" count as
missing; a table that is there but cannot be read raises.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

# Error conditions that mean the path holds no table.
MISSING = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def is_missing(error: AnalysisException) -> bool:
    return (error.getCondition() or "").split(".")[0] in MISSING


def read_if_exists(spark: SparkSession, path: str, fmt: str = "parquet", options: dict | None = None) -> DataFrame | None:
    """The table at ``path``, or None when nothing is there."""
    try:
        return spark.read.format(fmt).options(**(options or {})).load(path)
    except AnalysisException as e:
        if is_missing(e):
            return None
        raise
