"""Tables that readers see whole: written to a fresh folder, checked, then published.

A published table is a catalog view over one or more Parquet folders. A new
state of the table is written beside the old one and counted; only then one
catalog statement points the view at it, whatever its columns and partitions. A
load that breaks on the way leaves the view, and whoever reads it, where they were.
Needs a catalog that outlives the session (a metastore) where tables are to.
"""
from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


class IncompleteWrite(RuntimeError):
    """What was written does not hold the rows that were to be written."""


def _quoted(name: str) -> str:
    return ".".join("`" + part.replace("`", "``") + "`" for part in name.split("."))


def stage(df: DataFrame, base_path: str, table: str, partition_by: list[str] | None = None, rows: int | None = None) -> str:
    """Write ``df`` to a fresh folder under ``<base_path>/<table>`` and read back and count what is there (``rows``, if
    given, are what it must hold). Returns the folder."""
    folder = f"{base_path.rstrip('/')}/{table}/{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    found = df.sparkSession.read.schema(df.schema).parquet(folder).count()
    if rows is not None and rows != found:
        raise IncompleteWrite(f"{folder}: {found} of {rows} rows")
    return folder


def folders_of(spark: SparkSession, table: str) -> list[str] | None:
    """Folders that the published ``table`` shows, or None where there is none."""
    value = property_of(spark, table, "folders")
    return None if value is None else json.loads(value)


def property_of(spark: SparkSession, table: str, name: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    found = {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES {_quoted(table)}").collect()}
    return found.get(name)


def publish(spark: SparkSession, table: str, folders: list[str], columns: list[str], properties: dict[str, str] | None = None) -> None:
    """Point ``table`` at ``folders`` (with the same columns) in one catalog statement."""
    def text(value: str) -> str:
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    props = {"folders": json.dumps(folders)} | (properties or {})
    listed = ", ".join("`" + c.replace("`", "``") + "`" for c in columns)
    parts = " UNION ALL ".join(f"SELECT {listed} FROM parquet.`{f.replace('`', '``')}`" for f in folders)
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(table)} TBLPROPERTIES ({', '.join(f'{text(k)} = {text(v)}' for k, v in props.items())}) AS {parts}")


def read_published(spark: SparkSession, table: str) -> DataFrame | None:
    """The table as it is now (a later load does not change the result), or None."""
    return spark.table(table) if spark.catalog.tableExists(table) else None


def remove_unused(spark: SparkSession, base_path: str, tables: list[str], older_than_hours: float = 24.0) -> list[str]:
    """Delete the folders of ``tables`` that no longer are published and have not changed for so long
    (longer than any reader may still need them). Returns them."""
    jvm, gone = spark.sparkContext._jvm, []
    limit = (time.time() - older_than_hours * 3600) * 1000
    for table in tables:
        used = {f.rstrip("/").rsplit("/", 1)[-1] for f in folders_of(spark, table) or []}
        home = jvm.org.apache.hadoop.fs.Path(f"{base_path.rstrip('/')}/{table}")
        fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for entry in fs.listStatus(home) if fs.exists(home) else []:
            if entry.isDirectory() and entry.getPath().getName() not in used and entry.getModificationTime() < limit:
                fs.delete(entry.getPath(), True)
                gone.append(entry.getPath().toString())
    return gone
