"""Structured Streaming forms of the incremental fact load and the drift check.

Both use ``foreachBatch`` and dynamic partition overwrite: a micro-batch of the
fact writes into its own ``batch_id=<n>`` partition, a drift report into that of
its snapshot. A retried batch replaces its own output, so the sinks stay
exactly-once with plain Parquet; the stream's checkpoint (on shared storage)
records progress and state.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.drift import MONITORED_FEATURES, STAT_DIGITS, drift_check
from ..sources.paths import read_if_exists


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write
     .mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def stream_incremental_fact(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                            schema, date_col: str = "order_date", files_per_batch: int | None = None):
    """High-water append of new fact files. Rows not after the maximum of the
    earlier extracts (late or repeated rows) are dropped (strict mode). Runs all
    available files and stops (``availableNow``); returns the finished query.

    The files there at the start are one extract: all are held against the mark
    that stood before it, in whatever order and however many batches they come,
    and the mark moves once they are all in. A run that breaks off leaves the
    old mark; the next one goes on with the files left over. Marks are rows
    (last batch, maximum) of a small table next to the sink (``<sink>_hwm``), so
    loaded data is not scanned again."""
    hwm_dir = sink_dir.rstrip("/") + "_hwm"
    marks = read_if_exists(spark, hwm_dir)
    last = marks.agg(F.max("hwm").alias("hwm"), F.max("last_batch").alias("batch")).first() if marks is not None else None
    hwm, done = (last.hwm, last.batch) if last is not None else (None, -1)

    def load(batch: DataFrame, batch_id: int) -> None:
        _write_batch(batch if hwm is None else batch.filter(F.col(date_col) > F.lit(hwm)), sink_dir, batch_id)

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    q = (reader.parquet(source_dir).writeStream.foreachBatch(load)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    loaded = read_if_exists(spark, sink_dir)
    if loaded is not None:
        new = loaded.filter(F.col("batch_id") > F.lit(done)).agg(
            F.max("batch_id").cast("long").alias("last_batch"), F.max(date_col).alias("hwm")).filter("last_batch is not null")
        new.coalesce(1).write.mode("append").parquet(hwm_dir)
    return q


def stream_drift(spark: SparkSession, snapshots_dir: str, baseline_stats: DataFrame, log_dir: str,
                 checkpoint_dir: str, schema, snapshot_col: str = "snapshot_id", threshold: float = 3.0):
    """Compare each feature snapshot (rows tagged with ``snapshot_col``) with the baseline: one report
    per snapshot and feature in ``log_dir`` (read it with ``drift_log``).

    The files of a snapshot may arrive in any number of runs. Sums and counts per snapshot and
    feature are the stream's state; whenever files of a snapshot come in, its report is
    written anew from all of them and replaces the one before. A retried batch writes the same."""
    present = [f for f in MONITORED_FEATURES if f in {field.name for field in schema.fields}]

    def judge(sums: DataFrame, batch_id: int) -> None:
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f"s_{f}") / F.col(f"n_{f}"), STAT_DIGITS).alias("mean"))
                          for f in present])
        means = sums.select(snapshot_col, F.explode(pairs).alias("p")).select(snapshot_col, "p.feature", "p.mean").filter("mean is not null")
        report = drift_check(baseline_stats, means, threshold, by=snapshot_col)
        (report.withColumn("of_snapshot", F.col(snapshot_col).cast("string")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("of_snapshot").parquet(log_dir))

    numbers = {f: F.col(f).cast("double") for f in present}
    state = spark.readStream.schema(schema).parquet(snapshots_dir).groupBy(snapshot_col).agg(
        *[F.sum(c).alias(f"s_{f}") for f, c in numbers.items()],
        *[F.when(F.count(c) > 0, F.count(c)).alias(f"n_{f}") for f, c in numbers.items()])
    q = (state.writeStream.outputMode("update").foreachBatch(judge).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def drift_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """The reports of ``stream_drift``, one per snapshot and feature."""
    return spark.read.parquet(log_dir).drop("of_snapshot")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's checkpoint directory (shared storage
    on a cluster)."""
    import uuid
    from ..session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
