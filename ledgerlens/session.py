"""Session helpers: one place for the settings every plan relies on."""
from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Event, Thread

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerlens", driver_memory: str | None = None) -> SparkSession:
    """Return (or create) a session with AQE on and a UTC session clock.

    On a cluster ``master`` stays None and the launcher's settings win; the
    overrides here only fill in what the launcher left unset.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true")
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:   # local mode: the driver JVM is the whole cluster
        builder = builder.config("spark.driver.memory", driver_memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure reliable checkpoints have a directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Where nothing is configured, a local session (one machine) gets a
    scratch folder of its own, and any other raises: a folder of the driver is
    not seen by the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    local_dir = tempfile.mkdtemp(prefix="ledgerlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local_dir)
    return local_dir


#: Seconds between two collections of the driver while a library's fit runs.
COLLECT_EVERY = 15


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark removes them as the write ends. Otherwise they stay until
    the driver happens to collect what refers to them, and a driver with memory to spare does not."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def collecting(spark: SparkSession, seconds: float | None = None) -> Iterator[None]:
    """Let the driver collect now and then while a fit runs, and as it ends: a fit drops its steps as it goes, but Spark removes
    their shuffle files only once the driver's JVM has noticed."""
    ended = Event()

    def collect() -> None:
        while not ended.wait(seconds or COLLECT_EVERY):
            spark.sparkContext._jvm.System.gc()

    thread = Thread(target=collect, daemon=True)
    thread.start()
    try:
        yield
    finally:
        ended.set()
        thread.join()
        spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def written_to(df: DataFrame, path: str) -> DataFrame:
    """``df`` as Parquet at ``path``; its shuffles are removed as soon as it is there."""
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in a fresh folder of the checkpoint directory, for what is read several times: its joins
    and sorts run once, and each reader takes only the columns and days it needs."""
    return written_to(df, scratch_path(df.sparkSession, name))


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``written_to`` that nothing reads any more."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
