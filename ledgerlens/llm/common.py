"""Helpers shared by the operators of this package."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, written_once

#: A word in the sense of most operators here: a run of anything but space and \t \n \v \f \r.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: UTF-8 bytes with all but ASCII letters, digits and what lies beyond ASCII as a space.
SPACED = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and all characters beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(SPACED).split()


#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with its session set to hand rows to Python workers in batches of
    ``BATCH_ROWS`` at most: whole texts are long, and a worker holds a batch."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(name, "0"))
    if not 0 < now <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's shared checkpoint folder and read it back:
    later jobs neither recompute it nor depend on an executor that may go."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the session's shared checkpoint folder: like ``cut`` for what
    is read more than once by few of its columns, smaller, and without the shuffles that made it."""
    return written_once(df, name)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under this operator's own names, so that other
    columns of the input, however they are called, cannot clash."""
    return df.select(*[df[src].alias(dst) for dst, src in columns.items()])


def top_by_hash(df: DataFrame, group: str, key: str, k: int, salts: int = 8) -> DataFrame:
    """For each ``group`` the ``k`` rows with the smallest hash of ``key``
    (ties by key): a bounded, repeatable sample. The rank is taken inside
    ``salts`` slices of each group first, so no task sees a whole hot group."""
    from pyspark.sql import Window
    h = F.xxhash64(F.col(key).cast("string"), F.lit("sample"))
    d = df.withColumn("_h", h).withColumn("_s", F.pmod(F.xxhash64(F.col("_h")), F.lit(salts)))
    order = ["_h", key]
    first = Window.partitionBy(group, "_s").orderBy(*order)
    last = Window.partitionBy(group).orderBy(*order)
    return (d.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= k)
            .withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= k)
            .drop("_s", "_r"))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null matches null; the keys come from ``left``."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])
