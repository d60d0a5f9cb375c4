"""Global ranking without a single-partition window.

``ROW_NUMBER()/NTILE()/PERCENT_RANK() OVER (ORDER BY ...)`` with no PARTITION BY
makes Spark move every row into one task. Here the order is established with a
range shuffle instead:

1. ``repartitionByRange(n, keys)`` + ``sortWithinPartitions(keys)``;
2. each row gets its partition id and its position inside the partition;
3. the tagged rows are checkpointed (reliable storage under
   ``spark.checkpoint.dir``), so partition contents can never differ between the
   counting job and the numbering job, also after an executor loss;
4. per-partition counts (one row per partition: a proven size bound) are turned
   into offsets and broadcast; ``row_number = offset + position + 1``.

The order keys must end with a unique key so that the numbering is
deterministic.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import idiv
from ..session import ensure_checkpoint_dir

_PID, _IDX, _OFF, _TOTAL = "_gr_pid", "_gr_idx", "_gr_off", "_gr_total"


def _range_sorted(df: DataFrame, order_by: list[Column], num_partitions: int | None) -> DataFrame:
    """Range partition + sort within partitions. Without an explicit count AQE
    may merge adjacent (small) ranges, which keeps the global order; the
    checkpoint that follows freezes whatever partitioning ran."""
    ranged = (df.repartitionByRange(num_partitions, *order_by) if num_partitions
              else df.repartitionByRange(*order_by))
    return ranged.sortWithinPartitions(*order_by)


def global_row_number(df: DataFrame, order_by: list[Column] | None, rn_col: str = "rn",
                      total_col: str | None = None, num_partitions: int | None = None) -> DataFrame:
    """Append a 1-based global row number in ``order_by`` order (and optionally
    the total row count). With ``order_by=None`` the rows are numbered in their
    current partition order without any shuffle (dense ids fixed by the
    checkpoint, e.g. surrogate keys of a table written once)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    pid = F.spark_partition_id()
    ordered = df if order_by is None else _range_sorted(df, order_by, num_partitions)
    tagged = (ordered
              .withColumn(_PID, pid)
              .withColumn(_IDX, F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
              .checkpoint(eager=True))
    counts = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("_cnt"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        _PID,
        (F.sum("_cnt").over(Window.orderBy(_PID)) - F.col("_cnt")).alias(_OFF),
        F.sum("_cnt").over(everything).alias(_TOTAL))
    out = (tagged.join(F.broadcast(offsets), _PID, "inner")
           .withColumn(rn_col, F.col(_OFF) + F.col(_IDX) + F.lit(1)))
    if total_col:
        out = out.withColumn(total_col, F.col(_TOTAL))
    return out.drop(_PID, _IDX, _OFF, _TOTAL)


def count_below(cuts: list, key: Column) -> Column:
    """How many of the sorted ``cuts`` are below ``key``: first the run of cuts it falls into, then its place there, so
    a row meets about twice the square root of their number."""
    run = max(1, math.isqrt(len(cuts)))
    runs = [cuts[i:i + run] for i in range(0, len(cuts), run)]
    before = F.size(F.filter(F.array(*[F.lit(r[0]) for r in runs]), lambda b: b < key))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, r)) for r in runs]), F.greatest(before, F.lit(1)))
    return F.when(before == 0, F.lit(0)).otherwise((before - 1) * run + F.size(F.filter(inside, lambda b: b < key)))


def range_row_number(df: DataFrame, keys: list[str], rn_col: str = "rn", ranges: int | None = None) -> DataFrame:
    """1-based row number in the order of ``keys`` (unique together; nulls last)
    without writing the rows anywhere.

    Bounds are taken once from approximate quantiles of the first key and used
    by two passes: one counts the rows of each range (it reads the first key
    only), one numbers the rows inside their range. The counts (a row for each
    range) become offsets. Only the quantiles are computed right away."""
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(keys[0])
    bounds = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(bounds or []))
    place = count_below(cuts, key) if cuts else F.lit(0)
    ranged = df.withColumn("_range", F.when(key.isNull(), F.lit(len(cuts) + 1)).otherwise(place))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*[F.col(k).asc_nulls_last() for k in keys])
    return (ranged.withColumn("_at", F.row_number().over(inside)).join(F.broadcast(offsets), "_range")
            .withColumn(rn_col, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before"))


def _cuts_below(score: int, key: Column) -> Column:
    return F.size(F.filter("_cuts", lambda c: (c["s"] == score) & (c["k"] < key)))


def ntiles(df: DataFrame, scores: dict[str, list[Column]], id_col: str, tiles: int) -> DataFrame:
    """``NTILE(tiles) OVER (ORDER BY keys, id)`` for several scores at once.

    ``scores``: column name -> up to two numeric keys, ascending (negate for
    descending); ties go by the id. Only (score, keys, id) is ranked, all scores
    in one go; of the ranks just the last key of each tile is kept, and every row
    finds its tile by comparing its keys with these few."""
    def key(keys: list[Column]) -> Column:
        first, second = (keys + [F.lit(0)])[:2]
        return F.struct(first.cast("decimal(38,6)").alias("a"), second.cast("decimal(38,6)").alias("b"),
                        F.col(id_col).alias("id"))

    every = F.array(*[F.struct(F.lit(i).alias("s"), key(k).alias("k")) for i, k in enumerate(scores.values())])
    narrow = df.select(F.explode(every).alias("_x")).select("_x.s", "_x.k")
    ranked = global_row_number(narrow, [F.col("s").asc(), F.col("k").asc()], "_rn", total_col="_total")
    n = idiv(F.col("_total"), F.lit(len(scores)))
    at = F.col("_rn") - F.col("s") * n
    # tile t ends at row t * (n div tiles) + min(t, n mod tiles)
    ends = [F.lit(t) * idiv(n, F.lit(tiles)) + F.least(F.lit(t), n % tiles) for t in range(1, tiles)]
    cuts = ranked.select("s", "k", F.explode(F.array(*[F.when(at == e, F.lit(t)) for t, e in enumerate(ends, 1)])).alias("t"))
    # (tiles - 1) keys of each score, attached as one value
    held = cuts.filter("t is not null").agg(F.collect_list(F.struct("s", "k")).alias("_cuts"))
    out = attach_scalars(df, held)
    for i, (name, keys) in enumerate(scores.items()):
        # a tile without rows ends where the one before it does, and counts as passed there too
        out = out.withColumn(name, (_cuts_below(i, key(keys)) + 1).cast("long"))
    return out.drop("_cuts")


def value_counts(values: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, value, n, before): how often each value occurs and how many rows of
    its group are smaller. Ranks the distinct values only, so a value that most
    rows share costs no more than any other."""
    counted = values.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    run = global_running_sums(counted, [*[F.col(g).asc() for g in group], F.col(value).asc()], ["n"], rn_col="_rn")
    run = run.withColumn("_before", F.col("cum_n") - F.col("n"))
    if not group:
        return run.select(value, "n", F.col("_before").alias("before"))
    first = run.groupBy(*group).agg(F.min("_before").alias("_first"))     # a row for each group
    return run.join(F.broadcast(first), group).select(*group, value, "n", (F.col("_before") - F.col("_first")).alias("before"))


def value_at(counted: DataFrame, value: str, position: Column) -> Column:
    """Aggregate over ``value_counts`` rows: the value at a 0-based position in order."""
    return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("n")), F.col(value)))


def qcut_positions(inputs: DataFrame, population: DataFrame, id_col: str, value_cols: list[str]) -> DataFrame:
    """For every input row (by a unique id) and each of ``value_cols``: ``<col>_rank``, 1 + number of population values
    strictly below its value, and ``n``, the population size + 1. This is the rank the row gets
    when it is put in front of the population and ranked with ``method="first"``.

    Only distinct values are ordered, those of all columns in one go: of the population with their
    counts, of the inputs with count 0."""
    def long(df: DataFrame, *more: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(value_cols)])
        return df.select(*more, F.explode(pairs).alias("_x")).select(*more, "_x.m", "_x.v")

    asked = long(inputs, id_col)
    both = (long(population).groupBy("m", "v").agg(F.count(F.lit(1)).alias("w"))
            .unionByName(asked.select("m", "v").distinct().withColumn("w", F.lit(0).cast("long")))
            .groupBy("m", "v").agg(F.sum("w").alias("w")))
    run = global_running_sums(both, [F.col("m").asc(), F.col("v").asc()], ["w"], rn_col="_rn_all").withColumn("_before", F.col("cum_w") - F.col("w"))
    start = run.groupBy("m").agg(F.min("_before").alias("_start"))       # a row for each column
    below = run.join(F.broadcast(start), "m").select(F.col("m").alias("_m"), F.col("v").alias("_v"), (F.col("_before") - F.col("_start") + 1).alias("_rank"))
    ranked = asked.join(below, (F.col("m") == F.col("_m")) & F.col("v").eqNullSafe(F.col("_v")))
    wide = ranked.groupBy(id_col).agg(*[F.max(F.when(F.col("m") == i, F.col("_rank"))).alias(f"{c}_rank") for i, c in enumerate(value_cols)])
    return attach_scalars(wide, population.agg((F.count(F.lit(1)) + 1).alias("n")))


def qcut_bin(rank: Column, n: Column, q: int = 5) -> Column:
    """Bin of ``pandas.qcut(ranks, q)`` for rank r among 1..n: the least k with
    r <= 1 + (n-1)k/q (first bin closed on the left)."""
    num = F.lit(q) * (rank - F.lit(1))
    den = F.greatest(n - F.lit(1), F.lit(1))
    k = idiv(num + den - F.lit(1), den)
    return F.greatest(k, F.lit(1)).cast("long")


def global_running_sums(df: DataFrame, order_by: list[Column], sum_cols: list[str],
                        rn_col: str = "rn", total_col: str | None = None,
                        num_partitions: int | None = None) -> DataFrame:
    """Row number plus inclusive running sums (``SUM(x) OVER (ORDER BY ... ROWS
    UNBOUNDED PRECEDING)``) over a global order, without a one-task window.

    Per-partition totals become offsets (one row per partition, broadcast); the
    running sum inside a partition is a window partitioned by the range
    partition id, so every task handles one range."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    pid = F.spark_partition_id()
    tagged = (_range_sorted(df, order_by, num_partitions)
              .withColumn(_PID, pid)
              .withColumn(_IDX, F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), 33))
              .checkpoint(eager=True))
    part = tagged.groupBy(_PID).agg(F.count(F.lit(1)).alias("_cnt"),
                                    *[F.sum(c).alias(f"_p_{c}") for c in sum_cols])
    before = Window.orderBy(_PID)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = part.select(
        _PID,
        (F.sum("_cnt").over(before) - F.col("_cnt")).alias(_OFF),
        F.sum("_cnt").over(everything).alias(_TOTAL),
        *[(F.sum(f"_p_{c}").over(before) - F.col(f"_p_{c}")).alias(f"_o_{c}") for c in sum_cols])
    inside = Window.partitionBy(_PID).orderBy(_IDX).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.join(F.broadcast(offsets), _PID, "inner").withColumn(rn_col, F.col(_OFF) + F.col(_IDX) + F.lit(1))
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_o_{c}") + F.sum(c).over(inside))
    if total_col:
        out = out.withColumn(total_col, F.col(_TOTAL))
    return out.drop(_PID, _IDX, _OFF, _TOTAL, *[f"_o_{c}" for c in sum_cols])


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row frame (a global aggregate) to every row
    as a scalar subquery: the aggregate runs once and its value is inlined
    (no join). An empty frame gives NULLs."""
    cols = one_row.columns
    packed = one_row.select(F.struct(*[F.col(c) for c in cols]).alias("_scalar")).scalar()
    out = df.withColumn("_scalar", packed)
    return out.select(*[F.col(c) for c in df.columns], *[F.col("_scalar")[c].alias(c) for c in cols])
