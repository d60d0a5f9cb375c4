"""Feature drift: per-feature statistics in long form, baseline comparison by
z-score, and an append-only drift log.

Medians and quantiles are exact: the distinct values of each feature with their
counts are put in order (no single-task window, no collect), and the values at
the needed positions taken."""
from __future__ import annotations

import datetime as _dt
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import value_at, value_counts
from ..sources.paths import read_if_exists

# Features watched for drift (fixed list).
MONITORED_FEATURES = ["recency", "frequency", "monetary", "avg_order_value",
                      "avg_days_between_orders", "purchase_trend", "orders_last_90d", "unique_categories"]
API_BASELINE_FEATURES = ["recency", "frequency", "monetary"]
DRIFT_THRESHOLD_STD = 3.0
STAT_DIGITS = 6


def long_form(df: DataFrame, features: list[str], id_col: str = "customer_id") -> DataFrame:
    """(id, feature, value) for every present feature with a non-null value."""
    present = [f for f in features if f in df.columns]
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in present])
    return (df.select(F.col(id_col).alias("_id"), F.explode(pairs).alias("_p"))
            .select("_id", "_p.feature", "_p.value").filter(F.col("value").isNotNull()))


def _counted(long: DataFrame) -> DataFrame:
    """(feature, value, n, before) and the feature's total ``_n``."""
    c = value_counts(long, ["feature"], "value")
    total = c.groupBy("feature").agg(F.sum("n").alias("_n"))
    return c.join(F.broadcast(total), "feature")     # a row for each feature of the list


def quantiles(long: DataFrame, probs: dict[str, float], counted: DataFrame | None = None) -> DataFrame:
    """Linear-interpolated quantiles per feature (value at 0-based position
    (n-1)p, interpolated between its neighbours)."""
    c = counted if counted is not None else _counted(long)
    aggs = []
    for name, p in probs.items():
        h = (F.col("_n") - 1) * F.lit(p)
        lo, hi = value_at(c, "value", F.floor(h)), value_at(c, "value", F.ceil(h))
        aggs.append((lo + (hi - lo) * F.max(h - F.floor(h))).alias(name))
    return c.groupBy("feature").agg(*aggs)


def _moments(counted: DataFrame) -> DataFrame:
    """feature, mean, std (sample), min, max, count from the counted values; the
    squares are taken from the mean, so nothing cancels."""
    mean = counted.groupBy("feature").agg((F.sum(F.col("value") * F.col("n")) / F.max("_n")).alias("mean"))
    d = counted.join(F.broadcast(mean), "feature")   # a row for each feature of the list
    square = F.sum(F.col("n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean")))
    return d.groupBy("feature").agg(
        F.max("mean").alias("mean"), F.when(F.max("_n") > 1, F.sqrt(square / (F.max("_n") - 1))).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), F.max("_n").alias("count"),
        ((value_at(d, "value", F.floor((F.col("_n") - 1) / 2)) + value_at(d, "value", F.ceil((F.col("_n") - 1) / 2))) / 2)
        .alias("median"))


def feature_stats(df: DataFrame, features: list[str] = MONITORED_FEATURES, id_col: str = "customer_id") -> DataFrame:
    """feature, mean, std (sample), min, max, median, count over non-null values,
    all from one table of distinct values and their counts."""
    out = _moments(_counted(long_form(df, features, id_col)))
    return out.select("feature", *[F.round(F.col(c), STAT_DIGITS).alias(c) for c in ("mean", "std", "min", "max", "median")],
                      "count")


def baseline_stats_api(rfm: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """mean, std, p25, p75 of recency, frequency, monetary."""
    counted = _counted(long_form(rfm, API_BASELINE_FEATURES, id_col))
    base = _moments(counted).select("feature", "mean", "std", F.col("count").alias("n_customers"))
    q = quantiles(None, {"p25": 0.25, "p75": 0.75}, counted)
    return base.join(q, "feature").select(
        "feature", *[F.round(F.col(c), STAT_DIGITS).alias(c) for c in ("mean", "std", "p25", "p75")], "n_customers")


def feature_means(df: DataFrame, features: list[str] = MONITORED_FEATURES, by: str | None = None) -> DataFrame:
    """feature, mean over non-null values (and ``by``, for each of its values):
    one grouped pass, all that ``drift_check`` reads of the current side."""
    present = [f for f in features if f in df.columns]
    keys = [by] if by else []
    wide = df.groupBy(*keys).agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in present])
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(F.col(f), STAT_DIGITS).alias("mean")) for f in present])
    return wide.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.feature", "_p.mean").filter("mean is not null")


def drift_check(baseline: DataFrame, current: DataFrame, threshold: float = DRIFT_THRESHOLD_STD,
                by: str | None = None) -> DataFrame:
    """z = |mean_cur - mean_base| / std_base per feature present in both (and
    ``by``, for each of its values); features with a zero or missing baseline
    std are skipped. Both sides hold one row per feature."""
    keys = [by] if by else []
    b = baseline.select("feature", F.col("mean").alias("_bm"), F.col("std").alias("_bs"))
    c = current.select(*keys, "feature", F.col("mean").alias("_cm"))
    j = b.join(c, "feature").filter(F.col("_bs").isNotNull() & (F.col("_bs") != 0))
    z = F.abs(F.col("_cm") - F.col("_bm")) / F.col("_bs")
    return j.select(*keys, "feature", F.round("_bm", 4).alias("baseline_mean"), F.round("_cm", 4).alias("current_mean"),
                    F.round(z, 4).alias("z_score"), (z > threshold).alias("drifted"))


def drift_summary(report: DataFrame) -> DataFrame:
    """One row: drift_detected, drifted_features (sorted)."""
    return report.agg(F.coalesce(F.max(F.col("drifted").cast("int")), F.lit(0)).cast("boolean").alias("drift_detected"),
                      F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"))


class DriftMonitor:
    """Baseline and log kept as Parquet tables under ``root`` (a shared path)."""

    def __init__(self, spark, root: str, threshold: float = DRIFT_THRESHOLD_STD):
        self.spark, self.root, self.threshold = spark, root, threshold
        self.baseline_path = os.path.join(root, "baseline_stats")
        self.log_path = os.path.join(root, "drift_log")

    def set_baseline(self, features: DataFrame) -> DataFrame:
        stats = feature_stats(features).withColumn("set_at", F.lit(_dt.datetime.now(_dt.timezone.utc).isoformat()))
        stats.write.mode("overwrite").parquet(self.baseline_path)
        return self.spark.read.parquet(self.baseline_path)

    def check(self, features: DataFrame) -> DataFrame:
        """Compare with the stored baseline; without one, store it and report an
        empty (no drift) result. Each check is appended to the log."""
        baseline = read_if_exists(self.spark, self.baseline_path)
        if baseline is None:
            self.set_baseline(features)
            return self.spark.createDataFrame([], "feature string, baseline_mean double, current_mean double, "
                                                  "z_score double, drifted boolean")
        report = drift_check(baseline, feature_means(features), self.threshold)
        checked_at = _dt.datetime.now(_dt.timezone.utc).isoformat()
        report.withColumn("checked_at", F.lit(checked_at)).write.mode("append").parquet(self.log_path)
        return report

    def last_report(self) -> DataFrame | None:
        """Rows of the latest check (log table filtered to its max checked_at)."""
        log = read_if_exists(self.spark, self.log_path)
        if log is None:
            return None
        last = log.agg(F.max("checked_at").alias("_last"))
        return log.join(F.broadcast(last), log.checked_at == last._last).drop("_last")

    def retrain_signal(self) -> bool:
        last = self.last_report()
        return bool(last is not None and last.filter(F.col("drifted")).limit(1).count() > 0)
