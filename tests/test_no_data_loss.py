"""Loads lose nothing: unreadable tables raise, extracts and snapshots of many
files in any order count whole, long orders keep all their items."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import drift as DR
from ledgerlens.sources import sinks
from ledgerlens.sources.paths import read_if_exists
from ledgerlens.sources.star import order_item_id
from ledgerlens.sources.tables import extract_all, read_staged
from ledgerlens.streaming.incremental import drift_log, stream_drift, stream_incremental_fact

SCHEMA = "order_id long, customer_id long, order_date date, sale_price double"


def _fact(spark, days):
    return spark.createDataFrame([(i, 1, dt.date(2024, 1, 1) + dt.timedelta(days=d), 1.0) for i, d in days], SCHEMA)


def _unreadable(path):
    os.makedirs(path)
    with open(os.path.join(path, "part-00000.parquet"), "wb") as f:
        f.write(b"this is not a table" * 50)
    return path


def test_unreadable_tables_raise_and_stay(spark, tmp_dir):
    path = _unreadable(os.path.join(tmp_dir, "fact"))
    before = open(os.path.join(path, "part-00000.parquet"), "rb").read()
    for act in (lambda: sinks.sink_incremental(_fact(spark, [(1, 1)]), path), lambda: sinks.high_water_mark(spark, path),
                lambda: read_if_exists(spark, path), lambda: read_staged(spark, tmp_dir, "fact"),
                lambda: extract_all(spark, tmp_dir, ["fact"])):
        with pytest.raises(Exception):
            act()
    monitor = DR.DriftMonitor(spark, tmp_dir)
    _unreadable(monitor.baseline_path)
    with pytest.raises(Exception):
        monitor.check(spark.createDataFrame([(1, 1.0)], "customer_id long, recency double"))
    assert open(os.path.join(path, "part-00000.parquet"), "rb").read() == before


def test_missing_tables_are_none(spark, tmp_dir):
    assert read_if_exists(spark, os.path.join(tmp_dir, "nothing")) is None
    assert sinks.high_water_mark(spark, os.path.join(tmp_dir, "nothing")) is None


@pytest.mark.parametrize("per_batch", [None, 1, 2])
def test_extract_of_many_files_in_falling_order(spark, tmp_dir, per_batch):
    src, sink, ck = (os.path.join(tmp_dir, f"{x}{per_batch}") for x in ("src", "sink", "ck"))
    kwargs = {} if per_batch is None else {"files_per_batch": per_batch}
    for k in range(4):    # later files hold earlier days
        _fact(spark, [(100 * k + i, 10 * (4 - k) + i) for i in range(10)]).coalesce(1).write.mode("append").parquet(src)
    schema = _fact(spark, [(1, 1)]).schema
    stream_incremental_fact(spark, src, sink, ck, schema, **kwargs)
    assert spark.read.parquet(sink).count() == 40
    for k in range(3):    # a re-extract: all days again and ten new ones, in mixed files
        _fact(spark, [(1000 + 100 * k + d, d) for d in range(10 + k, 60, 3)]).coalesce(1).write.mode("append").parquet(src)
    stream_incremental_fact(spark, src, sink, ck, schema, **kwargs)
    days = [r.order_date for r in spark.read.parquet(sink).filter("order_id >= 1000").collect()]
    assert sorted(days) == [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(50, 60)]


def test_snapshot_of_many_files_is_judged_once(spark, tmp_dir):
    rows = [(i, float(i % 50), 7) for i in range(1000)]
    df = spark.createDataFrame(rows, "customer_id long, recency double, snapshot_id int")
    base = DR.feature_stats(df, ["recency"])
    df.orderBy("recency").repartitionByRange(5, "recency").write.parquet(os.path.join(tmp_dir, "snap"))
    stream_drift(spark, os.path.join(tmp_dir, "snap"), base, os.path.join(tmp_dir, "log"), os.path.join(tmp_dir, "ck"), df.schema)
    log = spark.read.parquet(os.path.join(tmp_dir, "log")).collect()
    assert len(log) == 1 and log[0].z_score == 0.0 and not log[0].drifted


def test_snapshot_that_arrives_in_parts_has_one_verdict(spark, tmp_dir):
    rows = [(i, float(i % 50), float(i % 7) if i % 3 else None, 1 + i % 2) for i in range(900)]
    df = spark.createDataFrame(rows, "customer_id long, recency double, monetary double, snapshot_id int")
    base = DR.feature_stats(df.withColumn("recency", F.col("recency") * 2), ["recency", "monetary"])
    logs = []
    for parts in (1, 3):
        src, log, ck = (os.path.join(tmp_dir, f"{x}{parts}") for x in ("src", "log", "ck"))
        for k in range(parts):
            df.filter(F.col("customer_id") % parts == k).repartition(1 + k).write.mode("append").parquet(src)
            stream_drift(spark, src, base, log, ck, df.schema)
            so_far = drift_log(spark, log)
            assert so_far.count() == so_far.select("snapshot_id", "feature").distinct().count()
        stream_drift(spark, src, base, log, ck, df.schema)      # nothing new
        logs.append(sorted(drift_log(spark, log).collect()))
    assert logs[0] == logs[1] and len(logs[0]) == 4


def test_an_order_of_many_items_keeps_them_all(spark):
    ids = spark.range(1, 1501).withColumn("order_id", F.lit(7).cast("long")).union(spark.range(1, 6).withColumn("order_id", F.lit(8).cast("long")))
    assert ids.select(order_item_id(F.col("order_id"), F.col("id")).alias("x")).distinct().count() == 1505
    with pytest.raises(Exception):
        spark.range(1).select(order_item_id(F.lit(7).cast("long"), F.lit(1 << 20))).collect()
