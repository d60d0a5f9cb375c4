"""Feature edge cases and the incremental high-water mark."""
import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans import features as FE
from ledgerlens.sources.sinks import incremental_new_rows, sink_incremental

SCHEMA = "order_id long, order_item_id long, customer_id long, product_id long, order_date date, sale_price decimal(18,2), status string"


def _orders(spark, rows):
    return spark.createDataFrame([(o, i, c, p, d, __import__("decimal").Decimal(str(s)), "Complete")
                                  for o, i, c, p, d, s in rows], SCHEMA)


def test_gap_telescoping_equals_window_mean(spark):
    d = dt.date
    rows = [(1, 1, 7, 1, d(2024, 1, 1), 10), (1, 2, 7, 2, d(2024, 1, 1), 5), (2, 3, 7, 1, d(2024, 1, 11), 1),
            (3, 4, 7, 1, d(2024, 1, 11), 2), (4, 5, 8, 1, d(2024, 2, 1), 3)]
    o = _orders(spark, rows)
    feat = {r["customer_id"]: r for r in FE.build_rfm_features(o).collect()}
    w = Window.partitionBy("customer_id").orderBy("order_date", "order_item_id")
    gaps = o.withColumn("g", F.datediff("order_date", F.lag("order_date").over(w))).groupBy("customer_id").agg(F.avg("g").alias("g"))
    want = {r["customer_id"]: r["g"] for r in gaps.collect()}
    assert feat[7]["avg_days_between_orders"] == want[7] == 10 / 3
    assert feat[8]["avg_days_between_orders"] == 10 / 3         # single row -> median of the others
    assert feat[7]["frequency"] == 3


def test_lag_features_short_history(spark):
    d = dt.date
    o = _orders(spark, [(1, 1, 7, 1, d(2024, 1, 1), 10), (2, 2, 7, 1, d(2024, 1, 2), 20), (3, 3, 8, 1, d(2024, 1, 1), 5)])
    lag = {r["customer_id"]: r for r in FE.lag_features(o).collect()}
    assert (lag[7]["monetary_lag_1"], lag[7]["monetary_lag_2"]) == (10.0, 0.0)
    assert lag[8]["monetary_lag_1"] == 0.0


def test_incremental_edges(spark, tmp_dir):
    d = dt.date
    existing = _orders(spark, [(1, 1, 7, 1, d(2024, 1, 10), 1)])
    batch = _orders(spark, [(2, 2, 7, 1, d(2024, 1, 9), 1), (3, 3, 7, 1, d(2024, 1, 10), 1), (4, 4, 7, 1, d(2024, 1, 11), 1)])
    assert [r["order_id"] for r in incremental_new_rows(existing, batch).collect()] == [4]
    path = tmp_dir + "/fact"
    assert sink_incremental(existing, path) == 1
    assert sink_incremental(batch, path) == 1
    assert sink_incremental(batch, path) == 0
