"""Sinks, versioned outputs, surrogate keys and the streaming jobs."""
import datetime as dt
import os

from pyspark.sql import functions as F

from ledgerlens.plans import etl
from ledgerlens.sources import sinks
from ledgerlens.sources.tables import read_staged, write_staged
from ledgerlens.streaming.incremental import stream_incremental_fact


def _fact(spark, rows):
    return spark.createDataFrame(rows, "order_id long, customer_id long, order_date date, sale_price double")


def test_staged_round_trip_and_missing(spark, tmp_dir):
    df = spark.range(5).withColumnRenamed("id", "x")
    write_staged(df, tmp_dir, "t")
    assert read_staged(spark, tmp_dir, "t").count() == 5
    assert read_staged(spark, tmp_dir, "missing") is None


def test_versioned_output_and_export(spark, tmp_dir):
    df = spark.range(3)
    p1 = sinks.versioned_output(df, tmp_dir, "features", {"churn_threshold_days": 90})
    p2 = sinks.versioned_output(df, tmp_dir, "features")
    assert p1.endswith("features_v1") and p2.endswith("features_v2")
    meta = spark.read.parquet(p1 + "_meta").first()["metadata"]
    assert '"version": "v1"' in meta and '"churn_threshold_days": 90' in meta
    sinks.export_scores(df, os.path.join(tmp_dir, "scores_csv"))
    assert spark.read.option("header", True).csv(os.path.join(tmp_dir, "scores_csv")).count() == 3


def test_load_all_full_then_incremental(spark, tmp_dir):
    d = dt.date
    dims = {"dim_customers": spark.range(2).withColumnRenamed("id", "customer_id")}
    f1 = _fact(spark, [(1, 0, d(2024, 1, 1), 1.0), (2, 1, d(2024, 1, 5), 2.0)])
    counts = {r["table"]: r["rows"] for r in sinks.load_all({**dims, "fact_orders": f1}, tmp_dir, prefix="t1_").collect()}
    assert counts == {"dim_customers": 2, "fact_orders": 2}
    f2 = _fact(spark, [(2, 1, d(2024, 1, 5), 2.0), (3, 1, d(2024, 1, 6), 3.0)])
    counts = {r["table"]: r["rows"] for r in sinks.load_all({**dims, "fact_orders": f2}, tmp_dir, "incremental", "t1_").collect()}
    assert counts["fact_orders"] == 3
    for t in ("dim_customers", "fact_orders"):
        spark.sql(f"DROP VIEW t1_{t}")


def test_margin_when_items_carry_cost(spark):
    orders = spark.createDataFrame([(1, 10, "Complete", "2024-01-02 00:00:00")],
                                   "order_id long, user_id long, status string, created_at string")
    items = spark.createDataFrame([(11, 1, 10, 5, 9.5, 4.0)],
                                  "id long, order_id long, user_id long, product_id long, sale_price double, cost double")
    fact = etl.build_fact_orders(items, orders).first()
    assert fact["margin"] == 5.5 and fact["fact_id"] == 1


def test_surrogate_keys_are_dense(spark):
    orders = spark.createDataFrame([(i, 1, "Complete", "2024-01-02 00:00:00") for i in range(50)],
                                   "order_id long, user_id long, status string, created_at string")
    items = spark.createDataFrame([(100 + i, i, 1, 5, 1.0) for i in range(50)],
                                  "id long, order_id long, user_id long, product_id long, sale_price double")
    ids = sorted(r["fact_id"] for r in etl.build_fact_orders(items, orders).collect())
    assert ids == list(range(1, 51))


def test_stream_incremental_is_strict_and_idempotent(spark, tmp_dir):
    d = dt.date
    src, sink, ck = (os.path.join(tmp_dir, x) for x in ("src", "sink", "ck"))
    first = _fact(spark, [(1, 0, d(2024, 1, 1), 1.0), (2, 0, d(2024, 1, 5), 2.0)])
    first.write.mode("append").parquet(src)
    stream_incremental_fact(spark, src, sink, ck, first.schema, files_per_batch=None)
    # late row (<= high-water mark), equal row and a new row
    _fact(spark, [(3, 0, d(2024, 1, 4), 1.0), (4, 0, d(2024, 1, 5), 1.0), (5, 0, d(2024, 1, 7), 1.0)]) \
        .write.mode("append").parquet(src)
    stream_incremental_fact(spark, src, sink, ck, first.schema, files_per_batch=None)
    # a restart with nothing new writes nothing
    stream_incremental_fact(spark, src, sink, ck, first.schema, files_per_batch=None)
    got = sorted(r["order_id"] for r in spark.read.parquet(sink).collect())
    assert got == [1, 2, 5]


def test_materialized_fact_prunes_partitions(spark, tmp_dir):
    from ledgerlens.plans import reports as R
    from ledgerlens.sources.star import load_materialized_fact, load_star, materialize_fact
    from tests.conftest import SF_SMALL
    star = load_star(spark, SF_SMALL)
    mat = load_materialized_fact(spark, materialize_fact(star.fact_slim, os.path.join(tmp_dir, "fact")))
    got = R.trend(mat, "1998-01-01", "1998-03-31")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "(order_month" in plan and "<= 1998-03-01" in plan and ">= 1998-01-01" in plan
    assert got.collect() == R.trend(star.fact_slim, "1998-01-01", "1998-03-31").collect()
    assert R.kpis(mat, "1998-01-01", "1998-03-31").collect() == R.kpis(star.fact_slim, "1998-01-01", "1998-03-31").collect()


def test_read_table_formats_and_extract_all(spark, tmp_dir):
    from ledgerlens.sources.tables import extract_all, read_table
    spark.range(4).write.mode("overwrite").option("header", True).csv(os.path.join(tmp_dir, "t_csv"))
    assert read_table(spark, tmp_dir, "t_csv", "csv", {"header": "true"}).count() == 4
    got = extract_all(spark, "/root/testdata/sf0.001", ["orders", "nation", "no_such_table"])
    assert sorted(got) == ["nation", "orders"]


def test_bucketed_fact_groups_without_shuffle(spark):
    from ledgerlens.sources.star import load_star, materialize_fact_table
    from tests.conftest import SF_SMALL
    star = load_star(spark, SF_SMALL)
    materialize_fact_table(star.fact_slim, "fact_orders_bucketed", 4)
    t = spark.table("fact_orders_bucketed")
    per_c = t.groupBy("customer_id").agg(F.sum("sale_price").alias("m"))
    plan = per_c._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(customer_id" not in plan
    want = star.fact_slim.groupBy("customer_id").agg(F.sum("sale_price").alias("m"))
    assert sorted(per_c.collect()) == sorted(want.collect())
