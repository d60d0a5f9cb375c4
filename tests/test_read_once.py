"""What a query reads many times is joined and cleaned once."""
from pyspark.sql import functions as F

from ledgerlens import catalog
from ledgerlens.plans import etl
from ledgerlens.sources import sinks

from .conftest import SF_SMALL


def _analyzed(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_numbering_does_not_clean_the_items_again(spark):
    made = spark.range(50).select((F.col("id") * 3 % 50).alias("id"), F.col("id").alias("order_id"), F.lit(1).alias("user_id"), F.lit(2).alias("product_id"),
                                  F.lit(1.5).alias("sale_price"), F.expr("sha2(string(id), 256)").alias("_costly"))
    items = made.filter("_costly <> ''")
    orders = spark.range(50).select(F.col("id").alias("order_id"), F.lit("x").alias("status"), F.lit("2000-01-01").cast("timestamp_ntz").alias("created_at"))
    fact = etl.build_fact_orders(items, orders)
    assert "sha2" not in _analyzed(fact)
    assert [tuple(r) for r in fact.select("fact_id", "order_item_id").orderBy("fact_id").collect()] == [(i + 1, i) for i in range(50)]


def test_repeated_loads_and_reports_share_one_star(spark, monkeypatch):
    seen = []
    load, kpis = sinks.load_all, catalog.R.kpis
    monkeypatch.setattr(sinks, "load_all", lambda tables, *more: seen.extend(tables.values()) or load(tables, *more))
    monkeypatch.setattr(catalog.R, "kpis", lambda fact, *more, **named: seen.append(fact) or kpis(fact, *more, **named))
    catalog.queries()["load_all"](spark, SF_SMALL)
    catalog.queries()["kpis_stored_segments"](spark, SF_SMALL)
    seen.append(catalog.queries()["audit_recompute"](spark, SF_SMALL))
    assert len(seen) >= 16 and not [df for df in seen if "l_extendedprice" in _analyzed(df)]
