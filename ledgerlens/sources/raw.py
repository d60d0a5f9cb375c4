"""Raw commerce tables (orders, order_items, users, products) derived from the
TPC-H-style test tables, in the shape the ETL expects. Timestamps that the
source does not have are derived from the order date and the status."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .star import dim_customers, order_item_id, order_items, sale_price, status_from_order
from .tables import Tables


def _ts_after(base, days: int, cond):
    return F.when(cond, base + F.make_dt_interval(F.lit(days))).cast("timestamp_ntz")


def orders_raw(t: Tables) -> DataFrame:
    o = t.orders
    status = status_from_order(F.col("o_orderstatus"), F.col("o_orderpriority"))
    created = F.col("o_orderdate").cast("timestamp_ntz")
    return o.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), status.alias("status"),
        created.alias("created_at")).select(
        "order_id", "user_id", "status", "created_at",
        _ts_after(F.col("created_at"), 12, F.col("status") == "Returned").alias("returned_at"),
        _ts_after(F.col("created_at"), 2, F.col("status").isin("Shipped", "Complete", "Returned")).alias("shipped_at"),
        _ts_after(F.col("created_at"), 5, F.col("status").isin("Complete", "Returned")).alias("delivered_at"))


def order_items_raw(t: Tables) -> DataFrame:
    items = order_items(t)
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    j = items.join(o, items.l_orderkey == o.o_orderkey)
    status = status_from_order(F.col("o_orderstatus"), F.col("o_orderpriority"))
    created = F.col("o_orderdate").cast("timestamp_ntz")
    return j.select(
        order_item_id(F.col("l_orderkey"), F.col("_item_no")).alias("id"),
        F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("product_id"), status.alias("status"),
        sale_price(F.col("l_extendedprice"), F.col("l_discount")).cast("double").alias("sale_price"),
        created.alias("created_at"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("shipped_at"),
        _ts_after(created, 5, status.isin("Complete", "Returned")).alias("delivered_at"),
        _ts_after(created, 12, status == "Returned").alias("returned_at"))


def users_raw(t: Tables) -> DataFrame:
    d = dim_customers(t)
    return d.select(F.col("customer_id").alias("id"), "first_name", "last_name", "email", "gender", "age",
                    "city", "state", F.initcap(F.col("country")).alias("country"),
                    F.col("created_at").cast("timestamp_ntz").alias("created_at"))


def products_raw(t: Tables) -> DataFrame:
    p = t.part
    retail = F.col("p_retailprice").cast("decimal(10,2)")
    return p.select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
        F.lower(F.col("p_type")).alias("category"), F.lower(F.col("p_brand")).alias("brand"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("department"),
        retail.cast("string").alias("retail_price"),
        F.round(retail * F.lit(0.55).cast("decimal(3,2)"), 2).cast("string").alias("cost"))


def raw_tables(t: Tables) -> dict[str, DataFrame]:
    return {"orders": orders_raw(t), "order_items": order_items_raw(t),
            "users": users_raw(t), "products": products_raw(t)}
