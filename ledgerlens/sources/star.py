"""Star schema over the TPC-H-style test tables.

The commerce model of the reference (orders, order items, users, products) is
mapped onto lineitem/orders/customer/part:

* fact grain is the line item; ``order_item_id`` is ``order_id * 2^20 + n`` where
  ``n`` (an order with more items raises) numbers the items of one order (the pair (l_orderkey, l_linenumber) is
  not unique in the data, so the number runs over all item columns);
* status comes from order status and priority;
* ``sale_price`` is exact ``decimal(18,2)``.

Every piece is a lazy DataFrame. At scale the fact would be materialised once by
the ETL (partitioned by order month); the reports only need its columns.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import date_id
from .tables import Tables

# Fixed mapping of (o_orderstatus, o_orderpriority) to the commerce status domain.
STATUS_CANCELLED_PRIORITY = "5-LOW"
STATUS_RETURNED_PRIORITY = "4-NOT SPECIFIED"
#: Items of one order that have room in ``order_item_id``; one more raises.
ITEM_ID_FACTOR = 1 << 20


def status_from_order(orderstatus: Column, priority: Column) -> Column:
    return (F.when((orderstatus == "F") & (priority == STATUS_CANCELLED_PRIORITY), F.lit("Cancelled"))
            .when((orderstatus == "F") & (priority == STATUS_RETURNED_PRIORITY), F.lit("Returned"))
            .when(orderstatus == "F", F.lit("Complete"))
            .when(orderstatus == "O", F.lit("Shipped"))
            .otherwise(F.lit("Processing")))


def sale_price(extendedprice: Column, discount: Column) -> Column:
    gross = extendedprice.cast("decimal(18,2)")
    net = gross * (F.lit(1) - discount.cast("decimal(4,2)"))
    return F.round(net, 2).cast("decimal(18,2)")


LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def order_item_id(order_id: Column, n: Column) -> Column:
    """Unique id of the ``n``-th item of an order; raises where there is no room for it."""
    fits = (n < ITEM_ID_FACTOR) & (order_id < (1 << 63) // ITEM_ID_FACTOR)
    return F.when(fits, order_id * ITEM_ID_FACTOR + n).otherwise(F.raise_error(F.lit("order_item_id out of range")))


def order_items(t: Tables) -> DataFrame:
    """Line items with a per-order item number. The window is partitioned by the
    order key, which is also the join key of the fact, so it reuses that shuffle."""
    w = Window.partitionBy("l_orderkey").orderBy(*[F.col(c) for c in LINEITEM_COLUMNS[1:]])
    return t.lineitem.withColumn("_item_no", F.row_number().over(w))


def fact_orders(t: Tables, with_item_id: bool = True) -> DataFrame:
    """fact_orders: order_id, order_item_id, customer_id, product_id, date_id,
    order_date (date), sale_price decimal(18,2), status."""
    o = t.orders.select(
        F.col("o_orderkey"), F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        status_from_order(F.col("o_orderstatus"), F.col("o_orderpriority")).alias("status"))
    items = order_items(t) if with_item_id else t.lineitem
    f = items.join(o, items.l_orderkey == o.o_orderkey, "inner")
    cols = [F.col("l_orderkey").alias("order_id")]
    if with_item_id:
        cols.append(order_item_id(F.col("l_orderkey"), F.col("_item_no")).alias("order_item_id"))
    cols += [F.col("customer_id"), F.col("l_partkey").alias("product_id"),
             date_id(F.col("order_date")).alias("date_id"), F.col("order_date"),
             sale_price(F.col("l_extendedprice"), F.col("l_discount")).alias("sale_price"),
             F.col("status")]
    return f.select(*cols)


def dim_customers(t: Tables) -> DataFrame:
    """dim_customers: name parts from c_name split at '#', country from the nation.
    gender, age, email, created_at do not exist in the source; they are derived
    deterministically from the key so that the dimension has its full shape."""
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    c = t.customer.select("c_custkey", "c_name", "c_nationkey")
    # nation and region are bounded (25 / 5 rows in TPC-H): broadcast is safe.
    geo = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey, "left")
    d = c.join(F.broadcast(geo), c.c_nationkey == geo.n_nationkey, "left")
    first = F.split_part(F.col("c_name"), F.lit("#"), F.lit(1))
    last = F.split_part(F.col("c_name"), F.lit("#"), F.lit(2))
    return d.select(
        F.col("c_custkey").alias("customer_id"),
        first.alias("first_name"), last.alias("last_name"),
        F.concat(F.lower(first), F.lit("."), last, F.lit("@example.com")).alias("email"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("Female")).otherwise(F.lit("Male")).alias("gender"),
        (F.lit(18) + F.col("c_custkey") % 53).cast("int").alias("age"),
        F.col("n_name").alias("city"), F.col("r_name").alias("state"),
        F.upper(F.col("n_name")).alias("country"),
        F.date_add(F.lit("1994-01-01").cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("created_at"))


def dim_products(t: Tables) -> DataFrame:
    p = t.part
    retail = F.col("p_retailprice").cast("decimal(10,2)")
    return p.select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"),
        F.col("p_type").alias("category"), F.col("p_brand").alias("brand"),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(2)).alias("department"),
        retail.alias("retail_price"),
        F.round(retail * F.lit(0.55).cast("decimal(3,2)"), 2).cast("decimal(10,2)").alias("cost"))


def dim_date_from_bounds(bounds: DataFrame, lo: str = "min_date", hi: str = "max_date") -> DataFrame:
    """Dense calendar between two dates held in a one-row frame (size = days in range)."""
    days = bounds.select(F.explode(F.sequence(F.col(lo), F.col(hi), F.expr("INTERVAL 1 DAY"))).alias("full_date"))
    return days.select(
        date_id(F.col("full_date")).alias("date_id"),
        F.col("full_date"),
        F.year("full_date").alias("year"),
        F.quarter("full_date").alias("quarter"),
        F.month("full_date").alias("month"),
        F.date_format("full_date", "MMMM").alias("month_name"),
        F.weekofyear("full_date").alias("week"),
        (F.weekday("full_date") + 1).alias("day_of_week"),
        F.date_format("full_date", "EEEE").alias("day_name"),
        (F.weekday("full_date") >= 5).alias("is_weekend"))


def dim_date(t: Tables) -> DataFrame:
    bounds = t.orders.agg(F.min(F.col("o_orderdate").cast("date")).alias("min_date"),
                          F.max(F.col("o_orderdate").cast("date")).alias("max_date"))
    return dim_date_from_bounds(bounds)


def customer_channels(t: Tables) -> DataFrame:
    """(customer_id, channel) rows: one per event of the user."""
    return t.events.select(F.col("user_id").alias("customer_id"), F.col("event_type").alias("channel"))


@dataclass
class Star:
    """Lazy star schema (fact + dims) over one data directory."""
    tables: Tables

    @property
    def fact(self) -> DataFrame:
        return fact_orders(self.tables)

    @property
    def fact_slim(self) -> DataFrame:
        """Fact without ``order_item_id`` (avoids the per-order window)."""
        return fact_orders(self.tables, with_item_id=False)

    @property
    def customers(self) -> DataFrame:
        return dim_customers(self.tables)

    @property
    def products(self) -> DataFrame:
        return dim_products(self.tables)

    @property
    def dates(self) -> DataFrame:
        return dim_date(self.tables)

    @property
    def channels(self) -> DataFrame:
        return customer_channels(self.tables)


def load_star(spark, base_dir: str) -> Star:
    return Star(Tables(spark, base_dir))


def materialize_fact(fact: DataFrame, path: str) -> str:
    """Write the fact once, partitioned by order month (``order_month`` = first
    day of the month). Reports over the written table add a matching
    ``order_month`` predicate, so a date range prunes whole partitions."""
    (fact.withColumn("order_month", F.trunc(F.col("order_date"), "month"))
     .write.mode("overwrite").partitionBy("order_month").parquet(path))
    return path


def load_materialized_fact(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)


def materialize_fact_table(fact: DataFrame, table: str, buckets: int) -> str:
    """Write the fact as a catalog table partitioned by order month and bucketed
    (and sorted) by ``customer_id``: per-customer aggregations and joins with
    customer-grain tables bucketed the same way read it without a shuffle."""
    (fact.withColumn("order_month", F.trunc(F.col("order_date"), "month"))
     .write.mode("overwrite").partitionBy("order_month")
     .bucketBy(buckets, "customer_id").sortBy("customer_id").saveAsTable(table))
    return table
