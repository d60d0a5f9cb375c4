"""Customer-grain feature store.

``orders`` is the valid-status fact (order_id, order_item_id, customer_id,
product_id, order_date, sale_price); ``orders_full`` is the same joined left to
the dimensions. All per-customer aggregates are one grouped pass with
conditional aggregation (partial aggregation before the shuffle, so a customer
with a huge share of rows costs no more than any other); the snapshot date is a
one-row aggregate broadcast to the rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CHURN_THRESHOLD_DAYS, lit_date, valid_status
from ..operators.ranking import attach_scalars, value_at, value_counts
from ..operators.topk import top_k_per_group

DEFAULT_WINDOWS = (30, 60)
DEFAULT_LAGS = (1, 2, 3)


def load_valid_orders(fact: DataFrame) -> DataFrame:
    """``load_valid_orders``: valid-status items, the columns the features use."""
    cols = [c for c in ["order_id", "order_item_id", "customer_id", "product_id", "order_date",
                        "sale_price", "status"] if c in fact.columns]
    return fact.filter(valid_status(F.col("status"))).select(*cols)


def load_full(fact: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """``load_full``: valid items LEFT JOIN both dims; customer_id and product_id
    are taken from the dims, so orphans become NULL."""
    item_id = ["order_item_id"] if "order_item_id" in fact.columns else []
    fo = fact.filter(valid_status(F.col("status"))).select(
        "order_id", *item_id, "order_date", "sale_price", "status",
        F.col("customer_id").alias("_fc"), F.col("product_id").alias("_fp"))
    dc = customers.select("customer_id", "age", "gender", "country", "city")
    dp = products.select("product_id", F.col("name").alias("product_name"), "category", "brand",
                         "retail_price", "cost")
    return (fo.join(dc, fo._fc == dc.customer_id, "left")
            .join(dp, F.col("_fp") == dp.product_id, "left")
            .drop("_fc", "_fp"))


def _snapshot(orders: DataFrame, snapshot_date=None) -> DataFrame:
    if snapshot_date is not None:
        return orders.sparkSession.range(1).select(lit_date(snapshot_date).alias("_snap"))
    return orders.agg(F.max("order_date").alias("_snap"))


def customer_aggregates(orders: DataFrame, snapshot_date=None, windows=DEFAULT_WINDOWS) -> DataFrame:
    """create_rfm + behavioral + time windows.

    Two grouped passes, no distinct-expansion: per (customer, order) the window
    flags (an order counts in a window when any of its items falls in it), then
    per customer plain sums. Both levels aggregate map-side first."""
    rows = attach_scalars(orders, _snapshot(orders, snapshot_date))
    snap = F.col("_snap")
    d = F.col("order_date")
    flags = {"_recent": d >= F.date_sub(snap, 90),
             "_prev": (d >= F.date_sub(snap, 180)) & (d < F.date_sub(snap, 90))}
    for w in windows:
        flags[f"_in{w}"] = d >= F.date_sub(snap, w)
    per_order = rows.groupBy("customer_id", "order_id").agg(
        F.max(d).alias("_last"), F.min(d).alias("_first"), F.count(F.lit(1)).alias("_rows"),
        F.sum("sale_price").alias("_amt"), F.first(snap).alias("_snap"),
        *[F.max(c.cast("int")).alias(k) for k, c in flags.items()],
        *[F.sum(F.when(flags[f"_in{w}"], F.col("sale_price"))).alias(f"_spend{w}") for w in windows])
    has_order = F.col("order_id").isNotNull()
    g = per_order.groupBy("customer_id").agg(
        F.max("_last").alias("last_order"), F.min("_first").alias("_first"), F.sum("_rows").alias("_rows"),
        F.count(F.when(has_order, 1)).alias("frequency"), F.sum("_amt").alias("_monetary"),
        F.first("_snap").alias("_snap"),
        F.sum(F.when(has_order, F.col("_recent")).otherwise(0)).alias("orders_last_90d"),
        F.sum(F.when(has_order, F.col("_prev")).otherwise(0)).alias("orders_prev_90d"),
        *[c for w in windows for c in (F.sum(f"_spend{w}").alias(f"_spend_{w}"),
                                       F.sum(F.when(has_order, F.col(f"_in{w}")).otherwise(0)).alias(f"orders_last_{w}d"))])
    out = g.select(
        "customer_id", "last_order",
        F.datediff(F.col("_snap"), F.col("last_order")).cast("long").alias("recency"),
        "frequency",
        F.col("_monetary").cast("double").alias("monetary"),
        (F.col("_monetary").cast("double") / F.greatest(F.col("frequency"), F.lit(1)).cast("double")).alias("avg_order_value"),
        # mean gap between consecutive item rows = (last - first) / (rows - 1): the gaps telescope
        F.when(F.col("_rows") > 1, F.datediff(F.col("last_order"), F.col("_first")).cast("double")
               / (F.col("_rows") - 1).cast("double")).alias("avg_days_between_orders"),
        F.col("orders_last_90d").cast("long").alias("orders_last_90d"),
        F.col("orders_prev_90d").cast("long").alias("orders_prev_90d"),
        (F.col("orders_last_90d") - F.col("orders_prev_90d")).cast("long").alias("purchase_trend"),
        *[c for w in windows for c in (F.coalesce(F.col(f"_spend_{w}"), F.lit(0)).cast("double").alias(f"spend_last_{w}d"),
                                       F.col(f"orders_last_{w}d").cast("long").alias(f"orders_last_{w}d"))],
        F.datediff(F.col("_snap"), F.col("_first")).cast("long").alias("days_since_first_order"))
    if 30 in windows:
        out = out.withColumn("spend_velocity",
                             F.col("spend_last_30d") / F.greatest(F.col("avg_order_value"), F.lit(1.0)))
    return out


def fill_gap_median(feat: DataFrame) -> DataFrame:
    """NULL avg_days_between_orders -> median over customers (mean of the two
    middle values for an even count). Only the distinct gaps and their counts are
    put in order; the median comes back as one value."""
    gap = F.col("avg_days_between_orders")
    counted = value_counts(feat.select(gap.alias("g")).filter("g is not null"), [], "g")
    n = counted.agg(F.sum("n").alias("_n"))
    mid = attach_scalars(counted, n)
    lo, hi = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2)
    med = mid.agg(((value_at(mid, "g", lo) + value_at(mid, "g", hi)) / 2).alias("_median"))
    return attach_scalars(feat, med).withColumn("avg_days_between_orders", F.coalesce(gap, F.col("_median"))).drop("_median")


PRODUCT_FEATURES = ("unique_categories", "unique_products", "last_category")


def product_diversity(orders: DataFrame, customers: DataFrame, products: DataFrame, columns=PRODUCT_FEATURES) -> DataFrame:
    """unique_categories, unique_products, last_category (latest non-null
    category; ties on the date broken by order id, then product id) over the
    valid items of known customers; products missing from the dimension count
    for nothing. The items are reduced to (customer, product) before any
    dimension is joined. Only the named ``columns`` are computed."""
    last = [F.max(F.struct("order_date", "order_id")).alias("_last")] if "last_category" in columns else []
    pairs = orders.filter("customer_id is not null").select("customer_id", "product_id", *(["order_date", "order_id"] if last else []))
    per_cp = pairs.groupBy("customer_id", "product_id").agg(*last) if last else pairs.distinct()
    known = per_cp.join(customers.select("customer_id"), "customer_id", "left_semi")
    dp = products.select(F.col("product_id").alias("_p"), "category")
    j = known.join(dp, F.col("product_id") == F.col("_p"), "left")
    if last:
        latest = F.when(F.col("category").isNotNull(), F.struct("_last", F.col("_p")))
    every = {"unique_categories": lambda: F.countDistinct("category"), "unique_products": lambda: F.countDistinct("_p"),
             "last_category": lambda: F.max_by(F.col("category"), latest)}
    return j.groupBy("customer_id").agg(*[make().alias(c) for c, make in every.items() if c in columns])


def lag_features(orders: DataFrame, lags=DEFAULT_LAGS, salt_buckets: int = 64) -> DataFrame:
    """monetary_lag_k: the sale price k rows before the customer's last item row
    (rows ordered by date, order id, product id, price; rows tied on all four
    have the same price); 0 when the customer has <= k rows."""
    kmax = max(lags) + 1
    order = [F.col("order_date").desc(), F.col("order_id").desc(), F.col("product_id").desc(),
             F.col("sale_price").desc()]
    top = top_k_per_group(orders.select("customer_id", "order_date", "order_id", "product_id", "sale_price"),
                          ["customer_id"], order, kmax,
                          salt_col=F.struct("order_id", "product_id", "sale_price"),
                          salt_buckets=salt_buckets, rank_col="_pos")
    aggs = [F.coalesce(F.max(F.when(F.col("_pos") == k + 1, F.col("sale_price"))).cast("double"), F.lit(0.0))
            .alias(f"monetary_lag_{k}") for k in lags]
    return top.groupBy("customer_id").agg(*aggs)


def channel_mode(channels: DataFrame, customers: DataFrame) -> DataFrame:
    """Most frequent channel of every customer, the smallest value on ties;
    'Unknown' for customers without one."""
    counts = channels.filter(F.col("channel").isNotNull()).groupBy("customer_id", "channel").agg(F.count(F.lit(1)).alias("_n"))
    modes = counts.groupBy("customer_id").agg(
        F.min_by(F.col("channel"), F.struct((-F.col("_n")).alias("n"), F.col("channel").alias("c"))).alias("_mode"))
    return customers.select("customer_id").join(modes, "customer_id", "left").select(
        "customer_id", F.coalesce("_mode", F.lit("Unknown")).alias("primary_channel"))


def item_features(orders: DataFrame) -> DataFrame:
    """total_items and avg_unit_price per customer."""
    return orders.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_items"),
        (F.sum("sale_price").cast("double") / F.count(F.lit(1)).cast("double")).alias("avg_unit_price"))


def churn_label(feat: DataFrame, threshold_days: int = CHURN_THRESHOLD_DAYS) -> DataFrame:
    return feat.withColumn("churn", (F.col("recency") > threshold_days).cast("int"))


def create_rfm(orders: DataFrame, snapshot_date=None) -> DataFrame:
    return customer_aggregates(orders, snapshot_date, windows=()).select(
        "customer_id", "last_order", "recency", "frequency", "monetary", "avg_order_value")


def _once(customers: DataFrame) -> DataFrame:
    """A customer-grain table that is read twice (for a median and for the rows), computed once."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(customers.sparkSession)
    return customers.checkpoint()


def build_rfm_features(orders: DataFrame, snapshot_date=None, churn_threshold: int = CHURN_THRESHOLD_DAYS) -> DataFrame:
    """RFM + behavioral + label."""
    agg = customer_aggregates(orders, snapshot_date, windows=())
    cols = ["customer_id", "last_order", "recency", "frequency", "monetary", "avg_order_value",
            "avg_days_between_orders", "orders_last_90d", "orders_prev_90d", "purchase_trend"]
    return churn_label(fill_gap_median(_once(agg.select(*cols))), churn_threshold)


def build_all_features(orders: DataFrame, customers: DataFrame, products: DataFrame, snapshot_date=None,
                       churn_threshold: int = CHURN_THRESHOLD_DAYS, windows=DEFAULT_WINDOWS, columns=None) -> DataFrame:
    """rfm -> behavioral -> product diversity -> time windows -> label; or only ``customer_id`` and
    the named ``columns``, with no more of these steps than they need. The fact is aggregated once."""
    every = ["last_order", "recency", "frequency", "monetary", "avg_order_value",
             "avg_days_between_orders", "orders_last_90d", "orders_prev_90d", "purchase_trend", *PRODUCT_FEATURES]
    for w in windows:
        every += [f"spend_last_{w}d", f"orders_last_{w}d"]
    every += ["days_since_first_order"] + (["spend_velocity"] if 30 in windows else []) + ["churn"]
    chosen = [c for c in every if columns is None or c in columns]
    needed = [w for w in windows if {f"spend_last_{w}d", f"orders_last_{w}d"} & set(chosen) or (w == 30 and "spend_velocity" in chosen)]
    own = customer_aggregates(orders, snapshot_date, needed)
    own = churn_label(own, churn_threshold).select("customer_id", *[c for c in chosen if c not in PRODUCT_FEATURES])
    feat = fill_gap_median(_once(own)) if "avg_days_between_orders" in chosen else own
    about_products = [c for c in PRODUCT_FEATURES if c in chosen]
    if about_products:
        feat = feat.join(product_diversity(orders, customers, products, about_products), "customer_id", "left")
        for c in set(about_products) - {"last_category"}:
            feat = feat.withColumn(c, F.coalesce(F.col(c), F.lit(1)).cast("long"))
    return feat.select("customer_id", *chosen)
