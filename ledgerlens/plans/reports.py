"""Dashboard reports over ``fact_orders ⋈ dims``.

Each report takes the fact (and dims), a date range and an optional list of
RFM segments and returns a DataFrame. Money is summed as exact decimals and
leaves as DOUBLE; averages and shares use exact half-up rounding.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (CHURN_THRESHOLD_DAYS, SEGMENT_CHURN_RISK, coalesce_label,
                                 date_range_filter, lit_date, map_lookup, monetary_bin, money,
                                 ratio_round, segment_display, valid_status)
from ..operators.ranking import attach_scalars, global_row_number, global_running_sums
from .segments import score_rfm, segment_filter


def _valid_range(fact: DataFrame, d_from, d_to, segments=None, only_valid: bool = True) -> DataFrame:
    cond = date_range_filter(F.col("order_date"), d_from, d_to)
    if "order_month" in fact.columns:   # materialized fact: prune month partitions
        cond = cond & (F.col("order_month") <= F.trunc(lit_date(d_to), "month"))
        if d_from is not None:
            cond = cond & (F.col("order_month") >= F.trunc(lit_date(d_from), "month"))
    if only_valid:
        cond = cond & valid_status(F.col("status"))
    seg = segment_filter(fact, d_to, segments)   # scored on all history <= d_to
    out = fact.filter(cond)
    return out if seg is None else out.join(seg, "customer_id", "left_semi")


def kpis(fact: DataFrame, d_from, d_to, segments=None) -> DataFrame:
    """total_customers, orders, revenue, aov, churn_rate_pct.

    Churn is averaged over item rows (a customer weighs by its items). One pass
    over the fact: items to orders to customers to the total. An order belongs
    to one customer, so the customers' orders add up; a NULL customer counts
    with its items but is no customer."""
    base = _valid_range(fact, d_from, d_to, segments)
    per_order = base.groupBy("customer_id", "order_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("order_date").alias("last"), F.sum("sale_price").alias("amount"))
    per_cust = per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("orders"), F.sum("n").alias("n_items"), F.max("last").alias("last_order"),
        F.sum("amount").alias("amount"))
    churned = F.datediff(lit_date(d_to), F.col("last_order")) > CHURN_THRESHOLD_DAYS
    both = per_cust.agg(F.count("customer_id").alias("total_customers"),
                        F.coalesce(F.sum("orders"), F.lit(0)).cast("long").alias("orders"),
                        F.sum("n_items").alias("_items"),
                        F.sum(F.when(churned, F.col("n_items")).otherwise(0)).alias("_churn_items"),
                        F.coalesce(F.sum("amount"), F.lit(0)).alias("_revenue"))
    return both.select(
        F.col("total_customers"), F.col("orders"),
        money(F.col("_revenue")).alias("revenue"),
        F.coalesce(ratio_round(F.col("_revenue"), F.col("orders"), 2), F.lit(0.0)).alias("aov"),
        F.coalesce(ratio_round(F.col("_churn_items") * 100, F.col("_items"), 1), F.lit(0.0)).alias("churn_rate_pct"))


def insights(fact: DataFrame, d_from, d_to, segments=None) -> DataFrame:
    """Customer-level summary with the Pareto share of the top 20 % by
    PERCENT_RANK (rows with percent rank <= .2 are the values >= the K-th
    largest, K = floor((n-1)/5) + 1). The per-customer rows are ranked once
    (checkpointed) and every total is read from them."""
    base = _valid_range(fact, d_from, d_to, segments)
    stats = (base.groupBy("customer_id")
             .agg(F.sum("sale_price").alias("monetary"), F.max("order_date").alias("last_order"))
             .withColumn("recency", F.datediff(lit_date(d_to), F.col("last_order"))))
    ranked = global_row_number(stats, [F.col("monetary").desc(), F.col("customer_id").asc()],
                               rn_col="_rn", total_col="_n")
    k = F.floor((F.col("_n") - 1) / 5) + 1
    threshold = ranked.filter(F.col("_rn") <= k).agg(F.min("monetary").alias("threshold"))
    out = attach_scalars(ranked, threshold).agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.coalesce(F.sum("monetary"), F.lit(0)).alias("_revenue"),
        F.coalesce(F.sum("recency"), F.lit(0)).alias("_recency"),
        F.coalesce(F.sum(F.when(F.col("recency") > CHURN_THRESHOLD_DAYS, 1).otherwise(0)), F.lit(0)).alias("_churned"),
        F.coalesce(F.sum(F.when(F.col("monetary") >= F.col("threshold"), F.col("monetary"))), F.lit(0)).alias("_top"))
    n = F.col("total_customers")
    return out.select(
        n.alias("total_customers"),
        money(F.col("_revenue")).alias("total_revenue"),
        F.coalesce(ratio_round(F.col("_revenue"), n, 2), F.lit(0.0)).alias("avg_monetary"),
        F.coalesce(ratio_round(F.col("_recency"), n, 1), F.lit(0.0)).alias("avg_recency_days"),
        F.coalesce(ratio_round(F.col("_churned") * 100, n, 1), F.lit(0.0)).alias("churn_rate_pct"),
        F.coalesce(ratio_round(F.col("_top") * 100, F.col("_revenue"), 1), F.lit(0.0)).alias("pareto_top20_pct"))


def date_bounds(fact: DataFrame) -> DataFrame:
    """min/max order date, defaulting to 2022-01-01 .. 2024-12-31 when empty."""
    return fact.agg(F.coalesce(F.min("order_date"), lit_date("2022-01-01")).alias("min_date"),
                    F.coalesce(F.max("order_date"), lit_date("2024-12-31")).alias("max_date"))


def trend(fact: DataFrame, d_from, d_to, granularity: str = "Monthly", segments=None) -> DataFrame:
    unit = "month" if granularity.lower() == "monthly" else "week"
    base = _valid_range(fact, d_from, d_to, segments)
    return (base.groupBy(F.to_date(F.date_trunc(unit, F.col("order_date"))).alias("period"))
            .agg(money(F.sum("sale_price")).alias("revenue"), F.countDistinct("order_id").alias("orders"))
            .orderBy("period"))


def status_breakdown(fact: DataFrame, d_from, d_to, segments=None) -> DataFrame:
    """Item count and revenue per status, all statuses (NULL -> 'Unknown')."""
    base = _valid_range(fact, d_from, d_to, segments, only_valid=False)
    return (base.groupBy(coalesce_label(F.col("status"), "Unknown").alias("status"))
            .agg(F.count(F.lit(1)).alias("cnt"), money(F.sum("sale_price")).alias("revenue"))
            .orderBy(F.col("revenue").desc(), F.col("status")))


def top_products(fact: DataFrame, products: DataFrame, d_from, d_to, limit: int = 25,
                 segments=None) -> DataFrame:
    """Top-N products by revenue: aggregate, take N (ties by product_id), then join
    the dimension — the limit runs before the join."""
    base = _valid_range(fact, d_from, d_to, segments)
    top = (base.groupBy("product_id")
           .agg(F.sum("sale_price").alias("_rev"), F.count(F.lit(1)).alias("units"))
           .orderBy(F.col("_rev").desc(), F.col("product_id").asc())
           .limit(limit))
    dp = products.select("product_id", "name", "category", "brand")
    return (dp.join(F.broadcast(top), "product_id")      # top: at most ``limit`` rows
            .select("product_id",
                    coalesce_label(F.col("name"), "Unknown Product").alias("product"),
                    coalesce_label(F.col("category"), "Unknown Category").alias("category"),
                    coalesce_label(F.col("brand"), "Unknown Brand").alias("brand"),
                    money(F.col("_rev")).alias("revenue"), F.col("units"))
            .orderBy(F.col("revenue").desc(), F.col("product_id")))


def categories(fact: DataFrame, products: DataFrame, d_from, d_to, segments=None) -> DataFrame:
    """Revenue, item count ("orders") and average item price per category."""
    base = _valid_range(fact, d_from, d_to, segments)
    per_product = base.groupBy("product_id").agg(F.sum("sale_price").alias("_rev"), F.count(F.lit(1)).alias("_n"))
    joined = per_product.join(products.select("product_id", "category"), "product_id")
    agg = joined.groupBy("category").agg(F.sum("_rev").alias("_rev"), F.sum("_n").alias("orders"))
    return (agg.select(coalesce_label(F.col("category"), "Unknown Category").alias("category"),
                       money(F.col("_rev")).alias("revenue"), F.col("orders"),
                       ratio_round(F.col("_rev"), F.col("orders"), 2).alias("avg_price"))
            .orderBy(F.col("revenue").desc(), F.col("category")))


def rfm_scored(fact: DataFrame, d_from, d_to, as_of=None, segments=None,
               recency_tiebreak: bool = True) -> DataFrame:
    """Customers in the range with r/f/m scores and segment keys. ``as_of``
    replaces the reference's CURRENT_DATE (default d_to)."""
    as_of = as_of or d_to
    base = _valid_range(fact, d_from, d_to, segments)
    rfm = (base.groupBy("customer_id")
           .agg(F.countDistinct("order_id").alias("frequency"), F.sum("sale_price").alias("monetary"),
                F.max("order_date").alias("last_order"))
           .withColumn("recency", F.datediff(lit_date(as_of), F.col("last_order"))).drop("last_order"))
    return score_rfm(rfm, recency_tiebreak=recency_tiebreak)


def rfm_distribution(fact: DataFrame, d_from, d_to, as_of=None, segments=None) -> DataFrame:
    """Customers per (segment, frequency, monetary bin of 50) with mean recency."""
    scored = rfm_scored(fact, d_from, d_to, as_of, segments)
    binned = scored.withColumn("monetary_bin", monetary_bin(F.col("monetary")))
    return (binned.groupBy("segment_key", "frequency", "monetary_bin")
            .agg(F.sum("recency").alias("_rsum"), F.count(F.lit(1)).alias("cnt"))
            .select(segment_display(F.col("segment_key")).alias("segment"), "segment_key", "frequency",
                    F.col("monetary_bin").cast("double").alias("monetary"),
                    ratio_round(F.col("_rsum"), F.col("cnt"), 1).alias("recency"), "cnt")
            .orderBy("segment_key", "frequency", "monetary"))


def segment_categories(fact: DataFrame, products: DataFrame, d_from, d_to, as_of=None,
                       segments=None) -> DataFrame:
    """Best-selling category (item count) per segment; scores without the
    recency tie-break, ties between categories by name."""
    scored = rfm_scored(fact, d_from, d_to, as_of, segments, recency_tiebreak=False)
    base = _valid_range(fact, d_from, d_to, segments)
    # pre-aggregate items per (customer, product) before any join
    per_cp = base.groupBy("customer_id", "product_id").agg(F.count(F.lit(1)).alias("_n"))
    cats = per_cp.join(products.select("product_id", "category"), "product_id")
    per_cc = cats.groupBy("customer_id", "category").agg(F.sum("_n").alias("_n"))
    seg_cat = (per_cc.join(scored.select("customer_id", "segment_key"), "customer_id")
               .groupBy("segment_key", "category").agg(F.sum("_n").alias("txn_count")))
    w = Window.partitionBy("segment_key").orderBy(F.col("txn_count").desc(), F.col("category").asc())
    return (seg_cat.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1)
            .select(segment_display(F.col("segment_key")).alias("segment"), "segment_key", "category",
                    "txn_count"))


# ---------------------------------------------------------------- roll-ups ---

def segment_rollup(rfm_bins: DataFrame) -> DataFrame:
    """Per segment: customers, revenue (bin x count) and the fixed churn-risk
    weight, highest risk first."""
    return (rfm_bins.groupBy("segment_key")
            .agg(F.sum("cnt").alias("customers"),
                 F.sum(F.col("monetary").cast("decimal(20,2)") * F.col("cnt")).alias("revenue"))
            .select(segment_display(F.col("segment_key")).alias("segment"), "segment_key", "customers",
                    money(F.col("revenue")).alias("revenue"), map_lookup(F.col("segment_key"), SEGMENT_CHURN_RISK, 50).alias("churn_risk"))
            .orderBy(F.col("churn_risk").desc()))


def at_risk_totals(rfm_bins: DataFrame) -> DataFrame:
    at_risk = F.col("segment_key").isin("At Risk", "Lost")
    return rfm_bins.agg(
        F.coalesce(F.sum(F.when(at_risk, F.col("cnt"))), F.lit(0)).alias("at_risk_customers"),
        money(F.coalesce(F.sum(F.when(at_risk, F.col("monetary").cast("decimal(20,2)") * F.col("cnt"))),
                         F.lit(0))).alias("at_risk_revenue"),
        F.coalesce(F.sum("cnt"), F.lit(0)).alias("total_customers"))


def pareto_curve(rfm_bins: DataFrame, max_points: int = 100) -> DataFrame:
    """Cumulative customer and revenue shares over bins by monetary desc, with a
    leading (0, 0) point, thinned to about ``max_points`` keeping the last."""
    bins = rfm_bins.select("segment_key", "frequency", "monetary", "cnt",
                           (F.col("monetary").cast("decimal(20,2)") * F.col("cnt")).alias("rev"))
    order = [F.col("monetary").desc(), F.col("segment_key").asc(), F.col("frequency").asc()]
    run = global_running_sums(bins, order, ["cnt", "rev"], rn_col="idx", total_col="_bins")
    totals = bins.agg(F.sum("cnt").alias("_tc"), F.sum("rev").alias("_tr"), F.count(F.lit(1)).alias("_nb"))
    pts = attach_scalars(run.select("idx", "cum_cnt", "cum_rev"), totals)
    origin = totals.select(F.lit(0).cast("long").alias("idx"), F.lit(0).cast("long").alias("cum_cnt"),
                           F.lit(0).cast("decimal(30,2)").alias("cum_rev"), "_tc", "_tr", "_nb")
    allpts = pts.select("idx", "cum_cnt", F.col("cum_rev").cast("decimal(30,2)").alias("cum_rev"),
                        "_tc", "_tr", "_nb").unionByName(origin)
    length = F.col("_nb") + 1
    step = F.greatest(F.lit(1), F.ceil(length / F.lit(max_points)))
    keep = (F.col("idx") % step == 0) | (F.col("idx") == length - 1)
    return (allpts.filter(keep)
            .select("idx",
                    F.coalesce(ratio_round(F.col("cum_cnt") * 100, F.col("_tc"), 1), F.lit(0.0)).alias("pct_customers"),
                    F.coalesce(ratio_round(F.col("cum_rev") * 100, F.col("_tr"), 1), F.lit(0.0)).alias("pct_revenue"))
            .orderBy("idx"))


def brand_rollup(top: DataFrame, limit: int = 15) -> DataFrame:
    """Revenue and units per brand over the returned top-N product rows."""
    return (top.groupBy(coalesce_label(F.col("brand"), "Unknown").alias("brand"))
            .agg(money(F.sum(F.col("revenue").cast("decimal(20,2)"))).alias("revenue"), F.sum("units").alias("units"))
            .orderBy(F.col("revenue").desc(), F.col("brand")).limit(limit))


def category_bars(cats: DataFrame, limit: int = 20) -> DataFrame:
    """Categories with revenue > 0, first 20 in revenue order."""
    return (cats.filter(F.col("revenue") > 0)
            .orderBy(F.col("revenue").desc(), F.col("category")).limit(limit)
            .select("category", "revenue", "orders"))


def top_customers(rfm: DataFrame, limit: int = 10) -> DataFrame:
    """Top N (1..100) customers of the RFM table by monetary value."""
    limit = max(1, min(100, int(limit)))
    cols = [c for c in ["customer_id", "recency", "frequency", "monetary", "segment"] if c in rfm.columns]
    return rfm.select(*cols).orderBy(F.col("monetary").desc(), F.col("customer_id")).limit(limit)


def segment_statistics(scored: DataFrame, segment_col: str = "segment_key") -> DataFrame:
    """Per segment: customers and their share, mean recency / frequency /
    monetary, revenue and its share (shares in percent, 2 dp)."""
    per = scored.groupBy(segment_col).agg(
        F.count(F.lit(1)).alias("customers"), F.sum("recency").alias("_r"), F.sum("frequency").alias("_f"),
        F.sum(F.col("monetary").cast("decimal(38,2)")).alias("_m"))
    tot = per.agg(F.sum("customers").alias("_tc"), F.sum("_m").alias("_tm"))
    j = attach_scalars(per, tot)
    return j.select(segment_col, "customers",
                    ratio_round(F.col("customers") * 100, F.col("_tc"), 2).alias("customers_pct"),
                    ratio_round(F.col("_r"), F.col("customers"), 2).alias("avg_recency"),
                    ratio_round(F.col("_f"), F.col("customers"), 2).alias("avg_frequency"),
                    ratio_round(F.col("_m"), F.col("customers"), 2).alias("avg_monetary"),
                    money(F.col("_m")).alias("revenue"),
                    ratio_round(F.col("_m") * 100, F.col("_tm"), 2).alias("revenue_pct"))


def revenue_at_risk(scored: DataFrame, risk_col: str = "risk_level") -> DataFrame:
    """Customers and revenue per risk level, with shares of the totals."""
    return segment_statistics(scored.withColumn("recency", F.col("recency").cast("double")), risk_col) \
        .select(risk_col, "customers", "customers_pct", "revenue", "revenue_pct")


def revenue_by_month_top5(fact: DataFrame, dates: DataFrame, limit: int = 5) -> DataFrame:
    """Load check: items and revenue per calendar month (all statuses), top 5."""
    n = F.count("order_item_id") if "order_item_id" in fact.columns else F.count(F.lit(1))
    per_day = fact.groupBy("date_id").agg(n.alias("_n"), F.sum("sale_price").alias("_v"))
    j = per_day.join(F.broadcast(dates.select("date_id", "year", "month", "month_name")), "date_id")
    return (j.groupBy("year", "month", "month_name").agg(F.sum("_n").alias("total_transactions"),
                                                         F.sum("_v").alias("_v"))
            .orderBy(F.col("_v").desc(), "year", "month").limit(limit)
            .select("year", "month_name", "total_transactions", money(F.col("_v")).alias("total_revenue")))


def bestseller_top5(fact: DataFrame, products: DataFrame, limit: int = 5) -> DataFrame:
    """Load check: items sold per (product name, category), all statuses, top 5."""
    n = F.count("order_item_id") if "order_item_id" in fact.columns else F.count(F.lit(1))
    per_p = fact.groupBy("product_id").agg(n.alias("_n"), F.sum("sale_price").alias("_v"))
    j = per_p.join(products.select("product_id", "name", "category"), "product_id")
    return (j.groupBy("name", "category").agg(F.sum("_n").alias("units_sold"), F.sum("_v").alias("_v"))
            .orderBy(F.col("units_sold").desc(), "name", "category").limit(limit)
            .select(F.col("name").alias("product"), "category", "units_sold", money(F.col("_v")).alias("total_revenue")))
