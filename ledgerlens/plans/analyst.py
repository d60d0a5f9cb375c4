"""Analyst questions: the five gold text-to-SQL answers, the prompt catalogue
expressed as DataFrame plans, audits, and a trend forecast / anomaly check."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (CHURN_THRESHOLD_DAYS, lit_date, money, ratio_round, valid_status)
from ..operators.ranking import attach_scalars, global_row_number
from . import reports as R
from .segments import segment_customers


def _valid(fact: DataFrame) -> DataFrame:
    return fact.filter(valid_status(F.col("status")))


def top_customers_by_name(fact: DataFrame, customers: DataFrame, limit: int = 5,
                          value_name: str = "total_revenue") -> DataFrame:
    """Gold 1 / 5: valid revenue grouped by (first_name, last_name) — namesakes
    merge, as in the gold SQL; pre-aggregated per customer before the join."""
    per_c = _valid(fact).groupBy("customer_id").agg(F.sum("sale_price").alias("_v"))
    j = per_c.join(customers.select("customer_id", "first_name", "last_name"), "customer_id")
    return (j.groupBy("first_name", "last_name").agg(F.sum("_v").alias("_v"))
            .orderBy(F.col("_v").desc(), "first_name", "last_name").limit(limit)
            .select("first_name", "last_name", money(F.col("_v")).alias(value_name)))


def monthly_revenue_year(fact: DataFrame, dates: DataFrame, year: int) -> DataFrame:
    """Gold 2: valid revenue per month of a year via dim_date."""
    dd = dates.filter(F.col("year") == year).select("date_id", "month", "month_name")
    per_day = _valid(fact).groupBy("date_id").agg(F.sum("sale_price").alias("_v"))
    return (per_day.join(F.broadcast(dd), "date_id")
            .groupBy("month", "month_name").agg(money(F.sum("_v")).alias("monthly_revenue"))
            .orderBy("month"))


def top_categories_items(fact: DataFrame, products: DataFrame, limit: int = 5) -> DataFrame:
    """Gold 3: COUNT(order_item_id) per category, all statuses (COUNT(*) when the
    fact carries no item id: the id is never NULL)."""
    n = F.count("order_item_id") if "order_item_id" in fact.columns else F.count(F.lit(1))
    per_p = fact.groupBy("product_id").agg(n.alias("_n"))
    return (per_p.join(products.select("product_id", "category"), "product_id")
            .groupBy("category").agg(F.sum("_n").alias("total_orders"))
            .orderBy(F.col("total_orders").desc(), "category").limit(limit))


def customers_by_country(customers: DataFrame, limit: int = 10) -> DataFrame:
    """Gold 4."""
    return (customers.groupBy("country").agg(F.count("customer_id").alias("total_customers"))
            .orderBy(F.col("total_customers").desc(), "country").limit(limit))


def revenue_in_year(fact: DataFrame, year: int) -> DataFrame:
    """1.1 total valid revenue of a year."""
    f = _valid(fact).filter((F.col("order_date") >= lit_date(f"{year}-01-01")) &
                            (F.col("order_date") < lit_date(f"{year + 1}-01-01")))
    return f.agg(money(F.coalesce(F.sum("sale_price"), F.lit(0))).alias("total_revenue"))


def orders_in_month(fact: DataFrame, year: int, month: int) -> DataFrame:
    """1.2 distinct orders placed in a month (all statuses)."""
    start = lit_date(f"{year}-{month:02d}-01")
    f = fact.filter((F.col("order_date") >= start) & (F.col("order_date") < F.add_months(start, 1)))
    return f.agg(F.countDistinct("order_id").alias("total_orders"))


def top_categories_orders(fact: DataFrame, products: DataFrame, limit: int = 5) -> DataFrame:
    """1.3 categories by number of distinct orders (all statuses)."""
    per = fact.select("order_id", "product_id").join(products.select("product_id", "category"), "product_id")
    return (per.groupBy("category").agg(F.countDistinct("order_id").alias("transactions"))
            .orderBy(F.col("transactions").desc(), "category").limit(limit))


def customers_count(customers: DataFrame) -> DataFrame:
    """1.4 distinct customers in the dimension."""
    return customers.agg(F.countDistinct("customer_id").alias("total_customers"))


def top_spenders_by_id(fact: DataFrame, customers: DataFrame, limit: int = 5) -> DataFrame:
    """2.1 top customers by valid spend, all time."""
    per_c = (_valid(fact).groupBy("customer_id").agg(F.sum("sale_price").alias("_v"))
             .orderBy(F.col("_v").desc(), "customer_id").limit(limit))
    return (per_c.join(customers.select("customer_id", "first_name", "last_name"), "customer_id", "left")
            .select("customer_id", "first_name", "last_name", money(F.col("_v")).alias("total_spend")))


def monthly_performance(fact: DataFrame, year: int) -> DataFrame:
    """2.2 revenue and distinct orders per month of a year."""
    return R.trend(fact, f"{year}-01-01", f"{year}-12-31", "Monthly").select(
        F.col("period").alias("month"), "revenue", "orders")


def brand_avg_price(fact: DataFrame, products: DataFrame, limit: int = 5) -> DataFrame:
    """2.3 brands with the highest average valid sale price."""
    per_p = _valid(fact).groupBy("product_id").agg(F.sum("sale_price").alias("_s"), F.count(F.lit(1)).alias("_n"))
    b = (per_p.join(products.select("product_id", "brand"), "product_id")
         .groupBy("brand").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n")))
    exact = F.col("_s").cast("double") / F.col("_n").cast("double")
    return (b.orderBy(exact.desc(), "brand").limit(limit)
            .select("brand", ratio_round(F.col("_s"), F.col("_n"), 2).alias("avg_price"), F.col("_n").alias("items")))


def aov_by_month(fact: DataFrame, d_from: str, d_to: str) -> DataFrame:
    """2.4 monthly AOV = revenue / distinct orders."""
    base = _valid(fact).filter((F.col("order_date") >= lit_date(d_from)) & (F.col("order_date") <= lit_date(d_to)))
    return (base.groupBy(F.to_date(F.date_trunc("month", F.col("order_date"))).alias("month"))
            .agg(F.sum("sale_price").alias("_s"), F.countDistinct("order_id").alias("orders"))
            .select("month", "orders", ratio_round(F.col("_s"), F.col("orders"), 2).alias("aov"))
            .orderBy("month"))


def segment_compare(fact: DataFrame, as_of: str) -> DataFrame:
    """3.1 per RFM segment: customers, mean distinct orders, total valid spend."""
    seg = segment_customers(fact, as_of)
    per_c = (_valid(fact).filter(F.col("order_date") < F.date_add(lit_date(as_of), 1))
             .groupBy("customer_id").agg(F.countDistinct("order_id").alias("_f"), F.sum("sale_price").alias("_m")))
    j = per_c.join(seg, "customer_id")
    return (j.groupBy("segment_key").agg(F.count(F.lit(1)).alias("customers"), F.sum("_f").alias("_f"),
                                         F.sum("_m").alias("_m"))
            .select("segment_key", "customers", ratio_round(F.col("_f"), F.col("customers"), 2).alias("avg_transactions"),
                    money(F.col("_m")).alias("total_spend")))


def repeat_rate(fact: DataFrame) -> DataFrame:
    """3.2 share of customers with more than one valid order (percent, 2 dp)."""
    per_c = _valid(fact).groupBy("customer_id").agg(F.countDistinct("order_id").alias("_f"))
    agg = per_c.agg(F.count(F.lit(1)).alias("customers"),
                    F.sum(F.when(F.col("_f") > 1, 1).otherwise(0)).alias("repeat_customers"))
    return agg.select("customers", "repeat_customers",
                      F.coalesce(ratio_round(F.col("repeat_customers") * 100, F.col("customers"), 2),
                                 F.lit(0.0)).alias("repeat_rate_pct"))


def category_share(fact: DataFrame, products: DataFrame, months: int = 6) -> DataFrame:
    """3.3 category share of monthly valid revenue over the last ``months``
    months of data; the month total is a window over the aggregated rows."""
    v = _valid(fact)
    last = v.agg(F.to_date(F.date_trunc("month", F.max("order_date"))).alias("_last"))
    rows = attach_scalars(v.select("order_date", "product_id", "sale_price"), last)
    rows = rows.filter(F.col("order_date") >= F.add_months(F.col("_last"), -(months - 1)))
    per_p = rows.groupBy(F.to_date(F.date_trunc("month", F.col("order_date"))).alias("month"), "product_id") \
        .agg(F.sum("sale_price").alias("_v"))
    mc = (per_p.join(products.select("product_id", "category"), "product_id")
          .groupBy("month", "category").agg(F.sum("_v").alias("_v")))
    w = Window.partitionBy("month")
    return mc.select("month", "category", money(F.col("_v")).alias("revenue"),
                     ratio_round(F.col("_v") * 100, F.sum("_v").over(w), 2).alias("share_pct"))


def inter_purchase_days(fact: DataFrame, as_of: str, segment: str = "Champion") -> DataFrame:
    """4.3 mean days between consecutive distinct orders of a segment's
    customers. Gaps between consecutive orders sum to last - first per
    customer, so the pooled mean needs no ordered window."""
    seg = segment_customers(fact, as_of).filter(F.col("segment_key") == segment).select("customer_id")
    orders = (_valid(fact).filter(F.col("order_date") < F.date_add(lit_date(as_of), 1))
              .groupBy("customer_id", "order_id").agg(F.min("order_date").alias("_d")))
    per_c = (orders.join(seg, "customer_id", "left_semi").groupBy("customer_id")
             .agg(F.count(F.lit(1)).alias("_n"), F.datediff(F.max("_d"), F.min("_d")).alias("_span")))
    agg = per_c.agg(F.count(F.lit(1)).alias("customers"), F.sum(F.col("_n") - 1).alias("gaps"),
                    F.sum("_span").alias("_days"))
    return agg.select("customers", F.coalesce(F.col("gaps"), F.lit(0)).alias("gaps"),
                      ratio_round(F.col("_days"), F.col("gaps"), 2).alias("avg_days_between_orders"))


# ------------------------------------------------------------------- audits ---

def audit_recompute(fact: DataFrame, products: DataFrame, d_from: str, d_to: str) -> DataFrame:
    """Recompute revenue, orders, customers, AOV, churn %, the top category and
    its revenue, and the Pareto share from the rows and compare them with the
    report values (the reports' top category and revenue are those of their
    first product)."""
    rows = fact.filter((F.col("order_date") >= lit_date(d_from)) &
                       (F.col("order_date") < F.date_add(lit_date(d_to), 1)) & valid_status(F.col("status")))
    gt = rows.agg(F.sum("sale_price").alias("_rev"), F.countDistinct("order_id").alias("_orders"),
                  F.countDistinct("customer_id").alias("_cust"))
    per_c = rows.groupBy("customer_id").agg(F.max("order_date").alias("_last"))
    churn = per_c.agg(F.count(F.lit(1)).alias("_n"),
                      F.sum(F.when(F.datediff(lit_date(d_to), F.col("_last")) > CHURN_THRESHOLD_DAYS, 1)
                            .otherwise(0)).alias("_churned"))
    top_cat = (rows.groupBy("product_id").agg(F.sum("sale_price").alias("_v"))
               .join(products.select("product_id", "category"), "product_id")
               .groupBy("category").agg(F.sum("_v").alias("_v"))
               .orderBy(F.col("_v").desc(), "category").limit(1)
               .select(F.col("category").alias("_gt_cat"), F.col("_v").alias("_gt_cat_rev")))
    app = R.kpis(fact, d_from, d_to)
    ins = R.insights(fact, d_from, d_to).select(F.col("churn_rate_pct").alias("_app_churn"),
                                                F.col("pareto_top20_pct").alias("_app_pareto"))
    heads = audit_pareto_headcount(fact, d_from, d_to).select(F.col("pareto_top20_pct").alias("_gt_pareto"))
    app_top = R.top_products(fact, products, d_from, d_to, limit=5).limit(1) \
        .select(F.col("category").alias("_app_cat"), F.col("revenue").alias("_app_cat_rev"))
    one = attach_scalars(attach_scalars(attach_scalars(attach_scalars(gt, churn), app), ins), top_cat)
    one = attach_scalars(attach_scalars(one, app_top), heads)
    gt_aov = ratio_round(F.col("_rev"), F.col("_orders"), 2)
    gt_churn = ratio_round(F.col("_churned") * 100, F.col("_n"), 1)
    def metric(name, gt, app, passed, gt_label=None, app_label=None):
        return F.struct(F.lit(name).alias("metric"), gt.cast("double").alias("ground_truth"),
                        app.cast("double").alias("app"),
                        (gt_label if gt_label is not None else F.lit(None)).cast("string").alias("ground_truth_label"),
                        (app_label if app_label is not None else F.lit(None)).cast("string").alias("app_label"),
                        passed.alias("passed"))

    none = F.lit(None)
    metrics = F.array(
        metric("revenue", money(F.col("_rev")), F.col("revenue"), F.abs(money(F.col("_rev")) - F.col("revenue")) < 1),
        metric("orders", F.col("_orders"), F.col("orders"), F.col("_orders") == F.col("orders")),
        metric("customers", F.col("_cust"), F.col("total_customers"), F.col("_cust") == F.col("total_customers")),
        metric("aov", gt_aov, F.col("aov"), F.abs(gt_aov - F.col("aov")) < 1),
        metric("churn_rate_pct", gt_churn, F.col("_app_churn"), F.abs(gt_churn - F.col("_app_churn")) < 0.2),
        metric("top_category", none, none, F.col("_gt_cat") == F.col("_app_cat"), F.col("_gt_cat"), F.col("_app_cat")),
        metric("top_category_revenue", money(F.col("_gt_cat_rev")), F.col("_app_cat_rev"),
               F.abs(money(F.col("_gt_cat_rev")) - F.col("_app_cat_rev")) < 1),
        metric("pareto_top20_pct", F.col("_gt_pareto"), F.col("_app_pareto"),
               F.abs(F.col("_gt_pareto") - F.col("_app_pareto")) < 0.2))
    return one.select(F.explode(metrics).alias("m")).select("m.*")


def audit_pareto_headcount(fact: DataFrame, d_from: str, d_to: str) -> DataFrame:
    """Share of revenue of the top int(0.2 n) customers by spend (head-count
    cut, one customer off the PERCENT_RANK cut in some sizes)."""
    rows = fact.filter((F.col("order_date") >= lit_date(d_from)) &
                       (F.col("order_date") < F.date_add(lit_date(d_to), 1)) & valid_status(F.col("status")))
    per_c = rows.groupBy("customer_id").agg(F.sum("sale_price").alias("clv"))
    ranked = global_row_number(per_c, [F.col("clv").desc(), F.col("customer_id").asc()], rn_col="_rn", total_col="_n")
    agg = ranked.agg(F.count(F.lit(1)).alias("customers"),
                     F.sum(F.when(F.col("_rn") <= F.floor(F.col("_n") * 2 / 10), F.col("clv"))).alias("_top"),
                     F.sum("clv").alias("_tot"))
    return agg.select("customers", F.floor(F.col("customers") * 2 / 10).cast("long").alias("top_customers"),
                      F.coalesce(ratio_round(F.coalesce(F.col("_top"), F.lit(0)) * 100, F.col("_tot"), 1),
                                 F.lit(0.0)).alias("pareto_top20_pct"))


# ------------------------------------------------------- forecast, anomaly ---

def daily_revenue(fact: DataFrame) -> DataFrame:
    return _valid(fact).groupBy(F.col("order_date").alias("day")).agg(F.sum("sale_price").alias("revenue"))


def forecast_revenue(fact: DataFrame, horizon: int = 14) -> DataFrame:
    """Daily revenue = least-squares line on the day index + mean residual of
    the weekday, for ``horizon`` days after the last day. The regression is
    solved in exact integer arithmetic (cents), so results are reproducible."""
    d = daily_revenue(fact).withColumn("_cents", (F.col("revenue") * 100).cast("decimal(38,0)"))
    first = d.agg(F.min("day").alias("_d0"), F.max("day").alias("_d1"))
    d = attach_scalars(d, first).withColumn("x", F.datediff(F.col("day"), F.col("_d0")).cast("decimal(38,0)"))
    s = d.agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("n"), F.sum("x").alias("sx"), F.sum("_cents").alias("sy"),
              F.sum(F.col("x") * F.col("_cents")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    coef = s.select(((F.col("n") * F.col("sxx")) - F.col("sx") * F.col("sx")).alias("den"),
                    (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")).alias("b_num"),
                    (F.col("sy") * F.col("sxx") - F.col("sx") * F.col("sxy")).alias("a_num"))
    # residual*den per observed day, summed per weekday
    res = attach_scalars(d, coef).withColumn(
        "_r", F.col("_cents") * F.col("den") - F.col("a_num") - F.col("b_num") * F.col("x"))
    wk = res.groupBy(F.dayofweek("day").alias("_wd")).agg(F.sum("_r").alias("_rs"), F.count(F.lit(1)).alias("_rc"))
    future = first.select(F.explode(F.sequence(F.date_add(F.col("_d1"), 1), F.date_add(F.col("_d1"), horizon)))
                          .alias("day"), "_d0")
    fut = attach_scalars(future, coef).withColumn("x", F.datediff(F.col("day"), F.col("_d0")).cast("decimal(38,0)"))
    fut = fut.withColumn("_wd", F.dayofweek("day")).join(F.broadcast(wk), "_wd", "left")
    rc = F.coalesce(F.col("_rc"), F.lit(1)).cast("decimal(38,0)")
    rs = F.coalesce(F.col("_rs"), F.lit(0)).cast("decimal(38,0)")
    num = (F.col("a_num") + F.col("b_num") * F.col("x")) * rc + rs
    den = F.col("den") * rc * 100
    sign = F.when(num < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return fut.select("day", F.when(F.col("den") > 0, sign * ratio_round(F.abs(num), den, 2)).alias("forecast")) \
        .orderBy("day")


def anomaly_revenue(fact: DataFrame, window_days: int = 28, z_limit: float = 3.0) -> DataFrame:
    """z-score of daily revenue against the previous ``window_days`` days. The
    daily series has one row per calendar day (its size is bounded by the
    calendar, not by the data volume), so an ordered window over it is safe."""
    d = daily_revenue(fact).withColumn("revenue", money(F.col("revenue")))
    w = Window.orderBy("day").rowsBetween(-window_days, -1)
    z = (F.col("revenue") - F.avg("revenue").over(w)) / F.stddev_samp("revenue").over(w)
    out = d.select("day", "revenue", F.round(z, 4).alias("z_score"))
    return out.withColumn("is_anomaly", F.coalesce(F.abs(F.col("z_score")) > z_limit, F.lit(False)))
