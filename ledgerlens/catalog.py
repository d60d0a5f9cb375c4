"""Registry of named queries: (spark, data_dir) -> DataFrame, and their oracles."""
from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions.scalars import valid_status
from .operators.overlap import overlap_top_k
from .models import churn as CH
from .plans import analyst as A
from .plans import drift as DR
from .plans import etl as ETL
from .plans import scoring as SC
from .plans import segments as SG
from .plans import features as FE
from .plans import quality as QA
from .sources.raw import raw_tables
from .plans import reports as R
from .session import written_once
from .sources.star import load_star

# Parameters of the registered report calls. The full range runs from the first
# to the last order date of the data; the second range and the segment list
# exercise the filters.
FULL = (O.FIRST, O.LAST)
MID = ("1998-01-01", "1999-12-31")
SEGS = ["Champion", "Loyal"]

Query = Callable[[SparkSession, str], DataFrame]


def _star(spark, d):
    return load_star(spark, d)


def _full(s, d) -> tuple[str, str]:
    """First and last order date (min and max of one column: a footer-sized job)."""
    day = F.col("o_orderdate").cast("date").cast("string")
    return tuple(_star(s, d).tables.orders.agg(F.min(day), F.max(day)).first())


def _last(s, d) -> str:
    return _full(s, d)[1]


def report_queries() -> dict[str, Query]:
    return {
        "kpis": lambda s, d: R.kpis(_star(s, d).fact_slim, *_full(s, d)),
        "kpis_mid_segments": lambda s, d: R.kpis(_star(s, d).fact_slim, *MID, segments=SEGS),
        "insights": lambda s, d: R.insights(_star(s, d).fact_slim, *_full(s, d)),
        "insights_mid_segments": lambda s, d: R.insights(_star(s, d).fact_slim, *MID, segments=SEGS),
        "date_bounds": lambda s, d: R.date_bounds(_star(s, d).fact_slim),
        "trend_monthly": lambda s, d: R.trend(_star(s, d).fact_slim, *_full(s, d), "Monthly"),
        "trend_weekly_segments": lambda s, d: R.trend(_star(s, d).fact_slim, *MID, "Weekly", segments=["At Risk", "Lost"]),
        "status_breakdown": lambda s, d: R.status_breakdown(_star(s, d).fact_slim, *_full(s, d)),
        "top_products": lambda s, d: R.top_products(_star(s, d).fact_slim, _star(s, d).products, *_full(s, d), limit=25),
        "top_products_segments": lambda s, d: R.top_products(_star(s, d).fact_slim, _star(s, d).products, *MID,
                                                             limit=10, segments=SEGS),
        "categories": lambda s, d: R.categories(_star(s, d).fact_slim, _star(s, d).products, *_full(s, d)),
        "rfm_distribution": lambda s, d: R.rfm_distribution(_star(s, d).fact_slim, *_full(s, d)),
        "segment_categories": lambda s, d: R.segment_categories(_star(s, d).fact_slim, _star(s, d).products, *_full(s, d)),
        "segment_rollup": lambda s, d: R.segment_rollup(R.rfm_distribution(_star(s, d).fact_slim, *_full(s, d))),
    }


def report_oracles() -> dict[str, str]:
    return {
        "kpis": O.kpis(*FULL),
        "kpis_mid_segments": O.kpis(*MID, segments=SEGS),
        "insights": O.insights(*FULL),
        "insights_mid_segments": O.insights(*MID, segments=SEGS),
        "date_bounds": O.date_bounds(),
        "trend_monthly": O.trend(*FULL, "month"),
        "trend_weekly_segments": O.trend(*MID, "week", segments=["At Risk", "Lost"]),
        "status_breakdown": O.status_breakdown(*FULL),
        "top_products": O.top_products(*FULL, limit=25),
        "top_products_segments": O.top_products(*MID, limit=10, segments=SEGS),
        "categories": O.categories(*FULL),
        "rfm_distribution": O.rfm_distribution(*FULL),
        "segment_categories": O.segment_categories(*FULL),
        "segment_rollup": O.segment_rollup(*FULL),
    }


def _orders(s, d):
    return FE.load_valid_orders(_star(s, d).fact_slim)


def _load_full_orphans(s, d):
    """Valid items against dimensions that lack every 7th customer and 5th product."""
    st = _star(s, d)
    full = FE.load_full(st.fact_slim, st.customers.filter("customer_id % 7 <> 0"), st.products.filter("product_id % 5 <> 0"))
    return full.groupBy(F.col("customer_id").isNull().alias("no_customer"), F.col("product_id").isNull().alias("no_product")).agg(
        F.count(F.lit(1)).alias("items"), F.sum("sale_price").alias("revenue"),
        F.countDistinct("customer_id").alias("customers"), F.countDistinct("product_id").alias("products"),
        F.countDistinct("category").alias("categories"))


def feature_queries() -> dict[str, Query]:
    return {
        "create_rfm": lambda s, d: FE.create_rfm(_orders(s, d)),
        "rfm_features": lambda s, d: FE.build_rfm_features(_orders(s, d)),
        "all_features": _features,
        "product_diversity": lambda s, d: FE.product_diversity(_orders(s, d), _star(s, d).customers, _star(s, d).products),
        "lag_features": lambda s, d: FE.lag_features(_orders(s, d)),
        "channel_mode": lambda s, d: FE.channel_mode(_star(s, d).channels, _star(s, d).customers),
        "load_full_orphans": _load_full_orphans,
        "item_features": lambda s, d: FE.item_features(_orders(s, d)),
    }


def feature_oracles() -> dict[str, str]:
    return {
        "create_rfm": O.create_rfm(),
        "rfm_features": O.rfm_features(),
        "all_features": O.all_features(),
        "product_diversity": O.product_diversity(),
        "lag_features": O.lag_features(),
        "channel_mode": O.channel_mode(),
        "load_full_orphans": O.load_full_orphans(),
        "item_features": O.item_features(),
    }


def _raw(s, d):
    return raw_tables(_star(s, d).tables)


def _etl(s, d, surrogate_key=True):
    return ETL.run_transform(_raw(s, d), surrogate_key=surrogate_key)


def etl_queries() -> dict[str, Query]:
    return {
        "clean_orders": lambda s, d: ETL.clean_orders(_raw(s, d)["orders"]),
        "clean_order_items": lambda s, d: ETL.clean_order_items(_raw(s, d)["order_items"]),
        "clean_users": lambda s, d: ETL.clean_users(_raw(s, d)["users"]),
        "clean_products": lambda s, d: ETL.clean_products(_raw(s, d)["products"]),
        "etl_dim_customers": lambda s, d: _etl(s, d, surrogate_key=False)["dim_customers"],
        "etl_dim_products": lambda s, d: _etl(s, d, surrogate_key=False)["dim_products"],
        "etl_dim_date": lambda s, d: _etl(s, d, surrogate_key=False)["dim_date"],
        "etl_fact_orders": lambda s, d: _etl(s, d)["fact_orders"],
        "null_profile_raw": lambda s, d: reduce(
            DataFrame.unionByName, [QA.null_profile(df, n) for n, df in _raw(s, d).items()]),
        "validate_raw": lambda s, d: QA.validate_raw(_raw(s, d)),
        "validate_star": lambda s, d: QA.validate_star(_etl(s, d)),
        "anti_orphans": lambda s, d: (lambda t: QA.anti_orphans(t["fact_orders"], t["dim_customers"]))(
            _etl(s, d, surrogate_key=False)),
        "verify_counts": lambda s, d: QA.verify_counts(_etl(s, d, surrogate_key=False)),
    }


def etl_oracles() -> dict[str, str]:
    return {
        "clean_orders": O.etl("clean_orders"),
        "clean_order_items": O.etl("clean_items"),
        "clean_users": O.etl("clean_users"),
        "clean_products": O.etl("clean_products"),
        "etl_dim_customers": O.etl("etl_dim_customers"),
        "etl_dim_products": O.etl("etl_dim_products"),
        "etl_dim_date": O.etl("etl_dim_date"),
        "etl_fact_orders": O.etl("etl_fact"),
        "null_profile_raw": O.null_profile_raw(),
        "validate_raw": O.validate("raw"),
        "validate_star": O.validate("star"),
        "anti_orphans": O.anti_orphans(),
        "verify_counts": O.verify_counts(),
    }


def _portable(df: DataFrame) -> DataFrame:
    """Decimal result columns leave as DOUBLE (exact values, engine-neutral type)."""
    from pyspark.sql.types import DecimalType
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _wrap(fn: Query) -> Query:
    return lambda s, d: _portable(fn(s, d))


YEAR = 1998
AS_OF = FULL[1]


#: Two trees over (revenue, orders, items) of a day: (feature, cut, low, high, length) of their nodes; -1 ends a path.
GIVEN_TREES = [
    [(1, 3.0, 1, 2, 0.0), (-1, 0.0, -1, -1, 1.0), (0, 500_000.0, 3, 4, 0.0), (2, 9.0, 5, 6, 0.0), (-1, 0.0, -1, -1, 2.5), (-1, 0.0, -1, -1, 3.0),
     (-1, 0.0, -1, -1, 4.25)],
    [(2, 20.0, 1, 2, 0.0), (0, 100_000.0, 3, 4, 0.0), (-1, 0.0, -1, -1, 1.5), (-1, 0.0, -1, -1, 2.0), (-1, 0.0, -1, -1, 3.75)]]
#: Given coefficients of a trend: level, slope, change points, sine and cosine of the weekly and yearly waves.
GIVEN_TREND = [1000.0, 250.0] + [(-1) ** j * 40.0 * (j + 1) for j in range(12)] + [10.0 * (i % 5) - 15.0 for i in range(16)]
DAY_FEATURES = ["revenue", "orders", "items"]


def _days(s, d):
    """A row for each day: its revenue, orders and items."""
    sold = _star(s, d).fact_slim.filter(valid_status())
    return sold.groupBy(F.col("order_date").alias("day")).agg(F.sum("sale_price").cast("double").alias("revenue"),
                                                              F.countDistinct("order_id").alias("orders"), F.count(F.lit(1)).alias("items"))


def _anomaly_forest(s, d):
    from .models import anomaly
    return anomaly.isolation_forest(_days(s, d).checkpoint(), "day", DAY_FEATURES)


def _anomaly_given(s, d):
    from .models import anomaly
    forest = s.createDataFrame(list(anomaly.tree_rows(GIVEN_TREES)), anomaly.NODE)
    scored = anomaly.score_forest(_days(s, d), forest, "day", DAY_FEATURES, anomaly.SAMPLE)
    return scored.select("day", "path", F.round("score", 6).alias("score"), "is_anomaly")


def _forecast_seasons(s, d):
    from .models import forecast
    return forecast.forecast(_days(s, d).checkpoint(), 28)


def _forecast_given(s, d):
    """Given coefficients, evaluated on every day of the data."""
    from .models import forecast
    days = _days(s, d)
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    trend = forecast.Trend(ends.a, (ends.b - ends.a).days + 1, GIVEN_TREND)
    return days.select("day", F.round(trend.value(F.col("day")), 4).alias("value"))


def analyst_queries() -> dict[str, Query]:
    st = _star
    return {
        "q_top5_customers_revenue": lambda s, d: A.top_customers_by_name(st(s, d).fact_slim, st(s, d).customers),
        "q_monthly_revenue_year": lambda s, d: A.monthly_revenue_year(st(s, d).fact_slim, st(s, d).dates, YEAR),
        "q_top_categories": lambda s, d: A.top_categories_items(st(s, d).fact_slim, st(s, d).products),
        "q_customers_by_country": lambda s, d: A.customers_by_country(st(s, d).customers),
        "q_clv_top5": lambda s, d: A.top_customers_by_name(st(s, d).fact_slim, st(s, d).customers, value_name="clv"),
        "q_revenue_year": lambda s, d: A.revenue_in_year(st(s, d).fact_slim, YEAR),
        "q_orders_month": lambda s, d: A.orders_in_month(st(s, d).fact_slim, YEAR, 1),
        "q_top5_categories_orders": lambda s, d: A.top_categories_orders(st(s, d).fact_slim, st(s, d).products),
        "q_customers_count": lambda s, d: A.customers_count(st(s, d).customers),
        "q_top5_spenders_by_id": lambda s, d: A.top_spenders_by_id(st(s, d).fact_slim, st(s, d).customers),
        "q_monthly_perf": lambda s, d: A.monthly_performance(st(s, d).fact_slim, YEAR),
        "q_brand_avg_price": lambda s, d: A.brand_avg_price(st(s, d).fact_slim, st(s, d).products),
        "q_aov_month": lambda s, d: A.aov_by_month(st(s, d).fact_slim, f"{YEAR}-01-01", f"{YEAR}-06-30"),
        "q_segment_compare": lambda s, d: A.segment_compare(st(s, d).fact_slim, _last(s, d)),
        "q_repeat_rate": lambda s, d: A.repeat_rate(st(s, d).fact_slim),
        "q_category_share": lambda s, d: A.category_share(st(s, d).fact_slim, st(s, d).products),
        "q_inter_purchase": lambda s, d: A.inter_purchase_days(st(s, d).fact_slim, _last(s, d)),
        "fewshot_overlap_topk": lambda s, d: overlap_top_k(st(s, d).tables.benchmark, st(s, d).tables.documents,
                                                           "item_id", "text", "doc_id", "text", k=2),
        "audit_recompute": lambda s, d: A.audit_recompute(written_once(st(s, d).fact_slim, "fact"), st(s, d).products, *_full(s, d)),
        "audit_pareto_headcount": lambda s, d: A.audit_pareto_headcount(st(s, d).fact_slim, *_full(s, d)),
        "forecast_revenue": lambda s, d: A.forecast_revenue(st(s, d).fact_slim, 14),
        "anomaly_revenue": lambda s, d: A.anomaly_revenue(st(s, d).fact_slim),
        "anomaly_forest": _anomaly_forest, "anomaly_forest_given": _anomaly_given,
        "forecast_seasons": _forecast_seasons, "forecast_seasons_given": _forecast_given,
    }


def analyst_oracles() -> dict[str, str]:
    return {
        "q_top5_customers_revenue": O.top_customers_by_name(),
        "q_monthly_revenue_year": O.monthly_revenue_year(YEAR),
        "q_top_categories": O.top_categories_items(),
        "q_customers_by_country": O.customers_by_country(),
        "q_clv_top5": O.top_customers_by_name(value_name="clv"),
        "q_revenue_year": O.revenue_in_year(YEAR),
        "q_orders_month": O.orders_in_month(YEAR, 1),
        "q_top5_categories_orders": O.top_categories_orders(),
        "q_customers_count": O.customers_count(),
        "q_top5_spenders_by_id": O.top_spenders_by_id(),
        "q_monthly_perf": O.monthly_performance(YEAR),
        "q_brand_avg_price": O.brand_avg_price(),
        "q_aov_month": O.aov_by_month(f"{YEAR}-01-01", f"{YEAR}-06-30"),
        "q_segment_compare": O.segment_compare(AS_OF),
        "q_repeat_rate": O.repeat_rate(),
        "q_category_share": O.category_share(),
        "q_inter_purchase": O.inter_purchase_days(AS_OF),
        "fewshot_overlap_topk": O.overlap_top_k(),
        "audit_recompute": O.audit_recompute(*FULL),
        "audit_pareto_headcount": O.audit_pareto_headcount(*FULL),
        "forecast_revenue": O.daily_forecast(14),
        "anomaly_revenue": O.anomaly_revenue(),
        "anomaly_forest_given": O.anomaly_forest(GIVEN_TREES, DAY_FEATURES, 256, 0.6),
        "forecast_seasons_given": O.forecast_seasons(GIVEN_TREND, 12, 3, 5, 0.8),
    }


HISTORY_CUT = "1999-12-31"


def _orders_until(s, d, until):
    return _orders(s, d).filter(F.col("order_date") <= F.lit(until).cast("date"))


def _features(s, d, until=None, columns=None):
    st = _star(s, d)
    return FE.build_all_features(_orders(s, d) if until is None else _orders_until(s, d, until), st.customers, st.products, columns=columns)


def _watched(s, d, until=None):
    """The features that are watched for drift, and no others."""
    return _features(s, d, until, DR.MONITORED_FEATURES)


def _scenario(df):
    return df.withColumn("recency", F.col("recency") * 10).withColumn("monetary", F.col("monetary") / 100)


def _churn_features(s, d):
    return _features(s, d, columns=[*CH.CHURN_FEATURES, "churn"])


def _cluster_features(s, d):
    from .models import segmentation
    return _features(s, d, columns=segmentation.BASE_FEATURES + segmentation.EXTRA_FEATURES)


def _drift_scenario(s, d):
    """The features against themselves after a shift: computed once for both sides."""
    watched = _watched(s, d).checkpoint()
    return DR.drift_check(DR.feature_stats(watched), DR.feature_means(_scenario(watched)))


def monitoring_queries() -> dict[str, Query]:
    return {
        "feature_stats": lambda s, d: DR.feature_stats(_watched(s, d)),
        "baseline_stats_api": lambda s, d: DR.baseline_stats_api(_features(s, d, columns=DR.API_BASELINE_FEATURES)),
        "drift_check_scenario": _drift_scenario,
        "drift_check_history": lambda s, d: DR.drift_check(DR.feature_stats(_watched(s, d)), DR.feature_means(_watched(s, d, HISTORY_CUT))),
        "churn_heuristic": lambda s, d: SC.churn_heuristic(FE.create_rfm(_orders(s, d))),
        "churn_pseudo_features": lambda s, d: SC.churn_pseudo_features(FE.create_rfm(_orders(s, d))),
        "segment_score_batch": lambda s, d: SC.segment_score_batch(FE.create_rfm(_orders_until(s, d, HISTORY_CUT)),
                                                                   FE.create_rfm(_orders(s, d))),
    }


def monitoring_oracles() -> dict[str, str]:
    return {
        "feature_stats": O.feature_stats(),
        "baseline_stats_api": O.baseline_stats_api(),
        "drift_check_scenario": O.drift_check(scenario=True),
        "drift_check_history": O.drift_check(current_until=HISTORY_CUT),
        "churn_heuristic": O.churn_heuristic(),
        "churn_pseudo_features": O.churn_pseudo_features(),
        "segment_score_batch": O.segment_score_batch(HISTORY_CUT),
    }


def _clv(s, d):
    from .models import clv
    return clv.fit_and_predict(_orders(s, d), months=1)


def _clv_later(s, d):
    """Customers as they stood at ``HISTORY_CUT``, seen from the last day: who has
    not come back since is likely lost."""
    from .models import clv
    return clv.fit_and_predict(_orders_until(s, d, HISTORY_CUT), months=1, observation_end=_last(s, d))


def _kmeans(s, d):
    from .models import segmentation
    return segmentation.run_kmeans(_cluster_features(s, d))[0]


#: Fixed parameters under which CLV scores can be computed in any engine.
GIVEN_BG = {"r": 0.8, "alpha": 60.0, "a": 0.9, "b": 2.5}
GIVEN_GG = {"p": 6.0, "q": 4.0, "v": 5000.0}


def _clv_given(s, d):
    """CLV scores under fixed parameters, three months ahead."""
    from .models import clv
    return clv.clv_predict(clv.clv_summary(_orders(s, d)), GIVEN_BG, GIVEN_GG, months=3)


def _clv_later_given(s, d):
    from .models import clv
    return clv.clv_predict(clv.clv_summary(_orders_until(s, d, HISTORY_CUT), _last(s, d)), GIVEN_BG, GIVEN_GG)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, O.CLV_DIGITS.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _at_risk_top_clv(s, d, clv=_clv):
    seg = _segments(s, d).filter(F.col("segment_key") == "At Risk")
    return (clv(s, d).join(seg, "customer_id", "left_semi").orderBy(F.col("clv_pred").desc(), "customer_id")
            .limit(10).select("customer_id", "clv_pred", "predicted_purchases", "predicted_aov"))


def _segments(s, d):
    return SG.segment_customers(_star(s, d).fact_slim, _last(s, d))


def _champion_gg_gap(s, d, clv=_clv):
    champ = _segments(s, d).filter(F.col("segment_key") == "Champion")
    c = clv(s, d).join(champ, "customer_id", "left_semi").filter(F.col("frequency") > 0)
    return c.agg(F.count(F.lit(1)).alias("customers"), F.avg("monetary_value").alias("actual_aov"),
                 F.avg("predicted_aov").alias("gamma_gamma_aov"))


def _low_p_active_category(s, d, category="PROMO", clv=_clv_later):
    st = _star(s, d)
    buyers = (FE.load_valid_orders(st.fact_slim).join(st.products.filter(F.col("category") == category)
                                                      .select("product_id"), "product_id", "left_semi")
              .select("customer_id").distinct())
    return (clv(s, d).filter(F.col("p_alive") < 0.2).join(buyers, "customer_id", "left_semi")
            .select("customer_id", "p_alive", "frequency", "recency", "T"))


def _churn(s, d, kinds=("lr", "gbt")):
    return CH.train_churn_model(_churn_features(s, d), kinds=kinds)


def _gbt_importance(s, d):
    return CH.feature_importance(CH.fit_churn_model(_churn_features(s, d), "gbt"))


def _churn_choice_checked(s, d):
    """The model choice, its metrics computed again from the stored hold-out predictions."""
    return CH.check_choice(_churn(s, d))


def _churn_scores(s, d):
    feats = _churn_features(s, d).checkpoint()
    return CH.predict_churn_risk(CH.fit_churn_model(feats), feats)


def _als_recs(s, d):
    from .models import recommend as REC
    st = _star(s, d)
    m = written_once(REC.interaction_matrix(FE.load_valid_orders(st.fact_slim)), "matrix")
    return REC.enrich(REC.recommend(REC.train_als(m), m, n=5), st.products)


def _als_exact(s, d):
    """The recommendations held, customer by customer and rank by rank, against the library's ranking of all
    products without those bought: how many ranks there are, and how many scores differ."""
    from .models import recommend as REC
    m = written_once(REC.interaction_matrix(_orders(s, d)), "matrix")
    model = REC.train_als(m)
    ours = REC.recommend(model, m, n=5)
    theirs = REC.library_ranking(model, m, n=5)
    both = ours.join(theirs.withColumnRenamed("score", "library_score").select("customer_id", "rank", "library_score"), ["customer_id", "rank"], "full")
    off = F.abs(F.col("score") - F.col("library_score")) > 1e-4
    return both.agg(F.countDistinct("customer_id").alias("customers"), F.count(F.lit(1)).alias("ranks"),
                    F.count(F.when(off | F.col("score").isNull() | F.col("library_score").isNull(), 1)).alias("different"))


def _churn_blend(s, d):
    """Model probability of the fitted classifier blended with the heuristic,
    on the pseudo-features derived from R, F, M."""
    model = CH.fit_churn_model(_churn_features(s, d))
    pseudo = SC.churn_pseudo_features(FE.create_rfm(_orders(s, d))).withColumn("churn", F.lit(0))
    probs = CH.predict_churn_risk(model, pseudo).withColumnRenamed("churn_probability", "model_probability")
    return SC.churn_blend(pseudo.join(probs.select("customer_id", "model_probability"), "customer_id"))


def _heuristic_predictions(s, d):
    """churn label (recency > 90) with the heuristic probability as the score
    and p >= .6 as the predicted class."""
    rfm = FE.build_rfm_features(_orders(s, d))
    h = SC.churn_heuristic(rfm.select("customer_id", "recency", "frequency", "monetary"))
    return (rfm.select("customer_id", F.col("churn").cast("double").alias("label")).join(h, "customer_id")
            .select("customer_id", "label", F.col("churn_probability").alias("score"),
                    (F.col("churn_probability") >= 0.6).cast("double").alias("prediction")))


def model_queries() -> dict[str, Query]:
    from .models import clv
    from .models import recommend as REC
    from .models import segmentation
    return {
        "clv_summary": lambda s, d: clv.clv_summary(_orders(s, d)),
        "clv_predict": _clv,
        "q_at_risk_top_clv": _at_risk_top_clv,
        "q_champion_gg_gap": _champion_gg_gap,
        "q_low_p_active_category": _low_p_active_category,
        "kmeans_segments": _kmeans,
        "silhouette_k_sweep": lambda s, d: segmentation.silhouette_k_sweep(FE.create_rfm(_orders(s, d))),
        "churn_train_lr_metrics": lambda s, d: _churn(s, d, kinds=("lr",)).metrics.drop("chosen"),
        "churn_model_choice": lambda s, d: _churn(s, d).metrics,
        "churn_gbt_importance": _gbt_importance,
        "churn_score": _churn_scores,
        "binary_metrics_heuristic": lambda s, d: CH.binary_metrics(_heuristic_predictions(s, d)),
        "auc_heuristic": lambda s, d: CH.auc_rank_sum(_heuristic_predictions(s, d)),
        "churn_blend": _churn_blend,
        "als_matrix": lambda s, d: REC.interaction_matrix(FE.load_valid_orders(_star(s, d).fact_slim)),
        "als_recommend": _als_recs,
    }


def model_oracles() -> dict[str, str]:
    return {"clv_summary": O.clv_summary(), "als_matrix": O.als_matrix(),
            "binary_metrics_heuristic": O.binary_metrics_heuristic(), "auc_heuristic": O.auc_heuristic()}


def _incremental(s, d):
    from .sources.sinks import incremental_new_rows
    fact = _star(s, d).fact_slim
    return incremental_new_rows(fact.filter(F.col("order_date") <= F.lit(HISTORY_CUT).cast("date")), fact)


def _stream_fact(s, d):
    from .streaming.incremental import scratch_dir, stream_incremental_fact
    fact = _star(s, d).fact_slim
    base = scratch_dir(s, "stream-fact")
    src, sink, ck = base + "/source", base + "/sink", base + "/checkpoint"
    fact.filter(F.col("order_date") <= F.lit(HISTORY_CUT).cast("date")).repartition(5, "order_id").write.mode("append").parquet(src)
    stream_incremental_fact(s, src, sink, ck, fact.schema)
    # a later full re-extract, in several files whose dates are mixed, two files a batch
    fact.repartition(7, "order_id").write.mode("append").parquet(src)
    stream_incremental_fact(s, src, sink, ck, fact.schema, files_per_batch=2)
    return s.read.parquet(sink).drop("batch_id")


def _stream_drift(s, d):
    from .streaming.incremental import drift_log, scratch_dir, stream_drift
    base = scratch_dir(s, "stream-drift")
    src, log, ck = base + "/snapshots", base + "/log", base + "/checkpoint"
    full = _watched(s, d).checkpoint()
    baseline = DR.feature_stats(full).checkpoint()
    first = _watched(s, d, HISTORY_CUT).checkpoint().withColumn("snapshot_id", F.lit(1))
    for part in range(3):       # one snapshot that arrives in three runs, the second of several files
        first.filter(F.col("customer_id") % 3 == part).repartition(1 + part % 2 * 3, "customer_id").write.mode("append").parquet(src)
        stream_drift(s, src, baseline, log, ck, first.schema)
    second = _scenario(full).withColumn("snapshot_id", F.lit(2)).select(*first.columns)
    second.repartition(3, "customer_id").write.mode("append").parquet(src)
    stream_drift(s, src, baseline, log, ck, first.schema)
    return drift_log(s, log)


def _scratch(s, name):
    from .streaming.incremental import scratch_dir
    return scratch_dir(s, name)


def _sink_incremental(s, d):
    """A table loaded up to ``HISTORY_CUT``, then the whole fact appended twice."""
    from .sources import sinks
    path = _scratch(s, "sink-incremental") + "/fact"
    fact = _star(s, d).fact_slim
    sinks.sink_incremental(fact.filter(F.col("order_date") <= F.lit(HISTORY_CUT).cast("date")).repartition(5, "order_id"), path)
    sinks.sink_incremental(fact.repartition(7, "order_id"), path)
    sinks.sink_incremental(fact, path)
    return s.read.parquet(path)


def _once(s, table: str) -> DataFrame:
    """The published table as it is now; its name is given up again."""
    from .sources.published import read_published
    found = read_published(s, table)
    s.sql(f"DROP VIEW `{table}`")
    return found


def _fresh_name(name: str) -> str:
    import uuid
    return f"ll_{uuid.uuid4().hex[:12]}_{name}"


def _broken(df: DataFrame, column: str) -> DataFrame:
    """``df``, whose last row (by ``column``) breaks the job that reads it."""
    from .operators.ranking import attach_scalars
    last = attach_scalars(df, df.agg(F.max(column).alias("_last")))
    return last.withColumn(column, F.when(F.col(column) == F.col("_last"), F.raise_error(F.lit("broken row"))).otherwise(F.col(column))).drop("_last")


def _fails(action) -> None:
    try:
        action()
    except Exception as e:
        if "broken row" not in str(e):
            raise
        return
    raise AssertionError("the load was to break")


def _sink_full_replace(s, d):
    """An older, longer table of other columns, partitioned, replaced by the products."""
    from .sources import sinks
    base, table = _scratch(s, "sink-full"), _fresh_name("dim_products")
    products = _etl(s, d)["dim_products"]
    sinks.sink_full_replace(products.union(products).withColumn("more", F.lit(1)), table, base, ["category"])
    sinks.sink_full_replace(products, table, base)
    return _once(s, table)


def _sink_replace_broken(s, d):
    """Products loaded; a second load of other rows breaks midway: the table is still the first load."""
    from .sources import sinks
    base, table = _scratch(s, "sink-broken"), _fresh_name("dim_products")
    products = _etl(s, d)["dim_products"]
    sinks.sink_full_replace(products, table, base)
    _fails(lambda: sinks.sink_full_replace(_broken(products.union(products).repartition(4), "product_id"), table, base))
    return _once(s, table)


def _load_star(s, d, loads) -> DataFrame:
    """Rows per table after the star was loaded by each of ``loads`` in turn. The star is built once, for all of them."""
    from .sources import sinks
    from .sources.published import read_published
    base, prefix = _scratch(s, "load-all"), _fresh_name("")
    star = {n: written_once(df, n) for n, df in _etl(s, d, surrogate_key=False).items()}
    for load in loads:
        load(lambda tables, mode: sinks.load_all(tables, base, mode, prefix), star)
    counts = QA.verify_counts({n: read_published(s, prefix + n) for n in star})
    for n in star:
        s.sql(f"DROP VIEW IF EXISTS `{prefix}{n}`")
    return counts


def _load_all(s, d):
    """The star up to ``HISTORY_CUT`` loaded in full, then all of it incrementally, twice."""
    def first(load, star):
        day = F.col("order_date")       # items without an order have no day and come with the first load only
        load(star | {"fact_orders": star["fact_orders"].filter(day.isNull() | (day <= F.lit(HISTORY_CUT).cast("date")))}, "full")
    again = lambda load, star: load(star, "incremental")
    return _load_star(s, d, [first, again, again])


def _load_all_broken(s, d):
    """The star loaded; later loads that change the dimensions break in the fact, full or incremental: nothing has changed."""
    def broken(mode):
        def load(load, star):
            later = star["fact_orders"].withColumn("order_date", F.date_add("order_date", 10_000))
            fewer = {n: df.limit(3) for n, df in star.items() if n != "fact_orders"}
            _fails(lambda: load(fewer | {"fact_orders": _broken(later, "order_item_id")}, mode))
        return load
    return _load_star(s, d, [lambda load, star: load(star, "full"), broken("full"), broken("incremental")])


def _kpis_stored_segments(s, d):
    """The KPIs of two segments from stored segments: a report before a load, one after it, and the next one of that day."""
    base, fact = _scratch(s, "segments"), written_once(_star(s, d).fact_slim, "fact")
    store = SG.SegmentStore(s, base, _fresh_name(""))
    earlier = fact.filter(F.col("order_date") <= F.lit("1998-12-31").cast("date"))
    R.kpis(earlier, *MID, segments=store.filter(earlier, MID[1], SEGS)).collect()
    R.kpis(fact, *MID, segments=store.filter(fact, MID[1], SEGS)).collect()
    out = R.kpis(fact, *MID, segments=store.filter(fact, MID[1], SEGS))
    store.forget(MID[1])
    return out


def _verify_counts_missing(s, d):
    """Counts of a star of which one table was never loaded."""
    def partly(load, star):
        load({n: df for n, df in star.items() if n != "dim_date"}, "full")
    return _load_star(s, d, [partly])


def _staged(s, d):
    """Users written to the stage, read back and cleaned."""
    from .sources.tables import read_staged, write_staged
    base = _scratch(s, "stage")
    write_staged(_raw(s, d)["users"], base, "users")
    return ETL.clean_users(read_staged(s, base, "users"))


def _versioned(s, d):
    """The second version of a feature table, read back."""
    from .sources import sinks
    base, rfm = _scratch(s, "versions"), FE.create_rfm(_orders(s, d))
    sinks.versioned_output(rfm.limit(0), base, "rfm")
    return s.read.parquet(sinks.versioned_output(rfm, base, "rfm"))


def _exported(s, d):
    """Scores exported as CSV, read back."""
    from .sources import sinks
    path, scores = _scratch(s, "export") + "/scores", SC.churn_heuristic(FE.create_rfm(_orders(s, d)))
    sinks.export_scores(scores, path)
    return s.read.schema(scores.schema).option("header", True).csv(path)


def _margin(s, d):
    """Fact built from items that carry their product's cost."""
    raw = _raw(s, d)
    cost = raw["products"].select(F.col("id").alias("product_id"), F.col("cost").cast("double").alias("cost"))
    items = raw["order_items"].join(cost, "product_id", "left")
    fact = ETL.build_fact_orders(ETL.clean_order_items(items), ETL.clean_orders(raw["orders"]), surrogate_key=False)
    return fact.select("order_item_id", F.round("margin", 4).alias("margin"))


def _drift_baseline(s, d):
    return DR.DriftMonitor(s, _scratch(s, "drift")).set_baseline(_watched(s, d)).drop("set_at")


def _drift_log(s, d):
    """The latest report of a monitor's log after two checks."""
    monitor, features = DR.DriftMonitor(s, _scratch(s, "drift")), _watched(s, d).checkpoint()
    monitor.set_baseline(features)
    monitor.check(features)
    monitor.check(_scenario(features))
    return monitor.last_report().drop("checked_at")


def _dirty_raw(s, d):
    """Raw tables with faults: most order statuses missing, no email column, few products."""
    raw = dict(_raw(s, d))
    raw["orders"] = raw["orders"].select("order_id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("status"), "created_at")
    raw["users"] = raw["users"].drop("email")
    raw["products"] = raw["products"].filter("id <= 50")
    return raw


def _dirty_orphans(s, d):
    """Orphan check against a dimension without every 7th customer."""
    star = _etl(s, d, surrogate_key=False)
    return QA.anti_orphans(star["fact_orders"], star["dim_customers"].filter("customer_id % 7 <> 0"))


def _churn_split(s, d):
    """Hold-out and fold sizes of each class."""
    split = CH.prepare(_churn_features(s, d))
    return (split.groupBy("label", "is_test").agg(F.count(F.lit(1)).alias("n"))
            .select("label", "is_test", "n"))


def _blend_given(s, d):
    """Blend with a supplied model probability (here 1 / (1 + frequency))."""
    rfm = FE.create_rfm(_orders(s, d)).withColumn("model_probability", F.lit(1.0) / (F.lit(1.0) + F.col("frequency")))
    return SC.churn_blend(rfm).select("customer_id", "churn_probability", "risk_level", "prediction")


def _p_active_given(s, d):
    """P(alive) under fixed parameters."""
    from .models import clv
    return clv.clv_summary(_orders(s, d)).select("customer_id", F.round(clv.p_alive(GIVEN_BG), 6).alias("p_alive"))


def _als_invariants(s, d):
    """What any recommendation must satisfy, counted over all customers."""
    from .models import recommend as REC
    m = written_once(REC.interaction_matrix(_orders(s, d)), "matrix")
    recs = written_once(REC.recommend(REC.train_als(m), m, n=5), "recommendations")
    bought = recs.join(m, ["customer_id", "product_id"], "left_semi").agg(F.count(F.lit(1)).alias("already_bought"))
    per = recs.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("last"), F.countDistinct("rank").alias("ranks"))
    total = per.agg(F.count(F.lit(1)).alias("customers"), F.sum("n").cast("long").alias("recommendations"),
                    F.count(F.when((F.col("last") != F.col("n")) | (F.col("ranks") != F.col("n")), 1)).alias("gaps_in_rank"))
    from .operators.ranking import attach_scalars
    return attach_scalars(total, bought)


def _kmeans_invariants(s, d):
    """What any clustering must satisfy: every customer once, four labelled
    clusters, labels in the order of the centroids' scores, and nobody nearer (in
    standardised units) to another centre."""
    from pyspark.ml.functions import vector_to_array
    from .models import segmentation as SEG
    rfm = _cluster_features(s, d).checkpoint()
    scored, model, centroids = SEG.run_kmeans(rfm)
    data, _ = SEG._prepared(rfm, SEG.BASE_FEATURES + SEG.EXTRA_FEATURES)
    x = vector_to_array("features")
    gaps = [F.aggregate(F.zip_with(x, F.array(*map(F.lit, map(float, c))), lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                        lambda acc, v: acc + v) for c in model.clusterCenters()]
    near = data.select("customer_id", F.array(*gaps).alias("gap")).join(scored, "customer_id")
    wrong = F.element_at("gap", F.col("cluster") + 1) > F.array_min("gap") + 1e-9
    scores = [c[2] - 0.3 * c[0] + 2 * c[1] for c in centroids]      # monetary, recency, frequency
    labels = {r.cluster: r.segment for r in scored.select("cluster", "segment").distinct().collect()}    # one for each cluster
    ordered = [labels[i] for i in sorted(labels, key=lambda i: -scores[i])] == SEG.CLUSTER_LABELS[:len(labels)]
    return near.agg(F.count(F.lit(1)).alias("customers"), F.countDistinct("cluster").alias("clusters"),
                    F.countDistinct("segment").alias("segments"), F.count(F.when(wrong, 1)).alias("misplaced")).withColumn(
        "labels_in_order", F.lit(ordered))


def _lookup_enrich(s, d):
    """Name and category of every product bought, with the fall-back labels where the dimension lacks it."""
    from .models import recommend as REC
    recs = _orders(s, d).select("customer_id", "product_id").distinct().withColumn("rank", F.lit(1))
    return REC.enrich(recs, _star(s, d).products.filter("product_id % 3 <> 0"))


def load_queries() -> dict[str, Query]:
    return {
        "sink_incremental": _sink_incremental, "sink_full_replace": _sink_full_replace, "load_all": _load_all,
        "sink_replace_broken": _sink_replace_broken, "load_all_broken": _load_all_broken, "kpis_stored_segments": _kpis_stored_segments,
        "churn_choice_checked": _churn_choice_checked,
        "verify_counts_missing": _verify_counts_missing, "scan_parquet_stage": _staged, "versioned_output": _versioned,
        "export_scores": _exported, "margin": _margin, "drift_set_baseline": _drift_baseline, "drift_log": _drift_log,
        "validate_raw_dirty": lambda s, d: QA.validate_raw(_dirty_raw(s, d)), "anti_orphans_dirty": _dirty_orphans,
        "churn_split": _churn_split, "churn_blend_given": _blend_given, "p_active_given": _p_active_given,
        "clv_predict_given": lambda s, d: _rounded(_clv_given(s, d)),
        "q_at_risk_top_clv_given": lambda s, d: _rounded(_at_risk_top_clv(s, d, _clv_given)),
        "q_champion_gg_gap_given": lambda s, d: _rounded(_champion_gg_gap(s, d, _clv_given)),
        "q_low_p_active_category_given": lambda s, d: _rounded(_low_p_active_category(s, d, clv=_clv_later_given)),
        "als_invariants": _als_invariants, "als_exact": _als_exact, "lookup_enrich": _lookup_enrich, "kmeans_invariants": _kmeans_invariants,
    }


def load_oracles() -> dict[str, str]:
    return {
        "sink_incremental": O.stream_incremental_fact(HISTORY_CUT), "sink_full_replace": O.etl("etl_dim_products"),
        "sink_replace_broken": O.etl("etl_dim_products"), "load_all_broken": O.verify_counts(),
        "kpis_stored_segments": O.kpis(*MID, segments=SEGS), "churn_choice_checked": O.churn_choice_checked(),
        "load_all": O.verify_counts(), "verify_counts_missing": O.verify_counts_missing(), "scan_parquet_stage": O.etl("clean_users"),
        "versioned_output": O.create_rfm(), "export_scores": O.churn_heuristic(), "margin": O.margin(),
        "drift_set_baseline": O.feature_stats(), "drift_log": O.drift_check(scenario=True),
        "validate_raw_dirty": O.validate_raw_dirty(), "anti_orphans_dirty": O.anti_orphans("AND customer_id % 7 <> 0"),
        "churn_split": O.churn_split(), "churn_blend_given": O.churn_blend_given(), "p_active_given": O.p_active_given(),
        "clv_predict_given": O.clv_predict_given(GIVEN_BG, GIVEN_GG, 3), "q_at_risk_top_clv_given": O.at_risk_top_clv(GIVEN_BG, GIVEN_GG, 3, AS_OF),
        "q_champion_gg_gap_given": O.champion_gg_gap(GIVEN_BG, GIVEN_GG, 3, AS_OF),
        "q_low_p_active_category_given": O.low_p_active_category(GIVEN_BG, GIVEN_GG, HISTORY_CUT, "PROMO"),
        "als_invariants": O.als_invariants(), "als_exact": O.als_exact(), "lookup_enrich": O.lookup_enrich(),
        "kmeans_invariants": O.kmeans_invariants(),
    }


def stream_queries() -> dict[str, Query]:
    return {"incremental_new_rows": _incremental, "stream_incremental_fact": _stream_fact,
            "stream_drift": _stream_drift}


def stream_oracles() -> dict[str, str]:
    return {"incremental_new_rows": O.incremental_new_rows(HISTORY_CUT),
            "stream_incremental_fact": O.stream_incremental_fact(HISTORY_CUT),
            "stream_drift": O.stream_drift(HISTORY_CUT)}


def _rfm_bins(s, d):
    return R.rfm_distribution(_star(s, d).fact_slim, *_full(s, d))


def rollup_queries() -> dict[str, Query]:
    from .models import clv
    st = _star
    return {
        "top_customers": lambda s, d: R.top_customers(_features(s, d, columns=["recency", "frequency", "monetary"]), 10),
        "segment_statistics": lambda s, d: R.segment_statistics(
            SG.score_rfm(SG.customer_rfm(st(s, d).fact_slim, None, _last(s, d)))),
        "revenue_at_risk": lambda s, d: R.revenue_at_risk(
            SC.churn_heuristic(FE.create_rfm(_orders(s, d))).join(FE.create_rfm(_orders(s, d)), "customer_id")),
        "at_risk_totals": lambda s, d: R.at_risk_totals(_rfm_bins(s, d)),
        "brand_rollup": lambda s, d: R.brand_rollup(R.top_products(st(s, d).fact_slim, st(s, d).products, *_full(s, d), 25)),
        "category_bars": lambda s, d: R.category_bars(R.categories(st(s, d).fact_slim, st(s, d).products, *_full(s, d))),
        "pareto_curve": lambda s, d: R.pareto_curve(_rfm_bins(s, d)),
        "revenue_by_month_top5": lambda s, d: R.revenue_by_month_top5(st(s, d).fact_slim, st(s, d).dates),
        "bestseller_top5": lambda s, d: R.bestseller_top5(st(s, d).fact_slim, st(s, d).products),
        "gg_training_set": lambda s, d: clv.gg_training_set(clv.clv_summary(_orders(s, d))),
    }


def rollup_oracles() -> dict[str, str]:
    return {
        "top_customers": O.top_customers(10),
        "segment_statistics": O.segment_statistics(AS_OF),
        "revenue_at_risk": O.revenue_at_risk(),
        "at_risk_totals": O.at_risk_totals(*FULL),
        "brand_rollup": O.brand_rollup(*FULL),
        "category_bars": O.category_bars(*FULL),
        "pareto_curve": O.pareto_curve(*FULL),
        "revenue_by_month_top5": O.revenue_by_month_top5(),
        "bestseller_top5": O.bestseller_top5(),
        "gg_training_set": O.gg_training_set(),
    }


def queries() -> dict[str, Query]:
    q = {}
    q.update(report_queries())
    q.update(feature_queries())
    q.update(etl_queries())
    q.update(analyst_queries())
    q.update(monitoring_queries())
    q.update(model_queries())
    q.update(stream_queries())
    q.update(load_queries())
    q.update(rollup_queries())
    return {k: _wrap(v) for k, v in q.items()}


def oracles() -> dict[str, str]:
    o = {}
    o.update(report_oracles())
    o.update(feature_oracles())
    o.update(etl_oracles())
    o.update(analyst_oracles())
    o.update(monitoring_oracles())
    o.update(model_oracles())
    o.update(stream_oracles())
    o.update(load_oracles())
    o.update(rollup_oracles())
    return o
