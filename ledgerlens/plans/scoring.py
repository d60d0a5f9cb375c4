"""Rule-based scoring: churn heuristic, model/heuristic blend inputs, risk
bands, and RFM segment scoring of new customers against a population."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (SEGMENT_ACTION, half_even, map_lookup, risk_band_cut, risk_threshold_api, segment_display,
                                 segment_key)
from ..operators.ranking import qcut_bin, qcut_positions


def _d(c: str):
    return F.col(c).cast("double")


def churn_heuristic(df: DataFrame) -> DataFrame:
    """p = min(1, .6 min(1, R/180) + .25 max(0, 1 - F/20) + .15 max(0, 1 - M/2000))."""
    r = F.least(F.lit(1.0), _d("recency") / F.lit(180.0))
    f = F.greatest(F.lit(0.0), F.lit(1.0) - _d("frequency") / F.lit(20.0))
    m = F.greatest(F.lit(0.0), F.lit(1.0) - _d("monetary") / F.lit(2000.0))
    p = F.least(F.lit(1.0), r * F.lit(0.6) + f * F.lit(0.25) + m * F.lit(0.15))
    risk, pred = risk_threshold_api(F.col("churn_probability"))
    return (df.select("customer_id", half_even(p, 4).alias("churn_probability"))
            .withColumn("risk_level", risk).withColumn("prediction", pred)
            .withColumn("risk_band", risk_band_cut(F.col("churn_probability"))))


def churn_pseudo_features(df: DataFrame) -> DataFrame:
    """Model inputs derived from R, F, M (and optional aov) for single-customer
    scoring; counts are rounded half-even."""
    freq = _d("frequency")
    aov = (F.coalesce(_d("avg_order_value"), _d("monetary") / F.greatest(freq, F.lit(1.0)))
           if "avg_order_value" in df.columns else _d("monetary") / F.greatest(freq, F.lit(1.0)))
    decay = F.greatest(F.lit(0.0), F.lit(1.0) - _d("recency") / F.lit(365.0))
    expected = freq * F.lit(90.0 / 365.0)
    last90 = F.greatest(F.lit(0), half_even(expected * decay, 0).cast("long"))
    prev90 = F.greatest(F.lit(0), half_even(expected * F.least(F.lit(1.0), F.lit(1.5) - decay), 0).cast("long"))
    return df.select(
        "customer_id", _d("recency").alias("recency"), freq.alias("frequency"), _d("monetary").alias("monetary"),
        aov.alias("avg_order_value"), (F.lit(365.0) / F.greatest(freq, F.lit(1.0))).alias("avg_days_between_orders"),
        (last90 - prev90).alias("purchase_trend"), last90.alias("orders_last_90d"), prev90.alias("orders_prev_90d"),
        F.least(freq, F.lit(5.0)).alias("unique_categories"), F.least(freq, F.lit(10.0)).alias("unique_products"))


def churn_blend(df: DataFrame, prob_col: str = "model_probability") -> DataFrame:
    """.7 model + .3 min(1, .6 min(1, R/180) + .4 max(0, 1 - F/20))."""
    r = F.least(F.lit(1.0), _d("recency") / F.lit(180.0))
    f = F.greatest(F.lit(0.0), F.lit(1.0) - _d("frequency") / F.lit(20.0))
    h = F.least(F.lit(1.0), r * F.lit(0.6) + f * F.lit(0.4))
    p = _d(prob_col) * F.lit(0.7) + h * F.lit(0.3)
    out = df.withColumn("churn_probability", half_even(p, 4))
    risk, pred = risk_threshold_api(F.col("churn_probability"))
    return out.withColumn("risk_level", risk).withColumn("prediction", pred)


def segment_score_batch(inputs: DataFrame, population: DataFrame, id_col: str = "customer_id") -> DataFrame:
    """Score each input customer against the population, as if it were put in
    front of the population and ranked with method="first" and cut into 5
    quantile bins: r labels 5..1, f and m labels 1..5.

    All metrics are put in order together; both inputs are read once for it (the
    one to be scored, three columns of it, twice)."""
    metrics = ["recency", "frequency", "monetary"]
    pos = qcut_positions(inputs, population, id_col, metrics)
    bins = {m: qcut_bin(F.col(f"{m}_rank"), F.col("n")) for m in metrics}
    scores = {"r_score": F.lit(6) - bins["recency"], "f_score": bins["frequency"], "m_score": bins["monetary"]}
    out = pos.select(id_col, *[c.cast("long").alias(n) for n, c in scores.items()])
    total = F.col("r_score") + F.col("f_score") + F.col("m_score")
    key = segment_key(total)
    return out.select(id_col, "r_score", "f_score", "m_score", total.cast("double").alias("rfm_score"),
                      key.alias("segment_key"), segment_display(key).alias("segment"),
                      map_lookup(key, SEGMENT_ACTION).alias("action"))
