"""Drift scenario of the reference tests, risk bands, heuristic scores."""
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.scalars import risk_band_cut, risk_threshold_api
from ledgerlens.plans import drift as D
from ledgerlens.plans import scoring as S


@pytest.fixture(scope="module")
def rfm(spark):
    rng = np.random.default_rng(42)
    pdf = pd.DataFrame({"customer_id": np.arange(200), "recency": rng.uniform(1, 365, 200),
                        "frequency": rng.uniform(1, 50, 200), "monetary": rng.uniform(10, 5000, 200)})
    return spark.createDataFrame(pdf)


def test_drift_detected_and_not(spark, rfm):
    base = D.feature_stats(rfm)
    same = D.drift_check(base, D.feature_stats(rfm)).collect()
    assert not any(r["drifted"] for r in same)
    shifted = rfm.withColumn("recency", F.col("recency") * 10).withColumn("monetary", F.col("monetary") / 100)
    report = D.drift_check(base, D.feature_stats(shifted))
    rep = {r["feature"]: r["drifted"] for r in report.collect()}
    assert D.drift_summary(report).first()["drift_detected"]
    assert rep["recency"] and not rep["frequency"]   # monetary / 100 moves the mean by ~1.7 std only
    extreme = rfm.withColumn("recency", F.lit(9999.0))
    assert {r["feature"]: r["drifted"] for r in D.drift_check(base, D.feature_stats(extreme)).collect()}["recency"]


def test_drift_skips_zero_std_and_missing(spark, rfm):
    const = rfm.withColumn("frequency", F.lit(3.0))
    base = D.feature_stats(const)
    cur = D.feature_stats(rfm.drop("monetary"))
    feats = {r["feature"] for r in D.drift_check(base, cur).collect()}
    assert "frequency" not in feats and "monetary" not in feats and "recency" in feats


def test_monitor_sets_baseline_when_missing(spark, rfm, tmp_dir):
    mon = D.DriftMonitor(spark, tmp_dir)
    assert mon.check(rfm).count() == 0          # baseline stored, no drift reported
    assert mon.check(rfm).filter("drifted").count() == 0
    assert mon.retrain_signal() is False
    shifted = rfm.withColumn("recency", F.col("recency") * 10)
    mon.check(shifted)
    assert mon.retrain_signal() is True


def test_feature_stats_median_and_quantiles(spark, rfm):
    pdf = rfm.toPandas()
    st = {r["feature"]: r for r in D.feature_stats(rfm).collect()}
    assert st["recency"]["median"] == pytest.approx(pdf["recency"].median(), abs=1e-6)
    assert st["monetary"]["std"] == pytest.approx(pdf["monetary"].std(), abs=1e-6)
    q = {r["feature"]: r for r in D.baseline_stats_api(rfm).collect()}
    assert q["frequency"]["p25"] == pytest.approx(pdf["frequency"].quantile(0.25), abs=1e-6)


def test_risk_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,)], "p double")
    risk, pred = risk_threshold_api(F.col("p"))
    out = df.select(risk_band_cut(F.col("p")).alias("band"), risk.alias("risk"), pred.alias("pred")).collect()
    assert [r["band"] for r in out] == ["Low", "Low", "Medium", "High"]
    assert [r["risk"] for r in out] == ["Low", "Medium", "High", "High"]
    assert [r["pred"] for r in out] == ["RETAINED", "AT RISK", "CHURN", "CHURN"]


def test_churn_heuristic_values(spark):
    df = spark.createDataFrame([(1, 30, 5, 250.0), (2, 120, 2, 150.0), (3, 5, 10, 2000.0)],
                               "customer_id long, recency long, frequency long, monetary double")
    got = {r["customer_id"]: r["churn_probability"] for r in S.churn_heuristic(df).collect()}
    def h(r, f, m):
        p = min(1.0, min(1.0, r / 180) * 0.6 + max(0.0, 1 - f / 20) * 0.25 + max(0.0, 1 - m / 2000) * 0.15)
        nine = Decimal(repr(p)).quantize(Decimal("1e-9"), ROUND_HALF_UP)
        return float(nine.quantize(Decimal("1e-4"), ROUND_HALF_EVEN))
    assert got == {1: h(30, 5, 250.0), 2: h(120, 2, 150.0), 3: h(5, 10, 2000.0)}


def test_rounding_rule_on_ties(spark):
    """Ties go to the even digit, in all three uses."""
    from ledgerlens.functions.scalars import half_even
    cases = [(0.25375, 4, 0.2538), (0.25365, 4, 0.2536), (0.11374999999999999, 4, 0.1138), (0.113749, 4, 0.1137), (2.5, 0, 2.0), (3.5, 0, 4.0),
             (2.4999999999, 0, 2.0), (0.00005, 4, 0.0), (0.00015, 4, 0.0002)]
    df = spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "i int, x double")
    for digits in (0, 4):
        got = {r.i: r.y for r in df.select("i", half_even(F.col("x"), digits).alias("y")).collect()}
        assert all(got[i] == want for i, (_, d, want) in enumerate(cases) if d == digits)
    # model 0.5 and no other risk: 0.35; R = 180 days and one order
    one = spark.createDataFrame([(1, 73, 20, 2000.0, 0.18892857142857142)], "customer_id int, recency int, frequency int, monetary double, model_probability double")
    assert S.churn_heuristic(one).first().churn_probability == 0.2433
    assert S.churn_pseudo_features(one.withColumn("recency", F.lit(0)).withColumn("frequency", F.lit(365 / 90 * 2.5))).first().orders_last_90d == 2
    tie = one.withColumn("recency", F.lit(0)).withColumn("model_probability", F.lit(0.3625))       # 0.25375
    assert S.churn_blend(tie).first().churn_probability == 0.2538
