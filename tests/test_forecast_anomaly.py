"""Isolation forest against a walk by hand, trend and seasons against a local solve."""
import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.models import anomaly, forecast


def _walk(nodes, x):
    at = 0
    while nodes.feature[at] >= 0:
        at = nodes.low[at] if x[nodes.feature[at]] < nodes.cut[at] else nodes.high[at]
    return nodes.length[at]


def test_forest_paths_and_scores(spark):
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.normal()), float(rng.normal()), None if i % 50 == 0 else float(i % 3)) for i in range(1500)] + [(1500, 30.0, -25.0, 9.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    features = ["a", "b", "c"]
    forest = anomaly.fit_forest(df, "id", features, trees=20, sample=64).collect()
    again = anomaly.fit_forest(df.repartition(7), "id", features, trees=20, sample=64).collect()
    assert {r.tree: r for r in forest} == {r.tree: r for r in again}
    assert len(forest) == 20 and all(len(r.feature) <= 127 for r in forest)
    got = {r.id: r for r in anomaly.score_forest(df, spark.createDataFrame(forest, anomaly.NODE), "id", features, 64, 6).collect()}
    for i, *x in rows:
        path = sum(_walk(t, [v or 0.0 for v in x]) for t in forest) / 20
        assert abs(got[i].path - path) < 1e-9 and abs(got[i].score - 2 ** (-path / anomaly.mean_path(64))) < 1e-9
    assert 1500 in [r.id for r in sorted(got.values(), key=lambda r: -r.score)[:15]] and got[1500].is_anomaly


def test_subsamples_are_bounded_and_differ(spark):
    df = spark.range(5000).withColumn("a", F.col("id").cast("double"))
    rows = anomaly.subsamples(df, "id", ["a"], 10, 100, 1).collect()
    by = {}
    for r in rows:
        by.setdefault(r.tree, set()).add(r.x[0])
    assert all(len(v) == 100 for v in by.values()) and len(by) == 10 and by[0] != by[1]
    few = anomaly.isolation_forest(df.limit(3), "id", ["a"], trees=5)
    assert few.count() == 3 and anomaly.isolation_forest(df.limit(0), "id", ["a"], trees=5).count() == 0
    same = anomaly.isolation_forest(df.limit(50).withColumn("a", F.lit(1.0)), "id", ["a"], trees=5).collect()
    assert len({r.score for r in same}) == 1


def test_mean_path():
    assert anomaly.mean_path(1) == 0 and anomaly.mean_path(2) == 1.0
    assert abs(anomaly.mean_path(256) - (2 * (math.log(255) + 0.5772156649 + 1 / 510) - 2 * 255 / 256)) < 1e-3


def _series(spark, n, gaps=()):
    first = dt.date(2021, 3, 1)
    rows = []
    for t in range(n):
        if t not in gaps:
            y = 100 + 0.5 * t - (0.8 * (t - 400) if t > 400 else 0) + 20 * math.sin(2 * math.pi * t / 7) + 35 * math.cos(2 * math.pi * t / 365.25)
            rows.append((first + dt.timedelta(days=t), y))
    return spark.createDataFrame(rows, "day date, revenue double").repartition(4), rows


def test_trend_equals_a_local_solve(spark):
    daily, rows = _series(spark, 900, gaps={5, 6, 300})
    trend = forecast.fit_trend(daily)
    t = np.array([(d - rows[0][0]).days for d, _ in rows], dtype=float)
    x, y = forecast.design(t, 900), np.array([v for _, v in rows])
    held = np.zeros(x.shape[1])
    held[2:2 + forecast.CHANGES] = forecast.PENALTY
    held[2 + forecast.CHANGES:] = 1e-6
    want = np.linalg.solve(x.T @ x + np.diag(held * len(rows)), x.T @ y)
    assert np.allclose(trend.coefficients, want, rtol=1e-6, atol=1e-6)
    got = {r.day: r.v for r in daily.select("day", trend.value(F.col("day")).alias("v")).collect()}
    assert all(abs(got[d] - v) < 1e-6 for (d, _), v in zip(rows, x @ want))
    assert np.mean(np.abs(x @ want - y)) < 3


def test_forecast_goes_on_after_the_last_day(spark):
    daily, rows = _series(spark, 1100)
    got = {r.day: r.forecast for r in forecast.forecast(daily, 28).collect()}
    _, later = _series(spark, 1128)
    assert sorted(got) == [d for d, _ in later[1100:]]
    assert np.mean([abs(got[d] - v) for d, v in later[1100:]]) < 12
    assert forecast.forecast(daily.limit(0)).count() == 0
    assert forecast.forecast(daily.limit(1), 3).count() == 3


@pytest.mark.parametrize("n", [10, 200])
def test_short_histories_have_finite_forecasts(spark, n):
    daily, _ = _series(spark, n)
    assert all(math.isfinite(r.forecast) for r in forecast.forecast(daily, 14).collect())
