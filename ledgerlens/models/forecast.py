"""Daily forecast by a trend with change points and Fourier seasons.

value(t) = a + b t + sum c_j max(0, t - s_j) + weekly and yearly waves, least
squares with a small penalty on the change points. The normal equations are sums
over the days: every task adds up its part of them, the parts are added by position,
and only the p x p system is solved in one place. Values and forecasts are column
expressions of the coefficients.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import lit_date

#: Waves of the week and of the year, change points over the first ``SPAN`` of the days, and their penalty.
WEEK, YEAR, CHANGES, SPAN, PENALTY = 3, 5, 12, 0.8, 1e-4
YEAR_DAYS = 365.25


@dataclass
class Trend:
    """Coefficients of the terms of ``terms`` over days since ``first``, of which there are ``days``."""
    first: object
    days: int
    coefficients: list[float]

    def value(self, day: Column) -> Column:
        """The fitted value of a day."""
        t = F.datediff(day, lit_date(self.first)).cast("double")
        parts = [F.lit(c) * x for c, x in zip(self.coefficients, columns(t, self.days))]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        return total


def change_points(days: int) -> list[float]:
    return [days * SPAN * (j + 1) / (CHANGES + 1) for j in range(CHANGES)]


def _waves() -> list[float]:
    return [2 * math.pi * k / 7.0 for k in range(1, WEEK + 1)] + [2 * math.pi * k / YEAR_DAYS for k in range(1, YEAR + 1)]


def columns(t: Column, days: int) -> list[Column]:
    """The terms at day ``t`` (a column)."""
    scaled = t / F.lit(float(max(days, 1)))
    hinges = [F.greatest(F.lit(0.0), t - F.lit(s)) / F.lit(float(max(days, 1))) for s in change_points(days)]
    return [F.lit(1.0), scaled, *hinges, *[f(t * F.lit(w)) for w in _waves() for f in (F.sin, F.cos)]]


def design(t: np.ndarray, days: int) -> np.ndarray:
    """The same terms for an array of days."""
    n = float(max(days, 1))
    hinges = [np.maximum(0.0, t - s) / n for s in change_points(days)]
    return np.stack([np.ones_like(t), t / n, *hinges, *[f(t * w) for w in _waves() for f in (np.sin, np.cos)]], axis=1)


def normal_equations(daily: DataFrame, first, days: int, day_col: str, value_col: str) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y over all days, added up by the tasks."""
    p = 2 + CHANGES + 2 * (WEEK + YEAR)

    def part(batches):
        total = np.zeros(p * p + p)
        for b in batches:
            x, y = design(b["t"].to_numpy(float), days), b["y"].to_numpy(float)
            total += np.concatenate(((x.T @ x).ravel(), x.T @ y))
        yield pd.DataFrame({"at": np.arange(len(total)), "s": total})

    rows = daily.select(F.datediff(F.col(day_col), lit_date(first)).cast("double").alias("t"), F.col(value_col).cast("double").alias("y"))
    sums = rows.filter("t is not null and y is not null").mapInPandas(part, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()   # p * p + p rows
    total = np.zeros(p * p + p)
    total[sums["at"].to_numpy()] = sums["s"].to_numpy()
    return total[:p * p].reshape(p, p), total[p * p:]


def fit_trend(daily: DataFrame, day_col: str = "day", value_col: str = "revenue") -> Trend | None:
    """Least squares over the days that have a value; None without any."""
    ends = daily.filter(F.col(value_col).isNotNull()).agg(F.min(day_col).alias("a"), F.max(day_col).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not ends.n:
        return None
    days = (ends.b - ends.a).days + 1
    xx, xy = normal_equations(daily, ends.a, days, day_col, value_col)
    held = np.zeros(len(xy))
    held[2:2 + CHANGES] = PENALTY
    held[2 + CHANGES:] = 1e-6      # a year's waves over less than a year: the smallest that fit
    return Trend(ends.a, days, np.linalg.lstsq(xx + np.diag(held * ends.n), xy, rcond=None)[0].tolist())


def forecast(daily: DataFrame, horizon: int = 14, day_col: str = "day", value_col: str = "revenue", digits: int = 2) -> DataFrame:
    """``day_col`` and ``forecast`` for the ``horizon`` days after the last one; empty without a day."""
    trend = fit_trend(daily, day_col, value_col)
    spark = daily.sparkSession
    if trend is None:
        return spark.createDataFrame([], f"{day_col} date, forecast double")
    days = spark.range(1, horizon + 1).select(F.date_add(lit_date(trend.first), (F.col("id") + trend.days - 1).cast("int")).alias(day_col))
    return days.select(day_col, F.round(trend.value(F.col(day_col)), digits).alias("forecast"))
