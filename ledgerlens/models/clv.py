"""Customer lifetime value: BG/NBD purchase model + Gamma-Gamma spend model.

* ``clv_summary`` is a grouped Spark plan (per customer and purchase day).
* Fitting maximises the published likelihoods (Fader, Hardie & Lee 2005;
  Fader & Hardie 2013). The data enter through sufficient statistics: BG/NBD
  needs only the distinct (x, t_x, T) triples with their counts, Gamma-Gamma
  the distinct (x, m) pairs. Newton steps on the log parameters: one job sums
  the likelihood, its gradient and its Hessian (closed forms) over the grouped
  table at the next point. The fit has converged when the gradient is below
  ``GRADIENT_TOL``; else the next penaliser is tried, and after the last one the
  fit raises. Times are scaled to at most 10 before the penaliser applies.
* Scoring is column arithmetic plus one Arrow-batched pandas UDF for 2F1.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma, gammaln, hyp2f1, trigamma
from ..operators.ranking import attach_scalars
from ..plans.drift import long_form, quantiles

PENALIZERS = [0.01, 0.1, 0.5, 1.0]
MAX_STEPS = 100
GRADIENT_TOL = 1e-6
LARGEST_TIME = 10.0


def clv_summary(orders: DataFrame, observation_end=None) -> DataFrame:
    """customer_id, frequency (purchase days - 1), recency (last - first day),
    T (end - first day), monetary_value (mean daily spend after the first day,
    0 without repeat days). ``end`` defaults to the last day in the data."""
    daily = (orders.filter(F.col("customer_id").isNotNull())
             .groupBy("customer_id", F.to_date("order_date").alias("day"))
             .agg(F.sum("sale_price").alias("_amt")))
    end = (orders.agg(F.max(F.to_date("order_date")).alias("_end")) if observation_end is None
           else orders.sparkSession.range(1).select(F.lit(observation_end).cast("date").alias("_end")))
    per_c = daily.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("_days"), F.min("day").alias("_first"), F.max("day").alias("_last"),
        F.sum("_amt").alias("_total"), F.min(F.struct("day", "_amt")).alias("_first_row"))
    per_c = attach_scalars(per_c, end)
    freq = F.col("_days") - 1
    repeat_amt = F.col("_total") - F.col("_first_row._amt")
    return per_c.select(
        "customer_id", freq.cast("double").alias("frequency"),
        F.datediff("_last", "_first").cast("double").alias("recency"),
        F.datediff("_end", "_first").cast("double").alias("T"),
        F.when(freq > 0, repeat_amt.cast("double") / freq.cast("double")).otherwise(F.lit(0.0)).alias("monetary_value"))


# ------------------------------------------------------------- likelihoods ---

def _bgnbd_ll(params, x, tx, T):
    r, alpha, a, b = params
    a1 = gammaln(r + x) - gammaln(r) + r * np.log(alpha)
    a2 = gammaln(a + b) + gammaln(b + x) - gammaln(b) - gammaln(a + b + x)
    a3 = -(r + x) * np.log(alpha + T)
    a4 = np.log(a) - np.log(b + np.maximum(x, 1.0) - 1.0) - (r + x) * np.log(tx + alpha)
    return a1 + a2 + np.logaddexp(a3, np.where(x > 0, a4, -np.inf))


def _gg_ll(params, x, m):
    p, q, v = params
    px = p * x
    return (gammaln(px + q) - gammaln(px) - gammaln(q) + q * np.log(v) + (px - 1.0) * np.log(m)
            + px * np.log(x) - (px + q) * np.log(x * m + v))


def _bgnbd_terms(params, x, tx, T):
    """Log likelihood of each row, its gradient (a row per parameter) and Hessian (upper triangle, by rows)."""
    r, alpha, a, b = params
    value = _bgnbd_ll(params, x, tx, T)
    again = x > 0
    more = np.maximum(x, 1.0) - 1.0
    # the two ways to the data: alive at the end, or gone after the last purchase
    base = gammaln(r + x) - gammaln(r) + r * np.log(alpha) + gammaln(a + b) + gammaln(b + x) - gammaln(b) - gammaln(a + b + x)
    alive = np.exp(-(r + x) * np.log(alpha + T) - (value - base))
    gone = np.where(again, np.exp(np.log(a) - np.log(b + more) - (r + x) * np.log(tx + alpha) - (value - base)), 0.0)
    n, zero = r + x, np.zeros_like(x)
    of_alive = [-np.log(alpha + T), -n / (alpha + T), zero, zero]
    of_gone = [-np.log(alpha + tx), -n / (alpha + tx), zero + 1.0 / a, -1.0 / (b + more)]
    mixed = [alive * u + gone * v for u, v in zip(of_alive, of_gone)]
    gradient = [digamma(r + x) - digamma(r) + np.log(alpha) + mixed[0], r / alpha + mixed[1],
                digamma(a + b) - digamma(a + b + x) + mixed[2],
                digamma(a + b) + digamma(b + x) - digamma(b) - digamma(a + b + x) + mixed[3]]
    second_alive, second_gone = {(0, 1): -1.0 / (alpha + T), (1, 1): n / (alpha + T) ** 2}, {
        (0, 1): -1.0 / (alpha + tx), (1, 1): n / (alpha + tx) ** 2, (2, 2): -1.0 / a ** 2, (3, 3): 1.0 / (b + more) ** 2}
    both = trigamma(a + b) - trigamma(a + b + x)
    own = {(0, 0): trigamma(r + x) - trigamma(r), (0, 1): 1.0 / alpha, (1, 1): -r / alpha ** 2, (2, 2): both, (2, 3): both,
           (3, 3): both + trigamma(b + x) - trigamma(b)}
    hessian = [own.get(k, 0.0) + alive * (second_alive.get(k, 0.0) + of_alive[k[0]] * of_alive[k[1]])
               + gone * (second_gone.get(k, 0.0) + of_gone[k[0]] * of_gone[k[1]]) - mixed[k[0]] * mixed[k[1]]
               for k in [(i, j) for i in range(4) for j in range(i, 4)]]
    return value, gradient, hessian


def _gg_terms(params, x, m):
    p, q, v = params
    n, total, spent = p * x + q, x * m + v, np.log(x * m + v)
    gradient = [x * (digamma(n) - digamma(p * x) + np.log(m) + np.log(x) - spent), digamma(n) - digamma(q) + np.log(v) - spent,
                q / v - n / total]
    hessian = [x * x * (trigamma(n) - trigamma(p * x)), x * trigamma(n), -x / total, trigamma(n) - trigamma(q),
               1.0 / v - 1.0 / total, n / total ** 2 - q / v ** 2]
    return _gg_ll(params, x, m), gradient, hessian


@dataclass
class FitResult:
    params: dict
    penalizer: float
    objective: float
    gradient: float
    steps: int


def _evaluator(grouped: DataFrame, cols: list[str], terms, n: int):
    """point -> (mean log likelihood, gradient, Hessian) there, in one job over the grouped table."""
    size = 1 + n + n * (n + 1) // 2

    def at(point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches):
            total = np.zeros(size + 1)
            for b in batches:
                w = b["w"].to_numpy(float)
                with np.errstate(all="ignore"):
                    value, gradient, hessian = terms(point, *[b[c].to_numpy(float) for c in cols])
                total += np.array([float(np.sum(w * v)) for v in (value, *gradient, *hessian)] + [float(w.sum())])
            yield pd.DataFrame({"s": [total.tolist()]})
        row = grouped.mapInPandas(part, "s array<double>").agg(*[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size + 1)]).first()
        sums = np.array([row[i] for i in range(size)], dtype=float) / row[size]
        hessian = np.zeros((n, n))
        hessian[np.triu_indices(n)] = sums[1 + n:]
        return float(sums[0]), sums[1:1 + n], hessian + np.triu(hessian, 1).T
    return at


def _newton(at, n: int, penalizer: float) -> tuple[np.ndarray, float, float, int]:
    """(log parameters, objective, largest gradient, jobs) where the penalised mean likelihood is least; the
    gradient is infinite if no step leads further down."""
    jobs = 0

    def look(x: np.ndarray):
        nonlocal jobs
        jobs += 1
        p = np.exp(x)
        value, gradient, hessian = at(p)
        value, gradient, hessian = -value + penalizer * (p ** 2).sum(), -gradient + 2 * penalizer * p, -hessian + 2 * penalizer * np.eye(n)
        gradient = p * gradient         # by the log parameters
        return value, gradient, np.outer(p, p) * hessian + np.diag(gradient)

    x = np.zeros(n)
    value, gradient, hessian = look(x)
    while jobs < MAX_STEPS:
        if not (np.isfinite(value) and np.isfinite(gradient).all() and np.isfinite(hessian).all()):
            break
        if np.abs(gradient).max() < GRADIENT_TOL:
            return x, value, float(np.abs(gradient).max()), jobs
        size, axes = np.linalg.eigh(hessian)
        move = -axes @ ((axes.T @ gradient) / np.maximum(np.abs(size), 1e-8))     # downhill also where it is not convex
        move *= min(1.0, 2.0 / np.abs(move).max())
        for length in (1.0, 0.3, 0.1, 0.03, 0.01, 0.001):
            found = look(x + length * move)
            # rounding aside no higher; near the optimum a smaller gradient is what tells
            if found[0] < value or found[0] <= value + 1e-12 * abs(value) and np.abs(found[1]).max() < np.abs(gradient).max():
                break
        else:
            break
        x = x + length * move
        value, gradient, hessian = found
    return x, value, float("inf"), jobs


def _fit(grouped: DataFrame, cols: list[str], terms, names: list[str]) -> FitResult:
    grouped = grouped.persist()
    try:
        at = _evaluator(grouped, cols, terms, len(names))
        for penalizer in PENALIZERS:
            x, value, gradient, jobs = _newton(at, len(names), penalizer)
            if gradient < GRADIENT_TOL:
                return FitResult(dict(zip(names, np.exp(x).tolist())), penalizer, value, gradient, jobs)
    finally:
        grouped.unpersist()
    raise RuntimeError("the likelihood fit did not converge with any penaliser")


def fit_bgnbd(summary: DataFrame) -> FitResult:
    """r, alpha, a, b. Times are scaled for the fit; alpha comes back in days."""
    longest = summary.agg(F.max("T")).first()[0]
    scale = LARGEST_TIME / longest if longest else 1.0
    g = summary.groupBy("frequency", (F.col("recency") * scale).alias("tx"), (F.col("T") * scale).alias("t")).agg(
        F.count(F.lit(1)).alias("w"))
    fit = _fit(g, ["frequency", "tx", "t"], _bgnbd_terms, ["r", "alpha", "a", "b"])
    fit.params["alpha"] /= scale
    return fit


def gg_training_set(summary: DataFrame, upper_quantile: float = 0.999) -> DataFrame:
    """Repeat buyers with positive spend, capped at the exact 99.9th percentile
    (linear interpolation) of monetary_value."""
    ret = summary.filter((F.col("frequency") > 0) & (F.col("monetary_value") > 0))
    q = quantiles(long_form(ret, ["monetary_value"]), {"upper": upper_quantile}).select("upper")
    return attach_scalars(ret, q).filter(F.col("monetary_value") <= F.col("upper")).drop("upper")


def fit_gamma_gamma(summary: DataFrame) -> FitResult:
    g = gg_training_set(summary).groupBy("frequency", "monetary_value").agg(F.count(F.lit(1)).alias("w"))
    return _fit(g, ["frequency", "monetary_value"], _gg_terms, ["p", "q", "v"])


# ------------------------------------------------------------------ scoring ---

def expected_purchases_np(t, x, tx, T, r, alpha, a, b):
    """E[purchases in (T, T+t] | x, t_x, T] of BG/NBD."""
    t = np.asarray(t, dtype=float)
    hyp = hyp2f1(r + x, b + x, a + b + x - 1.0, t / (alpha + T + t))
    first = (a + b + x - 1.0) / (a - 1.0)
    second = 1.0 - hyp * ((alpha + T) / (alpha + t + T)) ** (r + x)
    denom = 1.0 + np.where(x > 0, a / (b + x - 1.0) * ((alpha + T) / (alpha + tx)) ** (r + x), 0.0)
    return np.where(t > 0, first * second / denom, 0.0)


def p_alive(bg: dict):
    """P(alive) as a column expression."""
    r, alpha, a, b = (F.lit(bg[k]) for k in ("r", "alpha", "a", "b"))
    x, tx, T = F.col("frequency"), F.col("recency"), F.col("T")
    ratio = a / (b + x - 1) * F.pow((alpha + T) / (alpha + tx), r + x)
    return F.lit(1.0) / (F.lit(1.0) + F.when(x > 0, ratio).otherwise(F.lit(0.0)))


def clv_predict(summary: DataFrame, bg: dict, gg: dict, months: int = 1, discount_rate: float = 0.01,
                days_per_month: int = 30) -> DataFrame:
    """predicted_purchases (months*30 days), predicted_aov (0 without repeat
    purchases), clv_pred (monthly discounted), p_alive; NULL -> 0."""
    from pyspark.sql.functions import pandas_udf

    r, alpha, a, b = bg["r"], bg["alpha"], bg["a"], bg["b"]
    steps = [days_per_month * i for i in range(0, months + 1)]

    @pandas_udf("array<double>")
    def cumulative(x: pd.Series, tx: pd.Series, T: pd.Series) -> pd.Series:
        xs, txs, Ts = x.to_numpy(float), tx.to_numpy(float), T.to_numpy(float)
        cols = [expected_purchases_np(s, xs, txs, Ts, r, alpha, a, b) for s in steps]
        return pd.Series(list(np.stack(cols, axis=1)))

    p, q, v = gg["p"], gg["q"], gg["v"]
    x, m = F.col("frequency"), F.col("monetary_value")
    weight = F.lit(p) * x / (F.lit(p) * x + F.lit(q - 1.0))
    expected_aov = (F.lit(1.0) - weight) * F.lit(v * p / (q - 1.0)) + weight * m
    scored = summary.withColumn("_cum", cumulative(F.col("frequency"), F.col("recency"), F.col("T")))
    clv = None
    for i in range(1, months + 1):
        term = (F.col("_cum")[i] - F.col("_cum")[i - 1]) * expected_aov / F.lit((1.0 + discount_rate) ** i)
        clv = term if clv is None else clv + term
    return scored.select(
        "customer_id", "frequency", "recency", "T", "monetary_value",
        F.coalesce(F.col("_cum")[months], F.lit(0.0)).alias("predicted_purchases"),
        F.coalesce(F.when(x > 0, expected_aov).otherwise(F.lit(0.0)), F.lit(0.0)).alias("predicted_aov"),
        F.coalesce(F.nanvl(clv, F.lit(0.0)), F.lit(0.0)).alias("clv_pred"),
        p_alive(bg).alias("p_alive"))


def fit_and_predict(orders: DataFrame, months: int = 1, observation_end=None) -> DataFrame:
    summary = clv_summary(orders, observation_end)
    bg = fit_bgnbd(summary)
    gg = fit_gamma_gamma(summary)
    return clv_predict(summary, bg.params, gg.params, months)
