"""Vectorised special functions (numpy only): log-gamma, its first two derivatives and Gauss 2F1.

Used inside Arrow-batched pandas UDFs.
"""
from __future__ import annotations

import math

import numpy as np

# Lanczos approximation, g = 7, n = 9 (published coefficients).
_G = 7.0
_P = np.array([0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
               -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6,
               1.5056327351493116e-7])
_HALF_LOG_2PI = 0.5 * math.log(2.0 * math.pi)


def gammaln(x):
    """log|Gamma(x)| for x > 0 (array or scalar)."""
    x = np.asarray(x, dtype=float)
    small = x < 0.5
    z = np.where(small, 1.0 - x, x) - 1.0
    a = np.full_like(z, _P[0])
    for i in range(1, len(_P)):
        a = a + _P[i] / (z + i)
    t = z + _G + 0.5
    lg = _HALF_LOG_2PI + (z + 0.5) * np.log(t) - t + np.log(a)
    refl = np.log(np.pi / np.abs(np.sin(np.pi * x))) - lg
    out = np.where(small, refl, lg)
    return out if out.ndim else float(out)


def _shifted(x, step):
    """(sum of ``step`` over x, x + 1, ... below 12, the first of them from 12 on), for x > 0."""
    x, total = np.array(x, dtype=float), np.zeros(np.shape(x))
    for _ in range(12):
        low = x < 12.0
        total = total + np.where(low, step(x), 0.0)
        x = np.where(low, x + 1.0, x)
    return total, x


def digamma(x):
    """First derivative of log Gamma for x > 0: recurrence up to 12, then the asymptotic series."""
    below, x = _shifted(x, lambda v: 1.0 / v)
    y = 1.0 / (x * x)
    return np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132 - y * 691 / 32760))))) - below


def trigamma(x):
    """Second derivative of log Gamma for x > 0, likewise."""
    below, x = _shifted(x, lambda v: 1.0 / (v * v))
    y = 1.0 / (x * x)
    return 1.0 / x + 0.5 * y + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * (5 / 66 - y * 691 / 2730))))) + below


def hyp2f1(a, b, c, z, tol: float = 1e-15):
    """Gauss hypergeometric 2F1(a, b; c; z) by its power series, 0 <= z < 1.

    Summed until each value's terms have fallen below ``tol`` of it; terms fall
    like z^n, so their number follows from z and the parameters. Raises for
    values outside the series' reach."""
    a, b, c, z = (np.array(v, dtype=float) for v in np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, c, z))))
    if np.any(~(np.abs(z) < 1)):
        raise ValueError("2F1: |z| must be below 1")
    total, term, open_ = np.ones_like(z), np.ones_like(z), np.ones(z.shape, dtype=bool)
    # past this index the terms' ratio stays below (1 + |z|) / 2
    most = np.max((np.abs(a) + np.abs(b) + np.abs(c) + 40.0) / (1.0 - np.abs(z)), initial=1.0) * 8
    n = 0
    while open_.any():
        if n > most:
            raise ArithmeticError("2F1: the series has not converged")
        term = np.where(open_, term * (a + n) * (b + n) / ((c + n) * (n + 1.0)) * z, 0.0)
        total = total + term
        open_ &= np.abs(term) > tol * np.abs(total)
        n += 1
    return total
