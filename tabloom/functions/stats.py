"""Exact binomial confidence interval, vectorized over the rows of a small aggregate."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_lgamma = np.frompyfunc(math.lgamma, 1, 1)


def _fraction(a, b, x):
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return h


def beta_cdf(x, a, b):
    """Regularized incomplete beta function for arrays with 0 < x < 1."""
    x, a, b = (np.asarray(v, dtype="float64") for v in np.broadcast_arrays(x, a, b))
    lg = (_lgamma(a + b) - _lgamma(a) - _lgamma(b)).astype("float64")
    front = np.exp(lg + a * np.log(x) + b * np.log1p(-x))
    low = x < (a + 1.0) / (a + b + 2.0)
    left = front * _fraction(a, b, np.where(low, x, 0.5)) / a
    right = 1.0 - front * _fraction(b, a, np.where(low, 0.5, 1.0 - x)) / b
    return np.where(low, left, right)


def beta_quantile(p, a, b):
    """Inverse of :func:`beta_cdf` by bisection."""
    a = np.asarray(a, dtype="float64")
    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(80):
        mid = (lo + hi) / 2
        below = beta_cdf(mid, a, b) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return (lo + hi) / 2


def interval(acc, n, alpha: float = 0.05):
    """(low, high) arrays for int(acc * n) successes in n trials."""
    n = np.asarray(n, dtype="float64")
    x = np.floor(np.asarray(acc, dtype="float64") * n)
    lo, hi = np.zeros_like(n), np.ones_like(n)
    k = x > 0
    if k.any():
        lo[k] = beta_quantile(alpha / 2, x[k], (n - x + 1)[k])
    k = x < n
    if k.any():
        hi[k] = beta_quantile(1 - alpha / 2, (x + 1)[k], (n - x)[k])
    return lo, hi


def clopper_pearson(acc: Column, n: Column, alpha: float = 0.05) -> Column:
    """struct<low, high>; meant for one row per task, after aggregation."""

    @F.pandas_udf("low double, high double")
    def bounds(a: pd.Series, m: pd.Series) -> pd.DataFrame:
        lo, hi = interval(a.to_numpy(), m.to_numpy(), alpha)
        return pd.DataFrame({"low": lo, "high": hi})

    return bounds(acc.cast("double"), n.cast("double"))
