"""Distribution functions on already aggregated rows (a handful per study)."""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_sf(x: float, k: float) -> float:
    """Upper tail of the chi-squared distribution: series below a + 1, continued fraction above."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h, i = d, 1
    while True:
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            return front * h
        i += 1


def rank_sum_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p-value of the U statistic: exact without ties when a group has at most eight values, else the normal
    approximation with tie and continuity correction."""
    if ties == 0 and min(n1, n2) <= 8:
        # Number of rank arrangements per U: coefficients of the Gaussian binomial coefficient
        small, large = min(n1, n2), max(n1, n2)
        ways = np.zeros(n1 * n2 + 1)
        ways[0] = 1
        for i in range(1, small + 1):
            top = large + i
            numer = ways.copy()
            if top < len(ways):
                numer[top:] -= ways[:-top]
            for j in range(i, len(numer)):
                numer[j] += numer[j - i]
            ways = numer
        hi = max(u, n1 * n2 - u)
        return float(min(1.0, 2 * ways[math.ceil(hi):].sum() / ways.sum()))
    n = n1 + n2
    var = n1 * n2 / 12 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / math.sqrt(var)
    return float(min(1.0, math.erfc(z / math.sqrt(2))))


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the numerically integrated density."""
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)

    def cdf(t):
        x = np.linspace(0, t, 4001)
        y = c * (1 + x * x / df) ** (-(df + 1) / 2)
        return 0.5 + float((y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()) * (x[1] - x[0]) / 3)

    lo, hi = 0.0, 1e3
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return lo


@F.pandas_udf(DoubleType())
def chi2_p(h: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else chi2_sf(float(x), float(d)) for x, d in zip(h, k)], dtype="float64")


@F.pandas_udf(DoubleType())
def rank_sum_p_col(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else rank_sum_p(float(x), int(a), int(b), float(t)) for x, a, b, t in zip(u, n1, n2, ties)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_critical(n: pd.Series) -> pd.Series:
    cache: dict = {}
    return pd.Series([None if pd.isna(v) or v < 2 else cache.setdefault(int(v), t_quantile(0.975, int(v) - 1)) for v in n], dtype="float64")
