"""Distribution tails and unit-root statistics for grouped and scalar UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _chi2_sf(x: float, k: float) -> float:
    """Upper tail by the recurrence Q(a+1, x) = Q(a, x) + x^a e^-x / Gamma(a+1)."""
    if not (x >= 0 and k > 0):
        return math.nan
    h = x / 2.0
    if h == 0:
        return 1.0
    a, q = (0.5, math.erfc(math.sqrt(h))) if k % 2 else (1.0, math.exp(-h))
    while a < k / 2.0 - 1e-9:
        q += math.exp(a * math.log(h) - h - math.lgamma(a + 1.0))
        a += 1.0
    return min(1.0, q)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series([_chi2_sf(a, b) for a, b in zip(x, k)], dtype="float64")


def phi(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


@F.pandas_udf(DoubleType())
def normal_cdf(z: pd.Series) -> pd.Series:
    return z.map(phi, na_action="ignore").astype("float64")


# Published response-surface coefficients of the tau distribution
# with a constant, for one and for two variables (MacKinnon).
TAU = {
    1: dict(lowest=-18.83, star=-1.61, highest=2.74,
            small=(2.1659, 1.4412, 0.038269), large=(1.7339, 0.93202, -0.12745, -0.010368)),
    2: dict(lowest=-18.86, star=-2.62, highest=0.92,
            small=(2.92, 1.5012, 0.039796), large=(2.1945, 0.64695, -0.29198, -0.042377)),
}
# Level-stationarity critical values and their p-values.
KPSS_POINTS = (0.347, 0.463, 0.574, 0.739)
KPSS_P = (0.10, 0.05, 0.025, 0.01)


def tau_p(stat: float, n_vars: int = 1) -> float:
    t = TAU[n_vars]
    if stat > t["highest"]:
        return 1.0
    if stat < t["lowest"]:
        return 0.0
    coef = t["small"] if stat <= t["star"] else t["large"]
    return phi(sum(c * stat ** i for i, c in enumerate(coef)))


def _ols(y: np.ndarray, X: np.ndarray):
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    e = y - X @ beta
    return beta, e


def adf_stat(x: np.ndarray, constant: bool = True) -> float:
    """Unit-root t-statistic with the lag count of lowest AIC."""
    x = np.asarray(x, float)
    n = len(x)
    top = min(int(math.ceil(12.0 * (n / 100.0) ** 0.25)), n // 2 - 2 - int(constant))
    dx = np.diff(x)

    def design(p: int, skip: int):
        rows = np.arange(skip, len(dx))
        cols = [x[rows]] + [dx[rows - j] for j in range(1, p + 1)]
        if constant:
            cols.append(np.ones(len(rows)))
        return dx[rows], np.column_stack(cols)

    def aic(p: int) -> float:
        y, X = design(p, top)
        _, e = _ols(y, X)
        m = len(y)
        return m * (math.log(2 * math.pi * float(e @ e) / m) + 1) + 2 * X.shape[1]

    best = min(range(top + 1), key=aic)
    y, X = design(best, best)
    beta, e = _ols(y, X)
    s2 = float(e @ e) / (len(y) - X.shape[1])
    return float(beta[0] / math.sqrt(s2 * np.linalg.inv(X.T @ X)[0, 0]))


def kpss_stat(x: np.ndarray) -> float:
    """Level-stationarity statistic with the data-driven bandwidth."""
    e = np.asarray(x, float) - np.mean(x)
    n = len(e)
    cov = lambda j: float(e[j:] @ e[:n - j]) / n
    span = int(n ** (2.0 / 9.0))
    s0 = cov(0) + 2 * sum(cov(j) for j in range(1, span + 1))
    s1 = 2 * sum(j * cov(j) for j in range(1, span + 1))
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    long_run = cov(0) + 2 * sum((1 - j / (width + 1)) * cov(j) for j in range(1, width + 1))
    return float(np.sum(np.cumsum(e) ** 2) / n ** 2 / long_run)


def kpss_p(stat: float) -> float:
    return float(np.interp(stat, KPSS_POINTS, KPSS_P))
