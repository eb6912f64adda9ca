"""Special functions evaluated in vectorised batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    floor = 1e-300

    def safe(v: np.ndarray) -> np.ndarray:
        return np.where(np.abs(v) < floor, floor, v)

    c = np.ones_like(x)
    d = 1.0 / safe(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, 400):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / safe(1.0 + even * d)
        c = safe(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / safe(1.0 + odd * d)
        c = safe(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    inner = np.clip(x, 1e-300, 1.0 - 1e-16)
    front = np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(inner) + b * np.log1p(-inner))
    swap = inner > (a + 1.0) / (a + b + 2.0)
    p, q = np.where(swap, b, a), np.where(swap, a, b)
    z = np.where(swap, 1.0 - inner, inner)
    value = front * _beta_fraction(p, q, z) / p
    value = np.where(swap, 1.0 - value, value)
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


@F.pandas_udf(DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|) for Student's t; NULL in, NULL out."""
    tv, nu = t.to_numpy(dtype=float), df.to_numpy(dtype=float)
    out = np.full(len(tv), np.nan)
    ok = np.isfinite(tv) & np.isfinite(nu) & (nu > 0)
    if ok.any():
        n = nu[ok]
        out[ok] = incomplete_beta(n / 2.0, np.full(ok.sum(), 0.5), n / (n + tv[ok] ** 2))
    return pd.Series([None if math.isnan(v) else v for v in out], dtype=object)
