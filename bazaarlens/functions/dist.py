"""Distribution functions in numpy, for the few rows that carry test statistics, and their pandas UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_erf = np.vectorize(math.erf, otypes=[float])
_lgamma = np.vectorize(math.lgamma, otypes=[float])


def norm_cdf(x) -> np.ndarray:
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


def norm_sf2(x) -> np.ndarray:
    """Two-sided tail of the standard normal."""
    return np.vectorize(math.erfc, otypes=[float])(np.abs(np.asarray(x, float)) / math.sqrt(2))


def norm_ppf(p) -> np.ndarray:
    """Inverse normal by Newton steps on the distribution function, from a logistic start."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    low = np.minimum(p, 1 - p)
    t = np.sqrt(-2 * np.log(low))
    x = -(t - np.log(t * math.sqrt(2 * math.pi) + 1e-12) / np.maximum(t, 1e-3))
    x = np.where(low > 0.2, (low - 0.5) * math.sqrt(2 * math.pi), x)
    for _ in range(60):
        tail = 0.5 * np.vectorize(math.erfc, otypes=[float])(-x / math.sqrt(2))
        density = np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
        step = (tail - low) / np.maximum(density, 1e-300)
        x = x - np.clip(step / (1 + np.clip(step * x / 2, -0.5, 0.5)), -1, 1)
    return np.where(p > 0.5, -x, x)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function, by its continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    flip = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    c, f = np.ones_like(x), d
    for m in range(1, 300):
        for even in (True, False):
            k = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if even else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + k * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + k / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    out = np.where(x == 0, 0.0, front * f)
    return np.where(flip, 1 - out, out)


def gamma_inc(a, x) -> np.ndarray:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.maximum(np.asarray(x, float), 0))
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(-x + a * np.log(np.where(x > 0, x, 1)) - _lgamma(a))
        term, total = 1 / a, 1 / a
        for n in range(1, 500):
            term = term * x / (a + n)
            total = total + term
        b = x + 1 - a
        c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
        h = d
        for n in range(1, 500):
            k = -n * (n - a)
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        return np.where(x <= 0, 0.0, np.where(x < a + 1, front * total, 1 - front * h))


def t_sf2(t, df) -> np.ndarray:
    """Two-sided tail of Student's t."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_inc(np.maximum(df, 1e-9) / 2, 0.5, df / (df + t * t))


def f_sf(x, d1, d2) -> np.ndarray:
    x = np.maximum(np.asarray(x, float), 0)
    d1, d2 = np.asarray(d1, float), np.asarray(d2, float)
    if np.ndim(d2) == 0 and np.isinf(d2):
        return 1 - gamma_inc(d1 / 2, d1 * x / 2)
    return beta_inc(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def chi2_sf(x, df) -> np.ndarray:
    return 1 - gamma_inc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


# Response surfaces for the tau statistic (MacKinnon 1994), as (small, large, star, least, greatest).
SURFACE = {
    (1, "n"): ((0.6344, 1.2378, 0.032496), (0.4797, 0.93557, -0.06999, 0.033066), -1.04, -19.04, math.inf),
    (1, "c"): ((2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368), -1.61, -18.83, 2.74),
    (1, "ct"): ((3.2512, 1.6047, 0.049588), (2.5261, 0.61654, -0.37956, -0.060285), -2.89, -16.18, 0.70),
    (2, "c"): ((2.92, 1.5012, 0.039796), (2.1945, 0.64695, -0.29198, -0.042377), -2.62, -18.86, 0.92),
}
# Finite-sample critical values (MacKinnon 2010) at 1, 5 and 10 %.
CRITICAL = {
    (1, "c"): ((-3.43035, -6.5393, -16.786, -79.433), (-2.86154, -2.8903, -4.234, -40.040), (-2.56677, -1.5384, -2.809)),
    (1, "ct"): ((-3.95877, -9.0531, -28.428, -134.155), (-3.41049, -4.3904, -9.036, -45.374), (-3.12705, -2.5856, -3.925, -22.380)),
    (2, "c"): ((-3.89644, -10.9519, -22.527), (-3.33613, -6.1101, -6.823), (-3.04445, -4.2412, -2.720)),
}
LEVELS = ("1%", "5%", "10%")


def mackinnon_p(tau, trend: str = "c", n: int = 1) -> np.ndarray:
    """Approximate p-value; NaN where the papers' surface is not at hand (quadratic trends)."""
    tau = np.asarray(tau, float)
    if (n, trend) not in SURFACE:
        return np.full(tau.shape, np.nan)
    small, large, star, least, greatest = SURFACE[n, trend]
    poly = lambda c: sum(k * tau**i for i, k in enumerate(c))
    p = norm_cdf(np.where(tau <= star, poly(small), poly(large)))
    return np.where(np.isnan(tau), np.nan, np.where(tau > greatest, 1.0, np.where(tau < least, 0.0, p)))


def mackinnon_critical(n_obs, trend: str = "c", n: int = 1) -> np.ndarray:
    """(rows, 3): critical values at 1, 5 and 10 %."""
    t = np.asarray(n_obs, float)
    if (n, trend) not in CRITICAL:
        return np.full((*t.shape, 3), np.nan)
    return np.stack([sum(k / t**i for i, k in enumerate(row)) for row in CRITICAL[n, trend]], -1)


def udf(function, *fixed):
    """A Column function that applies a numpy function to columns of doubles; nulls stay null."""

    @F.pandas_udf(T.DoubleType())
    def run(*columns: pd.Series) -> pd.Series:
        values = [c.astype(float).to_numpy() for c in columns]
        ok = ~np.any([np.isnan(v) for v in values], axis=0)
        out = np.full(len(values[0]), np.nan)
        if ok.any():
            out[ok] = function(*[v[ok] for v in values], *fixed)
        return pd.Series(out).astype(object).where(~np.isnan(out), None)

    return lambda *columns: run(*[c.cast("double") if not isinstance(c, str) else F.col(c).cast("double") for c in columns])


normal_p = udf(norm_sf2)
normal_quantile = udf(norm_ppf)
normal_cdf = udf(norm_cdf)
student_p = udf(t_sf2)
f_p = udf(f_sf)
chi2_p = udf(chi2_sf)
