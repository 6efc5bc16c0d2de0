"""Upper tails and quantiles of the F, chi-square and Student t distributions.

They run as Arrow functions over result tables (one row per test).
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = 2000
_TINY = 1e-300
#: Degrees of freedom beyond which the series of the chi-square tail are too long.
_WIDE = 10_000


def _lgamma_ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(gamma(a + b) / gamma(a)); the difference form stays exact for huge a."""
    lg = np.vectorize(math.lgamma, otypes=[float])
    big = a > 1e4
    safe = np.where(big, 1.0, a)
    direct = lg(safe + np.where(big, 1.0, b)) - lg(safe)
    s = np.where(big, a, 1e6)
    t = s + b
    stirling = (
        (s - 0.5) * np.log1p(b / s) + b * np.log(t) - b + 1 / (12 * t) - 1 / (12 * s)
    )
    return np.where(big, stirling, direct)


def _beta_fraction(a, b, x):
    """Continued fraction of the incomplete beta function, evaluated by Lentz's rule."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 4e-16):
            break
    return np.where(np.abs(step - 1) < 1e-12, h, np.nan)  # not settled: no value rather than a wrong one


def f_tail(f, d1, d2) -> np.ndarray:
    """P(F > f) for arrays; NaN in, NaN out."""
    f, d1, d2 = (np.asarray(v, float) for v in np.broadcast_arrays(f, d1, d2))
    out = np.where(np.isnan(f) | np.isnan(d1) | np.isnan(d2) | (d2 <= 0), np.nan, 1.0)
    out[(f == np.inf) & ~np.isnan(out)] = 0.0
    use = np.isfinite(f) & (f > 0) & ~np.isnan(out)
    # Long panels: gamma limit of the beta tail, relative error of order 1/d2².
    far = use & (d2 > 2e6)
    if far.any():
        n = d2[far] / 2 + (d1[far] / 2 - 1) / 2
        out[far] = chi2_tail(2 * n * np.log1p(d1[far] * f[far] / d2[far]), d1[far])
        use &= ~far
    if not use.any():
        return out
    f, d1, d2 = f[use], d1[use], d2[use]
    a, b = d2 / 2, d1 / 2
    x, y = d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f)
    log_x = -np.log1p(d1 * f / d2)
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(_lgamma_ratio(a, b) - lg(b) + a * log_x + b * np.log(y))
    upper = y > (b + 1) / (a + b + 2)
    p, q = np.where(upper, a, b), np.where(upper, b, a)
    part = front / p * _beta_fraction(p, q, np.where(upper, x, y))
    out[use] = np.clip(np.where(upper, part, 1 - part), 0.0, 1.0)
    return out


def _wide_gamma_tail(z: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Upper tail at z of the gamma distribution of large shape a: its density is summed outwards from z, on the side away from the mean.

    Sixteen standard deviations in Gauss panels that widen; the density by Stirling's series, in the distance from a.
    """
    node, weight = np.polynomial.legendre.leggauss(32)
    edge = np.array([0, 0.05, 0.15, 0.4, 1, 2, 4, 7, 11, 16])
    half = np.diff(edge)[:, None] / 2
    u, w = (edge[:-1, None] + half * (node + 1)).ravel(), (half * weight).ravel()
    above, a = z > a, a[:, None]
    far = z[:, None] - a + np.where(above, 1, -1)[:, None] * np.sqrt(a) * u
    share = np.maximum(far / a, 1e-12 - 1)
    density = np.exp(-a * (share - np.log1p(share)) - 1 / (12 * a)) / (np.sqrt(2 * np.pi) * (1 + share))
    side = np.where(far > -a, density, 0.0) @ w
    return np.where(above, side, 1 - side)


def chi2_tail(x, df) -> np.ndarray:
    """P(chi2(df) > x) for arrays."""
    x, df = (np.asarray(v, float) for v in np.broadcast_arrays(x, df))
    out = np.where(np.isnan(x) | np.isnan(df), np.nan, 1.0)
    out[(x == np.inf) & ~np.isnan(out)] = 0.0
    use = np.isfinite(x) & (x > 0) & ~np.isnan(out)
    if not use.any():
        return out
    wide = use & (df > _WIDE)
    if wide.any():
        out[wide] = np.clip(_wide_gamma_tail(x[wide] / 2, df[wide] / 2), 0.0, 1.0)
        use &= ~wide
        if not use.any():
            return out
    z, a = x[use] / 2, df[use] / 2
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = np.exp(a * np.log(z) - z - lg(a))
    low = z < a + 1
    # below the mean: power series of the lower tail
    term = total = 1 / a
    for n in range(1, _STEPS):
        term = np.where(low, term * z / (a + n), 0.0)
        total = total + term
        if np.all(term <= 1e-17 * total):
            break
    # above the mean: continued fraction of the upper tail
    zc = np.where(low, a + 2, z)
    b0 = zc + 1 - a
    c, d = np.full_like(zc, 1 / _TINY), 1 / b0
    h = d.copy()
    for n in range(1, _STEPS):
        an = -n * (n - a)
        b0 = b0 + 2
        d = an * d + b0
        d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
        c = b0 + an / c
        c = np.where(np.abs(c) < _TINY, _TINY, c)
        h = h * (c * d)
        if np.all(np.abs(c * d - 1) < 4e-16):
            break
    out[use] = np.clip(np.where(low, 1 - front * total, front * h), 0.0, 1.0)
    return out


def _quantile(tail, log_density, level: np.ndarray) -> np.ndarray:
    """Point whose upper tail is 1 - level: Newton steps, halved back into a bracket when they leave it."""
    target = 1 - level
    lo, hi = np.zeros_like(target), np.ones_like(target)
    for _ in range(1000):
        short = tail(hi) > target
        if not short.any():
            break
        lo, hi = np.where(short, hi, lo), np.where(short, hi * 2, hi)
    x = (lo + hi) / 2
    for _ in range(200):
        gap = tail(x) - target
        lo, hi = np.where(gap > 0, x, lo), np.where(gap > 0, hi, x)
        with np.errstate(all="ignore"):
            step = x + gap * np.exp(-log_density(x))
        new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
        done = np.all(np.abs(new - x) <= 1e-14 * np.abs(new))
        x = new
        if done:
            break
    return x


def f_quantile(level, d1, d2) -> np.ndarray:
    level, d1, d2 = (np.array(v, float) for v in np.broadcast_arrays(level, d1, d2))
    a, b = d2 / 2, d1 / 2
    lg = np.vectorize(math.lgamma, otypes=[float])
    front = _lgamma_ratio(a, b) - lg(b) + b * np.log(d1 / d2)

    def log_density(x):
        return front + (b - 1) * np.log(x) - (a + b) * np.log1p(d1 * x / d2)

    return _quantile(lambda v: f_tail(v, d1, d2), log_density, level)


def chi2_quantile(level, df) -> np.ndarray:
    level, df = (np.array(v, float) for v in np.broadcast_arrays(level, df))
    a = df / 2
    front = -np.vectorize(math.lgamma, otypes=[float])(a) - a * np.log(2)
    return _quantile(lambda v: chi2_tail(v, df), lambda x: front + (a - 1) * np.log(x) - x / 2, level)


def normal_quantile(level: float) -> float:
    return NormalDist().inv_cdf(level)


def _as_col(v) -> Column:
    return v if isinstance(v, Column) else F.col(v) if isinstance(v, str) else F.lit(v)


def _call(fn, *args) -> Column:
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series(fn(*[c.to_numpy(dtype=float, na_value=np.nan) for c in cols]))

    # Marked so that a filter on the result does not evaluate the function a second time below the projection.
    udf = F.pandas_udf(run, "double").asNondeterministic()
    return udf(*[_as_col(a).cast("double") for a in args])


def f_sf(f, d1, d2) -> Column:
    """Upper tail of F(d1, d2) at ``f``."""
    return _call(f_tail, f, d1, d2)


def chi2_sf(x, df) -> Column:
    """Upper tail of chi-square(df) at ``x``."""
    return _call(chi2_tail, x, df)


def t_sf2(t, df) -> Column:
    """Two-sided Student t tail, as the F(1, df) tail of the square."""
    t = _as_col(t)
    return f_sf(t * t, 1, df)


def f_ppf(level, d1, d2) -> Column:
    """Quantile of F(d1, d2)."""
    return _call(f_quantile, level, d1, d2)


def chi2_ppf(level, df) -> Column:
    """Quantile of chi-square(df)."""
    return _call(chi2_quantile, level, df)


def f_sf_even(f, m: int, d2) -> Column:
    """Upper tail of F(2m, d2) as a plain Column: finite sum, no Python stage."""
    f, d2 = _as_col(f), _as_col(d2).cast("double")
    g = F.greatest(f, F.lit(0.0))
    a, ratio = d2 / 2, (2 * m) * g / d2
    y = ratio / (1 + ratio)
    term = total = F.lit(1.0)
    for j in range(1, m):
        term = term * y * (a + (j - 1)) / j
        total = total + term
    return F.when(f.isNotNull(), F.exp(-a * F.log1p(ratio)) * total)


def chi2_sf_even(x, m: int) -> Column:
    """Upper tail of chi-square(2m) as a plain Column."""
    x = _as_col(x)
    h = F.greatest(x, F.lit(0.0)) / 2
    term = total = F.lit(1.0)
    for j in range(1, m):
        term = term * h / j
        total = total + term
    return F.when(x.isNotNull(), F.exp(-h) * total)
