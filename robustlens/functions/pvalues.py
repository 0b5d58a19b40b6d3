"""Tail probabilities for summary rows (never for facts): regularised incomplete beta in NumPy."""
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

def _lgamma(v):
    return np.array([math.lgamma(x) for x in np.ravel(v)]).reshape(np.shape(v))


def _fraction(a, b, x, steps=200_000):
    """Lentz evaluation of the incomplete-beta continued fraction, element-wise; raises if it has not converged."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            h = h * step
        if np.nanmax(np.abs(step - 1), initial=0) < 1e-15:
            return h
    if np.nanmax(np.abs(step - 1), initial=0) > 1e-9:
        raise ArithmeticError("incomplete beta did not converge")
    return h


def betainc(a, b, x):
    """Regularised incomplete beta I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, dtype=float) for v in (a, b, x)))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1) / (a + b + 2)
    aa, bb, xx = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        front = np.exp(_lgamma(aa + bb) - _lgamma(aa) - _lgamma(bb) + aa * np.log(xx) + bb * np.log1p(-xx)) / aa
        part = np.where(xx > 0, front * _fraction(aa, bb, np.where(xx > 0, xx, 0.5)), 0.0)
    return np.where(flip, 1 - part, part)


def f_sf(f, d1, d2):
    """Upper tail of the F distribution."""
    f, d1, d2 = (np.asarray(v, dtype=float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def t_sf2(t, dof):
    """Two-sided tail of Student's t."""
    t, dof = np.broadcast_arrays(np.asarray(t, dtype=float), np.asarray(dof, dtype=float))
    many = dof > 1e7           # the normal tail differs by less than 1e-7 there, and log-gamma differences lose digits
    out = f_sf(np.where(many, 1.0, t * t), 1.0, np.where(many, 1.0, dof))
    return np.where(many, norm_sf2(t), out)


def norm_sf2(z):
    return np.array([math.erfc(abs(v) / math.sqrt(2)) for v in np.ravel(z)]).reshape(np.shape(z))


def t_ppf(p, dof):
    """Quantile of Student's t for p > 0.5, by bisection on the tail."""
    dof = np.asarray(dof, dtype=float)
    lo, hi = np.zeros_like(dof), np.full_like(dof, 1e6)
    for _ in range(100):
        mid = (lo + hi) / 2
        high = t_sf2(mid, dof) / 2 > 1 - p
        lo, hi = np.where(high, mid, lo), np.where(high, hi, mid)
    return (lo + hi) / 2


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, dof: pd.Series) -> pd.Series:
    """1 where the statistic is undefined."""
    ok = t.notna() & dof.notna() & (dof > 0)
    out = np.ones(len(t))
    if ok.any():
        out[ok] = t_sf2(t[ok].to_numpy(), dof[ok].to_numpy())
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    ok = f.notna() & (d1 > 0) & (d2 > 0)
    out = np.ones(len(f))
    if ok.any():
        out[ok] = f_sf(f[ok].to_numpy(), d1[ok].to_numpy(), d2[ok].to_numpy())
    return pd.Series(out)


@F.pandas_udf(T.DoubleType())
def t_critical(dof: pd.Series) -> pd.Series:
    """97.5% quantile (0 where dof < 1)."""
    return pd.Series(np.where(dof >= 1, t_ppf(0.975, np.maximum(dof.to_numpy(dtype=float), 1.0)), 0.0))


def corr_t(r, n):
    """t statistic of a correlation; null below three points."""
    return F.when(n > 2, r * F.sqrt((n - 2).cast("double")) / F.sqrt(F.greatest(1 - r * r, F.lit(1e-300))))


def corr_pvalue(r, n):
    """Two-sided p of a correlation; 1 where it is undefined or rests on fewer than three points."""
    r, n = (F.col(c) if isinstance(c, str) else c for c in (r, n))
    return t_pvalue(corr_t(r, n), (n - 2).cast("double"))
