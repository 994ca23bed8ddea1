"""Student and F tails, and the exact rank-sum, for result tables: Arrow-batched, each batch as whole arrays.

The F density on the scale of log f is exp(g) times a constant, with g concave and 0 at f = 1. Both g and the
constant are written so that nothing cancels at any degrees of freedom: g in terms of log(1 + y) - y, the constant
in terms of what Stirling's formula leaves of a log-gamma. A tail is the integral of the density from its side of
f = 1 outwards, by Gauss-Legendre on panels that reach to where the density has fallen by exp(-45).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .normal import chi2_sf, normal_two_sided

PANELS, FALL = 20, 45.0
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)
#: Rows that are integrated at once: 320 nodes each.
ROWS = 2048
#: Coefficients of Stirling's series for log-gamma, B(2k) / (2k (2k - 1)).
STIRLING = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360, 1 / 156]


def _stirling_rest(a: np.ndarray) -> np.ndarray:
    """log-gamma(a) less Stirling's (a - 1/2) log a - a + log(2 pi) / 2; small arguments are raised above 16 first."""
    a, out = a.astype(float), np.zeros(len(a))
    for _ in range(16):
        low = a < 16
        if not low.any():
            break
        # rest(a) - rest(a + 1) = (a + 1/2) log(1 + 1/a) - 1
        out[low] += (a[low] + 0.5) * np.log1p(1 / a[low]) - 1
        a = np.where(low, a + 1, a)
    power = inverse = 1 / a
    rest = np.zeros(len(a))
    for c in STIRLING:
        rest += c * power
        power = power * inverse * inverse
    return out + rest


def _log1p_less(y: np.ndarray, log1p_y: np.ndarray) -> np.ndarray:
    """log(1 + y) - y without cancellation; `log1p_y` is used away from 0."""
    small = np.abs(y) <= 0.5
    r = np.where(small, y / (2 + np.where(small, y, 0.0)), 0.0)
    square, series = r * r, np.zeros_like(r)
    for k in range(41, 1, -2):
        series = series * square + 1 / k
    return np.where(small, 2 * r * square * series - y * r, log1p_y - y)


def _log_density(v: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """g at v = log f >= 0."""
    fall = np.exp(-v)
    gap = -np.expm1(-v)
    scale = df1 + df2 * fall
    y, z = -df1 * gap / scale, df2 * gap / scale  # 1 + y and 1 + z are the ratios of the two shares to their centre
    log_y = np.where(y > -0.5, np.log1p(np.maximum(y, -0.5)), np.log((df1 + df2) / scale) - v)
    return df2 / 2 * _log1p_less(y, log_y) + df1 / 2 * _log1p_less(z, np.log1p(z))


def _outer(v: np.ndarray, df1: np.ndarray, df2: np.ndarray) -> np.ndarray:
    """Probability of log F > v, for v >= 0."""
    top = _log_density(v, df1, df2)
    out = np.zeros(len(v))
    rows = np.flatnonzero(top > -746)  # beyond it the tail is no double
    v, df1, df2, top = v[rows], df1[rows], df2[rows], top[rows]
    reach = np.full(len(v), 1e-12)
    while (near := _log_density(v + reach, df1, df2) > top - FALL).any():
        reach = np.where(near, reach * 2, reach)
    for back in (0.75, 0.8, 0.85, 0.9, 0.95):  # not much farther than needed
        shorter = reach * back
        reach = np.where(_log_density(v + shorter, df1, df2) < top - FALL, shorter, reach)
    a, b = df2 / 2, df1 / 2
    rest = _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    density = np.sqrt(a / (a + b) * b / (2 * math.pi)) * np.exp(rest)
    edges = np.arange(PANELS)[:, None]
    places = ((edges + 0.5 + _NODES / 2) / PANELS).ravel()
    weights = np.tile(_WEIGHTS / (2 * PANELS), PANELS)
    for s in range(0, len(v), ROWS):
        part = slice(s, s + ROWS)
        at = v[part, None] + reach[part, None] * places
        heights = np.exp(_log_density(at, df1[part, None], df2[part, None]))
        out[rows[part]] = density[part] * reach[part] * (heights @ weights)
    return np.minimum(out, 1.0)


def log_f_tail(v, df1, df2) -> np.ndarray:
    """Probability that F exceeds exp(v), for arrays; NaN where an argument is missing or a df is not positive.

    Relative error below 1e-9 for degrees of freedom up to 1e15 (infinite ones count as 1e300).
    """
    v, df1, df2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (v, df1, df2)))
    out = np.full(v.shape, np.nan)
    good = ~np.isnan(v) & (df1 > 0) & (df2 > 0)
    df1, df2 = np.minimum(df1, 1e300), np.minimum(df2, 1e300)
    up = good & (v >= 0)
    down = good & (v < 0)
    out[up & np.isinf(v)] = 0.0
    out[down & np.isinf(v)] = 1.0
    up, down = up & np.isfinite(v), down & np.isfinite(v)
    out[up] = _outer(v[up], df1[up], df2[up])
    out[down] = 1.0 - _outer(-v[down], df2[down], df1[down])
    return out


def f_tails(f, df1, df2) -> np.ndarray:
    f = np.asarray(f, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        v = np.where(f > 0, np.log(f), np.where(np.isnan(f), np.nan, -np.inf))
    return log_f_tail(v, df1, df2)


def t_tails(t, df) -> np.ndarray:
    with np.errstate(divide="ignore"):
        v = 2 * np.log(np.abs(np.asarray(t, float)))
    return log_f_tail(v, 1.0, df)


def t_points(p, df) -> np.ndarray:
    """Quantiles of Student's t for p >= 1/2: Newton steps on the log of the tail, kept inside a bracket, for a whole batch."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    out = np.full(p.shape, np.nan)
    good = (p >= 0.5) & (p <= 1) & (df > 0)
    out[good & (p == 0.5)] = 0.0
    out[good & (p == 1)] = np.inf
    rows = np.flatnonzero(good & (p > 0.5) & (p < 1))
    goal, df = np.log(2 * (1 - p[rows])), np.minimum(df[rows], 1e300)
    low, high = np.full(len(rows), -80.0), np.full(len(rows), 1.0)
    while (far := np.log(np.maximum(log_f_tail(high, 1.0, df), 5e-324)) > goal).any() and high.max() < 1400:
        low, high = np.where(far, high, low), np.where(far, high * 2, high)
    v = (np.maximum(low, -2.0) + high) / 2
    half = np.full(len(v), 0.5)
    rest = _stirling_rest(df / 2 + 0.5) - _stirling_rest(df / 2) - _stirling_rest(half)
    log_density = 0.5 * np.log(df / (df + 1) * 0.5 / (2 * math.pi)) + rest
    for _ in range(100):
        tail = np.log(np.maximum(log_f_tail(v, 1.0, df), 5e-324))
        above = tail > goal
        low, high = np.where(above, v, low), np.where(above, high, v)
        mirrored = np.where(v >= 0, _log_density(np.abs(v), half * 2, df), _log_density(np.abs(v), df, half * 2))
        step = v + (tail - goal) * np.exp(np.minimum(tail - log_density - mirrored, 50.0))
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(new - v) <= 1e-13 * np.maximum(1.0, np.abs(v))):
            v = new
            break
        v = new
    out[rows] = np.exp(v / 2)
    return out


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, as a tail of F."""
    if not 0.0 < x < 1.0:
        return float(x >= 1.0)
    return float(log_f_tail([math.log1p(-x) - math.log(x) + math.log(a / b)], 2 * b, 2 * a)[0])


def _one(x: np.ndarray) -> float | None:
    return None if np.isnan(x[0]) else float(x[0])


def _numbers(*values) -> list[list[float]]:
    return [[math.nan if v is None else float(v)] for v in values]


def f_tail(f: float, df1: float, df2: float) -> float | None:
    return _one(f_tails(*_numbers(f, df1, df2)))


def t_tail(t: float, df: float) -> float | None:
    return _one(t_tails(*_numbers(t, df)))


def t_point(p: float, df: float) -> float | None:
    """Quantile of Student's t for p >= 1/2."""
    return _one(t_points(*_numbers(p, df)))


#: Sides of the exact rank-sum are below this, so all its tables together take about 10 MB.
EXACT_ROWS = 50


@lru_cache(maxsize=EXACT_ROWS**2)
def _rank_sum_shares(n1: int, n2: int) -> np.ndarray:
    """Cumulative share of each rank-sum statistic 0..n1*n2 when no values are tied; kept for every pair of sizes."""
    ways = np.zeros(n1 * n2 + 1)
    ways[0] = 1.0
    for i in range(1, n1 + 1):
        grown = ways.copy()
        grown[n2 + i :] -= ways[: max(0, len(ways) - n2 - i)]
        for r in range(i):
            grown[r::i] = np.cumsum(grown[r::i])
        ways = grown
    return np.cumsum(ways) / ways.sum()


def exact_rank_sums(w, n1, n2) -> np.ndarray:
    """Two-sided probabilities of rank-sum statistics at least as far from their centre; one table for each pair of sizes.

    Missing statistics or sizes give NaN. The distribution is symmetric in the two sizes, and the upper tail is read
    from the lower one, as one minus the lower share would cancel.
    """
    w, n1, n2 = (np.asarray(x, float) for x in (w, n1, n2))
    out = np.full(len(w), np.nan)
    rows = np.flatnonzero(~(np.isnan(w) | np.isnan(n1) | np.isnan(n2)))
    sizes = np.sort(np.stack([n1[rows], n2[rows]], axis=1), axis=1).astype(np.int64)
    at = np.rint(w[rows]).astype(np.int64)
    at = np.minimum(at, sizes[:, 0] * sizes[:, 1] - at)
    kinds, kind = np.unique(sizes, axis=0, return_inverse=True)
    for k, (a, b) in enumerate(kinds.tolist()):
        mine = kind.ravel() == k
        out[rows[mine]] = np.minimum(1.0, 2.0 * _rank_sum_shares(a, b)[at[mine]])
    return out


def exact_rank_sum(w: float, n1: int, n2: int) -> float:
    return float(exact_rank_sums([w], [n1], [n2])[0])


def _series(values: np.ndarray) -> pd.Series:
    return pd.Series(values).astype("object").where(~np.isnan(values), None).astype("Float64")


@pandas_udf(T.DoubleType())
def f_sf(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    """Upper tail of the F distribution."""
    return _series(f_tails(f, df1, df2))


@pandas_udf(T.DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t."""
    return _series(t_tails(t, df))


@pandas_udf(T.DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    """Quantile of Student's t (upper half)."""
    return _series(t_points(p, df))


@pandas_udf(T.DoubleType())
def rank_sum_exact(w: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Two-sided exact rank-sum probability; meant for untied groups below 50 rows."""
    return _series(exact_rank_sums(w, n1, n2))


def with_p_value(
    results: DataFrame,
    dist: str,
    stat: str,
    df1: str | None = None,
    df2: str | None = None,
    out: str = "p",
) -> DataFrame:
    """Add a tail probability to a test-result table: `normal` and `t` two-sided, `chi2` and `f` upper."""

    def number(name: str) -> Column:
        return F.col(name).cast("double")

    if dist == "normal":
        p = normal_two_sided(f"`{stat}`")
    elif dist == "chi2":
        p = chi2_sf(f"`{stat}`", f"`{df1}`")
    elif dist == "t":
        p = t_two_sided(number(stat), number(df1))
    elif dist == "f":
        p = f_sf(number(stat), number(df1), number(df2))
    else:
        raise ValueError(f"unknown distribution {dist!r}")
    return results.withColumn(out, p)
