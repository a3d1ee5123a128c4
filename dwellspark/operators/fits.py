"""Curves fitted to correlations, group by group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellspark.functions.special import separation_correlation, separation_correlation_at

def usable(df: DataFrame, t: str = "t", delta: str = "delta", y: str = "cvv_normed", ste: str | None = None, counts: str | None = None, most: float = 4.0, least: int = 3) -> DataFrame:
    """Rows that a curve can be fitted to: finite times, lags above 0, finite values and errors, at most `most` lags, and more than
    `least` counts."""
    for c in (t, delta, y, *([ste] if ste else [])):
        df = df.where(F.abs(F.col(c).cast("double")) < float("inf"))
    df = df.where((F.col(delta) > 0) & (F.col(t) <= most * F.col(delta)))
    return df.where(F.col(counts) > least) if counts else df


_FIXED = "alpha double, amplitude double, rest double, points long"


def fit_alpha(df: DataFrame, keys: Sequence[str], t: str = "t", delta: str = "delta", y: str = "cvv_normed", low: float = 0.05, high: float = 1.95, most: float = 4.0) -> DataFrame:
    """keys, alpha, amplitude, rest, points: least squares of a fractional velocity correlation, amplitude times its form
    for alpha, over finite points of at most `most` lags. The amplitude follows from alpha, which is searched between its
    bounds: on a grid, then by golden sections around its best point. A group is a curve, one row for each time."""

    def form(alpha: float, own: pd.DataFrame) -> np.ndarray:
        p = lambda x: np.abs(x) ** alpha
        return (p(own[t] - own[delta]) - 2 * p(own[t]) + p(own[t] + own[delta])).to_numpy() / (2 * p(own[delta].to_numpy()))

    def rest(alpha: float, own: pd.DataFrame) -> tuple[float, float]:
        f, want = form(alpha, own), own[y].to_numpy(float)
        a = max(0.0, float(f @ want) / max(float(f @ f), 1e-300))
        return float(((a * f - want) ** 2).sum()), a

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.astype({t: float, delta: float})
        found: list = [None, None, None, len(own)]
        if len(own) >= 3:
            grid = np.linspace(low, high, 77)
            k = int(np.argmin([rest(a, own)[0] for a in grid]))
            a, b = grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)]
            g = (np.sqrt(5) - 1) / 2
            for _ in range(60):
                c, d = b - g * (b - a), a + g * (b - a)
                a, b = (a, d) if rest(c, own)[0] <= rest(d, own)[0] else (c, b)
            alpha = float((a + b) / 2)
            found[:3] = alpha, rest(alpha, own)[1], rest(alpha, own)[0]
        return pd.DataFrame([[*key, *found]], columns=[*keys, "alpha", "amplitude", "rest", "points"])

    good = usable(df, t, delta, y, most=most)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", {_FIXED}"
    return good.select(*keys, t, delta, y).groupBy(*keys).applyInPandas(one, schema)


_TWO = "amplitude double, relaxed double, amplitude_var double, relaxed_var double, covariance double, rest double, points long"


def _golden(rest, a: float, b: float, steps: int = 60) -> float:
    g = (np.sqrt(5) - 1) / 2
    for _ in range(steps):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if rest(c) <= rest(d) else (c, b)
    return float((a + b) / 2)


def fit_two_loci(df: DataFrame, keys: Sequence[str], t: str = "t", delta: str = "delta", y: str = "cvv_normed", amplitudes: tuple[float, float] = (0.0, 10.0), times: tuple[float, float] = (1.5, 1000.0), most: float = 4.0, exponent: float = 0.5) -> DataFrame:
    """keys, amplitude, relaxed, their covariance, rest, points: least squares of the velocity correlation of two linked loci that relax as
    Rouse chains do where a locus moves with the given exponent, over finite points of at most `most` lags. Both are held between bounds. The amplitude follows from the relaxation time, which
    is searched on a logarithmic grid, then by golden sections. The covariance is that of the linearised model, as curve fits give it; null
    with fewer than three points or at a bound. A group is a curve, one row for each time and lag."""

    def one(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        at, lag, want = (own[c].to_numpy(float) for c in (t, delta, y))
        found: list = [None] * 6 + [len(own)]
        form = separation_correlation if exponent == 0.5 else lambda a, b, c: separation_correlation_at(a, b, c, exponent)

        def best(log_time: float) -> tuple[float, float]:
            f = form(at, lag, float(np.exp(log_time)))
            a = float(np.clip((f @ want) / max(float(f @ f), 1e-300), *amplitudes))
            return float(((a * f - want) ** 2).sum()), a

        if len(own) >= 2:
            grid = np.linspace(*np.log(times), 100)
            k = int(np.argmin([best(g)[0] for g in grid]))
            where = _golden(lambda g: best(g)[0], grid[max(0, k - 1)], grid[min(len(grid) - 1, k + 1)])
            rest, a = best(where)
            found[:2], found[5] = (a, float(np.exp(where))), rest
            h = 1e-4 * np.exp(where)
            slope = a * (form(at, lag, np.exp(where) + h) - form(at, lag, np.exp(where) - h)) / (2 * h)
            j = np.c_[form(at, lag, float(np.exp(where))), slope]
            inside = amplitudes[0] < a < amplitudes[1] and times[0] * 1.001 < np.exp(where) < times[1] / 1.001
            if len(own) > 2 and inside and np.linalg.cond(j) < 1e8:
                cov = np.linalg.inv(j.T @ j) * rest / (len(own) - 2)
                found[2:5] = float(cov[0, 0]), float(cov[1, 1]), float(cov[0, 1])
        return pd.DataFrame([[*key, *found]], columns=[*keys, *(c.split()[0] for c in _TWO.split(", "))])

    good = usable(df, t, delta, y, most=most)
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + f", {_TWO}"
    return good.select(*keys, t, delta, y).groupBy(*keys).applyInPandas(one, schema)
