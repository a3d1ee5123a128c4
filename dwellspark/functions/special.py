"""Theory that needs special functions, as Arrow UDFs: Spark has neither the error function nor Mittag-Leffler's."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf


def _erfc(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.array([math.erfc(v) for v in x.ravel()]).reshape(x.shape)


@lru_cache(maxsize=32)
def _spectrum(alpha: float, nodes: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Rates and weights of E_alpha(-t**alpha) as a mixture of exponentials exp(-r t), for alpha between 0 and 1: the
    mixture's density, over the logarithm of the rate, is smooth and falls off at both ends."""
    u = np.linspace(-40 / alpha, 40 / alpha, nodes * 8)
    r = np.exp(u)
    ra = np.exp(alpha * u)
    density = math.sin(alpha * math.pi) / math.pi * ra / (ra * ra + 2 * ra * math.cos(alpha * math.pi) + 1)
    return r, density * (u[1] - u[0])


def relaxation(x: np.ndarray, alpha: float) -> np.ndarray:
    """E_alpha(-x), the Mittag-Leffler function of a negative argument, for x >= 0 and 0 < alpha <= 1."""
    x = np.asarray(x, float)
    if alpha == 1:
        return np.exp(-x)
    rate, weight = _spectrum(alpha)
    t = np.power(x, 1 / alpha).ravel()
    out = np.array([weight @ np.exp(-rate * s) for s in t]) / weight.sum()
    return out.reshape(x.shape)


def _coefficient(p, b: float, beads: float, kbt: float):
    return 3 * math.pi**2 * kbt / (beads * b**2) * np.square(p)


def mode_correlation(p: float, t: Column, alpha: float, b: float, beads: float, kbt: float = 1.0, xi: float = 1.0) -> Column:
    """Correlation of a Rouse mode with itself a time t later."""
    k = float(_coefficient(p, b, beads, kbt))

    @pandas_udf("double")
    def f(t: pd.Series) -> pd.Series:
        return pd.Series(3 * kbt / k * relaxation(k * t.to_numpy(float) ** alpha / (beads * xi * math.gamma(3 - alpha)), alpha))

    return f(t.cast("double"))


def middle_msd(t: Column, alpha: float, b: float, beads: float, kbt: float = 1.0, xi: float = 1.0, modes: int = 1000) -> Column:
    """Mean squared displacement of the middle bead of a Rouse chain in a fractional medium."""

    @pandas_udf("double")
    def f(t: pd.Series) -> pd.Series:
        s = t.to_numpy(float)
        own = 6 * kbt / xi * s if alpha == 1 else 3 * kbt / xi * math.sin(alpha * math.pi) / (math.pi * (1 - alpha / 2) * (1 - alpha) * alpha) * s**alpha
        total = own / beads
        for p in range(1, modes + 1):
            k = float(_coefficient(2 * p, b, beads, kbt))
            scale = 1.0 if alpha == 1 else math.gamma(3 - alpha)
            total = total + 12 * kbt / k * (1 - relaxation(k * s**alpha / (beads * xi * scale), alpha))
        return pd.Series(total)

    return f(t.cast("double"))


def mode_velocity_correlation(t: Column, delta: Column, p: float, alpha: float, b: float, beads: float, kbt: float = 1.0, xi: float = 1.0) -> Column:
    """A mode's part of the correlation of velocities over a lag delta."""
    z = float(_coefficient(p, b, beads, kbt)) / (beads * xi * math.gamma(3 - alpha))

    @pandas_udf("double")
    def f(t: pd.Series, delta: pd.Series) -> pd.Series:
        e = lambda x: relaxation(z * np.abs(x) ** alpha, alpha)
        s, d = t.to_numpy(float), delta.to_numpy(float)
        return pd.Series(2 * e(s) - e(s + d) - e(s - d))

    return f(t.cast("double"), delta.cast("double"))


def two_locus_correlation(t: Column, delta: Column, apart: float, b: float, kbt: float = 1.0, xi: float = 1.0) -> Column:
    """Correlation of the velocities of two loci `apart` beads from each other on an endless chain."""
    k = 3 * kbt / b**2

    def part(s: np.ndarray) -> np.ndarray:
        s = np.abs(s)
        z = np.divide(apart**2 * xi, 4 * k * s, out=np.full_like(s, np.inf), where=s > 0)
        root = np.sqrt(np.where(np.isfinite(z), z, 0))
        g = np.where(np.isfinite(z), 2 * np.exp(-np.where(np.isfinite(z), z, 0)) - 2 * math.sqrt(math.pi) * root * _erfc(root), 0.0)
        return np.sqrt(s) * g

    @pandas_udf("double")
    def f(t: pd.Series, delta: pd.Series) -> pd.Series:
        s, d = t.to_numpy(float), delta.to_numpy(float)
        return pd.Series(3 * kbt / (d**2 * math.sqrt(xi * k)) * (part(s - d) + part(s + d) - 2 * part(s)))

    return f(t.cast("double"), delta.cast("double"))


def normal_below(z: Column) -> Column:
    """The chance of a standard normal below z; in its lower tail as exact as the error function."""

    @pandas_udf("double")
    def f(z: pd.Series) -> pd.Series:
        return pd.Series(_erfc(-z.to_numpy(float) / math.sqrt(2)) / 2)

    return f(z.cast("double"))


def normal_quantile(p: Column) -> Column:
    """The value that a standard normal is below with chance p; null unless p lies between 0 and 1."""

    @pandas_udf("double")
    def f(p: pd.Series) -> pd.Series:
        unit = NormalDist()
        return pd.Series([unit.inv_cdf(x) if 0 < x < 1 else None for x in p], dtype=float)

    return f(p)


def curvature(x: np.ndarray, alpha: float) -> np.ndarray:
    """E_{alpha, alpha - 1}(-x), the Mittag-Leffler function of two parameters, for x > 0 and 0 < alpha < 1. It is minus
    t**(2 - alpha) times the second derivative of relaxation(t**alpha) in t."""
    x = np.asarray(x, float)
    rate, weight = _spectrum(alpha)
    t = np.power(x, 1 / alpha).ravel()
    out = np.array([-(s ** (2 - alpha)) * (weight @ (rate * rate * np.exp(-rate * s))) for s in t]) / weight.sum()
    return out.reshape(x.shape)


def middle_velocity_correlation(t: Column, alpha: float, b: float, beads: float, kbt: float = 1.0, xi: float = 1.0, modes: int = 1000) -> Column:
    """Correlation of the velocity of the middle bead of a Rouse chain in a fractional medium; null at t = 0."""

    @pandas_udf("double")
    def f(t: pd.Series) -> pd.Series:
        s = t.to_numpy(float)
        s = np.where(s > 0, s, np.nan)
        own = -3 * kbt / xi * math.sin(alpha * math.pi) / (math.pi * (2 - alpha)) * s ** (alpha - 2)
        total = np.zeros_like(s)
        for p in range(1, modes + 1):
            total += curvature(float(_coefficient(2 * p, b, beads, kbt)) * s**alpha / (beads * xi * math.gamma(3 - alpha)), alpha)
        return pd.Series(own * (1 + 2 * (alpha - 1) * total)).replace(np.nan, None)

    return f(t.cast("double"))


def separation_correlation(t: np.ndarray, delta: np.ndarray, relaxed: float) -> np.ndarray:
    """Correlation of the velocities of the separation of two loci on an endless Rouse chain, relative to that of one free locus at
    t = 0: that of a locus with itself, less that with the other, from which it is as far as relaxes in that time."""

    def part(s: np.ndarray) -> np.ndarray:
        s = np.abs(s)
        z = np.divide(relaxed, s, out=np.full_like(s, np.inf), where=s > 0)
        there = np.where(np.isfinite(z), z, 0.0)
        cross = np.where(np.isfinite(z), np.exp(-there) - math.sqrt(math.pi) * np.sqrt(there) * _erfc(np.sqrt(there)), 0.0)
        return np.sqrt(s) * (1 - cross)

    return (part(t - delta) + part(t + delta) - 2 * part(t)) / (2 * np.sqrt(delta))


def _shared(z: np.ndarray) -> np.ndarray:
    """The part of their motion that two loci of an ideal chain have in common, where z is their relaxation time over the lag: 1 at 0."""
    return np.exp(-z) - np.sqrt(math.pi * z) * _erfc(np.sqrt(z))


@lru_cache(maxsize=64)
def shared_motion(exponent: float, low: float = -9.0, high: float = 9.0, points: int = 1441) -> tuple[np.ndarray, np.ndarray]:
    """A table of the part of their motion that two loci of a Rouse chain have in common, in a medium in which a locus moves with this
    exponent (up to 1/2, that of a viscous one): logarithms (to the base 10) of the lag over their relaxation time, and the part.

    In a fractional medium the modes' relaxation E_a(-k t^a), with a twice the exponent, is a mixture of exp(-k t^a u), where u is the power -a of a
    one-sided stable number. By Kanter's form that number comes of an angle and an exponential number; both are integrated over, by Gauss's and by the trapezoid rule."""
    alpha, at = 2.0 * exponent, np.linspace(low, high, points)
    if not 0 < alpha <= 1:
        raise ValueError("the exponent lies between 0 and 1/2")
    z = 10.0 ** (-alpha * at)
    if alpha == 1:
        return at, _shared(z)
    nodes, weights = np.polynomial.legendre.leggauss(48)
    angle = (nodes + 1) * math.pi / 2
    # The number's logarithm is (v - a) (1 - alpha) / alpha less; v is that of the exponential number.
    a = (1 - alpha) * np.log(np.sin((1 - alpha) * angle)) + alpha * np.log(np.sin(alpha * angle)) - np.log(np.sin(angle))
    v = np.linspace(-36.0, 4.5, 271)
    u = np.exp((1 - alpha) * v[None, :] - a[:, None])
    # Squared displacements grow with the root of the effective time t^a u.
    share = weights[:, None] * np.exp(v - np.exp(v))[None, :] * np.sqrt(u)
    u, share = u.ravel(), (share / share.sum()).ravel()
    kept = share > 1e-14
    return at, np.array([share[kept] @ _shared(x / u[kept]) for x in z])


def separation_correlation_at(t: np.ndarray, delta: np.ndarray, relaxed: float, exponent: float) -> np.ndarray:
    """separation_correlation for any exponent up to 1/2, by straight lines in the table of shared_motion."""
    at, shared = shared_motion(exponent)

    def part(s: np.ndarray) -> np.ndarray:
        s = np.abs(s)
        where = np.log10(np.divide(s, relaxed, out=np.full_like(s, 1.0), where=s > 0))
        return s**exponent * (1 - np.interp(where, at, shared))

    return (part(t - delta) + part(t + delta) - 2 * part(t)) / (2 * delta**exponent)
