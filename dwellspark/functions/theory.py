"""Closed forms of diffusion theory as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def fractional_msd(t: Column, alpha: float, kbt: float = 1.0, xi: float = 1.0) -> Column:
    """Mean squared displacement of a fractional Langevin particle."""
    if alpha == 1:  # the limit, in which the sine and 1 - alpha vanish together
        return 6 * kbt / xi * t
    return F.lit(3 * kbt / xi * math.sin(alpha * math.pi) / (math.pi * (1 - alpha / 2) * (1 - alpha) * alpha)) * F.pow(t, F.lit(alpha))


def fractional_velocity_correlation(t: Column, alpha: float, kbt: float = 1.0, xi: float = 1.0) -> Column:
    return F.lit(-3 * kbt / xi * math.sin(alpha * math.pi) / (math.pi * (2 - alpha))) * F.abs(F.pow(t, F.lit(alpha - 2)))


def normalised_velocity_correlation(t: Column, delta: Column, alpha: float) -> Column:
    """Of velocities over a lag delta, t apart, relative to t = 0."""
    p = lambda x: F.pow(F.abs(x), F.lit(alpha))
    return (p(t - delta) - 2 * p(t) + p(t + delta)) / (2 * p(delta))


def rouse_mode(p: Column, n: Column, beads: float = 1.0) -> Column:
    return F.when(p == 0, 1.0).otherwise(math.sqrt(2) * F.cos(p * math.pi * n / beads))


def rouse_mode_coefficient(p: Column, b: float, beads: float, kbt: float = 1.0) -> Column:
    return F.lit(3 * math.pi**2 * kbt / (beads * b**2)) * p * p


def rouse_time(alpha: float, b: float, beads: Column, kbt: float = 1.0, xi: float = 1.0) -> Column:
    return F.pow(beads * beads * F.lit(b * b * xi / kbt), F.lit(1 / alpha))


def rouse_middle_msd(t: Column, b: float, beads: float, kbt: float = 1.0, xi: float = 1.0, modes: int = 1000) -> Column:
    """Of the middle bead of a Rouse chain: its even modes, and the chain's own diffusion."""

    def mode(total: Column, p: Column) -> Column:
        k = rouse_mode_coefficient(2 * p.cast("double"), b, beads, kbt)
        return total + 12 * kbt / k * (1 - F.exp(-k * t / (beads * xi)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(modes)), F.lit(0.0), mode) + 6 * kbt / (xi * beads) * t


def log_gamma(x: Column) -> Column:
    """ln of the gamma function of a positive number: Stirling's series eight places further on, and back by the recurrence."""
    z = x + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5)))
    product = x
    for k in range(1, 8):
        product = product * (x + k)
    return series - F.log(product)


def discrete_velocity_correlation(t: Column, delta: Column, alpha: float, kbt: float = 1.0, xi: float = 1.0) -> Column:
    """Of velocities over a lag delta of a fractional Langevin particle, t apart; in three pieces."""
    eta = F.try_divide(delta, t)
    power = lambda x: F.pow(x, F.lit(alpha))
    scale = F.try_divide(fractional_velocity_correlation(t, alpha, kbt, xi), eta * eta * (alpha * (1 - alpha)))
    apart = scale * (2 - power(1 - eta) - power(1 + eta))
    over = scale * (2 + power(eta - 1) - power(1 + eta)) + F.try_divide(fractional_msd(delta - t, alpha, kbt, xi), delta * delta)
    return F.when(t == 0, F.try_divide(fractional_msd(delta, alpha, kbt, xi), delta * delta)).when(eta <= 1, apart).otherwise(over)
