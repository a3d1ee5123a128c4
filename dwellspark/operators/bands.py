"""Bounds that hold for all bins of a histogram at once."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _chance(moments: np.ndarray, total: int) -> float:
    """The chance that independent Poisson counts, each known to lie in its window, add up to total, times that of the windows,
    relative to that of the total: the Edgeworth expansion of Sison and Glaz. moments: of the counts in their windows, about
    their means without one, of the orders 0 to 4, by row."""
    p, d = moments[0], moments[1:] / moments[0]
    mean, var = d[0], d[1] - d[0] ** 2
    third = d[2] - 3 * d[0] * d[1] + 2 * d[0] ** 3
    fourth = d[3] - 4 * d[0] * d[2] + 6 * d[0] ** 2 * d[1] - 3 * d[0] ** 4
    spread = var.sum()
    if not spread > 0:
        return 0.0
    skew, excess = third.sum() / spread**1.5, (fourth - 3 * var**2).sum() / spread**2
    z = -mean.sum() / math.sqrt(spread)  # the means without a window add up to the total
    bell = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    terms = 1 + skew * (z**3 - 3 * z) / 6 + excess * (z**4 - 6 * z**2 + 3) / 24 + skew**2 * (z**6 - 15 * z**4 + 45 * z**2 - 15) / 72
    whole = -total + total * math.log(total) - math.lgamma(total + 1)
    return math.exp(float(np.log(p).sum()) - whole) * bell * terms / math.sqrt(spread)


def multinomial_bounds(counts: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Low and high of each share, so that all hold at once with a chance of 1 - alpha."""
    counts = np.asarray(counts, float)
    total = int(counts.sum())
    rates = np.maximum(counts, 1e-300)
    log_factorial = np.vectorize(math.lgamma, otypes=[float])

    def at(y: np.ndarray) -> np.ndarray:
        chance = np.where(y >= 0, np.exp(y * np.log(rates) - rates - log_factorial(np.maximum(y, 0) + 1)), 0.0)
        return chance * (y - counts) ** np.arange(5)[:, None]

    # The windows grow by one count on either side, until the chance is met.
    moments, before = at(counts), 0.0
    for c in range(1, total + 1):
        moments = moments + at(counts - c) + at(counts + c)
        now = _chance(moments, total)
        if now >= 1 - alpha:
            part = (1 - alpha - before) / (now - before)
            share, low = counts / total, (c - 1) / total
            return np.maximum(share - low, 0), np.minimum(share + low + 2 * part / total, 1)
        before = now
    return np.zeros(len(counts)), np.ones(len(counts))


def simultaneous_bounds(counts: DataFrame, keys: Sequence[str], n: str = "n", alpha: float = 0.05) -> DataFrame:
    """counts (keys, bin, n) with low and high of each bin's share. A group is one histogram; one without counts has nulls."""
    names = [*keys, "bin", n]
    schema = ", ".join(f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in names) + ", low double, high double"

    def one(own: pd.DataFrame) -> pd.DataFrame:
        low, high = multinomial_bounds(own[n].to_numpy(float), alpha) if own[n].sum() > 0 else (None, None)
        return own.assign(low=low, high=high)

    return counts.select(*names).groupBy(*keys).applyInPandas(one, schema)
