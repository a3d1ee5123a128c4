"""Curves after they are estimated: errors, densities, exponents, smoothing."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def doubled(curve: DataFrame) -> DataFrame:
    """Each row twice, numbered by copy, as steps are drawn."""
    return curve.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))


def pointwise_bounds(curve: DataFrame, n: str, z: float, y: str = "cdf") -> DataFrame:
    """low, high: the normal interval of a share y of n, within 0 and 1."""
    half = F.lit(z) * F.sqrt(F.try_divide(F.col(y) * (1 - F.col(y)), F.col(n)))
    return curve.withColumns({"low": F.greatest(F.lit(0.0), F.col(y) - half), "high": F.least(F.lit(1.0), F.col(y) + half)})


def smooth_density(weights: DataFrame, keys: Sequence[str], grid: Sequence[float], x: str = "x", weight: str = "w") -> DataFrame:
    """keys, x, density: a Gaussian kernel over weighted points at each point of a short grid, with Scott's bandwidth for
    the effective number of points. Values are summed up by key first, so rows don't matter, distinct values do."""
    points = weights.groupBy(*keys, F.col(x).alias("_x")).agg(F.sum(weight).alias("_w"))
    share = points.groupBy(*keys).agg(F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_w")).alias("_q"), F.sum(F.col("_w") * F.col("_x")).alias("_m"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_v"))
    effective = F.col("_s") * F.col("_s") / F.col("_q")
    mean = F.col("_m") / F.col("_s")
    variance = (F.col("_v") / F.col("_s") - mean * mean) / (1 - 1 / effective)
    width = F.pow(effective, F.lit(-0.2)) * F.sqrt(variance)
    # One row for each key, each of which goes with its own points.
    both = points.join(share.select(*keys, "_s", width.alias("_h")).where("_h > 0"), list(keys))
    at = both.withColumn("x", F.explode(F.array(*(F.lit(float(g)) for g in grid))))
    z = (F.col("x") - F.col("_x")) / F.col("_h")
    kernel = F.col("_w") / F.col("_s") * F.exp(-0.5 * z * z) / (F.col("_h") * float(np.sqrt(2 * np.pi)))
    return at.groupBy(*keys, "x").agg(F.sum(kernel).alias("density"))


#: Nodes to a bandwidth, and bandwidths on either side over which a kernel reaches.
NODES, REACH = 16, 5


def binned_density(df: DataFrame, keys: Sequence[str], x: str, weight: str | None = None) -> DataFrame:
    """keys, x, density at evenly spaced nodes: a Gaussian kernel over weighted values with Scott's bandwidth for the effective number of points. Each value is dealt out
    linearly to the two nodes around it, counted before it is shuffled, and the nodes are convolved with the kernel: the
    work after the count depends on the values' spread in bandwidths, not on how many there are. Nulls don't count; keys without a spread have no row."""
    own = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_w"))
    sums = own.groupBy(*keys).agg(F.sum("_w").alias("_s"), F.sum(F.col("_w") * F.col("_w")).alias("_q"), F.sum(F.col("_w") * F.col("_x")).alias("_m"), F.sum(F.col("_w") * F.col("_x") * F.col("_x")).alias("_v"), F.min("_x").alias("_low"))
    effective, mean = F.col("_s") * F.col("_s") / F.col("_q"), F.col("_m") / F.col("_s")
    width = F.pow(effective, F.lit(-0.2)) * F.sqrt(F.try_divide(F.col("_v") / F.col("_s") - mean * mean, 1 - 1 / effective))
    spans = sums.select(*keys, "_s", "_low", width.alias("_h")).where("_h > 0")
    at = (F.col("_x") - F.col("_low")) / (F.col("_h") / NODES)
    placed = own.join(spans, list(keys)).select(*keys, "_w", F.floor(at).alias("_k"), (at - F.floor(at)).alias("_f"))
    ends = F.array(F.struct(F.col("_k").alias("k"), ((1 - F.col("_f")) * F.col("_w")).alias("w")), F.struct((F.col("_k") + 1).alias("k"), (F.col("_f") * F.col("_w")).alias("w")))
    nodes = placed.select(*keys, F.explode(ends).alias("_e")).groupBy(*keys, F.col("_e.k").alias("_k")).agg(F.sum("_e.w").alias("_w"))
    kernel = F.array(*(F.struct(F.lit(j).alias("j"), F.lit(float(np.exp(-0.5 * (j / NODES) ** 2) / np.sqrt(2 * np.pi))).alias("p")) for j in range(-NODES * REACH, NODES * REACH + 1)))
    sent = nodes.select(*keys, "_k", "_w", F.explode(kernel).alias("_p")).groupBy(*keys, (F.col("_k") + F.col("_p.j")).alias("_k")).agg(F.sum(F.col("_w") * F.col("_p.p")).alias("_d"))
    return sent.join(spans, list(keys)).select(*keys, (F.col("_low") + F.col("_k") * (F.col("_h") / NODES)).alias("x"), (F.col("_d") / F.col("_s") / F.col("_h")).alias("density"))


def exponential_mean(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, mean: of the exponential whose survival is a line in the logarithm through the curve's points below 1."""
    own = curve.where("cdf < 1")
    return own.groupBy(*keys).agg((-F.try_divide(F.lit(1.0), F.regr_slope(F.log1p(-F.col("cdf")), "x"))).alias("mean"))


def tail_exponent(curve: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """keys, alpha: one more than the fall of the survival's logarithm with that of x above `least`."""
    own = curve.where((F.col("cdf") < 1) & (F.col("x") > least))
    return own.groupBy(*keys).agg((1 - F.regr_slope(F.log10(1 - F.col("cdf")), F.log10("x"))).alias("alpha"))


def power_law_at(fits: DataFrame, x: Column, into: str = "value") -> DataFrame:
    """The value at x of a line in logarithms (slope, intercept, natural)."""
    return fits.withColumn(into, F.exp(F.col("slope") * F.log(x) + F.col("intercept")))


def summary(fits: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, sample deviation and standard error (over n - 1) of each column, and their count."""
    out = []
    for c in columns:
        std = F.stddev_samp(c)
        out += [F.avg(c).alias(f"{c}_mean"), std.alias(f"{c}_std"), F.try_divide(std, F.sqrt(F.count(c) - 1)).alias(f"{c}_ste")]
    return fits.groupBy(*keys).agg(*out, F.count(F.lit(1)).alias("count"))


def weighted_level(curve: DataFrame, keys: Sequence[str], least: float, x: str = "delta", y: str = "mean", error: str = "ste") -> DataFrame:
    """The level of a curve from `least` on, points weighing by the inverse square of their errors."""
    w = F.try_divide(F.lit(1.0), F.col(error) * F.col(error))
    own = curve.where((F.col(x) >= least) & (F.col(error) > 0)).withColumn("_w", w)
    return own.groupBy(*keys).agg(F.try_divide(F.sum(F.col(y) * F.col("_w")), F.sum("_w")).alias("level"))


def polynomial_rows(window: int, order: int) -> list[list[float]]:
    """Row i: how the value at place i of a window follows from its values, by a polynomial fitted to them."""
    a = np.vander(np.arange(window) - window // 2, order + 1, increasing=True).astype(float)
    return (a @ np.linalg.pinv(a)).tolist()


def smoothed(df: DataFrame, keys: Sequence[str], t: str, x: str, window: int = 7, order: int = 3) -> DataFrame:
    """smooth, fluct: x after a Savitzky-Golay filter, and what it leaves. Frames within half a window of an end lie on the
    polynomial of the first or last whole window; trajectories of no more than a window's frames have nulls."""
    half, rows = window // 2, polynomial_rows(window, order)
    w = Window.partitionBy(*keys).orderBy(t)
    n, at = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(w) - 1
    # The window's middle, moved inwards at the ends, is `shift` frames away.
    placed = df.withColumns({"_n": n, "_i": at})
    shift = F.when(F.col("_i") < half, half - F.col("_i")).when(F.col("_i") >= F.col("_n") - half, F.col("_n") - 1 - half - F.col("_i")).otherwise(0)
    values = F.collect_list(F.struct(F.col(t), F.col(x).alias("v"))).over(w.rowsBetween(-2 * half, 2 * half))
    held = placed.withColumns({"_s": shift, "_v": values})
    start = F.least(F.col("_i"), F.lit(2 * half)) + F.col("_s") - half
    table = F.array(*(F.array(*(F.lit(c) for c in row)) for row in rows))
    weights = F.get(table, (half - F.col("_s")).cast("int"))
    terms = F.zip_with(F.slice("_v", start + 1, F.lit(window)), weights, lambda v, c: v["v"] * c)
    smooth = F.when(F.col("_n") > window, F.aggregate(terms, F.lit(0.0), lambda s, v: s + v))
    return held.withColumn("smooth", smooth).withColumn("fluct", F.col(x) - F.col("smooth")).drop("_n", "_i", "_s", "_v")
