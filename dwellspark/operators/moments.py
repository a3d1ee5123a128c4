"""Moments that can be combined, and summaries of trajectories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellspark.functions.special import normal_below, normal_quantile
from dwellspark.operators.distributions import running
from dwellspark.operators.ordered import Sum, Whole, along


def moments(df: DataFrame, keys: Sequence[str], columns: Sequence[str], ns: Sequence[int] = (0, 1, 2)) -> DataFrame:
    """Raw moments in long form: keys, column, moment, value. The 0th is the number of values; NaN counts as missing."""
    aggregates = []
    for c in columns:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggregates += [(F.count(x).cast("double") if n == 0 else F.avg(F.pow(x, F.lit(n)))).alias(f"{c}_{n}") for n in ns]
    wide = df.groupBy(*keys).agg(*aggregates)
    entries = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("moment"), F.col(f"{c}_{n}").alias("value")) for c in columns for n in ns]
    return wide.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def combine_moments(parts: DataFrame, keys: Sequence[str], part: Sequence[str]) -> DataFrame:
    """Moments of the whole from those of its parts, which carry their 0th."""
    count = F.max(F.when(F.col("moment") == 0, F.col("value"))).over(Window.partitionBy(*keys, *part, "column"))
    weighted = parts.withColumn("_n", count)
    mean = F.try_divide(F.sum(F.col("value") * F.col("_n")), F.sum(F.when(F.col("value").isNotNull(), F.col("_n"))))
    return weighted.groupBy(*keys, "column", "moment").agg(F.when(F.col("moment") == 0, F.sum("value")).otherwise(mean).alias("value"))


def mean_of_means(df: DataFrame, keys: Sequence[str], mean: str = "mean", count: str = "count") -> DataFrame:
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(mean) * F.col(count)), F.sum(count)).alias(mean))


def power_law_slope(df: DataFrame, keys: Sequence[str], x: str, least: float) -> DataFrame:
    """Maximum-likelihood exponent of a power law above `least`."""
    tail = df.where(F.col(x) >= least)
    return tail.groupBy(*keys).agg((1 + F.try_divide(F.count(x), F.sum(F.log(F.col(x) / least)))).alias("slope"))


def loglog_fit(df: DataFrame, keys: Sequence[str], x: str = "delta", y: str = "mean", below: float | None = None) -> DataFrame:
    """Least squares of ln y on ln x over positive values: slope, intercept, r, standard error and number of points."""
    own = df.where((F.col(x) > 0) & (F.col(y) > 0)) if below is None else df.where((F.col(x) > 0) & (F.col(y) > 0) & (F.col(x) < below))
    lx, ly = F.log(x), F.log(y)
    found = own.groupBy(*keys).agg(F.regr_slope(ly, lx).alias("slope"), F.regr_intercept(ly, lx).alias("intercept"), F.corr(ly, lx).alias("r"), F.regr_count(ly, lx).alias("n"), F.regr_sxx(ly, lx).alias("_sxx"), F.regr_syy(ly, lx).alias("_syy"))
    left = F.greatest(F.col("_syy") - F.col("slope") * F.col("slope") * F.col("_sxx"), F.lit(0.0))
    return found.withColumn("stderr", F.sqrt(F.try_divide(F.try_divide(left, F.col("n") - 2), F.col("_sxx")))).drop("_sxx", "_syy")


def gyration(df: DataFrame, keys: Sequence[str], coords: Sequence[str]) -> DataFrame:
    """Mean distance from the trajectory's centre."""
    w, total = Window.partitionBy(*keys), F.lit(0.0)
    for c in coords:
        off = F.col(c) - F.avg(c).over(w)
        total = total + off * off
    return df.withColumn("_r", F.sqrt(total)).groupBy(*keys).agg(F.avg("_r").alias("radius"))


def fraction(df: DataFrame, keys: Sequence[str], what: Column) -> DataFrame:
    x = what.cast("double")
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.count(x).alias("count"))


def without_drift(df: DataFrame, frame: Sequence[str], coords: Sequence[str], digits: int = 6) -> DataFrame:
    """Coordinates less their mean over all that is in the frame. Means are of exact decimals with `digits` places, and are joined
    to the rows: a frame of all trajectories is no group of one task."""
    total = lambda c: F.sum(F.col(c).cast(f"decimal(28,{digits})")).cast("double") / F.count(c)
    means = df.groupBy(*frame).agg(*(total(c).alias(f"_{c}") for c in coords))
    moved = df.join(means, list(frame)).withColumns({c: F.col(c) - F.col(f"_{c}") for c in coords})
    return moved.select(*df.columns)


def every(df: DataFrame, keys: Sequence[str], skip: int, within: Sequence[str]) -> DataFrame:
    """Rows of each skip-th group, in the order of its keys, within larger groups."""
    groups = df.select(*within, *keys).distinct()
    # Groups are numbered by ranges of their first key: each range by itself, after as many as are in those before.
    cuts = groups.groupBy(*within).agg(F.percentile_approx(keys[0], [i / 64 for i in range(1, 64)], 1000).alias("_cuts"))
    placed = groups.join(cuts, list(within)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(keys[0])))).drop("_cuts")
    sizes = placed.groupBy(*within, "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = placed.join(sizes.withColumn("_before", before).drop("_n"), [*within, "_range"])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*within, "_range").orderBy(*keys)) - 1
    chosen = numbered.withColumn("_rank", rank).where(F.col("_rank") % skip == 0).select(*within, *keys)
    return df.join(chosen, [*within, *keys], "left_semi").select(*df.columns)


def two_sided(t: Column, dof: Column) -> Column:
    """The chance of a Student t farther from 0 than this one: the finite sums for whole degrees of freedom."""
    x = F.abs(t) / F.sqrt(dof)
    square, sine = 1 / (1 + x * x), x / F.sqrt(1 + x * x)
    odd = dof % 2 == 1

    def more(s: Column, k: Column) -> Column:
        term = s["term"] * square * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    # Terms 1 to (dof - 3) / 2 or dof / 2 - 1, after the first one, which is 1.
    last = F.when(odd, (dof - 3) / 2).otherwise(dof / 2 - 1).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")), more, lambda s: s["total"])
    within = F.when(odd, 2 / F.pi() * (F.atan(x) + F.when(dof > 1, sine * F.sqrt(square) * total).otherwise(0.0))).otherwise(sine * total)
    return F.when(t.isNotNull() & (dof > 0), F.greatest(1 - within, F.lit(0.0)))


def normality(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, n, ngp, ks, ad of x, standardised by the mean and sample deviation of its key: the non-Gaussian parameter, and the
    statistics of Kolmogorov and Smirnov and of Anderson and Darling against a normal. Equal values are one row, and their
    ranks come from running sums in ranges, so no task sorts all values of a key. Keys with a deviation of 0 have no row."""
    there = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("x"))
    about = there.groupBy(*keys).agg(F.avg("x").alias("_mean"), F.stddev_samp("x").alias("_std"), F.count(F.lit(1)).alias("n")).where("_std > 0")
    values = there.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_m"))
    ranked = running(values, keys, "x", {"_up": F.col("_m")}).join(about, list(keys))
    z = (F.col("x") - F.col("_mean")) / F.col("_std")
    ranked = ranked.withColumn("_z", z).withColumn("_p", normal_below(F.col("_z"))).withColumn("_q", normal_below(-F.col("_z")))
    below = F.col("_up") - F.col("_m")
    gap = F.greatest(F.abs(F.col("_up") / F.col("n") - F.col("_p")), F.abs(F.col("_p") - below / F.col("n")))
    # Ranks i = below + 1 to _up: the sums of 2 i - 1 and of 2 (n - i) + 1 are differences of squares.
    low = (F.col("_up") * F.col("_up") - below * below) * F.log(F.col("_p"))
    high = ((F.col("n") - below) * (F.col("n") - below) - (F.col("n") - F.col("_up")) * (F.col("n") - F.col("_up"))) * F.log(F.col("_q"))
    square = F.col("_z") * F.col("_z")
    sums = ranked.groupBy(*keys, "n").agg(F.sum(square * F.col("_m")).alias("_two"), F.sum(square * square * F.col("_m")).alias("_four"), F.max(gap).alias("ks"), F.sum(low + high).alias("_ad"))
    ngp = F.col("_four") * F.col("n") / (3 * F.col("_two") * F.col("_two")) - 1
    return sums.select(*keys, "n", ngp.alias("ngp"), "ks", (-F.col("n") - F.col("_ad") / F.col("n")).alias("ad"))


#: Royston's polynomials (1992, 1995) for the two outermost weights, in the inverse root of n, lowest power first.
_OUTER, _NEXT = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
#: Mean and logarithm of the deviation of the normalised statistic, in n from 4 to 11, and in the logarithm of n above.
_FEW = ((0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322))
_MANY = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def _polynomial(coefficients: Sequence[float], x: Column) -> Column:
    total = F.lit(0.0)
    for c in reversed(coefficients):
        total = total * x + F.lit(c)
    return total


def shapiro_wilk(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, n, w, p: Shapiro's and Wilk's statistic of normality and its chance by Royston's approximation. The weights are those of expected normal order statistics at the
    values' ranks within their key, which are running counts along ranges, so no task sorts all values of a key. Nulls don't count; keys of fewer than three values, or of equal ones, have no
    row. The approximation was fitted up to n = 5000."""
    values = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("x")).groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("_m"))
    ranked = along(values, keys, ["x"], _up=Sum(F.col("_m")), n=Whole(F.col("_m"))).where("n >= 3")
    # A row for each rank: equal values hold several.
    ranked = ranked.withColumn("_i", F.explode(F.sequence(F.col("_up") - F.col("_m") + 1, F.col("_up"))))
    ranked = ranked.withColumn("_e", normal_quantile((F.col("_i") - 0.375) / (F.col("n") + 0.25)))
    own = {"_ee": F.col("_e") * F.col("_e"), "_ex": F.col("_e") * F.col("x"), "_x": F.col("x"), "_xx": F.col("x") * F.col("x")}
    # Values about their middle one lose fewer digits.
    middle = values.groupBy(*keys).agg((F.sum(F.col("x") * F.col("_m")) / F.sum("_m")).alias("_mean"))
    ranked = ranked.join(middle, list(keys)).withColumn("x", F.col("x") - F.col("_mean"))
    at = lambda i: F.col("_i") == i
    ends = {"_e1": F.max(F.when(at(F.col("n")), F.col("_e"))), "_e2": F.max(F.when(at(F.col("n") - 1), F.col("_e"))), "_r1": F.max(F.when(at(F.col("n")), F.col("x"))) - F.max(F.when(at(F.lit(1)), F.col("x"))),
            "_r2": F.max(F.when(at(F.col("n") - 1), F.col("x"))) - F.max(F.when(at(F.lit(2)), F.col("x")))}
    s = ranked.groupBy(*keys, "n").agg(*(F.sum(c).alias(k) for k, c in own.items()), *(c.alias(k) for k, c in ends.items()))
    s = s.withColumn("_ss", F.col("_xx") - F.col("_x") * F.col("_x") / F.col("n")).where("_ss > 0")
    u, norm = 1 / F.sqrt("n"), F.sqrt("_ee")
    a1 = F.when(F.col("n") == 3, math.sqrt(0.5)).otherwise(_polynomial(_OUTER, u) + F.col("_e1") / norm)
    s = s.withColumns({"_a1": a1, "_a2": F.when(F.col("n") > 5, _polynomial(_NEXT, u) + F.col("_e2") / norm)})
    wide = F.col("n") > 5
    rest = F.col("_ee") - 2 * F.col("_e1") * F.col("_e1") - F.when(wide, 2 * F.col("_e2") * F.col("_e2")).otherwise(0.0)
    left = 1 - 2 * F.col("_a1") * F.col("_a1") - F.when(wide, 2 * F.col("_a2") * F.col("_a2")).otherwise(0.0)
    # The weights of all ranks but the outer ones are expected values over one number.
    inner = F.col("_ex") - F.col("_e1") * F.col("_r1") - F.when(wide, F.col("_e2") * F.col("_r2")).otherwise(0.0)
    line = F.col("_a1") * F.col("_r1") + F.when(wide, F.col("_a2") * F.col("_r2")).otherwise(0.0) + F.when(F.col("n") > 3, inner / F.sqrt(F.try_divide(rest, left))).otherwise(0.0)
    s = s.withColumn("w", F.least(line * line / F.col("_ss"), F.lit(1.0)))
    n, size = F.col("n").cast("double"), F.log("n")
    gap = F.log(1 - F.col("w"))
    few = (-F.log(-2.273 + 0.459 * n - gap) - _polynomial(_FEW[0], n)) / F.exp(_polynomial(_FEW[1], n))
    many = (gap - _polynomial(_MANY[0], size)) / F.exp(_polynomial(_MANY[1], size))
    three = 6 / math.pi * (F.asin(F.sqrt(F.least("w", F.lit(1.0)))) - math.asin(math.sqrt(0.75)))
    z = F.when(F.col("w") >= 1, F.lit(None).cast("double")).when(F.col("n") > 11, many).otherwise(few)
    # Where the gap is beyond what the approximation for few values knows, the chance is nought.
    p = F.when(F.col("n") == 3, F.greatest(three, F.lit(0.0))).when(F.col("w") >= 1, 1.0).when((F.col("n") < 12) & (gap >= -2.273 + 0.459 * n), 0.0).otherwise(normal_below(-z))
    return s.select(*keys, "n", "w", p.alias("p"))
