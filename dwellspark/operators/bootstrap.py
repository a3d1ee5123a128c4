"""Bootstraps as a key: each row takes part in each replicate as often as a seeded Poisson draw says."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellspark.operators.ordered import Sum, Whole, along
from dwellspark.operators.scratch import written

#: Draws above this have a chance below 1e-7 (for a mean of at most 1) and count as it.
MOST = 9
#: Draws that are made from one row.
PART = 10_000


def uniform(seed: int, *columns: str | Column) -> Column:
    """A number between 0 and 1, from the first 32 bits of the MD5 of the columns' text: it only depends on them and the
    seed, so that a lost task draws the same again. A null column is skipped."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def poisson(u: Column, mean: float | Column = 1.0) -> Column:
    """The Poisson draw of a mean of at most 1 that u stands for."""
    if isinstance(mean, Column):
        steps = F.sequence(F.lit(1), F.lit(MOST - 1))
        first = F.struct(F.exp(-mean).alias("chance"), F.exp(-mean).alias("below"), (u >= F.exp(-mean)).cast("int").alias("drawn"))

        def more(s: Column, k: Column) -> Column:
            chance = s["chance"] * mean / k
            below = s["below"] + chance
            return F.struct(chance.alias("chance"), below.alias("below"), (s["drawn"] + (u >= below).cast("int")).alias("drawn"))

        return F.aggregate(steps, first, more, lambda s: s["drawn"])
    below, chance, drawn = 0.0, math.exp(-mean), F.lit(0)
    for k in range(MOST):
        below += chance
        chance *= mean / (k + 1)
        drawn = drawn + (u >= below).cast("int")
    return drawn


def resampled(df: DataFrame, identity: Sequence[str], replicates: int, seed: int = 0, mean: float | Column = 1.0) -> DataFrame:
    """df with boot_id and times, how often a row counts there; rows that a replicate doesn't draw are left out. Rows
    of one identity, such as a trajectory, are drawn together. Sum rows up by identity first: each is repeated."""
    spread = df.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # Rows that aren't drawn go by the number itself: a condition on times would hash each row again for each of its steps.
    none = F.exp(-mean) if isinstance(mean, Column) else F.lit(math.exp(-mean))
    spread = spread.withColumn("_u", uniform(seed, "boot_id", *identity)).where(F.col("_u") >= none)
    return spread.withColumn("times", poisson(F.col("_u"), mean)).drop("_u")


def drawn(df: DataFrame, identity: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """df with boot_id and times: in each replicate exactly as many identities, such as trajectories, are drawn as there are, with replacement. Identities are numbered along
    their order; the draw of a number is that of a hash of replicate and number, so a lost task draws the same again. Rows that a replicate
    doesn't draw are left out; null identities are not drawn."""
    there = df.select(*identity).dropna().distinct()
    numbered = along(there, [], list(identity), _place=Sum(F.lit(1).cast("long")), _all=Whole(F.lit(1).cast("long")))
    numbered = written(numbered)
    spread = numbered.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    hit = F.least(F.floor(uniform(seed, "boot_id", "_place") * F.col("_all")) + 1, F.col("_all")).alias("_place")
    times = spread.select("boot_id", hit).groupBy("boot_id", "_place").agg(F.count(F.lit(1)).alias("times"))
    return df.join(times.join(numbered.drop("_all"), "_place").drop("_place"), list(identity))


def windowed_shares(rows: DataFrame, waits: DataFrame, keys: Sequence[str], trajectory: Sequence[str]) -> DataFrame:
    """keys, boot_id, bin, pmf: the share of each bin in each replicate, where windows of several sizes are corrected for by the survival that the replicate's own
    trajectories have. rows: trajectory, keys, boot_id, times, wait_time, window_size, bin, of waits seen whole. waits: trajectory, boot_id, times, window_size of all."""
    sizes = waits.groupBy("boot_id", *trajectory).agg(F.max("window_size").alias("x"), F.max("times").alias("_t"))
    sizes = sizes.groupBy("boot_id", "x").agg(F.sum("_t").alias("_n"))
    # Equal waits are one row; they and the sizes of windows go along the replicate's waits once, so that none has to be looked up.
    counted = rows.where("window_size > wait_time").groupBy(*keys, "boot_id", "bin", F.col("wait_time").alias("x"), "window_size").agg(F.sum("times").alias("_t"))
    both = counted.withColumns({"_n": F.lit(0).cast("long"), "_q": F.lit(0)}).unionByName(sizes.withColumn("_q", F.lit(1)), allowMissingColumns=True)
    met = along(both, ["boot_id"], ["x", "_q"], _up=Sum(F.col("_n"), back=True), _all=Whole(F.col("_n"))).where("_q = 0")
    weight = F.try_divide(F.col("_t") / (F.col("window_size") - F.col("x")), F.col("_up") / F.col("_all"))
    found = met.groupBy(*keys, "boot_id", "bin").agg(F.sum(weight).alias("k"))
    return shares(found, keys, "k")


def interval(df: DataFrame, keys: Sequence[str], value: str, alpha: float = 0.05) -> DataFrame:
    """keys, low, high: percentiles over replicates."""
    return df.groupBy(*keys).agg(F.percentile(value, F.lit(alpha / 2)).alias("low"), F.percentile(value, F.lit(1 - alpha / 2)).alias("high"))


def estimates(df: DataFrame, identity: Sequence[str], keys: Sequence[str], replicates: int, estimate: Callable[[Column], Column], seed: int = 0) -> DataFrame:
    """keys, boot_id, value: an aggregate of the rows' weights in each replicate."""
    return resampled(df, identity, replicates, seed).groupBy(*keys, "boot_id").agg(estimate(F.col("times")).alias("value"))


def mixture(df: DataFrame, identity: Sequence[str], condition: str, shares: dict, replicates: int, seed: int = 0) -> DataFrame:
    """df with boot_id and times: whole trajectories of several conditions drawn so that each condition has its share of
    them. As many are drawn, about, as leaves no condition's trajectories drawn more than once on average."""
    sizes = df.select(condition, *identity).distinct().groupBy(condition).agg(F.count(F.lit(1)).alias("_n"))
    share = F.create_map(*(F.lit(v) for pair in shares.items() for v in pair))[F.col(condition)]
    held = sizes.where(share > 0).select(F.struct(condition, "_n", share.alias("_s")).alias("_c"))
    # Rows of conditions, at most as many as shares.
    one = held.agg(F.min(F.col("_c._n") / F.col("_c._s")).alias("_most"), F.collect_list("_c").alias("_all")).select("_most", F.explode("_all").alias("_c"))
    means = one.select(f"_c.{condition}", (F.col("_most") * F.col("_c._s") / F.col("_c._n")).alias("_mean"))
    return resampled(df.join(F.broadcast(means), condition), identity, replicates, seed, F.col("_mean")).drop("_mean")


def drawn_shares(curve: DataFrame, keys: Sequence[str], n: str, replicates: int, seed: int = 0) -> DataFrame:
    """keys, boot_id, bin, pmf: in each replicate, n numbers drawn from a cdf on a short grid (keys, x, cdf, n), as the share of
    those within the grid that lie in each bin between its points. Bins without a draw have no row. Draws are rows, made from one row a key."""
    rows = curve.groupBy(*keys).agg(F.array_sort(F.collect_list("cdf")).alias("_c"), F.max(n).alias("_n"))
    boots = rows.where("_n > 0").withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    # Draws are dealt out in parts, over a number of tasks that is given: the rows they are made from are too small for Spark to keep them apart.
    parts = boots.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / PART).cast("long"))))
    parts = parts.repartition(int(curve.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "boot_id", "_part")
    last = F.least(F.col("_n").cast("long"), (F.col("_part") + 1) * PART)
    drawn = parts.withColumn("_i", F.explode(F.sequence(F.col("_part") * PART + 1, last))).drop("_part")
    drawn = drawn.withColumn("_u", uniform(seed, "boot_id", *keys, "_i"))
    # The first point that isn't below the draw; what lies before the first point or after the last has no bin.
    at = F.size(F.filter("_c", lambda c: c < F.col("_u")))
    counts = drawn.withColumn("bin", at.cast("long")).where((F.col("bin") > 0) & (F.col("bin") < F.size("_c"))).groupBy(*keys, "boot_id", "bin").agg(F.count(F.lit(1)).alias("_k"))
    return shares(counts, keys, "_k")


def shares(weights: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """keys, boot_id, bin, pmf: the share of the weight of a replicate that each bin has."""
    whole = weights.groupBy(*keys, "boot_id").agg(F.sum(weight).alias("_whole"))
    return weights.join(whole, [*keys, "boot_id"]).select(*keys, "boot_id", "bin", F.try_divide(F.col(weight), F.col("_whole")).alias("pmf"))


def share_bounds(pmfs: DataFrame, keys: Sequence[str], bins: int, replicates: int, alpha: float, bonferroni: bool = True) -> DataFrame:
    """keys, bin, low, high: the percentiles alpha and 1 - alpha of each bin's share over replicates; alpha is divided by the
    number of bins if bonferroni. A bin without a row in a replicate has a share of 0 there."""
    a = alpha / bins if bonferroni else alpha
    grid = pmfs.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(bins).cast("long"))))
    grid = grid.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    filled = grid.join(pmfs, [*keys, "bin", "boot_id"], "left").withColumn("pmf", F.coalesce("pmf", F.lit(0.0)))
    return filled.groupBy(*keys, "bin").agg(F.percentile("pmf", F.lit(a)).alias("low"), F.percentile("pmf", F.lit(1 - a)).alias("high"))
