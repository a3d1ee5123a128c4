"""Displacements over time lags: joins of a trajectory with itself."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellspark.functions.theory import log_gamma
from dwellspark.operators.streamed import by_key


#: Tiles are so many times as long as the largest lag: a frame is in two tiles for one in so many.
TILE = 4


def _met(a: DataFrame, b: DataFrame, keys: Sequence[str], ta: str, tb: str, most: Column | float, tile_by: Column | float) -> DataFrame:
    """a and b joined where 0 <= tb - ta < most (or as most says, a condition). Time is cut into tiles of TILE times tile_by, a bound on tb - ta; a row of a is in its
    own tile, one of b also in the tile before if it lies less than tile_by from its start. So each pair meets in one tile, and no task holds more of a
    trajectory than a tile."""
    reach = F.col("_reach")
    size = F.lit(float(TILE)) * reach
    place = lambda t: F.floor(F.try_divide(F.col(t), size))  # noqa: E731  of no length, no tile and no pair
    bound = tile_by if isinstance(tile_by, Column) else F.lit(float(tile_by))
    left = a.withColumn("_reach", bound).withColumn("_tile", place(ta)).drop("_reach")
    right = b.withColumn("_reach", bound).withColumn("_own", place(tb))
    halo = (F.col(tb) - F.col("_own") * size) <= reach
    right = right.withColumn("_tile", F.explode(F.when(halo, F.array(F.col("_own"), F.col("_own") - 1)).otherwise(F.array(F.col("_own"))))).drop("_own", "_reach")
    apart = F.col(tb) - F.col(ta)
    limit = most if isinstance(most, Column) else apart < most
    return left.join(right, [*keys, "_tile"]).where((apart >= 0) & limit).drop("_tile")


def lag_pairs(df: DataFrame, keys: Sequence[str], t: str = "t", coords: Sequence[str] = ("x",), max_delta: float | None = None, independent: bool = False) -> DataFrame:
    """Each pair of frames of a trajectory, the later or same one second: keys, ti, tf, delta, and v<coord> for each
    coordinate. max_delta bounds the lag strictly; pairs then meet in tiles of time, and the trajectory isn't joined with all of itself. independent keeps pairs that don't overlap others of their lag:
    those whose first frame's number is a multiple of the lag in frames."""
    numbered = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(t)) - 1) if independent else df.withColumn("_i", F.lit(0))
    a = numbered.select(*keys, F.col(t).alias("ti"), F.col("_i").alias("_ia"), *(F.col(c).alias(f"_a{c}") for c in coords))
    b = numbered.select(*keys, F.col(t).alias("tf"), F.col("_i").alias("_ib"), *(F.col(c).alias(f"_b{c}") for c in coords))
    pairs = a.join(b, list(keys)).where(F.col("tf") >= F.col("ti")) if max_delta is None else _met(a, b, keys, "ti", "tf", max_delta, max_delta)
    if independent:
        pairs = pairs.where((F.col("_ia") == F.col("_ib")) | (F.try_mod("_ia", F.col("_ib") - F.col("_ia")) == 0))
    return pairs.select(*keys, "ti", (F.col("tf") - F.col("ti")).alias("delta"), "tf", *((F.col(f"_b{c}") - F.col(f"_a{c}")).alias(f"v{c}") for c in coords))


def lag_pairs_at(df: DataFrame, keys: Sequence[str], deltas: Sequence[float], t: str = "t", coords: Sequence[str] = ("x",)) -> DataFrame:
    """lag_pairs for given lags of a whole-numbered time: an equality join, linear in frames and lags."""
    a = df.select(*keys, F.col(t).alias("ti"), *(F.col(c).alias(f"_a{c}") for c in coords)).withColumn("delta", F.explode(F.array(*(F.lit(d) for d in deltas))))
    b = df.select(*keys, F.col(t).alias("tf"), *(F.col(c).alias(f"_b{c}") for c in coords))
    a = a.withColumn("tf", (F.col("ti") + F.col("delta")).cast(b.schema["tf"].dataType))
    return a.join(b, [*keys, "tf"]).select(*keys, "ti", "delta", "tf", *((F.col(f"_b{c}") - F.col(f"_a{c}")).alias(f"v{c}") for c in coords))


def positions(velocities: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x",), t: str = "tf") -> DataFrame:
    """Displacements summed up in the order of time: keys, t, and each coordinate."""
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    return velocities.select(*keys, F.col(t).alias("t"), *(F.sum(f"v{c}").over(w).alias(c) for c in coords))


def squared(coords: Sequence[str]):
    total = F.lit(0.0)
    for c in coords:
        total = total + F.col(f"v{c}") * F.col(f"v{c}")
    return total


def displacement_moments(pairs: DataFrame, groups: Sequence[str], coords: Sequence[str] = ("x",), power: int = 2) -> DataFrame:
    """Mean, sample deviation and count of the displacement's length (power 1) or its square (power 2) by group and lag,
    with the standard error."""
    value = squared(coords) if power == 2 else F.sqrt(squared(coords))
    found = pairs.groupBy(*groups, "delta").agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    return found.withColumn("ste", F.try_divide("std", F.sqrt(F.col("count") - (2 - power))))


def products(df: DataFrame, keys: Sequence[str], t: str = "t", x: str = "x", max_dt: float | None = None) -> DataFrame:
    """x at two frames of a trajectory, multiplied: keys, t (the lag), tau (the later time), xx."""
    a = df.select(*keys, F.col(t).alias("_ta"), F.col(x).alias("_xa"))
    b = df.select(*keys, F.col(t).alias("tau"), F.col(x).alias("_xb"))
    pairs = a.join(b, list(keys)).where(F.col("tau") >= F.col("_ta")) if max_dt is None else _met(a, b, keys, "_ta", "tau", max_dt, max_dt)
    return pairs.select(*keys, (F.col("tau") - F.col("_ta")).alias("t"), "tau", (F.col("_xa") * F.col("_xb")).alias("xx"))


def autocorrelation(df: DataFrame, keys: Sequence[str], t: str = "t", x: str = "x", max_dt: float | None = None) -> DataFrame:
    return products(df, keys, t, x, max_dt).groupBy("t").agg(F.avg("xx").alias("mean"), F.stddev_samp("xx").alias("std"), F.count("xx").alias("count"))


def velocity_products(pairs: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x",), max_t_over_delta: float | None = 4.0, deltas: Sequence[float] | None = None) -> DataFrame:
    """Dot products of velocities of one lag and trajectory: keys, delta, t, tau, cvv, for lags above 0, or for the given ones only. Velocities with a null have none. The number of
    products is cubic in a trajectory's frames unless pairs hold few lags."""
    moving = pairs.where(F.col("delta") > 0)
    if deltas is not None:
        moving = moving.where(F.col("delta").isin(list(deltas)))
    for c in coords:
        moving = moving.where(F.col(f"v{c}").isNotNull())
    a = moving.select(*keys, "delta", F.col("ti").alias("_ta"), *(F.col(f"v{c}").alias(f"_a{c}") for c in coords))
    b = moving.select(*keys, "delta", F.col("ti").alias("tau"), *(F.col(f"v{c}").alias(f"_b{c}") for c in coords))
    if max_t_over_delta is None:
        found = a.join(b, [*keys, "delta"]).where(F.col("tau") >= F.col("_ta"))
    else:  # in tiles that are as long as the lag asks for
        reach = F.lit(float(max_t_over_delta)) * F.col("delta")
        found = _met(a, b, [*keys, "delta"], "_ta", "tau", (F.col("tau") - F.col("_ta")) <= reach, reach)
    dot = F.lit(0.0)
    for c in coords:
        dot = dot + F.col(f"_a{c}") * F.col(f"_b{c}")
    return found.select(*keys, "delta", (F.col("tau") - F.col("_ta")).alias("t"), "tau", dot.alias("cvv"))


def correlation_sums(found: DataFrame, groups: Sequence[str]) -> DataFrame:
    return found.groupBy(*groups, "delta", "t").agg(F.sum(F.col("cvv") * F.col("cvv")).alias("sqs"), F.sum("cvv").alias("sum"), F.count("cvv").alias("cnt"))


def correlation_curves(sums: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Means, population deviations and errors, and both relative to the mean at lag time 0 of the same group and lag."""
    cvv = F.col("sum") / F.col("cnt")
    found = sums.withColumn("cvv", cvv).withColumn("std", F.sqrt(F.greatest(F.col("sqs") / F.col("cnt") - F.col("cvv") * F.col("cvv"), F.lit(0.0))))
    found = found.withColumn("ste", F.col("std") / F.sqrt("cnt"))
    zero = F.max(F.when(F.col("t") == 0, F.col("cvv"))).over(Window.partitionBy(*groups, "delta"))
    return found.withColumn("cvv_normed", F.try_divide("cvv", zero)).withColumn("ste_normed", F.try_divide("ste", zero))


def rescaled_curves(curves: DataFrame, deltas: Sequence[float] | None = None, max_t_over_delta: float = 4.0, exponent: float = 0.5, amplitude: float = 1.0) -> DataFrame:
    """curves at some lags (all if none are given) with scaled_t, the time over the lag, up to a bound, and the correlation and its error over the amplitude, as scaled and scaled_ste, and
    as moved: scaled times the lag to the power 2 - exponent, on which curves of all lags of a free locus fall together."""
    kept = curves if deltas is None else curves.where(F.col("delta").isin(list(deltas)))
    kept = kept.withColumn("scaled_t", F.try_divide(F.col("t"), F.col("delta"))).where(F.col("scaled_t") <= max_t_over_delta)
    kept = kept.withColumns({"scaled": F.col("cvv_normed") / amplitude, "scaled_ste": F.col("ste_normed") / amplitude})
    return kept.withColumn("moved", F.pow(F.col("delta").cast("double"), F.lit(2.0 - exponent)) * F.col("scaled"))


def with_normed_error(found: DataFrame) -> DataFrame:
    """ste_norm: the standard error, corrected for the bias of a deviation estimated from few values of a normal."""
    n = F.col("count").cast("double")
    ratio = F.exp(log_gamma(n / 2) - log_gamma((n - 1) / 2))
    return found.withColumn("ste_norm", F.when(F.col("count") > 1, F.col("ste") * F.sqrt(F.try_divide(F.lit(2.0), n - 1)) * ratio))


#: Numbers of a matrix whose rows are transformed at once.
CELLS = 1 << 19


def lagged_sums(df: DataFrame, keys: Sequence[str], t: str = "t", coords: Sequence[str] = ("x",)) -> DataFrame:
    """keys, t (the lag, a whole number of frames), n, total, squares: of the dot products of all pairs of frames of a trajectory that lie so far apart, how many there are, their
    sum and the sum of their squares. No pair is made: values and the mask of present frames are padded with zeros and
    correlated by Fourier transforms, in n log n of the frames between a trajectory's ends, many trajectories of about one length at once.
    Rows with a null don't count; of repeated frames, the values and counts add up."""
    names = [f"_x{i}" for i in range(len(coords))]

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        at = table.column("_t").to_numpy()
        values = [table.column(c).to_numpy() for c in names]
        key = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        at = at - np.minimum.reduceat(at, starts)[key]
        padded = 1 << np.frexp(2.0 * np.maximum.reduceat(at, starts) + 1)[1].astype(np.int64)
        parts = []
        for width in np.unique(padded):
            width, of = int(width), np.flatnonzero(padded == width)
            for few in np.split(of, range(step := max(1, CELLS // width), len(of), step)):
                place = np.full(len(starts), -1)
                place[few] = np.arange(len(few))
                own = np.flatnonzero(place[key] >= 0)
                cell = place[key[own]] * width + at[own]

                def correlated(v: np.ndarray | None) -> np.ndarray:
                    """Sums of v at a frame times v at a later one, by trajectory and lag."""
                    f = np.fft.rfft(np.bincount(cell, v, len(few) * width).reshape(len(few), width))
                    return np.fft.irfft(f * np.conj(f), width)[:, : width // 2]

                n = np.rint(correlated(None)).astype(np.int64)
                seen = [v[own] for v in values]
                total = sum(correlated(v) for v in seen)
                squares = sum((2 if i < j else 1) * correlated(seen[i] * seen[j]) for i in range(len(seen)) for j in range(i, len(seen)))
                row, lag = np.nonzero(n)
                parts.append((few[row], lag, n[row, lag], total[row, lag], np.maximum(squares[row, lag], 0.0)))
        return dict(zip(("of", "t", "n", "total", "squares"), map(np.concatenate, zip(*parts))))

    own = df.select(*keys, t, *coords).dropna(subset=[t, *coords])
    own = own.select(*keys, F.col(t).cast("long").alias("_t"), *(F.col(c).cast("double").alias(n) for c, n in zip(coords, names)))
    return by_key(own, keys, "t long, n long, total double, squares double", work)


def autocorrelation_by_transform(df: DataFrame, keys: Sequence[str], t: str = "t", x: str = "x") -> DataFrame:
    """autocorrelation, of whole-numbered times, without pairs."""
    sums = lagged_sums(df, keys, t, [x]).groupBy("t").agg(F.sum("n").alias("count"), F.sum("total").alias("_s"), F.sum("squares").alias("_q"))
    mean = F.col("_s") / F.col("count")
    spread = F.greatest(F.col("_q") - F.col("_s") * mean, F.lit(0.0))
    return sums.select("t", mean.alias("mean"), F.sqrt(F.try_divide(spread, F.col("count") - 1)).alias("std"), "count")


def correlation_sums_by_transform(pairs: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x",), max_t_over_delta: float = 4.0) -> DataFrame:
    """correlation_sums of velocity_products over all trajectories, without the products: delta, t, sqs, sum, cnt. The lag is a whole number of frames."""
    moving = pairs.where(F.col("delta") > 0).select(*keys, "delta", "ti", *(f"v{c}" for c in coords))
    sums = lagged_sums(moving, [*keys, "delta"], "ti", [f"v{c}" for c in coords]).where(F.col("t") <= max_t_over_delta * F.col("delta"))
    return sums.groupBy("delta", "t").agg(F.sum("squares").alias("sqs"), F.sum("total").alias("sum"), F.sum("n").alias("cnt"))
