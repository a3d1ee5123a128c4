"""Curves of two parameters fitted to the points of all labels at once.

Each step of Levenberg and Marquardt is a Spark aggregate: residuals and slopes are columns of the points, and their
products are summed up by label. A label's points need no single task, and only the state - one row for each label - goes from step to step,
as a table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwellspark.operators.scratch import written


@dataclass(frozen=True)
class Curve:
    """value: of x and two parameters. slopes: the value's derivatives in the two parameters, of the same."""

    value: Callable[[Column, Column, Column], Column]
    slopes: Callable[[Column, Column, Column], tuple[Column, Column]]


#: The rational approximation 7.1.28 of the error function in Abramowitz and Stegun, exact to 3e-7.
ERF = (0.0705230784, 0.0422820123, 0.0092705272, 0.0001520143, 0.0002765672, 0.0000430638)


def _erfc(x: Column) -> tuple[Column, Column]:
    """The complementary error function of x >= 0, as approximated, and its derivative."""
    base, slope = F.lit(0.0), F.lit(0.0)
    for k in range(len(ERF), 0, -1):
        slope = slope * x + F.lit(k * ERF[k - 1])
        base = (base + F.lit(ERF[k - 1])) * x
    base = base + 1.0
    return F.pow(base, F.lit(-16.0)), -16.0 * slope * F.pow(base, F.lit(-17.0))


def _apart(x: Column, relaxed: Column) -> tuple[Column, Column]:
    """1 less the part of their motion over a lag x that two loci have in common, which relax in a given time; and its derivative in that time."""
    z = relaxed / x
    root = F.sqrt(z)
    value, slope = _erfc(root)
    own = 1.0 - F.exp(-z) + math.sqrt(math.pi) * root * value
    return own, (F.exp(-z) + math.sqrt(math.pi) / 2 * (value / root + slope)) / x


#: Mean squared change of the separation of two loci of an ideal chain over a lag: 2 A sqrt(x) as long as they move alone, flat when they have relaxed.
SEPARATION = Curve(
    lambda x, a, relaxed: 2.0 * a * F.sqrt(x) * _apart(x, relaxed)[0],
    lambda x, a, relaxed: (2.0 * F.sqrt(x) * _apart(x, relaxed)[0], 2.0 * a * F.sqrt(x) * _apart(x, relaxed)[1]),
)

_DAMP = (1e-12, 1e12)


def fit(
    points: DataFrame, keys: Sequence[str], x: str, y: str, curve: Curve, start: tuple[float, float], low: tuple[float, float], high: tuple[float, float],
    within: DataFrame | None = None, steps: int = 60, tolerance: float = 1e-10,
) -> DataFrame:
    """keys, p1, p2, p1_var, p2_var, covariance, rest, points: least squares of a curve between bounds.

    within: keys, x_from, x_to for labels of which only a part of the axis counts, ends included; other labels count whole. A label of
    fewer than two finite points (x above 0) has no row. The covariance is that of the linearised curve at the end, as if no bound held, and null
    for two points or where the points don't tell the parameters apart. Steps end when no label's parameters move by more than tolerance, relatively."""
    good = points.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    good = good.where((F.col("_x") > 0) & (F.col("_x") < float("inf")) & (F.abs("_y") < float("inf")))
    if within is not None:
        spans = within.select(*keys, "x_from", "x_to")
        good = good.join(spans, list(keys), "left").where("_x >= coalesce(x_from, _x) AND _x <= coalesce(x_to, _x)").drop("x_from", "x_to")
    good = written(good)
    counts = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("points")).where("points >= 2")
    blank = {c: F.lit(None).cast("double") for c in ("p1", "p2", "j11", "j12", "j22", "g1", "g2", "rest")}
    state = written(counts.withColumns({**blank, "damp": F.lit(1e-3), "q1": F.lit(float(start[0])), "q2": F.lit(float(start[1])), "moves": F.lit(True)}))
    for _ in range(steps):
        state = written(_step(good, state, keys, curve, low, high, tolerance))
        if state.where("moves").isEmpty():
            break
    det = F.col("j11") * F.col("j22") - F.col("j12") * F.col("j12")
    known = (det > 1e-12 * F.col("j11") * F.col("j22")) & (F.col("points") > 2)
    scale = F.when(known, F.col("rest") / (F.col("points") - 2) / det)
    return state.select(*keys, "p1", "p2", (F.col("j22") * scale).alias("p1_var"), (F.col("j11") * scale).alias("p2_var"), (-F.col("j12") * scale).alias("covariance"), "rest", "points")


def _step(points: DataFrame, state: DataFrame, keys: Sequence[str], curve: Curve, low: tuple[float, float], high: tuple[float, float], tolerance: float) -> DataFrame:
    """Judge each label's trial by its squares, and make the next one. A label that doesn't move any more stays as it is."""
    x, q1, q2 = F.col("_x"), F.col("q1"), F.col("q2")
    # The state is joined to the points; where it is small, Spark broadcasts it, and no point is shuffled.
    met = points.join(state.select(*keys, "q1", "q2"), list(keys))
    s1, s2 = curve.slopes(x, q1, q2)
    met = met.select(*keys, (F.col("_y") - curve.value(x, q1, q2)).alias("r"), s1.alias("s1"), s2.alias("s2"))
    sums = {"n_rest": "r * r", "n_j11": "s1 * s1", "n_j12": "s1 * s2", "n_j22": "s2 * s2", "n_g1": "s1 * r", "n_g2": "s2 * r"}
    tried = state.join(met.groupBy(*keys).agg(*(F.sum(F.expr(e)).alias(n) for n, e in sums.items())), list(keys))
    better = F.col("moves") & (F.col("rest").isNull() | (F.col("n_rest") < F.col("rest")))
    tried = tried.withColumn("better", better)
    pick = lambda old, new: F.when(F.col("better"), F.col(new)).otherwise(F.col(old)).alias(old)
    damp = F.when(~F.col("moves"), F.col("damp")).when(F.col("better"), F.greatest(F.col("damp") / 10, F.lit(_DAMP[0]))).otherwise(F.least(F.col("damp") * 10, F.lit(_DAMP[1])))
    now = tried.select(*keys, "points", "moves", pick("p1", "q1"), pick("p2", "q2"), *(pick(c, f"n_{c}") for c in ("j11", "j12", "j22", "g1", "g2", "rest")), damp.alias("damp"))
    # A parameter at a bound that the squares would push beyond it is held there.
    held = [((F.col(f"p{i}") <= low[i - 1]) & (F.col(f"g{i}") < 0)) | ((F.col(f"p{i}") >= high[i - 1]) & (F.col(f"g{i}") > 0)) for i in (1, 2)]
    both = ~held[0] & ~held[1]
    now = now.withColumns({"a11": F.col("j11") * (1 + F.col("damp")), "a22": F.col("j22") * (1 + F.col("damp")), "a12": F.when(both, F.col("j12")).otherwise(0.0)})
    det = F.col("a11") * F.col("a22") - F.col("a12") * F.col("a12")
    d1 = F.when(held[0], 0.0).otherwise(F.coalesce(F.try_divide(F.col("g1") * F.col("a22") - F.when(both, F.col("g2")).otherwise(0.0) * F.col("a12"), det), F.lit(0.0)))
    d2 = F.when(held[1], 0.0).otherwise(F.coalesce(F.try_divide(F.col("g2") * F.col("a11") - F.when(both, F.col("g1")).otherwise(0.0) * F.col("a12"), det), F.lit(0.0)))
    clip = lambda c, i: F.least(F.greatest(c, F.lit(float(low[i]))), F.lit(float(high[i])))
    now = now.withColumns({"q1": clip(F.col("p1") + d1, 0), "q2": clip(F.col("p2") + d2, 1)})
    far = (F.abs(F.col("q1") - F.col("p1")) > tolerance * F.abs("p1")) | (F.abs(F.col("q2") - F.col("p2")) > tolerance * F.abs("p2"))
    return now.withColumn("moves", F.col("moves") & far & (F.col("damp") < _DAMP[1])).drop("a11", "a12", "a22")


def fit_sql(points: str, start: tuple[float, float], low: tuple[float, float], high: tuple[float, float], steps: int) -> str:
    """The same fit of SEPARATION in DuckDB, with a fixed number of steps: points is a view of label, x, y; the views are steps and fitted. It is
    a recursion, so it stands in a WITH RECURSIVE."""
    base, slope = "0.0", "0.0"
    for k in range(len(ERF), 0, -1):
        slope, base = f"({slope} * u + {k * ERF[k - 1]!r})", f"(({base} + {ERF[k - 1]!r}) * u)"
    root_pi = repr(math.sqrt(math.pi))
    held = [f"((p{i} <= {low[i - 1]} AND g{i} < 0) OR (p{i} >= {high[i - 1]} AND g{i} > 0))" for i in (1, 2)]
    clip = lambda c, i: f"least(greatest({c}, {float(low[i])}), {float(high[i])})"
    return f"""steps AS (
  SELECT label, 0 AS k, count(*) AS points, NULL::DOUBLE AS p1, NULL::DOUBLE AS p2, NULL::DOUBLE AS j11, NULL::DOUBLE AS j12, NULL::DOUBLE AS j22, NULL::DOUBLE AS g1, NULL::DOUBLE AS g2,
    NULL::DOUBLE AS rest, 1e-3::DOUBLE AS damp, {float(start[0])}::DOUBLE AS q1, {float(start[1])}::DOUBLE AS q2, true AS moves FROM {points} GROUP BY label HAVING count(*) >= 2
  UNION ALL
  SELECT label, k, points, p1, p2, j11, j12, j22, g1, g2, rest, damp, q1, q2,
    moves AND (abs(q1 - p1) > 1e-10 * abs(p1) OR abs(q2 - p2) > 1e-10 * abs(p2)) AND damp < 1e12
  FROM (SELECT *, {clip("p1 + CASE WHEN h1 THEN 0 ELSE coalesce((g1 * a22 - CASE WHEN h1 OR h2 THEN 0 ELSE g2 END * a12) / nullif(a11 * a22 - a12 * a12, 0), 0) END", 0)} AS q1,
      {clip("p2 + CASE WHEN h2 THEN 0 ELSE coalesce((g2 * a11 - CASE WHEN h1 OR h2 THEN 0 ELSE g1 END * a12) / nullif(a11 * a22 - a12 * a12, 0), 0) END", 1)} AS q2
  FROM (SELECT *, j11 * (1 + damp) AS a11, j22 * (1 + damp) AS a22, CASE WHEN h1 OR h2 THEN 0 ELSE j12 END AS a12
  FROM (SELECT *, {held[0]} AS h1, {held[1]} AS h2
  FROM (SELECT label, k + 1 AS k, points, moves, CASE WHEN better THEN o1 ELSE p1 END AS p1, CASE WHEN better THEN o2 ELSE p2 END AS p2,
      {", ".join(f"CASE WHEN better THEN n_{c} ELSE {c} END AS {c}" for c in ("j11", "j12", "j22", "g1", "g2", "rest"))},
      CASE WHEN NOT moves THEN damp WHEN better THEN greatest(damp / 10, 1e-12) ELSE least(damp * 10, 1e12) END AS damp
  FROM (SELECT *, moves AND (rest IS NULL OR n_rest < rest) AS better
  FROM (SELECT label, k, any_value(points) AS points, bool_and(moves) AS moves, any_value(p1) AS p1, any_value(p2) AS p2, any_value(o1) AS o1, any_value(o2) AS o2, any_value(damp) AS damp,
      {", ".join(f"any_value({c}) AS {c}" for c in ("j11", "j12", "j22", "g1", "g2", "rest"))},
      sum(r * r) AS n_rest, sum(s1 * s1) AS n_j11, sum(s1 * s2) AS n_j12, sum(s2 * s2) AS n_j22, sum(s1 * r) AS n_g1, sum(s2 * r) AS n_g2
  FROM (SELECT *, y - 2 * o1 * sqrt(x) * own AS r, 2 * sqrt(x) * own AS s1, 2 * o1 * sqrt(x) * (exp(-z) + {root_pi} / 2 * (e / u + d)) / x AS s2
  FROM (SELECT *, 1 - exp(-z) + {root_pi} * u * e AS own
  FROM (SELECT *, base ** (-16.0) AS e, -16.0 * slope * base ** (-17.0) AS d
  FROM (SELECT *, {base} + 1.0 AS base, {slope} AS slope
  FROM (SELECT s.*, s.q1 AS o1, s.q2 AS o2, p.x, p.y, s.q2 / p.x AS z, sqrt(s.q2 / p.x) AS u FROM steps s JOIN {points} p USING (label) WHERE k < {steps}
  ))))) GROUP BY label, k))))))
), fitted AS (SELECT *, j11 * j22 - j12 * j12 AS det FROM steps WHERE k = {steps})"""
