"""Known small cases of waits, frames and distributions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.functions import theory
from dwellspark.operators import distributions as dist
from dwellspark.operators import frames, lags, loci, moments, waits

CHANGES = [
    (0, 1, -0.1, 0.1), (0, 0, 0.1, 1.1), (1, 0, -0.1, 1.0), (2, 0, 0.0, 0.101), (2, 1, 0.101, 0.109), (2, 0, 0.109, 0.2), (2, 1, 0.2, 1.1), (3, 1, 0.0, 0.199), (3, 0, 0.199, 0.2),
    (3, 1, 0.2, 0.3), (3, 0, 0.3, 1.0), (4, 1, 0.0, 0.099), (4, 0, 0.099, 1.2), (5, 1, -0.1, 1.1), (6, 0, -0.1, 1.1),
]
SEEN = ["10000000000", "00000000000", "00111111111", "11100000000", "10000000000", "11111111111", "00000000000"]


def changes(spark):
    rows = [(*c, 0.0, 1.0) for c in CHANGES]
    return spark.createDataFrame(rows, "traj int, state int, start_time double, end_time double, window_start double, window_end double")


def test_movie_of_changes(spark):
    found = frames.as_of(changes(spark), frames.frame_grid(changes(spark), ["traj"], 0.1, 11), ["traj"]).orderBy("traj", "t").collect()
    rows = {}
    for r in found:
        rows.setdefault(r.traj, []).append(str(r.state))
    # The third change of the fourth trajectory starts at 0.3, and 3 * 0.1 is just above it.
    assert [("".join(rows[k])) for k in range(7)] == [s if k != 3 else "11100000000" for k, s in enumerate(SEEN)]


def test_movie_after_the_end(spark):
    one = spark.createDataFrame([(0, "A", -1.0, 0.1), (0, "B", 0.1, 1.0)], "traj int, state string, start_time double, end_time double")
    grid = frames.frame_grid(one, ["traj"], 0.2, 11)
    assert [r.state for r in frames.as_of(one, grid, ["traj"]).orderBy("t").collect()] == ["A", *["B"] * 5, *[None] * 5]
    assert [r.state for r in frames.as_of(one, grid, ["traj"], clip_end=False).orderBy("t").collect()] == ["A", *["B"] * 10]


def test_waits_of_movie(spark):
    rows = [(k, float(t), 1 if k == 3 or (k == 1 and t in (0, 9)) else 0) for k in (1, 2, 3) for t in range(10)]
    found = waits.waits_of_movie(spark.createDataFrame(rows, "replicate int, t double, state int"), ["replicate"]).orderBy("replicate", "rank_order").collect()
    own = [(r.replicate, r.rank_order, r.start_time, r.end_time, r.wait_time, r.state, r.min_waits, r.max_waits, r.wait_type, r.window_size) for r in found]
    assert own == [
        (1, 0, 0, 1, 1, 1, 0, 1, "left exterior", 9),
        (1, 1, 1, 9, 8, 0, 7, 9, "interior", 9),
        (1, 2, 9, 9, 0, 1, 0, 1, "right exterior", 9),
        (2, 0, 0, 9, 9, 0, 9, 9, "full exterior", 9),
        (3, 0, 0, 9, 9, 1, 9, 9, "full exterior", 9),
    ]


def test_null_states_are_runs_of_their_own(spark):
    df = spark.createDataFrame([(0, 0.0, "a"), (0, 1.0, None), (0, 2.0, None), (0, 3.0, "a")], "traj int, t double, state string")
    assert waits.islands(df, ["traj"]).count() == 4
    assert waits.waits_of_movie(df.limit(0), ["traj"]).count() == 0


def test_quantised_changes(spark):
    rows = [(0, s, a, b, 0.0, 6.0) for s, a, b in (("A", 0.9, 1.5), ("B", 1.5, 1.7), ("A", 1.7, 2.5), ("B", 2.5, 3.1))]
    df = spark.createDataFrame(rows, "traj int, state string, start_time double, end_time double, window_start double, window_end double")
    found = frames.quantised(df, ["traj"], 1.0, 7).orderBy("start_time").collect()
    assert [(r.state, r.start_time, r.end_time) for r in found] == [("A", 1.0, 3.0), ("B", 3.0, 3.0)]
    seen = waits.waits_of_changes(frames.quantised(df, ["traj"], 1.0, 7), ["traj"]).orderBy("rank_order").collect()
    assert [(r.wait_time, r.wait_type) for r in seen] == [(2.0, "left exterior"), (0.0, "right exterior")]


def test_slow_and_fast_way_agree(spark):
    """Frames, then waits of frames; or frames of changes, then waits of changes."""
    rng, rows = np.random.default_rng(5), []
    for k in range(200):
        t, state = -rng.beta(5, 2), 0
        while t < 0.8:
            end = t + (rng.beta(5, 2) if state == 0 else rng.beta(2, 2))
            if end > 0:
                rows.append((k, "AB"[state], float(t), float(end), 0.0, 0.8))
            t, state = end, 1 - state
    df = spark.createDataFrame(rows, "traj int, state string, start_time double, end_time double, window_start double, window_end double")
    step = 0.04
    slow = waits.waits_of_movie(frames.as_of(df, frames.frame_grid(df, ["traj"], step, 21), ["traj"]), ["traj"])
    fast = waits.waits_of_changes(frames.quantised(df, ["traj"], step, 21), ["traj"])
    own = lambda d, first: sorted((r.traj, r.rank_order - first, r.state, round(r.wait_time, 9), r.wait_type) for r in d.collect())
    assert own(slow, 0) == own(fast, 1)


def test_windowed_curve_without_a_window(spark):
    df = spark.createDataFrame([("s", float(t), 4e10) for t in (1, 2, 1, 1, 2, 2, 3)], "state string, wait_time double, window_size double")
    for found in (dist.ecdf(df, ["state"], "wait_time", 0.0), dist.ecdf_windowed(df, ["state"])):
        rows = sorted((r.x, r.cdf) for r in found.collect())
        assert [x for x, _ in rows] == [0, 1, 2, 3]
        assert np.allclose([c for _, c in rows], [0, 3 / 7, 6 / 7, 1])
    grid = sorted((r.x, r.cdf) for r in dist.ecdf_on(df, ["state"], "wait_time", range(5)).collect())
    assert np.allclose([c for _, c in grid], [0, 3 / 7, 6 / 7, 1, 1])


def test_exterior_fit_is_the_least(spark):
    rng = np.random.default_rng(2)
    x = np.sort(rng.uniform(0, 1, 30))
    inner = spark.createDataFrame([("s", 0.0, 0.0), *(("s", float(a), float(b)) for a, b in zip(x, np.sort(rng.uniform(0, 1, 30))))], "state string, x double, cdf double")
    outer = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(x, 1.8 * x - 0.9 * x**2)], "state string, x double, cdf double")
    fit = dist.exterior_fit(outer, inner, ["state"]).first()
    area = [r.area for r in dist.integral(inner, ["state"]).orderBy("x").collect()]
    t, i = np.r_[0.0, x], np.array(area)
    e = np.interp(t, x, 1.8 * x - 0.9 * x**2)
    weight = np.r_[1, np.full(len(x), 2)]  # points that both curves have count twice
    cost = lambda a, b: (weight * (a * t + b * i - e) ** 2).sum()
    assert fit.a >= 0 >= fit.b and cost(fit.a, fit.b) <= min(cost(a, b) for a in np.linspace(0, 4, 81) for b in np.linspace(-4, 0, 81)) + 1e-9


def test_independent_pairs(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(6)], "traj int, t int, x double")
    found = {(r.ti, r.tf) for r in lags.lag_pairs(df, ["traj"], independent=True).collect()}
    assert found == {(i, i) for i in range(6)} | {(0, j) for j in range(1, 6)} | {(1, 2), (2, 3), (2, 4), (3, 4), (4, 5)}


def test_velocities_sum_to_positions(spark):
    df = spark.createDataFrame([(k, t, float((7 * t + k) % 5)) for k in range(3) for t in range(8)], "traj int, t int, x double")
    back = lags.positions(lags.lag_pairs_at(df, ["traj"], [1]), ["traj"])
    start = df.where("t = 0").select("traj", F.col("x").alias("x0"))
    assert back.join(start, "traj").join(df.withColumnRenamed("x", "want"), ["traj", "t"]).where("abs(x + x0 - want) > 1e-9").count() == 0


def test_wide_and_long(spark):
    rows = [(1, 1.6, 2.4, 3.1, 2.1, 1.5, 3.1, 0), (2, 1.9, 1.5, 3.1, 1.9, 2.5, 3.1, 30), (3, 2.0, 1.8, 3.0, None, None, None, 60)]
    df = spark.createDataFrame(rows, "frame int, X1 double, Y1 double, Z1 double, X2 double, Y2 double, Z2 double, t int")
    back = loci.wide_form(loci.long_form(df), ["frame"]).select(*df.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [r.foci for r in loci.label_foci(df).orderBy("frame").collect()] == ["unp", "unp", "pair"]


def test_moments_of_parts(spark):
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(20)] + [(0, None), (1, float("nan"))], "part int, x double")
    whole = {r.moment: r.value for r in moments.moments(df.withColumn("k", F.lit(0)), ["k"], ["x"]).collect()}
    parts = moments.combine_moments(moments.moments(df.withColumn("k", F.lit(0)), ["k", "part"], ["x"]), ["k"], ["part"])
    assert all(math.isclose(r.value, whole[r.moment]) for r in parts.collect()) and whole[0] == 20


def test_theory(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (3.0,)], "t double")
    found = df.select(theory.normalised_velocity_correlation(F.col("t"), F.lit(1.0), 1.0).alias("c")).collect()
    assert np.allclose([r.c for r in found], [1, 0.5, 0])  # at alpha 1: max(1 - t / delta, 0)
    assert df.select(theory.fractional_msd(F.col("t"), 1.0).alias("m")).collect()[2].m == pytest.approx(18)
