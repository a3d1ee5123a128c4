"""Bounds, bootstraps, hulls in space, tests of normality and two-locus theory against plain code."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.functions import special
from dwellspark.operators import bands, bootstrap, fits, frames, geometry, moments


def _chance(counts, c):
    """The chance that multinomial counts with these means all lie within c of them, by convolution."""
    total = sum(counts)
    ways = np.zeros(total + 1)
    ways[0] = 1.0
    for n in counts:
        step = np.zeros(total + 1)
        for y in range(max(0, n - c), min(total, n + c) + 1):
            step[y] = math.exp(y * math.log(n) - n - math.lgamma(y + 1))
        ways = np.convolve(ways, step)[: total + 1]
    return ways[total] / math.exp(total * math.log(total) - total - math.lgamma(total + 1))


@pytest.mark.parametrize("counts", [[12, 9, 20, 4], [91, 49, 37, 43], [300, 200, 100, 50, 25, 12]])
def test_simultaneous_bounds_are_nearly_exact(counts):
    low, high = bands.multinomial_bounds(np.array(counts), 0.05)
    c = round((np.array(counts) / sum(counts) - low).max() * sum(counts))
    assert _chance(counts, c) < 0.955 and _chance(counts, c + 1) > 0.945
    assert (high > np.array(counts) / sum(counts)).all() and (high - low <= (2 * c + 2) / sum(counts) + 1e-12).all()


def test_simultaneous_bounds_of_odd_histograms(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("b", 1, 0), ("c", 1, 9)], "k string, bin long, n long")
    found = {(r.k, r.bin): r for r in bands.simultaneous_bounds(rows, ["k"]).collect()}
    assert len(found) == 4 and found["b", 1].low is None and found["c", 1].high == 1
    assert 0 <= found["a", 2].low <= found["a", 2].high <= 1 and bands.simultaneous_bounds(rows.limit(0), ["k"]).count() == 0


def _volume(points):
    """Volume and surface by trying each plane through three points (none has four)."""
    middle, volume, area = points.mean(0), 0.0, 0.0
    for a, b, c in itertools.combinations(points, 3):
        n = np.cross(b - a, c - a)
        side = (points - a) @ n
        if (side < 1e-9).all() or (side > -1e-9).all():
            volume += abs(np.dot(a - middle, n)) / 6
            area += np.linalg.norm(n) / 2
    return volume, area


@pytest.mark.parametrize("part", [5, 50_000])
def test_hull_volume(spark, monkeypatch, part):
    monkeypatch.setattr(geometry, "PART", part)
    rng = np.random.default_rng(4)
    cloud, cube, flat = rng.normal(size=(30, 3)), list(itertools.product((0.0, 2.0), repeat=3)) + [(1.0, 1.0, 1.0)] * 3, [(x, y, 1.0) for x, y in rng.normal(size=(9, 2))]
    rows = [(k, *map(float, p)) for k, points in (("cloud", cloud), ("cube", cube), ("flat", flat), ("point", [(1, 1, 1)] * 4)) for p in points]
    df = spark.createDataFrame(rows + [("cube", None, 9.0, 9.0)], "k string, X double, Y double, Z double")
    found = {r.k: (r.volume, r.area) for r in geometry.hull_volume(df, ["k"]).collect()}
    assert np.allclose(found["cloud"], _volume(cloud)) and np.allclose(found["cube"], (8, 24))
    assert found["flat"] == found["point"] == (None, None) and geometry.hull_volume(df.limit(0), ["k"]).count() == 0
    areas = {r.k: r.area for r in geometry.hull_area(df, ["k"], "X", "Y").collect()}
    assert math.isclose(areas["cube"], 4) and areas["point"] is None


def test_hulls_of_many_trajectories_in_one_call(spark):
    """Points on a grid, many of them in one plane; few and many points have the same hull, and no key has a call of its own."""
    rng = np.random.default_rng(6)
    points = {k: np.column_stack([rng.integers(0, 90, 3 + k % 9) / 4, rng.integers(0, 5, 3 + k % 9) / 10, rng.integers(0, 3, 3 + k % 9) / 10]) for k in range(60)}
    df = spark.createDataFrame([(k, *map(float, p)) for k, own in points.items() for p in own], "k long, X double, Y double, Z double").repartition(3)
    volumes, areas = geometry.hull_volume(df, ["k"]), geometry.hull_area(df, ["k"], "X", "Y")
    assert not any("InPandas" in d._jdf.queryExecution().toString() for d in (volumes, areas))
    found = {r.k: (r.volume, r.area) for r in volumes.collect()}
    assert set(found) == set(points) and areas.count() == len(points)
    some = 0
    for k, own in points.items():
        again = np.concatenate([own] * geometry.FEW)  # repeated points change nothing
        faces = geometry._facets(again)
        assert (faces is None) == (found[k] == (None, None))
        if faces is not None:
            some += 1
            a, b, c = (again[faces[:, i]] for i in range(3))
            normal = np.cross(b - a, c - a)
            assert np.allclose(found[k], (((a - own.mean(0)) * normal).sum() / 6, np.linalg.norm(normal, axis=1).sum() / 2))
    assert 20 < some < 60


def test_two_loci_are_found_again(spark):
    t, delta = (g.ravel().astype(float) for g in np.meshgrid(np.arange(0, 40), [2, 5, 10]))
    y = 0.7 * special.separation_correlation(t, delta, 25.0)
    df = spark.createDataFrame([(1, float(a), float(b), float(c)) for a, b, c in zip(t, delta, y)] + [(1, 0.0, 5.0, None), (2, 0.0, 5.0, 1.0)], "k int, t double, delta double, y double")
    found = {r.k: r for r in fits.fit_two_loci(df, ["k"], y="y").collect()}
    assert math.isclose(found[1].amplitude, 0.7, rel_tol=1e-4) and math.isclose(found[1].relaxed, 25, rel_tol=1e-3) and found[1].relaxed_var >= 0
    assert found[1].points == int((t <= 4 * delta).sum()) and found[2].points == 1 and found[2].amplitude is None
    assert np.allclose(special.separation_correlation(np.zeros(1), np.ones(1), 1e9), 1)


def test_curvature_is_its_series():
    for alpha, x in itertools.product((0.4, 0.5, 0.8), (0.1, 0.7, 1.5)):
        at = [(k, alpha * k + alpha - 1) for k in range(60)]
        series = sum((-x) ** k / math.gamma(g) for k, g in at if abs(g) > 1e-9)  # at 0 the gamma function's inverse is 0
        assert math.isclose(float(special.curvature(np.array(x), alpha)), series, rel_tol=1e-5, abs_tol=1e-7)


def test_student(spark):
    rows = [(12.706205, 1), (4.302653, 2), (3.182446, 3), (2.776445, 4), (-2.570582, 5), (1.962339, 1000), (1.962341, 999)]
    found = spark.createDataFrame(rows, "t double, n int").select(moments.two_sided(F.col("t"), F.col("n")).alias("p"))
    assert all(abs(r.p - 0.05) < 1e-6 for r in found.collect())
    assert spark.createDataFrame([(1.0, 0), (None, 3)], "t double, n int").select(moments.two_sided(F.col("t"), F.col("n")).alias("p")).where("p IS NOT NULL").count() == 0


def test_normality(spark):
    rng = np.random.default_rng(7)
    x = {"a": rng.normal(size=400).round(1), "b": rng.exponential(size=90), "c": np.ones(5)}
    df = spark.createDataFrame([(k, float(v)) for k, own in x.items() for v in own] + [("a", None)], "k string, v double")
    found = {r.k: r for r in moments.normality(df, ["k"], "v").collect()}
    assert sorted(found) == ["a", "b"]
    for k in found:
        z, n = np.sort((x[k] - x[k].mean()) / x[k].std(ddof=1)), len(x[k])
        below = np.array([math.erfc(-v / math.sqrt(2)) / 2 for v in z])
        i = np.arange(1, n + 1)
        ks = max((i / n - below).max(), (below - (i - 1) / n).max())
        ad = -n - ((2 * i - 1) * (np.log(below) + np.log1p(-below[::-1]))).mean()
        ngp = n * (z**4).sum() / (3 * (z**2).sum() ** 2) - 1
        assert found[k].n == n and np.allclose([found[k].ks, found[k].ad, found[k].ngp], [ks, ad, ngp], atol=1e-9)


def test_mixture_has_its_shares(spark):
    rows = spark.range(6000).select(F.col("id").alias("traj"), (F.col("id") % 3 == 0).cast("int").alias("c"))
    found = {r.c: r.n for r in bootstrap.mixture(rows, ["traj"], "c", {0: 0.25, 1: 0.75}, 20).groupBy("c").agg(F.sum("times").alias("n")).collect()}
    # The 2000 of condition 1 are drawn once on average, and a third as many of condition 0.
    assert abs(found[1] / 20 - 2000) < 60 and abs(found[0] / found[1] - 1 / 3) < 0.02
    assert bootstrap.mixture(rows.limit(0), ["traj"], "c", {0: 0.5, 1: 0.5}, 3).count() == 0


def test_draws_follow_the_curve(spark):
    curve = spark.createDataFrame([("a", 0.0, 0.2, 4000), ("a", 1.0, 0.5, 4000), ("a", 2.0, 1.0, 4000)], "k string, x double, cdf double, n long")
    found = bootstrap.drawn_shares(curve, ["k"], "n", 10)
    mean = {r.bin: r.m for r in found.groupBy("bin").agg(F.avg("pmf").alias("m")).collect()}
    assert sorted(mean) == [1, 2] and abs(mean[1] - 0.3 / 0.8) < 0.01
    bounds = {r.bin: r for r in bootstrap.share_bounds(found, ["k"], 3, 10, 0.05).collect()}
    assert bounds[3].low == bounds[3].high == 0 and bounds[1].low <= mean[1] <= bounds[1].high
    assert bootstrap.drawn_shares(curve.limit(0), ["k"], "n", 10).count() == 0


def test_draws_are_dealt_out_in_parts(spark, monkeypatch):
    curve = spark.createDataFrame([("a", float(x), x / 4, 1003) for x in range(5)], "k string, x double, cdf double, n long")
    whole = lambda d: sorted(map(tuple, d.collect()))
    one = whole(bootstrap.drawn_shares(curve, ["k"], "n", 3, 5))
    monkeypatch.setattr(bootstrap, "PART", 10)
    found = bootstrap.drawn_shares(curve, ["k"], "n", 3, 5)
    assert whole(found) == one and "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_a_row_is_hashed_once_to_leave_it_out(spark):
    df = spark.range(2000).withColumn("traj", F.col("id"))
    found = bootstrap.resampled(df, ["traj"], 3, 7)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("md5(") for line in plan.splitlines() if "Filter" in line) == 1
    every = df.withColumn("boot_id", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("times", bootstrap.poisson(bootstrap.uniform(7, "boot_id", "traj")))
    assert found.columns == every.columns and sorted(map(tuple, found.collect())) == sorted(tuple(r) for r in every.collect() if r.times > 0)


def test_frames_at_any_times(spark):
    changes = spark.createDataFrame([(1, "A", 0.9, 1.5), (1, "B", 1.5, 1.7), (1, "A", 1.7, 2.5), (1, "B", 2.5, 3.1), (2, "A", 70.0, 80.0)], "traj int, state string, start_time double, end_time double")
    found = sorted(map(tuple, frames.quantised_on(changes, ["traj"], [0, 1, 2, 3, 4, 5, 6]).collect()))
    assert found == [(1, "A", 1.0, 3.0, 1.0, 3.0), (1, "B", 3.0, 3.0, 1.0, 3.0)]
    assert found == sorted(map(tuple, frames.quantised(changes, ["traj"], 1.0, 7).collect()))
    assert [tuple(r)[1:] for r in frames.quantised_on(changes, ["traj"], [0.0, 1.0, 1.6, 60.0]).orderBy("start_time").collect()] == [("A", 1.0, 1.6, 1.0, 1.6), ("B", 1.6, 1.6, 1.0, 1.6)]
