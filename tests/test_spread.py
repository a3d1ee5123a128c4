"""Ordered steps over ranges, long trajectories, tiled joins, bins and fits against plain code."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.functions import special
from dwellspark.operators import bootstrap, curves, estimates
from dwellspark.operators import distributions as dist
from dwellspark.operators import fits, frames, geometry, lags, least_squares, loci, long, moments, ordered, scratch, streamed, waits
from dwellspark.operators.ordered import After, Before, First, Last, Sum, Whole, along
from dwellspark.sources import cache, runs


def test_steps_along_ranges(spark):
    rng = random.Random(2)
    rows = [(k, x, rng.choice([None, rng.randint(-5, 5)])) for k in ("hot", "b", None) for x in range(400 if k == "hot" else 7)]
    df = spark.createDataFrame(rows, "k string, x int, v int").repartition(5)
    v = F.col("v")
    steps = dict(up=Sum(v), down=Sum(v, back=True), all=Whole(v), most=Whole(v, most=True), last=Last(v), first=First(v), before=Before(v), after=After(v))
    found = along(df, ["k"], ["x"], **steps)
    assert along(df.limit(0), ["k"], ["x"], **steps).count() == 0
    for key in ("hot", "b", None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        values = [r[2] for r in own]
        got = {r.x: r for r in found.where(F.col("k").eqNullSafe(key)).collect()}
        assert len(got) == len(own)
        some = lambda a: [x for x in a if x is not None]
        for i in range(len(own)):
            r = got[i]
            assert (r.up, r.down) == (sum(some(values[: i + 1])), sum(some(values[i:])))
            assert (r.all, r.most) == (sum(some(values)) if some(values) else None, max(some(values), default=None))
            assert (r.last, r.first) == (next(iter(some(values[: i + 1])[::-1]), None), next(iter(some(values[i:])), None))
            assert (r.before, r.after) == (values[i - 1] if i else None, values[i + 1] if i + 1 < len(values) else None)
    assert found.schema.names == ["k", "x", "v", *steps]


def test_one_key_is_in_many_tasks(spark):
    df = spark.range(40_000).selectExpr("'one' AS k", "id AS x")
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = along(df, ["k"], ["x"], up=Sum(F.col("x")))
        assert found.agg(F.max("up")).first()[0] == 40_000 * 39_999 // 2
        sizes = [r["count"] for r in df.repartitionByRange("k", "x").groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 20_000
    finally:
        for c, value in old.items():
            spark.conf.set(c, value)


@pytest.fixture
def many_ranges(spark):
    """Small tables in several ranges, and no table small enough to be sent to all tasks unless the code says so."""
    own = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {c: spark.conf.get(c) for c in own}
    for c, value in own.items():
        spark.conf.set(c, value)
    yield spark
    for c, value in old.items():
        spark.conf.set(c, value)


@pytest.fixture
def tables_written(monkeypatch):
    made = []
    for module in (ordered, bootstrap):
        monkeypatch.setattr(module, "written", lambda df: made.append(df) or scratch.written(df))
    return made


def test_rows_meet_their_carry_without_a_shuffle(many_ranges):
    df = many_ranges.range(3_000).selectExpr("IF(id < 2000, 'hot', concat('k', id % 300)) AS k", "id AS x", "id % 7 AS v")
    v = F.col("v")
    found = along(df, ["k"], ["x"], up=Sum(v), all=Whole(v), most=Whole(v, most=True), before=Before(v), after=After(v))
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert len(rows) == 3_000
    for key in ("hot", "k299", "k0"):
        own = sorted((r for r in rows if r.k == key), key=lambda r: r.x)
        values = [r.v for r in own]
        for i, r in enumerate(own):
            assert (r.up, r.all, r.most) == (sum(values[: i + 1]), sum(values), max(values))
            assert (r.before, r.after) == (values[i - 1] if i else None, values[i + 1] if i + 1 < len(own) else None)


def _some_waits(spark, n=600):
    rng = random.Random(12)
    rows = [(i % 90, rng.choice("ab"), float(rng.randint(1, 150)), float((40, 100, 160)[i % 3]), rng.choice(["interior", "interior", "left exterior"])) for i in range(n)]
    return [r for r in rows if r[2] <= r[3]], spark.createDataFrame([r for r in rows if r[2] <= r[3]], "traj long, state string, wait_time double, window_size double, wait_type string")


def test_corrected_curve_deals_waits_out_twice(many_ranges, tables_written):
    """Once among the windows, once for its sums: its weights aren't looked up, nor made again for its first rows."""
    rows, df = _some_waits(many_ranges)
    found = dist.ecdf_windowed(waits.interior(df), ["state"], df, ["traj"])
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert len(tables_written) == 2 and "Join Inner" not in plan(tables_written[1]) and "Union" not in plan(found)
    sizes = list({r[0]: r[3] for r in rows}.values())
    got = {(r.state, r.x): r.cdf for r in found.collect()}
    for state in "ab":
        own = [(x, w) for _, s, x, w, kind in rows if s == state and kind == "interior" and w > x]
        weight = lambda x, w: 1 / (w - x) / (sum(z >= x for z in sizes) / len(sizes))
        whole = sum(weight(*o) for o in own)
        want = {x: sum(weight(*o) for o in own if o[0] <= x) / whole for x in {o[0] for o in own}} | {0.0: 0.0}
        assert {x: pytest.approx(y) for x, y in want.items()} == {x: y for (s, x), y in got.items() if s == state}


def test_curves_deal_their_points_out_once(many_ranges, tables_written):
    rows, df = _some_waits(many_ranges)
    survival = dist.kaplan_meier(df, ["state"])
    assert len(tables_written) == 1
    dist.kaplan_meier_bounds(df, ["state"], 2.0)
    assert len(tables_written) == 2
    area = dist.integral(survival, ["state"])
    assert len(tables_written) == 3
    for state in "ab":
        own = [(x, kind) for _, s, x, _, kind in rows if s == state]
        s, total, last, want = 1.0, 0.0, None, {}
        for x in sorted({o[0] for o in own}):
            s *= 1 - sum(o == (x, "interior") for o in own) / sum(o[0] >= x for o in own)
            total, last = total + (0.0 if last is None else (1 - s) * (x - last)), x
            want[x] = (pytest.approx(1 - s), pytest.approx(total))
        assert want == {r.x: (r.cdf, r.area) for r in area.where(F.col("state") == state).collect()}


def test_replicates_windows_go_along_with_their_waits(many_ranges, tables_written):
    rows, df = _some_waits(many_ranges)
    boots = df.withColumns({"boot_id": F.lit(0), "times": F.lit(1).cast("long"), "bin": F.ceil(F.col("wait_time") / 20)})
    found = bootstrap.windowed_shares(waits.interior(boots), boots, ["state"], ["traj"])
    # The join that is left is that of a replicate's whole.
    assert len(tables_written) == 1 and found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    found = found.collect()
    sizes = list({r[0]: r[3] for r in rows}.values())
    for state in "ab":
        own = {}
        for _, s, x, w, kind in rows:
            if s == state and kind == "interior" and w > x:
                own[math.ceil(x / 20)] = own.get(math.ceil(x / 20), 0) + 1 / (w - x) / (sum(z >= x for z in sizes) / len(sizes))
        assert {r.bin: r.pmf for r in found if r.state == state} == {b: pytest.approx(k / sum(own.values())) for b, k in own.items()}


def test_no_frame_ends_with_the_last_row(spark):
    """Such frames take the square of their rows."""
    df = spark.range(100).selectExpr("id % 2 AS k", "id AS x")
    found = along(df, ["k"], ["x"], up=Sum(F.col("x")), down=Sum(F.col("x"), back=True), first=First(F.col("x")), last=Last(F.col("x")), before=Before(F.col("x")), after=After(F.col("x")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding$()" in plan and "unboundedfollowing$()" not in plan.replace("unboundedpreceding$(), unboundedfollowing$()", "")
    assert sorted((r.x, r.down, r.first) for r in found.where("k = 0").collect()) == [(x, sum(range(x, 100, 2)), x) for x in range(0, 100, 2)]


def test_long_waits_are_those_of_windows(spark):
    rng = random.Random(4)
    rows = [(k, t, rng.choice(["a", "a", "b", None]), None) for k in ("x", "y") for t in sorted(rng.sample(range(900), 300))] + [("single", 5, "a", None), ("none", 1, None, None)]
    movie = spark.createDataFrame(rows, "k string, t long, state string, _before int").repartition(4)
    columns = ["k", "rank_order", "state", "start_time", "end_time", "wait_time", "min_waits", "max_waits", "wait_type", "window_size"]
    one, other = (sorted(map(tuple, f(movie, ["k"]).select(*columns).collect()), key=str) for f in (long.waits_of_long_movie, waits.waits_of_movie))
    assert one == other and len(one) > 100
    assert long.waits_of_long_movie(movie.limit(0), ["k"]).count() == 0
    runs = {(r.k, r.rank_order) for r in long.numbered_waits(movie, ["k"]).collect()}
    assert runs == {(r[0], r[1]) for r in one}


def test_long_look_up_is_that_of_windows(spark):
    rng = random.Random(6)
    rows = []
    for k in range(3):
        times = sorted(rng.sample(range(200), 12))
        rows += [(k, rng.choice(["a", "b", None]), float(a), float(b)) for a, b in zip(times, times[1:])]
    changes = spark.createDataFrame(rows, "k int, state string, start_time double, end_time double")
    grid = spark.range(0, 220).select(F.col("id").cast("double").alias("t")).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("k")))
    for clip in (True, False):
        one, other = (sorted(map(tuple, f(changes, grid, ["k"], clip).select("k", "t", "state").collect()), key=str) for f in (long.as_of_long, frames.as_of))
        assert one == other and len(one) == 880


@pytest.mark.parametrize("most", [0.5, 3, 7.25, 1000])
def test_tiles_hold_each_pair_once(spark, most):
    rng = random.Random(7)
    rows = [(k, t, rng.random()) for k in ("a", "b") for t in sorted({round(rng.uniform(-50, 50), 2) for _ in range(120)} | {0.0, 4.0 * most, -4.0 * most, 8.0 * most})]
    df = spark.createDataFrame(rows, "k string, t double, x double")
    found = sorted((r.k, r.ti, r.tf) for r in lags.lag_pairs(df, ["k"], max_delta=most).collect())
    assert found == sorted((k, a, b) for k, a, _ in rows for j, b, _ in rows if k == j and 0 <= b - a < most)
    assert lags.lag_pairs(df, ["k"], max_delta=0).count() == 0
    got = sorted((r.k, round(r.tau - r.t, 6), r.tau) for r in lags.products(df, ["k"], max_dt=most).collect())
    assert got == sorted((k, round(a, 6), b) for k, a, b in found)


def test_velocity_products_in_tiles(spark):
    df = spark.createDataFrame([(k, t, float((t * 7 + k) % 11)) for k in (1, 2) for t in range(60) if (t + k) % 5], "k int, t long, x double")
    pairs = lags.lag_pairs_at(df, ["k"], [1, 2, 5])
    kept = lambda rows, most: sorted((r.k, r.delta, r.t, r.tau, r.cvv) for r in rows if most is None or r.t <= most * r.delta)
    every = lags.velocity_products(pairs, ["k"], max_t_over_delta=None).collect()
    for most in (0.5, 1, 4):
        assert kept(lags.velocity_products(pairs, ["k"], max_t_over_delta=most).collect(), None) == kept(every, most)


def test_bins_are_numpys(spark):
    rng = np.random.default_rng(3)
    values = {"a": rng.gamma(2, 3, 700), "b": rng.integers(0, 4, 50).astype(float), "c": np.array([2.5]), "d": np.array([1.0] * 40 + [9.0]), "e": rng.normal(size=4)}
    df = spark.createDataFrame([(k, float(x)) for k, v in values.items() for x in v] + [("a", None), ("f", None)], "state string, x double").repartition(4)
    quarters = {r.state: r for r in dist.quartiles(df, ["state"], "x").collect()}
    spans = {r.state: r for r in dist.auto_bins(df, ["state"], "x").collect()}
    found = dist.histogram_auto(df, ["state"], "x").collect()
    assert set(quarters) == set(values)
    for k, v in values.items():
        q, s = quarters[k], spans[k]
        assert (q.n, q.low, q.high) == (len(v), v.min(), v.max()) and (q.q1, q.q3) == pytest.approx(tuple(np.quantile(v, [0.25, 0.75])))
        fd, sturges = np.histogram_bin_edges(v, "fd"), np.histogram_bin_edges(v, "sturges")
        want = max(fd, sturges, key=len) if q.q3 > q.q1 else sturges
        assert s.bins == len(want) - 1 and (s.low, s.high) == (want[0], want[-1])
        counts, _ = np.histogram(v, want)
        own = {r.bin: r for r in found if r.state == k}
        assert sum(r.weight for r in own.values()) == len(v) and sum(r.density * r.width for r in own.values()) == pytest.approx(1)
        assert abs(np.array([own[i + 1].weight if i + 1 in own else 0 for i in range(s.bins)]) - counts).sum() <= 2  # on an edge, by rounding
    assert dist.histogram_auto(df.limit(0), ["state"], "x").count() == 0


def test_no_wait_is_lost(spark):
    from dwellspark.jobs.registry import KEY, obs

    outer = waits.exterior(obs(spark, "/root/testdata/sf0.1"))
    found = dist.histogram_auto(outer, ["state"], "wait_time")
    assert found.agg(F.sum("weight")).first()[0] == outer.count() > 2000


def plain_curve(x, a, relaxed):
    return [2 * a * math.sqrt(u) * (1 - math.exp(-relaxed / u) + math.sqrt(math.pi * relaxed / u) * math.erfc(math.sqrt(relaxed / u))) for u in x]


def dense_fit(x, y, low, high):
    """A grid over the time, the amplitude from it, then smaller and smaller grids."""
    lo, hi = math.log(low[1]), math.log(high[1])
    for _ in range(25):
        best = None
        for u in np.linspace(lo, hi, 41):
            f = np.array(plain_curve(x, 1.0, math.exp(u)))
            a = min(max(float(f @ y / (f @ f)), low[0]), high[0])
            rest = float(((a * f - y) ** 2).sum())
            if best is None or rest < best[0]:
                best = rest, a, u
        step = (hi - lo) / 40
        lo, hi = max(math.log(low[1]), best[2] - step), min(math.log(high[1]), best[2] + step)
    return best[0], best[1], math.exp(best[2])


def test_fits_by_label(spark):
    rng = np.random.default_rng(8)
    planted = {"free": (0.7, 400.0), "tied": (1.4, 12.0), "noisy": (1.1, 30.0), "flat": (5.0, 0.3), "two": (1.0, 20.0)}
    rows, low, high = [], (0.1, 1.0), (2.0, 173.0)
    for name, (a, relaxed) in planted.items():
        x = np.arange(1.0, 3.0 if name == "two" else 61.0)
        y = np.array(plain_curve(x, a, relaxed)) * (1 + (0.05 * rng.normal(size=len(x)) if name == "noisy" else 0))
        rows += [(name, float(u), float(v), 1) for u, v in zip(x, y)]
    rows += [("tied", None, 5.0, 1), ("tied", 7.0, float("nan"), 1), ("tied", 500.0, -1e9, 1), ("one", 3.0, 1.0, 1), ("tied", -1.0, 3.0, 1)]
    points = spark.createDataFrame(rows, "label string, lag double, msd double, p1 int").repartition(4)
    within = spark.createDataFrame([("tied", 1.0, 60.0), ("noisy", 2.0, 50.0)], "label string, x_from double, x_to double")
    found = {r.label: r for r in least_squares.fit(points, ["label"], "lag", "msd", least_squares.SEPARATION, (1.0, 100.0), low, high, within).collect()}
    assert set(found) == set(planted)
    assert (found["tied"].p1, found["tied"].p2) == pytest.approx(planted["tied"], rel=1e-3)
    assert found["two"].p1_var is None and found["tied"].points == 60 and found["noisy"].points == 49
    for name, r in found.items():
        own = [(x, y) for n, x, y, _ in rows if n == name and x and 0 < x <= 60 and y == y and (name != "noisy" or 2 <= x <= 50)]
        x, y = np.array(own).T
        rest, a, relaxed = dense_fit(x, y, low, high)
        assert r.rest <= rest * (1 + 1e-3) + 1e-6 and low[0] <= r.p1 <= high[0] and low[1] <= r.p2 <= high[1], name
        if name in ("tied", "noisy"):
            assert (r.p1, r.p2) == pytest.approx((a, relaxed), rel=2e-3)
            j = np.array([(np.array(plain_curve(x, r.p1 + h * 1e-5, r.p2 + k * 1e-5)) - np.array(plain_curve(x, r.p1 - h * 1e-5, r.p2 - k * 1e-5))) / 2e-5 for h, k in ((1, 0), (0, 1))]).T
            cov = np.linalg.inv(j.T @ j) * r.rest / (len(x) - 2)
            assert (r.p1_var, r.p2_var, r.covariance) == pytest.approx((cov[0, 0], cov[1, 1], cov[0, 1]), rel=1e-2)
    assert least_squares.fit(points.limit(0), ["label"], "lag", "msd", least_squares.SEPARATION, (1.0, 100.0), low, high).count() == 0


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 40])
def test_shapiro_weights_are_normed(spark, n):
    """The statistic is that of plain code, and 1 for the weights themselves."""
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=n) ** 3, 2 if n == 40 else 6)
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("a", None), ("few", 1.0), ("few", 2.0)] + [("same", 3.0)] * 5, "k string, v double").repartition(3)
    found = moments.shapiro_wilk(df, ["k"], "v").collect()
    from statistics import NormalDist

    e = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    poly = lambda c, u: sum(a * u**k for k, a in enumerate(c))
    a, u = e / np.sqrt(e @ e), 1 / math.sqrt(n)
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        outer = [poly(moments._OUTER, u) + a[-1]] + ([poly(moments._NEXT, u) + a[-2]] if n > 5 else [])
        k = len(outer)
        inner = e[k:-k] / math.sqrt((e @ e - 2 * sum(e[-k:] ** 2)) / (1 - 2 * sum(v * v for v in outer)))
        a = np.concatenate([[-v for v in outer], inner, outer[::-1]])
    assert a @ a == pytest.approx(1)
    s = np.sort(x)
    want = float((a @ s) ** 2 / ((s - s.mean()) ** 2).sum())
    assert [r.k for r in found] == ["a"] and found[0].n == n and found[0].w == pytest.approx(want, abs=1e-9) and 0 <= found[0].p <= 1


def test_shapiro_of_a_published_sample(spark):
    """Weights of eleven men: W = 0.79, p = 0.0067."""
    df = spark.createDataFrame([(float(v),) for v in (148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236)], "v double")
    r = moments.shapiro_wilk(df.withColumn("k", F.lit(1)), ["k"], "v").first()
    assert r.w == pytest.approx(0.7888, abs=2e-4) and r.p == pytest.approx(0.0067, abs=2e-4)


def test_binned_density_is_the_direct_sum(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.gamma(2, 3, 900), "b": rng.normal(size=30), "one": np.array([4.0])}
    df = spark.createDataFrame([(k, float(x), float(w)) for k, v in values.items() for x, w in zip(v, rng.uniform(0.5, 2, len(v)))] + [("a", None, 1.0)], "k string, v double, w double").repartition(3)
    for weight in (None, "w"):
        rows = [r for r in df.collect() if r.v is not None]
        found = curves.binned_density(df, ["k"], "v", weight).collect()
        assert {r.k for r in found} == {"a", "b"}
        for k in "ab":
            x, w = np.array([(r.v, r.w if weight else 1.0) for r in rows if r.k == k]).T
            n, mean = w.sum() ** 2 / (w @ w), w @ x / w.sum()
            h = n**-0.2 * math.sqrt((w @ (x * x) / w.sum() - mean**2) / (1 - 1 / n))
            at, got = np.array(sorted((r.x, r.density) for r in found if r.k == k)).T
            want = np.array([(w * np.exp(-0.5 * ((g - x) / h) ** 2)).sum() / w.sum() / h / math.sqrt(2 * math.pi) for g in at])
            assert np.abs(got - want).max() < 1e-3 * want.max() and got.sum() * (at[1] - at[0]) == pytest.approx(1, abs=1e-4)
    assert curves.binned_density(df.limit(0), ["k"], "v").count() == 0


def test_transforms_are_sums_over_pairs(spark):
    rng = random.Random(9)
    rows = [(k, t, rng.uniform(-3, 9), rng.uniform(0, 4)) for k in "ab" for t in sorted(rng.sample(range(70), 40))] + [("one", 5, 2.0, 1.0), ("a", 200, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, t long, x double, y double").repartition(3)
    found = {(r.k, r.t): (r.n, r.total, r.squares) for r in lags.lagged_sums(df, ["k"], "t", ["x", "y"]).collect()}
    want = {}
    for k, a, xa, ya in rows:
        for j, b, xb, yb in rows:
            if k == j and b >= a and xa is not None and xb is not None:
                n, s, q = want.get((k, b - a), (0, 0.0, 0.0))
                p = xa * xb + ya * yb
                want[k, b - a] = n + 1, s + p, q + p * p
    assert set(found) == set(want) and all(found[i] == pytest.approx(want[i], rel=1e-9, abs=1e-7) for i in want)
    assert lags.lagged_sums(df.limit(0), ["k"]).count() == 0
    one, other = ({r.t: r for r in f(df.dropna(), ["k"]).collect()} for f in (lags.autocorrelation_by_transform, lags.autocorrelation))
    assert set(one) == set(other) and all((one[t]["count"], one[t]["mean"]) == pytest.approx((other[t]["count"], other[t]["mean"])) for t in one)


def test_draws_are_as_many_as_there_are(spark):
    df = spark.createDataFrame([(f"t{i}", j) for i in range(90) for j in range(i % 3 + 1)] + [(None, 1)], "traj string, rank int").repartition(4)
    found = bootstrap.drawn(df, ["traj"], 7, seed=3)
    per = found.select("boot_id", "traj", "times").distinct().groupBy("boot_id").agg(F.sum("times").alias("n"), F.countDistinct("traj").alias("k")).collect()
    assert len(per) == 7 and all(r.n == 90 and 40 < r.k < 75 for r in per)
    whole = lambda d: sorted(map(tuple, d.collect()))
    assert whole(found) == whole(bootstrap.drawn(df.repartition(2), ["traj"], 7, seed=3)) != whole(bootstrap.drawn(df, ["traj"], 7, seed=4))
    rows = found.groupBy("boot_id", "traj", "times").count().collect()
    assert all(r["count"] == int(r.traj[1:]) % 3 + 1 for r in rows)
    assert bootstrap.drawn(df.limit(0), ["traj"], 7).count() == 0


def test_shared_motion_of_any_exponent():
    at, closed = special.shared_motion(0.5)
    z = 10.0**-at
    assert closed == pytest.approx([math.exp(-v) - math.sqrt(math.pi * v) * math.erfc(math.sqrt(v)) for v in z], abs=1e-7)
    assert np.abs(special.shared_motion(0.4999)[1] - closed).max() < 2e-4
    q = np.linspace(1e-4, 300.0, 600_001)
    for exponent in (0.25, 0.3, 0.4):  # the modes of a chain, one by one
        at, shared = special.shared_motion(exponent)
        assert (np.diff(shared) >= -1e-12).all() and shared[0] < 1e-9
        for x in (-1.0, 0.0, 1.0):
            moved = (1 - special.relaxation(q * q * 10 ** (2 * exponent * x), 2 * exponent)) / q**2
            area = lambda y: float(((y[1:] + y[:-1]) / 2 * np.diff(q)).sum())
            assert np.interp(x, at, shared) == pytest.approx(area(np.cos(2 * q) * moved) / (area(moved) + 1 / q[-1]), abs=3e-4)
    t = np.linspace(0, 20, 41)
    lag = np.full_like(t, 5.0)
    assert special.separation_correlation_at(t, lag, 7.0, 0.5) == pytest.approx(special.separation_correlation(t, lag, 7.0), abs=1e-4)


@pytest.mark.parametrize("exponent", [0.25, 0.35, 0.5])
def test_two_loci_of_any_exponent(spark, exponent):
    planted = {"a": (0.8, 20.0), "b": (1.3, 150.0)}
    rows = []
    for k, (a, relaxed) in planted.items():
        for d in (2.0, 5.0, 11.0):
            t = np.arange(0.0, 4 * d)
            rows += [(k, float(u), d, float(a * v)) for u, v in zip(t, special.separation_correlation_at(t, np.full_like(t, d), relaxed, exponent))]
    df = spark.createDataFrame(rows, "k string, t double, delta double, cvv_normed double")
    found = {r.k: (r.amplitude, r.relaxed) for r in fits.fit_two_loci(df, ["k"], exponent=exponent).collect()}
    assert all(found[k] == pytest.approx(planted[k], rel=1e-2) for k in planted)


def test_cached_tables_follow_their_inputs(spark, tmp_path):
    made = []
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).write.parquet(source)

    def get(version=""):
        rows = spark.read.parquet(source)
        return sorted(r[0] for r in cache.derived(spark, folder, "double", [rows], lambda: made.append(1) or rows.select(F.col("id") * 2), version).collect())

    assert get() == get() == [0, 2, 4, 6, 8] and len(made) == 1
    spark.range(5, 7).write.mode("append").parquet(source)
    assert get() == [0, 2, 4, 6, 8, 10, 12] and len(made) == 2
    assert get("new") == get("new") and len(made) == 3
    assert all("." not in p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))

    def fails():
        raise RuntimeError("no table")

    with pytest.raises(RuntimeError):
        cache.derived(spark, folder, "other", [spark.read.parquet(source)], fails)
    # Another maker was faster: its table stays.
    rows, path = spark.read.parquet(source), f"{folder}/third-{cache.fingerprint([spark.read.parquet(source)])[:24]}"

    def late():
        spark.range(1).write.parquet(path)
        return spark.range(3)

    assert cache.derived(spark, folder, "third", [rows], late).count() == 1


def test_runs_with_parameters(spark, tmp_path):
    folders = {runs.claimed(spark, str(tmp_path), "sim") for _ in range(3)}
    assert {f.rsplit("/", 1)[1] for f in folders} == {"sim.0", "sim.1", "sim.2"}
    folder = folders.pop()
    rows = [("a b", 1, 0.5), ("a b", 2, None), ("c/d", 1, 2.0), ("e", 3, 4.0), (None, 9, 9.0)]
    params = [("a b", "fp", "0.1"), ("a b", "n", "7"), ("c/d", "fp", "0.5"), ("c/d", "n", "x"), ("none", "fp", "1"), ("c/d", "extra", "7")]
    runs.write_runs(spark.createDataFrame(rows, "sim_name string, t int, x double"), spark.createDataFrame(params, "sim_name string, key string, value string"), folder)
    found = runs.read_runs_with(spark, folder, "t int, x double", ["fp", "n"])
    assert sorted(map(str, (tuple(r[c] for c in ("sim_name", "t", "x", "fp", "n")) for r in found.collect()))) == sorted(map(str, [("a b", 1, 0.5, 0.1, 7.0), ("a b", 2, None, 0.1, 7.0), ("c/d", 1, 2.0, 0.5, None)]))
    some = runs.read_runs_with(spark, folder, "t int, x double", ["fp"], "fp > 0.2")
    assert [r.sim_name for r in some.collect()] == ["c/d"]
    assert {(r.key, r["values"], r.runs) for r in runs.shared_params(spark, folder).collect()} == {("fp", 3, 3), ("n", 2, 2), ("extra", 1, 1)}


def test_small_checks(spark):
    df = spark.createDataFrame([("a", t, None if t == 2 else 1.0) for t in (0, 1, 2, 3)], "k string, t long, x double")
    assert [r.na_id for r in loci.number_gaps(df, ["k"], ["x"], contiguous=True).orderBy("t").collect()] == [0, 0, 1, 1]
    with pytest.raises(Exception, match="leaves frames out"):
        loci.number_gaps(df.where("t <> 1"), ["k"], ["x"], contiguous=True).collect()
    assert loci.named_by_position(df, {1: "frame", 0: "x"}, ["k"]).columns == ["x", "frame"]
    with pytest.raises(ValueError):
        loci.named_by_position(df, {7: "y"})
    times = spark.createDataFrame([("a", t) for t in (0.0, 30.1, 59.9, 91.5)], "k string, t double")
    assert frames.selected(times, ["k"], "t", [0.0, 30.0, 60.0], 0.01).count() == 3
    with pytest.raises(Exception, match="near enough"):
        frames.selected(times.withColumn("t", F.col("t") / 10), ["k"], "t", [0.0, 3.0, 9.0], 0.01).collect()
    points = spark.createDataFrame([(1.0, 2.0, 1.0, 0.1, 5), (9.0, 2.0, 1.0, 0.1, 5), (1.0, 0.0, 1.0, 0.1, 5), (1.0, 2.0, float("nan"), 0.1, 5), (1.0, 2.0, 1.0, None, 5), (1.0, 2.0, 1.0, 0.1, 3)], "t double, delta double, cvv_normed double, ste double, n int")
    assert fits.usable(points).count() == 3 and fits.usable(points, ste="ste", counts="n").count() == 1
    square = spark.createDataFrame([("a", t, x, y) for t, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (3.0, 3.0)])], "k string, t long, x double, y double")
    area = lambda **how: geometry.hull_area(geometry.at_times(square, **how), ["k"]).first()
    assert area(last=2).area == 0.5 and area(allowed=[0, 1, 3]).area == 1.5 and area(allowed=spark.createDataFrame([(0,), (1,)], "t long")).area is None
    three = spark.createDataFrame([("a", d, t, 1.0, 2.0, None if t == 3 else 3.0) for d in (1, 2) for t in range(5)], "k string, delta int, ti long, vx double, vy double, vz double")
    found = lags.velocity_products(three, ["k"], ("x", "y", "z"), None, deltas=[2]).collect()
    assert len(found) == 10 and {(r.delta, r.cvv) for r in found} == {(2, 14.0)}


def test_windows_of_own_span(spark):
    rows = [("a", 1.0, "x"), ("a", 2.0, "x"), ("a", 5.0, "y"), ("a", 9.0, "x"), ("b", 3.0, "y"), ("b", 4.0, "y"), ("c", 7.0, "x")]
    movie = spark.createDataFrame(rows, "k string, t double, state string")
    changes = waits.changes_of_runs(waits.islands(movie, ["k"]), ["k"])
    found = {(r.k, r.rank_order): (r.state, r.wait_time, r.window_size, r.wait_type) for r in waits.waits_of_changes(changes, ["k"]).collect()}
    assert found == {
        ("a", 1): ("x", 4.0, 8.0, "left exterior"), ("a", 2): ("y", 4.0, 8.0, "interior"), ("a", 3): ("x", 0.0, 8.0, "right exterior"),
        ("b", 1): ("y", 1.0, 1.0, "full exterior"), ("c", 1): ("x", 0.0, 0.0, "full exterior"),
    }
    assert waits.changes_of_runs(waits.islands(movie.limit(0), ["k"]), ["k"]).count() == 0


def test_curves_at_their_heights(spark):
    curve = spark.createDataFrame([("a", 1.0, 0.2, 0.1), ("a", 2.0, 0.5, 0.3), ("b", 1.0, 0.0, 0.0), ("c", 1.0, 1.0, 1.0)], "state string, x double, cdf double, low double")
    heights = spark.createDataFrame([("a", 0.8), ("b", 0.8)], "state string, height double")
    found = {(r.state, r.x): (r.cdf, r.low) for r in dist.rescaled(curve, ["state"], heights, ("cdf", "low")).collect()}
    assert found == {("a", 1.0): pytest.approx((0.32, 0.16)), ("a", 2.0): pytest.approx((0.8, 0.48)), ("b", 1.0): (None, None)}
    lag = spark.createDataFrame([(2, 4, 0.5, 0.1), (2, 9, 0.5, 0.1), (3, 3, 0.5, 0.1)], "delta int, t int, cvv_normed double, ste_normed double")
    r = lags.rescaled_curves(lag, [2], 4.0, 0.5, 5.0).collect()
    assert len(r) == 1 and (r[0].scaled_t, r[0].scaled, r[0].scaled_ste, r[0].moved) == pytest.approx((2.0, 0.1, 0.02, 2**1.5 * 0.1))
    assert lags.rescaled_curves(lag).count() == 2


def test_short_trajectories_are_transformed_together(spark, monkeypatch):
    """Keys that batches cut through, null ones and one longer than a task gathers, each as if it were alone; no call for each key."""
    monkeypatch.setattr(streamed, "ROWS", 8)
    monkeypatch.setattr(lags, "CELLS", 64)
    rng = random.Random(11)
    rows = [(k, d, t, rng.gauss(0, 1)) for k, n in [(None, 5), ("long", 90), *((f"k{i}", i % 7 + 1) for i in range(40))] for d in (1, 2) for t in range(3, 3 + n)]
    df = spark.createDataFrame(rows, "k string, d int, t long, x double").repartition(3)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        made = lags.lagged_sums(df, ["k", "d"])
        assert "InPandas" not in made._jdf.queryExecution().toString()
        found = {(r.k, r.d, r.t): (r.n, r.total) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    values = {}
    for k, d, t, x in rows:
        values.setdefault((k, d), []).append(x)
    want = {(*key, lag): (len(v) - lag, sum(v[i] * v[i + lag] for i in range(len(v) - lag))) for key, v in values.items() for lag in range(len(v))}
    assert set(found) == set(want) and all(found[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in want)


def test_both_kinds_of_waits_are_dealt_out_together(many_ranges, tables_written):
    """Two deals for all estimates of both; the same as each estimate on its own, also for states that have one kind only, waits as long as their window or none of any length."""
    rows, _ = _some_waits(many_ranges)
    rows += [(1, "a", 0.0, 100.0, "right exterior"), (1, "a", 0.0, 100.0, "interior"), (2, "cut", 3.0, 160.0, "left exterior"), (2, "cut", 9.0, 160.0, "right exterior"), (2, "seen", 4.0, 160.0, "interior")]
    rows += [(2, "long", 160.0, 160.0, "interior"), (2, "long", 2.0, 160.0, "left exterior"), (2, "long", 7.0, 160.0, "left exterior"), (0, "full", 40.0, 40.0, "full exterior"), (2, "zero", 0.0, 160.0, "left exterior")]
    df = many_ranges.createDataFrame(rows, "traj long, state string, wait_time double, window_size double, wait_type string")
    key, close = ["state"], lambda r: tuple(pytest.approx(v, rel=1e-9, abs=1e-9) if isinstance(v, float) else v for v in r)
    points = estimates.points(df, key, ["traj"])
    found = estimates.summary(points, key)
    got = {
        "fit": found.select("state", "a", "b", "end_share"), "bins": found.where("cut > 0").select("state", "low", "high", "bins"), "curve": estimates.interior_curve(points, key), "blended": estimates.combined(points, found, key),
        "bars": estimates.bars_of_bins(estimates.combined(points, found, key), key), "outer": dist.estimate_of_bins(estimates.exterior_bins(points, found, key), key),
        "density": dist.density_of_weights(points.where("w IS NOT NULL").select("state", "x", "w"), key, found, 0.0, 160.0, 8), "kaplan": estimates.kaplan_meier_bounds(points, key, 2.0).where("cdf < 1"),
    }
    got = {n: sorted(map(tuple, d.collect()), key=str) for n, d in got.items()}
    assert len(tables_written) == 2 and points.select("_range").distinct().count() > 2
    inner, outer = waits.interior(df), waits.exterior(df)
    curve = dist.ecdf_windowed(inner, key, df, ["traj"])
    fit = dist.exterior_fit(dist.ecdf(outer, key, "wait_time", 0.0), curve, key)
    blended = dist.blended(outer, curve, fit, inner.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), key)
    want = {
        "fit": fit, "bins": dist.auto_bins(outer, key, "wait_time"), "curve": curve, "blended": blended, "bars": dist.bars(blended, key), "outer": dist.exterior_estimate(outer, key, fit),
        "density": dist.interior_density(inner, key, df, ["traj"], fit, 0.0, 160.0, 8), "kaplan": dist.kaplan_meier_bounds(df, key, 2.0).where("cdf < 1"),
    }
    for name, d in want.items():
        other = sorted(map(tuple, d.collect()), key=str)
        own = {(r[0], round(r[1] or 0, 6)) if name not in ("fit", "bins") else r[0]: r for r in got[name]}
        assert len(own) == len(got[name]) == len(other), name
        for r in other:
            assert own[(r[0], round(r[1] or 0, 6)) if name not in ("fit", "bins") else r[0]] == close(r), name
    assert estimates.combined(estimates.points(df.limit(0), key, ["traj"]), found, key).count() == 0


def test_waits_in_own_windows_as_by_runs(spark):
    rng = random.Random(6)
    rows = [(k, None if t < k % 3 else float(t), rng.choice(["x", "y", None])) for k in range(12) for t in rng.sample(range(40), 1 + 2 * k) if k % 3 < 2 or t] + [(None, 1.0, "x"), (None, 4.0, "y"), (20, None, "x")]
    movie = spark.createDataFrame(rows, "k int, t double, state string")
    columns = ["k", "state", "start_time", "end_time", "window_size", "rank_order", "num_waits", "wait_time", "wait_type"]
    own = waits.waits_in_own_windows(movie, ["k"]).select(*columns)
    want = waits.waits_of_changes(waits.changes_of_runs(waits.islands(movie, ["k"]), ["k"]), ["k"]).select(*columns)
    assert sorted(map(str, own.collect())) == sorted(map(str, want.collect())) and own.count() > 100
    fresh = waits.waits_in_own_windows(movie, ["k"])
    assert fresh._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1 and waits.waits_in_own_windows(movie.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("beside", [100_000, 0])
def test_corrected_curve_of_whole_waits_is_written_once(many_ranges, tables_written, monkeypatch, beside):
    """Waits and windows are one table, and both sums are taken along its ranges; with many keys they are dealt out by key instead."""
    rng = random.Random(13)
    size = lambda i: float((40, 100, 160, 95)[i % 4] + i % 7)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randint(0, 120)), size(i), kind, n + 1) for i in range(90) for n, kind in enumerate(["left exterior"] + ["interior"] * (i % 9) + ["right exterior"])] + [(99, "b", 7.0, None, "interior", 1)]
    df = many_ranges.createDataFrame(rows, "traj int, state string, wait_time double, window_size double, wait_type string, rank_order int")
    want = {(r.state, r.x): r.cdf for r in dist.ecdf_windowed(waits.interior(df), ["state"], df, ["traj"]).collect()}
    tables_written.clear()
    monkeypatch.setattr(dist, "BESIDE", beside)
    monkeypatch.setattr(dist, "written", ordered.written)
    ranged = ordered.ranged
    monkeypatch.setattr(dist, "ranged", lambda *a: ranged(*a, rows=20))
    found = dist.ecdf_windowed_whole(df, ["state"])
    got = {(r.state, r.x): r.cdf for r in found.collect()}
    assert len(tables_written) == (1 if beside else 3) and len(got) == found.count() and {s for s, _ in got} == {"a", "b", None}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert dist.ecdf_windowed_whole(df.limit(0), ["state"]).count() == 0
    if beside:
        other = dist.ecdf_windowed(waits.interior(df), [], df, ["traj"], None)
        assert dict(dist.ecdf_windowed_whole(df, [], None).collect()) == {x: pytest.approx(c) for x, c in other.collect()}


def test_ranges_without_dealing_out(many_ranges):
    rng = random.Random(14)
    values = [None, None, float("nan"), float("-inf"), float("inf"), -0.0, 0.0] + [5.0] * 300 + [rng.lognormvariate(0, 3) for _ in range(2000)]
    df = many_ranges.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "x double, k int")
    placed, ranges, keys = ordered.ranged(df, ["k"], "x", rows=50)
    found = placed.groupBy("_range").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).orderBy("_range").collect()
    assert keys == 3 and 30 < ranges <= 47 and all(0 <= r._range < ranges for r in found)
    assert all(a.high < b.low or math.isnan(b.low) for a, b in zip(found, found[1:])) and max(r.n for r in found if not r.low <= 5.0 <= r.high) < 250
    assert placed.where("x IS NULL").select("_range").distinct().collect() == [(0,)] and ordered.ranged(df, [], "x")[1] == 1
    assert ordered.ranged(df.limit(0), [], "x")[0].count() == 0
