"""Hulls, bootstraps, simulated processes, fits and the stream."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwellspark.operators import bootstrap, fits, geometry, loci, renewal, waits
from dwellspark.operators import distributions as dist
from dwellspark.sources import arrays, runs
from dwellspark.streaming.waits import waits_of_stream


def test_hull(spark):
    rows = [("square", float(x), float(y)) for x in range(3) for y in range(3)] * 2 + [("line", float(i), float(i)) for i in range(5)] + [("point", 1.0, 1.0), ("none", None, 1.0)]
    found = {r.traj: (r.area, r.perimeter) for r in geometry.hull_area(spark.createDataFrame(rows, "traj string, x double, y double"), ["traj"]).collect()}
    assert found == {"square": (4.0, 8.0), "line": (None, None), "point": (None, None)}
    points = np.random.default_rng(1).random((40, 2))
    corners = {tuple(c) for c in geometry._hull(points)}
    for a, b, c in itertools.islice(itertools.combinations(corners, 3), 30):  # no point in a triangle of corners is one
        side = lambda p, u, v: (v[0] - u[0]) * (p[1] - u[1]) - (v[1] - u[1]) * (p[0] - u[0])
        for p in corners - {a, b, c}:
            signs = {side(p, a, b) > 0, side(p, b, c) > 0, side(p, c, a) > 0}
            assert len(signs) == 2


def test_bootstrap(spark):
    df = spark.range(3000).select(F.col("id").alias("traj"), (F.col("id") % 100).cast("double").alias("x"))
    mean = lambda times: F.sum(F.col("x") * times) / F.sum(times)
    found = bootstrap.interval(bootstrap.estimates(df, ["traj"], [], 100, mean), [], "value").first()
    se = 28.87 / np.sqrt(3000)
    assert 49.5 - 4 * se < found.low < 49.5 - se < 49.5 + se < found.high < 49.5 + 4 * se
    assert bootstrap.estimates(df, ["traj"], [], 3, mean).orderBy("boot_id").collect() == bootstrap.estimates(df.repartition(5), ["traj"], [], 3, mean).orderBy("boot_id").collect()


def test_lifetimes_of_a_simulated_process(spark):
    sim = renewal.simulate(spark, [renewal.Wait("exponential", 1.0), renewal.Wait("exponential", 3.0)], 40.0, 60.0, 400, ["A", "B"], seed=7).cache()
    assert sim.where("end_time <= 0 OR start_time > 40").count() == 0
    found = {r.state: r.mean_wait for r in waits.mean_lifetimes(waits.waits_of_changes(sim, ["replicate"]), ["replicate"]).collect()}
    assert found["A"] == pytest.approx(1, rel=0.1) and found["B"] == pytest.approx(3, rel=0.1)
    assert renewal.simulate(spark, [renewal.Wait("beta", 5, 2)], 1.0, 0.0, 0, ["A"]).count() == 0


def test_fit(spark):
    rows = []
    for key, alpha in (("a", 0.5), ("b", 1.2)):
        for t in np.linspace(0, 4, 30):
            value = 0.8 * (abs(t - 1) ** alpha - 2 * t**alpha + (t + 1) ** alpha) / 2
            rows.append((key, float(t), 1.0, float(value)))
    df = spark.createDataFrame([*rows, ("a", 1.0, 1.0, None), ("c", 1.0, 1.0, 0.5)], "k string, t double, delta double, cvv_normed double")
    found = {r.k: r for r in fits.fit_alpha(df, ["k"]).collect()}
    assert found["a"].alpha == pytest.approx(0.5, abs=1e-4) and found["b"].alpha == pytest.approx(1.2, abs=1e-4)
    assert found["a"].amplitude == pytest.approx(0.8, abs=1e-4) and found["c"].alpha is None


def test_stream(spark, tmp_path):
    rows = [(k, float(t), "ab"[(t // (2 + k)) % 2]) for k in range(3) for t in range(20)]
    df = spark.createDataFrame(rows, "traj int, t double, state string")
    for i, part in enumerate((df.where("t < 7"), df.where("t >= 7"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = waits_of_stream(stream, "traj").writeStream.format("memory").queryName("found").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    whole = waits.waits_of_movie(df, ["traj"]).where("wait_type IN ('interior', 'left exterior')")
    own = lambda d: sorted((r.traj, r.state, r.start_time, r.end_time, r.wait_time) for r in d.collect())
    assert own(spark.table("found")) == own(whole) and len(own(whole)) > 10


def test_relaxation():
    import math

    from dwellspark.functions.special import relaxation

    x = np.array([0.0, 0.1, 1.0, 3.0])
    assert np.allclose(relaxation(x, 0.5), [math.exp(v * v) * math.erfc(v) for v in x], atol=1e-7)
    series = lambda v, a: sum((-v) ** k / math.gamma(a * k + 1) for k in range(80))
    assert np.allclose(relaxation(np.array([0.3, 0.9]), 0.8), [series(0.3, 0.8), series(0.9, 0.8)], atol=1e-7)
    assert np.allclose(relaxation(x, 1), np.exp(-x))


def test_polymer_theory_in_its_limits(spark):
    from dwellspark.functions import special, theory

    df = spark.createDataFrame([(0.5,), (2.0,), (9.0,)], "t double")
    r = df.select(special.middle_msd(F.col("t"), 1.0, 1.0, 50.0, modes=60).alias("a"), theory.rouse_middle_msd(F.col("t"), 1.0, 50.0, modes=60).alias("b")).collect()
    assert np.allclose([x.a for x in r], [x.b for x in r])
    zero = df.select(special.two_locus_correlation(F.lit(0.0), F.lit(2.0), 0.0, 1.0).alias("c")).first().c
    assert zero > 0  # one locus with itself


def test_rouse_chain_has_its_thousand_modes(spark):
    from dwellspark.functions import special, theory

    t = F.col("t")
    r = spark.createDataFrame([(1.0,)], "t double").select(theory.rouse_middle_msd(t, 1.0, 100.0).alias("a"), special.middle_msd(t, 1.0, 1.0, 100.0).alias("b")).first()
    k = 3 * np.pi**2 / 100 * (2 * np.arange(1, 1001)) ** 2
    want = (12 / k * (1 - np.exp(-k / 100))).sum() + 0.06
    assert np.allclose([r.a, r.b], want, rtol=1e-9) and round(want, 3) == 1.944


def test_curves_of_every_window(spark):
    """Sizes of all thirds of the trajectories occur; for the largest, the curves of one size."""
    from dwellspark.jobs import registry

    sf = "/root/testdata/sf0.01"
    sizes = {r[0] for r in registry.obs(spark, sf).where("wait_type = 'interior'").select("window_size").distinct().collect()}
    assert len(sizes) > 1
    for name, alone in (("ecdf_windowed_by_size", "ecdf_windowed_single"), ("ecdf_simple_by_size", "ecdf_simple")):
        found = registry.QUERIES[name](spark, sf)
        assert {r[0] for r in found.select("window_size").distinct().collect()} == sizes
        one = registry.QUERIES[alone](spark, sf)
        assert sorted(found.where("window_size = 1728000").drop("window_size").collect()) == sorted(one.collect())


def test_runs(spark, tmp_path):
    rows = "t,bead,X1,is_loop\n0,1,1.5,1\n0,4,2.5,0\n0,9,x,1\n"
    for run in ("sim.0", "sim.1", "sim.2"):
        (tmp_path / run).mkdir()
        if run != "sim.2":
            (tmp_path / run / "beads.csv").write_text(rows)
    schema = "t double, bead int, X1 double, is_loop int"
    found = runs.read_runs(spark, str(tmp_path), "beads.csv", schema)
    linked = {(r.sim_name, r.bead): (r.X1, r.left_neighbor, r.right_neighbor) for r in runs.nearest_links(found, ["sim_name", "t"]).collect()}
    assert linked == {(s, b): v for s in ("sim.0", "sim.1") for b, v in ((1, (1.5, 1, 1)), (4, (2.5, 1, 9)), (9, (None, 9, 9)))}
    assert runs.read_runs(spark, str(tmp_path), "beads.csv", schema, bead=4).count() == 2
    runs.write_sorted(found, str(tmp_path / "out"), ["bead"], ["sim_name"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6 == runs.read_csv(spark, str(tmp_path / "sim.*/beads.csv"), schema).count()


def test_array_text(spark):
    texts = {"[1 2.5\n -3]": [1.0, 2.5, -3.0], "(1, 2)": [1.0, 2.0], "[]": [], "1 2": None, "[a]": None, None: None}
    df = spark.createDataFrame(list(enumerate(texts)), "i int, s string")
    assert [r.v for r in df.select("i", arrays.parsed(F.col("s")).alias("v")).orderBy("i").collect()] == list(texts.values())


def test_forms_and_stages(spark):
    wide = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0)], "traj int, t int, X1 double, Y1 double, Z1 double, X2 double, Y2 double, Z2 double")
    assert loci.pivoted(loci.pivoted(wide, ["traj", "t"]), ["traj", "t"]).select(*wide.columns).collect() == wide.collect()
    with pytest.raises(ValueError):
        loci.pivoted(wide.select("traj", "t"), ["traj", "t"])
    stages = spark.createDataFrame([("ta",), ("t0",), ("t5",), ("t",), (None,)], "s string").select(loci.stage_number(F.col("s")).alias("n"))
    assert [r.n for r in stages.collect()] == [-1, 0, 5, None, None]


def test_running_sums_in_ranges(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 5003).cast("double").alias("x"), F.lit(1).alias("one"))
    for after in (False, True):
        found = dist.running(df, ["k"], "x", {"n": F.col("one")}, after=after, total=True).collect()
        for k in range(3):
            own = sorted((r for r in found if r.k == k), key=lambda r: -r.x if after else r.x)
            assert [r.n for r in own] == list(range(1, len(own) + 1)) and {r.n_total for r in own} == {len(own)}


def test_exterior_estimate_by_hand(spark):
    """Counts of 3 and 1 in bins of width 2 and a mean wait of 4; a null wait and one beyond the bins don't count, nor does a state without a fit."""
    rows = [("a", 0.5), ("a", 1.0), ("a", 1.5), ("a", 4.0), ("a", 9.0), ("a", None), ("b", 1.0)]
    outer = spark.createDataFrame(rows, "state string, wait_time double")
    fit = spark.createDataFrame([("a", 0.25, -0.2, 0.8)], "state string, a double, b double, end_share double")
    found = {r.x: (r.cdf, r.low, r.high) for r in dist.exterior_estimate(outer, ["state"], fit, (0.0, 4.0, 2)).collect()}
    assert found == {1.0: pytest.approx((-0.5, -0.5 - math.sqrt(3), -0.5 + math.sqrt(3))), 3.0: pytest.approx((0.5, -0.5, 1.5))}
    flat = fit.withColumn("a", F.lit(0.0))
    assert {r.cdf for r in dist.exterior_estimate(outer, ["state"], flat, (0.0, 4.0, 2)).collect()} == {None}
    assert dist.exterior_estimate(outer.limit(0), ["state"], fit, (0.0, 4.0, 2)).count() == 0


def test_interior_density_by_hand(spark):
    """Waits of 1 and 3 in a window of 5 weigh 1/4 and 1/2; one as long as its window has no weight."""
    seen = spark.createDataFrame([(1, "a", 1.0, 5.0), (1, "a", 3.0, 5.0), (1, "a", 5.0, 5.0)], "traj long, state string, wait_time double, window_size double")
    fit = spark.createDataFrame([("a", 0.25, -0.2, 0.8)], "state string, a double, b double, end_share double")
    found = {r.x: r.pdf for r in dist.interior_density(seen, ["state"], seen, ["traj"], fit, 0.0, 4.0, 2).collect()}
    assert found == {1.0: pytest.approx(0.8 / 6), 3.0: pytest.approx(0.8 / 3)}
    assert dist.interior_density(seen.limit(0), ["state"], seen, ["traj"], fit, 0.0, 4.0, 2).count() == 0
