"""Queries of bootstraps, bounds, tests, hulls in space, frames at any times and two-locus theory."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.functions import special
from dwellspark.jobs.registry import EXTERIOR, GRID, INTERIOR, KEY, MOVIE_WAITS, PAIRS, _velocities, obs, obs_once, poisson_sql, query, r, rounded, uniform_sql
from dwellspark.jobs.summaries import EDGES, FITS, INNER_CURVE, _fits
from dwellspark.operators import bands, bootstrap, fits, frames, geometry, lags, moments, waits
from dwellspark.operators import distributions as dist
from dwellspark.sources import tables
from dwellspark.sources.tables import SIM

BOOTS = 20
STEP = 43_200
BINS = len(GRID) - 1
SIZED = ["state", "window_size"]
BOOT_PMF = f"""{SIM}, {INTERIOR}, w AS (SELECT traj, rank_order, state, window_size, ceil(wait_time / {STEP})::BIGINT AS bin, 1 / (window_size - wait_time) AS w FROM inner_waits WHERE window_size > wait_time),
d AS (SELECT w.*, b AS boot_id, {uniform_sql(1, 'b', 'traj', 'rank_order')} AS u FROM w, range({BOOTS}) r(b)), e AS (SELECT *, {poisson_sql('u')} AS times FROM d),
k AS (SELECT state, window_size, boot_id, bin, sum(w * times) AS k FROM e WHERE times > 0 AND bin BETWEEN 1 AND {BINS} GROUP BY ALL),
p AS (SELECT state, window_size, boot_id, bin, k / sum(k) OVER (PARTITION BY state, window_size, boot_id) AS pmf FROM k)"""


def _boot_pmf(spark, sf_dir):
    inner = waits.interior(obs(spark, sf_dir)).where("window_size > wait_time")
    rows = inner.select("traj", "rank_order", *SIZED, F.ceil(F.col("wait_time") / STEP).alias("bin"), (1 / (F.col("window_size") - F.col("wait_time"))).alias("w")).where(F.col("bin").between(1, BINS))
    drawn = bootstrap.resampled(rows, ["traj", "rank_order"], BOOTS, 1)
    return bootstrap.shares(drawn.groupBy(*SIZED, "boot_id", "bin").agg(F.sum(F.col("w") * F.col("times")).alias("k")), SIZED, "k")


@query(f"WITH {BOOT_PMF} SELECT state, window_size, boot_id::INT AS boot_id, bin, {r('pmf', f'pmf / {STEP} * 86400 AS density')} FROM p")
def boot_pmf(spark, sf_dir):
    """The corrected share of waits in each half day, waits being drawn anew: bars of each replicate."""
    return rounded(_boot_pmf(spark, sf_dir).withColumn("density", F.col("pmf") / STEP * 86_400))


@query(f"""WITH {BOOT_PMF}, g AS (SELECT DISTINCT state, window_size, bin, boot_id FROM (SELECT DISTINCT state, window_size FROM p), range(1, {BINS + 1}) x(bin), range({BOOTS}) y(boot_id)),
f AS (SELECT g.*, coalesce(pmf, 0) AS pmf FROM g LEFT JOIN p USING (state, window_size, bin, boot_id))
SELECT state, window_size, bin, {r(f'quantile_cont(pmf, {0.05 / BINS}) AS low', f'quantile_cont(pmf, {1 - 0.05 / BINS}) AS high')} FROM f GROUP BY state, window_size, bin""")
def boot_pmf_bounds(spark, sf_dir):
    """Pointwise bounds of boot_pmf, at a level divided by the number of bins."""
    return rounded(bootstrap.share_bounds(_boot_pmf(spark, sf_dir), SIZED, BINS, BOOTS, 0.05))


@query(f"""WITH {SIM}, {EXTERIOR}, g AS (SELECT unnest(range({BINS + 1})) * {STEP}.0::DOUBLE AS x), c AS (SELECT state, x, count(*) FILTER (wait_time <= x) / count(*) AS cdf, count(*) AS n FROM outer_waits, g GROUP BY state, x),
l AS (SELECT state, list(cdf ORDER BY cdf) AS c, max(n) AS n FROM c GROUP BY state), i AS (SELECT state, c, b AS boot_id, {uniform_sql(2, 'b', 'state', 'i')} AS u FROM (SELECT l.*, unnest(range(1, n + 1)) AS i FROM l), range({BOOTS}) r(b)),
k AS (SELECT state, boot_id, len(list_filter(c, lambda v: v < u)) AS bin, count(*) AS k FROM i GROUP BY ALL), p AS (SELECT * FROM k WHERE bin BETWEEN 1 AND {BINS})
SELECT state, boot_id::INT AS boot_id, bin::BIGINT AS bin, {r('k / sum(k) OVER (PARTITION BY state, boot_id) AS pmf')} FROM p""")
def cdf_draws(spark, sf_dir):
    """As many numbers as a state has waits that are cut off, drawn from their distribution on a grid, in replicates."""
    outer = waits.exterior(obs(spark, sf_dir))
    curve = dist.ecdf_on(outer, ["state"], "wait_time", GRID).join(outer.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state")
    return rounded(bootstrap.drawn_shares(curve, ["state"], "n", BOOTS, 2))


MIX = {0: 0.3, 1: 0.7}


@query(f"""WITH {MOVIE_WAITS}, s AS (SELECT traj, traj % 2 AS c, state, sum(wait_time) AS s, count(*) AS n FROM waits WHERE wait_type = 'interior' GROUP BY traj, state), z AS (SELECT c, count(DISTINCT traj) AS n, CASE c WHEN 0 THEN {MIX[0]}::DOUBLE ELSE {MIX[1]}::DOUBLE END AS share FROM s GROUP BY c),
m AS (SELECT c, (SELECT min(n / share) FROM z) * share / n AS mean FROM z), d AS (SELECT s.*, mean, b AS boot_id, {uniform_sql(3, 'b', 'traj')} AS u FROM s JOIN m USING (c), range(10) r(b)), e AS (SELECT *, {poisson_sql('u', 'mean')} AS times FROM d)
SELECT state, boot_id::INT AS boot_id, {r('sum(s * times) / sum(n * times) AS mean', digits=3)}, sum(n * times)::BIGINT AS n FROM e WHERE times > 0 GROUP BY state, boot_id""")
def mixed_conditions(spark, sf_dir):
    """Mean waits of a mixture of two conditions, three trajectories in ten being of the first."""
    inner = waits.interior(waits.waits_of_movie(tables.movie(spark, sf_dir), KEY))
    rows = inner.groupBy("traj", (F.col("traj") % 2).cast("int").alias("condition"), "state").agg(F.sum("wait_time").alias("s"), F.count(F.lit(1)).alias("n"))
    mixed = bootstrap.mixture(rows, KEY, "condition", MIX, 10, 3)
    found = mixed.groupBy("state", "boot_id").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("mean"), F.sum(F.col("n") * F.col("times")).alias("n"))
    return rounded(found, 3)


UNEVEN = [300.0 * i * i for i in range(76)]


def _before(x: str) -> str:
    return f"len(list_filter(g, lambda v: v < {x}))"


@query(f"""WITH {SIM}, o AS (SELECT *, {UNEVEN}::DOUBLE[] AS g, max(end_time) OVER (PARTITION BY traj) AS over FROM sim), i AS (SELECT traj, state, start_time, g, {_before('start_time')} AS i, least({_before('over')} - 1, {len(UNEVEN) - 1}) AS last FROM o),
f AS (SELECT *, min(i) OVER (PARTITION BY traj) AS first FROM i), s AS (SELECT traj, i, first, last, any_value(g) AS g, arg_max(state, start_time) AS state FROM f WHERE i <= last GROUP BY traj, i, first, last),
d AS (SELECT *, lag(state) OVER (PARTITION BY traj ORDER BY i) AS before FROM s), n AS (SELECT * FROM d WHERE before IS DISTINCT FROM state), e AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY traj ORDER BY i), last) AS next FROM n)
SELECT traj, state, g[i + 1] AS start_time, g[next + 1] AS end_time, g[first + 1] AS window_start, g[last + 1] AS window_end FROM e""")
def frame_times_uneven(spark, sf_dir):
    """State changes as frames that grow rarer would show them."""
    return frames.quantised_on(tables.state_changes(spark, sf_dir), KEY, UNEVEN)


SHARES = [i / 20 for i in range(1, 20)]


@query(f"""WITH {INNER_CURVE}, g AS (SELECT DISTINCT state, unnest({SHARES}::DOUBLE[]) AS p FROM curve), a AS (SELECT g.state, g.p, c.cdf AS p0, c.x AS x0 FROM g ASOF LEFT JOIN curve c ON g.state = c.state AND g.p >= c.cdf),
b AS (SELECT a.*, c.cdf AS p1, c.x AS x1 FROM a ASOF LEFT JOIN curve c ON a.state = c.state AND a.p <= c.cdf)
SELECT state, {r('p AS share')}, {r('CASE WHEN p0 = p THEN x0 ELSE coalesce(x0 + (x1 - x0) * (p - p0) / (p1 - p0), x0, x1) END AS wait_time', digits=3)} FROM b""")
def inverse_lookup(spark, sf_dir):
    """Where a curve has a given height, on straight lines between its points, flat beyond them: curve and heights change places."""
    inner = waits.interior(obs_once(spark, sf_dir))
    curve = dist.ecdf(inner, ["state"], "wait_time").select("state", F.col("cdf").alias("x"), F.col("x").alias("wait_time"))
    at = inner.select("state").distinct().withColumn("x", F.explode(F.array(*(F.lit(s) for s in SHARES))))
    found = dist.interpolated(curve, at, ["state"], "wait_time")
    return rounded(found.select("state", F.col("x").alias("share"), "wait_time"), 3)


@query(f"""WITH {PAIRS}, {FITS}, q AS (SELECT traj, n - 2 AS dof, abs(slope / nullif(sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx), 0)) / sqrt(n - 2) AS x FROM f),
k AS (SELECT q.*, unnest(range(greatest((dof - dof % 2) // 2, 1))) AS k FROM q), s AS (SELECT traj, dof, x, sum(CASE WHEN dof % 2 = 1 THEN exp(lgamma(1.5) + lgamma(k + 1) - lgamma(k + 1.5)) ELSE exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) END / (1 + x * x) ** k) AS total FROM k GROUP BY traj, dof, x)
SELECT traj, {r('greatest(1 - CASE WHEN dof % 2 = 1 THEN 2 / pi() * (atan(x) + CASE WHEN dof > 1 THEN x / (1 + x * x) * total ELSE 0 END) ELSE x / sqrt(1 + x * x) * total END, 0) AS p', digits=5)} FROM s""")
def loglog_pvalues(spark, sf_dir):
    """The chance of exponents as far from 0 if there were none."""
    found = _fits(spark, sf_dir)
    return rounded(found.select("traj", moments.two_sided(F.try_divide("slope", "stderr"), F.col("n") - 2).alias("p")), 5)


@query()
def simultaneous_bounds(spark, sf_dir):
    """Bounds of the shares of waits between edges that hold for all bins of a state at once."""
    counts = dist.histogram_between(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time", EDGES)
    return rounded(bands.simultaneous_bounds(counts.drop("density"), ["state"]))


@query()
def convex_hull_volume(spark, sf_dir):
    """Volume and surface of the hull of each customer's first spot."""
    return rounded(geometry.hull_volume(tables.two_loci(spark, sf_dir), KEY, "X1", "Y1", "Z1"), 4)


@query()
def fit_two_loci(spark, sf_dir):
    """Amplitude and relaxation time of two linked loci, fitted to each lag's curve."""
    curves = lags.correlation_curves(lags.correlation_sums(_velocities(spark, sf_dir), []), [])
    return fits.fit_two_loci(curves.withColumn("lag", F.col("delta")), ["delta"], delta="lag")


@query()
def displacement_normality(spark, sf_dir):
    """How far displacements are from a normal, by lag."""
    pairs = lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1, 2, 4])
    return rounded(moments.normality(pairs.select(F.col("delta").cast("long").alias("delta"), "vx"), ["delta"], "vx"))


@query()
def rouse_velocity(spark, sf_dir):
    """Velocity correlation of a chain's middle bead, at the frames that occur."""
    times = tables.track(spark, sf_dir).select("t").distinct()
    return rounded(times.select("t", special.middle_velocity_correlation(F.col("t").cast("double"), 0.5, 1.0, 100.0).alias("cv")))
