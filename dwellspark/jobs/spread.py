"""Queries whose work on one trajectory or label is spread over tasks, and fits of curves by label."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.jobs.intervals import BINS, STEP
from dwellspark.jobs.registry import CVV, EXTERIOR, FIT, INTERIOR, KEY, MULTI, ORACLES, PAIRS, obs, obs_once, query, r, rounded, uniform_sql
from dwellspark.jobs.registry import _velocities as velocities
from dwellspark.jobs.summaries import MUNGED, Z95
from dwellspark.operators import distributions as dist
from dwellspark.operators import bootstrap, curves, estimates, fits, frames, geometry, lags, least_squares, loci, long, moments, waits
from dwellspark.operators.scratch import shared_folder
from dwellspark.sources import cache, runs, tables
from dwellspark.sources.tables import MOVIE, SIM, TRACK

NEAR = 4


@query(ORACLES["movie_to_waits"])
def movie_to_waits_long(spark, sf_dir):
    """movie_to_waits along ranges of time."""
    return rounded(long.waits_of_long_movie(tables.movie(spark, sf_dir), KEY), 3)


@query(f"WITH {MOVIE} SELECT traj, {r('t', digits=3)}, state, island::BIGINT AS rank_order FROM numbered")
def frame_runs(spark, sf_dir):
    """The number of each frame's run of equal states."""
    return rounded(long.numbered_waits(tables.movie(spark, sf_dir), KEY).select("traj", "t", "state", "rank_order"), 3)


@query(ORACLES["asof_movie"])
def asof_movie_long(spark, sf_dir):
    """asof_movie along ranges of time."""
    changes = tables.state_changes(spark, sf_dir)
    return rounded(long.as_of_long(changes, frames.frame_grid(changes, KEY, 43_200.0, 41), KEY), 3)


@query(f"WITH {PAIRS} SELECT traj, ti, delta, tf, {r('vx', 'vy')} FROM pairs WHERE delta < {NEAR}")
def lag_pairs_near(spark, sf_dir):
    """Pairs of frames of a bounded lag, which meet in tiles of time."""
    return rounded(lags.lag_pairs(tables.track(spark, sf_dir), KEY, coords=("x", "y"), max_delta=NEAR))


@query(f"WITH {TRACK}, p AS (SELECT b.t - a.t AS t, a.x * b.x AS xx FROM track a JOIN track b ON a.traj = b.traj AND b.t >= a.t AND b.t - a.t < {NEAR}) SELECT t, {r('avg(xx) AS mean', 'stddev_samp(xx) AS std', digits=3)}, count(*) AS count FROM p GROUP BY t")
def autocorr_near(spark, sf_dir):
    return rounded(lags.autocorrelation(tables.track(spark, sf_dir), KEY, max_dt=NEAR), 3)


START, LOW, HIGH, STEPS = (1.0, 100.0), (0.1, 1.0), (100_000.0, 173.0), 40


@query(f"""WITH RECURSIVE {PAIRS}, msds AS (SELECT condition AS label, delta::DOUBLE AS x, avg(vx * vx) AS y FROM pairs WHERE delta > 0 GROUP BY ALL),
curve AS (SELECT label, x, y FROM msds WHERE x BETWEEN 1 AND length(label) + 3),
{least_squares.fit_sql('curve', START, LOW, HIGH, STEPS)}
SELECT label, {r('p1 AS amplitude', 'p2 AS relaxed', 'sqrt(j22 * rest / (points - 2) / det) / p1 AS amplitude_ste', 'rest / points / p1 / p1 AS rest', digits=4)}, points FROM fitted""")
def msd_fits(spark, sf_dir):
    """Amplitude and relaxation time of two loci, fitted to each condition's displacements over the lags that a table of bounds lets in; both
    are held between bounds."""
    pairs = lags.lag_pairs(tables.track(spark, sf_dir), KEY).where("delta > 0")
    named = tables.track(spark, sf_dir).select("traj", F.col("t").alias("ti"), F.col("condition").alias("label"))
    msds = pairs.join(named, ["traj", "ti"]).groupBy("label", F.col("delta").cast("double").alias("x")).agg(F.avg(F.col("vx") * F.col("vx")).alias("y"))
    bounds = named.select("label").distinct().select("label", F.lit(1.0).alias("x_from"), (F.length("label") + 3.0).alias("x_to"))
    found = least_squares.fit(msds, ["label"], "x", "y", least_squares.SEPARATION, START, LOW, HIGH, bounds, STEPS)
    error, scale = F.sqrt("p1_var") / F.col("p1"), F.col("points") * F.col("p1") * F.col("p1")
    return rounded(found.select("label", F.col("p1").alias("amplitude"), F.col("p2").alias("relaxed"), error.alias("amplitude_ste"), (F.col("rest") / scale).alias("rest"), "points"), 4)


@query()
def fit_two_loci_exponents(spark, sf_dir):
    """Amplitude and relaxation time of two linked loci at three exponents of the medium, fitted to each lag's curve."""
    curves = lags.correlation_curves(lags.correlation_sums(velocities(spark, sf_dir), []), []).withColumn("lag", F.col("delta"))
    out = None
    for exponent in (0.3, 0.4, 0.5):
        found = fits.fit_two_loci(curves, ["delta"], delta="lag", exponent=exponent).withColumn("exponent", F.lit(exponent))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"WITH {TRACK}, p AS (SELECT b.t - a.t AS t, a.x * b.x AS xx FROM track a JOIN track b ON a.traj = b.traj AND b.t >= a.t) SELECT t, {r('avg(xx) / 1000 AS mean', 'stddev_samp(xx) / 1000 AS std')}, count(*) AS count FROM p GROUP BY t")
def autocorr_fft(spark, sf_dir):
    """autocorr by Fourier transforms: no pair is made."""
    found = lags.autocorrelation_by_transform(tables.track(spark, sf_dir), KEY)
    return rounded(found.withColumns({"mean": F.col("mean") / 1000, "std": F.when(F.col("count") > 1, F.col("std") / 1000)}))


@query(f"WITH {CVV} SELECT delta, t, {r('sqs / cnt / 1e9 AS sqs', 'sum / cnt / 1e3 AS sum')}, cnt FROM sums")
def cvv_stats_fft(spark, sf_dir):
    """cvv_stats by Fourier transforms, as means of a product and its square."""
    pairs = lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1, 2, 4], coords=("x", "y")).withColumn("delta", F.col("delta").cast("long"))
    found = lags.correlation_sums_by_transform(pairs, KEY, ("x", "y"))
    return rounded(found.select("delta", "t", (F.col("sqs") / F.col("cnt") / 1e9).alias("sqs"), (F.col("sum") / F.col("cnt") / 1e3).alias("sum"), "cnt"))


@query(f"""WITH {SIM}, {INTERIOR}, v AS (SELECT state, wait_time / 86400 AS x FROM inner_waits), m AS (SELECT state, count(*)::DOUBLE AS s, sum(x) / count(*) AS m, sum(x * x) / count(*) AS q, min(x) AS low FROM v GROUP BY state),
h AS (SELECT state, s, low, s ** -0.2 * sqrt((q - m * m) / nullif(1 - 1 / s, 0)) AS h FROM m), a AS (SELECT state, (x - low) / (h / {curves.NODES}) AS p FROM v JOIN h USING (state) WHERE h > 0),
e AS (SELECT state, floor(p) + i AS k, CASE i WHEN 0 THEN 1 - (p - floor(p)) ELSE p - floor(p) END AS w FROM a, (SELECT unnest([0, 1]) AS i)), n AS (SELECT state, k, sum(w) AS w FROM e GROUP BY state, k),
p AS (SELECT unnest(range(-{curves.NODES * curves.REACH}, {curves.NODES * curves.REACH + 1})) AS j), d AS (SELECT state, k + j AS k, sum(w * exp(-0.5 * (j / {curves.NODES}) ** 2) / sqrt(2 * pi())) AS d FROM n, p GROUP BY ALL)
SELECT state, {r(f'low + k * (h / {curves.NODES}) AS x', 'd / s / h AS density')} FROM d JOIN h USING (state)""")
def wait_density_binned(spark, sf_dir):
    """The density of waits seen whole, in days, at nodes a sixteenth of a bandwidth apart."""
    days = waits.interior(obs(spark, sf_dir)).select("state", (F.col("wait_time") / 86_400).alias("x"))
    return rounded(curves.binned_density(days, ["state"], "x"))


DRAWS = 20


@query(f"""WITH {SIM}, ids AS (SELECT traj, row_number() OVER (ORDER BY traj) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT traj FROM obs)),
d AS (SELECT b AS boot_id, least(floor({uniform_sql(5, 'b', 'n')} * total)::BIGINT + 1, total) AS n FROM ids, range({DRAWS}) r(b)),
t AS (SELECT boot_id, traj, count(*) AS times FROM d JOIN ids USING (n) GROUP BY ALL), z AS (SELECT boot_id, traj, max(window_size) AS x, max(times) AS times FROM obs JOIN t USING (traj) GROUP BY ALL),
w AS (SELECT boot_id, state, wait_time, window_size, times, ceil(wait_time / {STEP})::BIGINT AS bin FROM obs JOIN t USING (traj) WHERE wait_type = 'interior' AND window_size > wait_time),
u AS (SELECT DISTINCT boot_id, wait_time FROM w), s AS (SELECT u.boot_id, wait_time, sum(times) FILTER (z.x >= wait_time) / sum(times) AS sf FROM u JOIN z ON u.boot_id = z.boot_id GROUP BY ALL),
k AS (SELECT state, boot_id, bin, sum(times / (window_size - wait_time) / nullif(sf, 0)) AS k FROM w JOIN s USING (boot_id, wait_time) WHERE bin BETWEEN 1 AND {BINS} GROUP BY ALL)
SELECT state, boot_id::INT AS boot_id, bin, {r('k / sum(k) OVER (PARTITION BY state, boot_id) AS pmf')} FROM k""")
def boot_windows(spark, sf_dir):
    """The corrected share of waits in each half day where as many trajectories are drawn as there are, and each replicate corrects for the windows that it drew."""
    drawn = bootstrap.drawn(obs_once(spark, sf_dir), KEY, DRAWS, 5)
    inner = waits.interior(drawn).withColumn("bin", F.ceil(F.col("wait_time") / STEP)).where(F.col("bin").between(1, BINS))
    return rounded(bootstrap.windowed_shares(inner, drawn, ["state"], KEY))


@query()
def displacement_shapiro(spark, sf_dir):
    """Shapiro's and Wilk's test of displacements, by lag."""
    pairs = lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1, 2, 4])
    return rounded(moments.shapiro_wilk(pairs.select(F.col("delta").cast("long").alias("delta"), "vx"), ["delta"], "vx"))


@query(ORACLES["munge_flat"])
def munge_flat_cached(spark, sf_dir):
    """munge_flat, kept in the shared folder until its table of orders changes."""
    orders = tables.table(spark, sf_dir, "orders")
    made = lambda: loci.flat_table(tables.two_loci(spark, sf_dir), KEY)
    return rounded(cache.derived(spark, shared_folder(spark), "flat", [orders], made, "munge_flat 1"))


@query(f"""WITH {MUNGED}, named AS (SELECT m.*, o_orderpriority AS sim_name FROM munged m JOIN (SELECT o_custkey AS traj, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, o_orderpriority FROM orders) USING (traj, t)),
params AS (SELECT sim_name, count(*)::DOUBLE AS frames, length(sim_name)::DOUBLE AS fp FROM named GROUP BY sim_name)
SELECT sim_name, traj, t, {r('dX', 'dY', 'dZ', digits=3)}, frames, fp FROM named JOIN params USING (sim_name) WHERE fp >= 6""")
def runs_with_params(spark, sf_dir):
    """Runs written to folders of their own, each with its parameters, and those read whose parameters meet a condition."""
    flat = loci.flat_table(tables.two_loci(spark, sf_dir), KEY).select("traj", "t", "dX", "dY", "dZ")
    named = flat.join(tables.track(spark, sf_dir).select("traj", "t", F.col("condition").alias("sim_name")), ["traj", "t"])
    counts = named.groupBy("sim_name").agg(F.count(F.lit(1)).alias("frames"))
    entries = F.array(F.struct(F.lit("frames").alias("key"), F.col("frames").cast("string").alias("value")), F.struct(F.lit("fp").alias("key"), F.length("sim_name").cast("string").alias("value")))
    folder = runs.claimed(spark, shared_folder(spark))
    runs.write_runs(named, counts.select("sim_name", F.explode(entries).alias("e")).select("sim_name", "e.*"), folder)
    found = runs.read_runs_with(spark, folder, "traj long, t long, dX double, dY double, dZ double", ["frames", "fp"], "fp >= 6")
    return found.select("sim_name", "traj", "t", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("dX", "dY", "dZ")), "frames", "fp")


@query(ORACLES["convex_hull_area"].replace("FROM track WHERE x IS NOT NULL", "FROM track WHERE t <= 9 AND t % 3 <> 1 AND x IS NOT NULL"))
def convex_hull_until(spark, sf_dir):
    """The hull of two of three frames up to the ninth."""
    track = tables.track(spark, sf_dir)
    allowed = track.select("t").distinct().where("t % 3 <> 1")
    return rounded(geometry.hull_area(geometry.at_times(track, "t", allowed, 9), KEY))


OWN = f"""{MOVIE}, sim AS (SELECT traj, state, first_t AS start_time, coalesce(lead(first_t) OVER (PARTITION BY traj ORDER BY island), last_t) AS end_time, min(first_t) OVER (PARTITION BY traj) AS window_start,
  max(last_t) OVER (PARTITION BY traj) AS window_end FROM runs), {SIM[SIM.index("clipped AS"):]}"""


def own_windows(spark, sf_dir):
    """Waits of the movie's runs, each trajectory being watched from its first frame to its last."""
    return waits.waits_in_own_windows(tables.movie(spark, sf_dir), KEY)


@query(f"WITH {OWN} SELECT traj, rank_order, state, wait_type, num_waits, {r('start_time', 'end_time', 'wait_time', 'window_size', digits=3)} FROM obs")
def sim_to_obs_own(spark, sf_dir):
    """Waits in windows that are the data's own span."""
    found = own_windows(spark, sf_dir)
    return rounded(found.select("traj", "rank_order", "state", "wait_type", "num_waits", "start_time", "end_time", "wait_time", "window_size"), 3)


@query(f"WITH {OWN}, {INTERIOR}, {MULTI} SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)} FROM padded")
def ecdf_windowed_own(spark, sf_dir):
    """The distribution of waits, corrected for as many sizes of windows as there are trajectories."""
    curve = dist.ecdf_windowed_whole(own_windows(spark, sf_dir), ["state"])
    return curve.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("cdf", 9) + F.lit(0.0)).alias("cdf"))


@query(f"""WITH {SIM}, {FIT}, b AS (SELECT state, wait_time AS x, count(*) FILTER (wait_type = 'interior') AS d, count(*) AS n FROM obs GROUP BY state, wait_time), k AS (SELECT *, sum(n) OVER (PARTITION BY state ORDER BY x DESC) AS risk FROM b),
v AS (SELECT state, x, product(1 - d / risk) OVER w AS s, sum(CASE WHEN risk > d THEN d / (risk * (risk - d)) ELSE 0 END) OVER w AS v FROM k WINDOW w AS (PARTITION BY state ORDER BY x)),
c AS (SELECT state, x, 1 - s AS cdf, 1 - s ** exp({Z95} * sqrt(v) / ln(s) * -1) AS high, 1 - s ** exp({Z95} * sqrt(v) / ln(s)) AS low FROM v WHERE s > 1e-9 AND s < 1 - 1e-9),
z AS (SELECT state, max(cdf) AS top FROM c GROUP BY state), f AS (SELECT state, -b / nullif(a, 0) / nullif(top, 0) AS scale FROM z JOIN fit USING (state))
SELECT state, {r('x', digits=3)}, {r('cdf * scale AS cdf', 'low * scale AS low', 'high * scale AS high', digits=5)} FROM c JOIN f USING (state)""")
def kaplan_meier_rescaled(spark, sf_dir):
    """Kaplan and Meier's curve and its interval at the height that the fit gives the distribution at the window's end."""
    curves = estimates.points(obs_once(spark, sf_dir), ["state"], KEY)
    curve = estimates.kaplan_meier_bounds(curves, ["state"], Z95).where("cdf > 1e-9 AND cdf < 1 - 1e-9")
    scaled = dist.rescaled(curve, ["state"], estimates.summary(curves, ["state"]).select("state", F.col("end_share").alias("height")), ("cdf", "low", "high"))
    return scaled.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("cdf", "low", "high")))


_COMBINED = ORACLES["ecdf_combined"].rpartition("\nSELECT ")[0]


@query(f"""{_COMBINED}, q AS (SELECT state, x, (i * iw + o * ow) / (iw + ow) AS cdf FROM e), n2 AS (SELECT state, x, lead(x) OVER w AS x_to, (lead(cdf) OVER w - cdf) / (lead(x) OVER w - x) AS pdf FROM q WINDOW w AS (PARTITION BY state ORDER BY x))
SELECT state, {r('x', 'x_to', digits=3)}, {r('pdf * 86400 AS pdf', digits=5)} FROM n2 WHERE x_to IS NOT NULL""")
def combined_pdf(spark, sf_dir):
    """The density between neighbouring points of the combined estimate, by day."""
    curves = estimates.points(obs_once(spark, sf_dir), ["state"], KEY)
    bars = estimates.bars_of_bins(estimates.combined(curves, estimates.summary(curves, ["state"]), ["state"]), ["state"])
    return bars.select("state", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("x", "x_to")), (F.round(F.col("pmf") * 86_400, 5) + F.lit(0.0)).alias("pdf"))


@query(f"""WITH {CVV}, c AS (SELECT delta, t, sum / cnt AS cvv, sqrt(greatest(sqs / cnt - (sum / cnt) * (sum / cnt), 0)) / sqrt(cnt) AS ste FROM sums),
z AS (SELECT *, max(CASE WHEN t = 0 THEN cvv END) OVER (PARTITION BY delta) AS zero FROM c)
SELECT delta, t, {r('t / delta AS scaled_t', 'cvv / zero / 2 AS scaled', 'ste / zero / 2 AS scaled_ste', 'delta ** 1.5 * cvv / zero / 2 AS moved')} FROM z WHERE delta IN (2, 4) AND t <= 3 * delta""")
def cvv_rescaled(spark, sf_dir):
    """Correlation curves of two lags over an amplitude, on scaled axes."""
    curves_of = lags.correlation_curves(lags.correlation_sums(velocities(spark, sf_dir), []), [])
    return rounded(lags.rescaled_curves(curves_of, [2, 4], 3.0, 0.5, 2.0).select("delta", "t", "scaled_t", "scaled", "scaled_ste", "moved"))
