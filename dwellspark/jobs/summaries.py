"""More queries: presets of displacements, errors and exponents of curves, counts, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.functions import theory
from dwellspark.jobs.registry import EXTERIOR, INTERIOR, KEY, LAGGED, MOVIE_WAITS, PADDED, PAIRS, SURVIVAL, WEIGHTED, _curve, ecdf_sql, obs, obs_once, query, r, rounded
from dwellspark.operators import curves, frames, lags, loci, moments, waits
from dwellspark.operators import distributions as dist
from dwellspark.operators.scratch import written
from dwellspark.sources import arrays, tables
from dwellspark.sources.tables import FLAT, SIM, TRACK

#: Ninety-five percent of a normal lie within so many deviations.
Z95 = 1.959963984540054
AXIS = 1.3333  # 10 * 0.13333
MUNGED = f"""{FLAT}, filled AS (SELECT traj, t, CASE WHEN X2 IS NULL THEN 'pair' ELSE 'unp' END AS foci, X1 * {AXIS}::DOUBLE AS X1, Y1 * {AXIS}::DOUBLE AS Y1, Z1 * 2.5::DOUBLE AS Z1,
  coalesce(X2, X1) * {AXIS}::DOUBLE AS X2, coalesce(Y2, Y1) * {AXIS}::DOUBLE AS Y2, coalesce(Z2, Z1) * 2.5::DOUBLE AS Z2 FROM flat),
marked AS (SELECT *, coalesce((foci <> lag(foci) OVER (PARTITION BY traj ORDER BY t))::INT, 0) AS change FROM filled),
munged AS (SELECT traj, t, foci, X1, Y1, Z1, X2, Y2, Z2, 0::BIGINT AS na_id, sum(change) OVER (PARTITION BY traj ORDER BY t)::BIGINT AS wait_id, X2 - X1 AS dX, Y2 - Y1 AS dY, Z2 - Z1 AS dZ FROM marked),
spots AS (SELECT traj, t, foci, na_id, wait_id, 1 AS spot, X1 AS X, Y1 AS Y, Z1 AS Z FROM munged UNION ALL SELECT traj, t, foci, na_id, wait_id, 2, X2, Y2, Z2 FROM munged)"""


@query(f"WITH {MUNGED} SELECT traj, t, foci, na_id, wait_id, {r('X1', 'Y1', 'Z1', 'X2', 'Y2', 'Z2', 'dX', 'dY', 'dZ')} FROM munged")
def munge_flat(spark, sf_dir):
    return rounded(loci.flat_table(tables.two_loci(spark, sf_dir), KEY))


@query(f"WITH {MUNGED} SELECT traj, t, foci, na_id, wait_id, spot, {r('X', 'Y', 'Z')} FROM spots")
def munge_long(spark, sf_dir):
    flat = loci.flat_table(tables.two_loci(spark, sf_dir), KEY).drop("dX", "dY", "dZ")
    return rounded(loci.pivoted(flat, ["traj", "t"]))


NEAR = 8


def _preset_sql(name: str) -> str:
    foci, form, spot, more = loci.PRESETS[name]
    where = " AND ".join([*([f"a.foci = '{foci}' AND b.foci = '{foci}'"] if foci else []), *([f"a.spot = {spot} AND b.spot = {spot}"] if spot else []), f"b.t - a.t < {NEAR}"])
    rows, d = ("munged", "d") if form == "flat" else ("spots", "")
    value = "sqrt(" + " + ".join(f"(b.{d}{x} - a.{d}{x}) * (b.{d}{x} - a.{d}{x})" for x in "XYZ") + ")"
    keys = " AND ".join(f"a.{k} = b.{k}" for k in ["traj", *more])
    return f"""SELECT preset, delta, {r('mean', 'std', 'ste', 'ste * sqrt(2.0 / (n - 1)) * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) AS ste_norm', digits=4)}, n AS count FROM (SELECT '{name}' AS preset, delta, avg(v) AS mean, stddev_samp(v) AS std,
      CASE WHEN count(*) > 1 THEN stddev_samp(v) / sqrt(count(*) - 1) END AS ste, count(*) AS n FROM (SELECT b.t - a.t AS delta, {value} AS v FROM {rows} a JOIN {rows} b ON {keys} AND b.t >= a.t WHERE {where}) GROUP BY delta HAVING count(*) > 1)"""


@query(f"WITH {MUNGED} " + " UNION ALL ".join(map(_preset_sql, loci.PRESETS)))
def msd_presets(spark, sf_dir):
    """Displacements of each preset by lag below NEAR, with the corrected error; lags of a single pair have none."""
    flat = loci.flat_table(tables.two_loci(spark, sf_dir), KEY)
    out = None
    for name in loci.PRESETS:
        rows, more, coords = loci.preset(flat, name)
        pairs = lags.lag_pairs(rows, [*KEY, *more], coords=coords, max_delta=NEAR)
        found = lags.with_normed_error(lags.displacement_moments(pairs, [], coords, 1)).where("count > 1").withColumn("preset", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return rounded(out.select("preset", "delta", "mean", "std", "ste", "ste_norm", "count"), 4)


@query(f"WITH {SIM} SELECT traj, state, rank_order, {r('wait_time', digits=3)} FROM obs WHERE rank_order > 1 AND rank_order < num_waits")
def interior_by_rank(spark, sf_dir):
    """Waits that are neither the first nor the last of their trajectory, by their rank alone."""
    return rounded(obs(spark, sf_dir).where("rank_order > 1 AND rank_order < num_waits").select("traj", "state", "rank_order", "wait_time"), 3)


STAGE = "CASE WHEN o_orderkey % 6 = 0 THEN 'ta' ELSE 't' || (o_orderkey % 6 - 1) END"


@query(f"SELECT o_orderkey AS id, CASE WHEN s = 'ta' THEN -1 ELSE substr(s, 2)::INT END AS stage FROM (SELECT o_orderkey, {STAGE} AS s FROM orders)")
def stage_number(spark, sf_dir):
    staged = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr(STAGE).alias("s"))
    return staged.select("id", loci.stage_number(F.col("s")).alias("stage"))


@query(f"WITH {TRACK} SELECT condition, count(DISTINCT traj) AS n_traj, count(DISTINCT t) AS n_frames, array_to_string(list_sort(list(DISTINCT t)), ' ') AS frames FROM track GROUP BY condition")
def distinct_counts(spark, sf_dir):
    """Distinct trajectories and frames of a condition; the list is bounded by the frames of a trajectory."""
    distinct = F.array_sort(F.collect_set("t"))
    return tables.track(spark, sf_dir).groupBy("condition").agg(F.count_distinct("traj").alias("n_traj"), F.count_distinct("t").alias("n_frames"), F.array_join(distinct.cast("array<string>"), " ").alias("frames"))


@query(f"""WITH {TRACK}, m AS (SELECT condition, delta, avg(mean) AS mean FROM (SELECT a.condition, b.t - a.t AS delta, (b.x - a.x) ** 2 AS mean FROM track a JOIN track b ON a.traj = b.traj AND b.t - a.t BETWEEN 1 AND 4) GROUP BY ALL),
n AS (SELECT condition, count(DISTINCT traj) AS cells FROM track GROUP BY condition) SELECT condition, delta, {r('mean / z.zero AS relative', 'mean / sqrt(cells) AS error')}, cells FROM m JOIN n USING (condition) JOIN (SELECT delta, mean AS zero FROM m WHERE condition = '1-URGENT') z USING (delta)""")
def relative_curves(spark, sf_dir):
    """A table of curves looked up in others: counts of cells by condition, and one condition's curve by lag."""
    track = tables.track(spark, sf_dir)
    start = track.select("traj", F.col("t").alias("ti"), "condition")
    pairs = lags.lag_pairs_at(track, KEY, [1, 2, 3, 4]).join(start, ["traj", "ti"])
    curve = pairs.groupBy("condition", F.col("delta").cast("long").alias("delta")).agg(F.avg(F.col("vx") * F.col("vx")).alias("mean"))
    cells = track.groupBy("condition").agg(F.count_distinct("traj").alias("cells"))
    zero = curve.where("condition = '1-URGENT'").select("delta", F.col("mean").alias("zero"))
    found = curve.join(cells, "condition").join(zero, "delta")
    return rounded(found.select("condition", "delta", F.try_divide("mean", "zero").alias("relative"), F.try_divide(F.col("mean"), F.sqrt("cells")).alias("error"), "cells"))


@query(f"WITH {FLAT}, v AS (SELECT traj, (max(X1) - min(X1)) * (max(Y1) - min(Y1)) * (max(Z1) - min(Z1)) AS volume FROM flat GROUP BY traj) SELECT traj, {r('cbrt(3 * volume / (4 * pi())) AS radius')} FROM v")
def volume_radius(spark, sf_dir):
    """The radius of the ball of the volume of each trajectory's box."""
    side = lambda c: F.max(c) - F.min(c)
    volume = tables.two_loci(spark, sf_dir).groupBy("traj").agg((side("X1") * side("Y1") * side("Z1")).alias("volume"))
    return rounded(volume.select("traj", F.cbrt(3 * F.col("volume") / (4 * F.pi())).alias("radius")))


FITS = """m AS (SELECT traj, delta, avg(vx * vx) AS mean FROM pairs WHERE delta > 0 GROUP BY traj, delta), l AS (SELECT traj, ln(delta) AS lx, ln(mean) AS ly FROM m WHERE mean > 0),
f AS (SELECT traj, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept, corr(ly, lx) AS r, regr_count(ly, lx) AS n, regr_sxx(ly, lx) AS sxx, regr_syy(ly, lx) AS syy FROM l GROUP BY traj HAVING count(*) >= 3)"""


def _fits(spark, sf_dir):
    pairs = lags.lag_pairs(tables.track(spark, sf_dir), KEY).where("delta > 0")
    return moments.loglog_fit(lags.displacement_moments(pairs, KEY, ("x",), 2), KEY).where("n >= 3")


@query(f"WITH {PAIRS}, {FITS} SELECT traj, {r('slope', 'intercept', 'r', 'sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx) AS stderr', digits=5)}, n FROM f")
def loglog_errors(spark, sf_dir):
    return rounded(_fits(spark, sf_dir).select("traj", "slope", "intercept", "r", "stderr", "n"), 5)


@query(f"WITH {PAIRS}, {FITS}, d AS (SELECT traj % 5 AS condition, slope, exp(intercept) AS d FROM f) SELECT condition, {', '.join(r(f'avg({c}) AS {c}_mean', f'stddev_samp({c}) AS {c}_std', f'CASE WHEN count({c}) > 1 THEN stddev_samp({c}) / sqrt(count({c}) - 1) END AS {c}_ste', digits=3) for c in ('slope', 'd'))}, count(*) AS count FROM d GROUP BY condition")
def fit_summary(spark, sf_dir):
    """Exponents and coefficients of trajectories by condition."""
    fits = _fits(spark, sf_dir).select((F.col("traj") % 5).alias("condition"), "slope", F.exp("intercept").alias("d"))
    return rounded(curves.summary(fits, ["condition"], ["slope", "d"]), 3)


@query(f"WITH {PAIRS}, {FITS} SELECT traj, {r('exp(slope * ln(5) + intercept) AS value', digits=3)} FROM f")
def power_law_at(spark, sf_dir):
    return rounded(curves.power_law_at(_fits(spark, sf_dir), F.lit(5.0)).select("traj", "value"), 3)


@query(f"""WITH {PAIRS}, c AS (SELECT condition, delta, avg(vx * vx) AS mean, stddev_samp(vx * vx) / sqrt(count(*)) AS ste FROM pairs WHERE delta BETWEEN 3 AND 8 GROUP BY condition, delta)
SELECT condition, {r('sum(mean / (ste * ste)) / sum(1 / (ste * ste)) AS level', digits=3)} FROM c WHERE ste > 0 GROUP BY condition""")
def weighted_plateau(spark, sf_dir):
    track = tables.track(spark, sf_dir)
    pairs = lags.lag_pairs(track, KEY, max_delta=9).where("delta >= 3").join(track.select("traj", F.col("t").alias("ti"), "condition"), ["traj", "ti"])
    return rounded(curves.weighted_level(lags.displacement_moments(pairs, ["condition"]), ["condition"], 3), 3)


INNER_CURVE = f"{SIM}, {INTERIOR}, {ecdf_sql('inner_waits', 'wait_time')}"


def _inner_curve(spark, sf_dir):
    return dist.ecdf(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time")


@query(f"WITH {INNER_CURVE}, n AS (SELECT state, count(*) AS n FROM inner_waits GROUP BY state) SELECT state, {r('x', digits=3)}, {r(f'greatest(cdf - {Z95} * sqrt(greatest(cdf * (1 - cdf), 0) / n), 0) AS low', f'least(cdf + {Z95} * sqrt(greatest(cdf * (1 - cdf), 0) / n), 1) AS high')} FROM curve JOIN n USING (state)")
def ecdf_bounds(spark, sf_dir):
    inner = waits.interior(obs(spark, sf_dir))
    sized = dist.ecdf(inner, ["state"], "wait_time").join(inner.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state")
    found = curves.pointwise_bounds(sized, "n", Z95)
    return found.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("low", "high")))


@query(f"WITH {INNER_CURVE} SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)}, copy FROM curve, (SELECT unnest([0, 1]) AS copy)")
def ecdf_steps(spark, sf_dir):
    return curves.doubled(_curve(_inner_curve(spark, sf_dir)))


@query(f"""WITH {INNER_CURVE}, s AS (SELECT state, min(x) AS first, (max(x) - min(x)) / (count(*) - 1) AS step FROM curve GROUP BY state)
SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)} FROM curve UNION ALL SELECT state, {r('first - step AS x', digits=3)}, 0.0 FROM s""")
def ecdf_auto_pad(spark, sf_dir):
    """A point of share 0 as far before the first as points are apart on average."""
    curve = _inner_curve(spark, sf_dir)
    step = F.try_divide(F.max("x") - F.min("x"), F.count(F.lit(1)) - 1)
    first = curve.groupBy("state").agg((F.min("x") - step).alias("x"), F.lit(0.0).alias("cdf"))
    return _curve(curve.unionByName(first))


UNNORMED = f"""{WEIGHTED.format(where='')}, {SURVIVAL}, survived AS (SELECT x, count(*) / (SELECT n FROM total) AS sf FROM (SELECT DISTINCT x FROM weights) JOIN sizes ON sizes.w >= x GROUP BY x)"""


@query(f"WITH {SIM}, {INTERIOR}, {UNNORMED}, g AS (SELECT unnest(range(41)) * 43200.0::DOUBLE AS x) SELECT state, {r('g.x AS x', digits=3)}, {r('sum(w / sf) FILTER (weights.x <= g.x) * 86400 AS cdf')} FROM weights JOIN survived USING (x), g GROUP BY state, g.x")
def ecdf_unnormed_grid(spark, sf_dir):
    """Corrected weights summed up to each frame, not made to end at 1."""
    found = obs_once(spark, sf_dir)
    weights = dist.windowed_weights(waits.interior(found), ["state"], found, KEY)
    bins = written(weights.groupBy("state", (F.ceil(F.greatest("x", F.lit(0.0)) / 43_200.0) * 43_200.0).alias("x")).agg(F.sum("w").alias("w")))
    at = bins.select("state").distinct().withColumn("x", F.explode(F.array(*(F.lit(i * 43_200.0) for i in range(41)))))
    summed = dist.running_on(bins, at, ["state"])
    return summed.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round(F.col("w") * 86_400, 6) + F.lit(0.0)).alias("cdf"))


@query(f"WITH {INNER_CURVE} SELECT state, {r('-1 / regr_slope(ln(1 - cdf), x) AS mean', digits=3)} FROM curve WHERE cdf < 1 GROUP BY state")
def exponential_mean(spark, sf_dir):
    return rounded(curves.exponential_mean(_inner_curve(spark, sf_dir), ["state"]), 3)


@query(f"WITH {INNER_CURVE} SELECT state, {r('1 - regr_slope(log10(1 - cdf), log10(x)) AS alpha')} FROM curve WHERE cdf < 1 AND x > 3600 GROUP BY state")
def tail_exponent(spark, sf_dir):
    return rounded(curves.tail_exponent(_inner_curve(spark, sf_dir), ["state"], 3_600.0))


DAYS_GRID = [0.5 * i for i in range(21)]


@query(f"""WITH {SIM}, {INTERIOR}, p AS (SELECT state, round(wait_time / 8640)  / 10 AS v, count(*)::DOUBLE AS w FROM inner_waits GROUP BY ALL),
s AS (SELECT state, sum(w) AS s, sum(w) ** 2 / sum(w * w) AS n, sum(w * v) / sum(w) AS m, sum(w * v * v) / sum(w) AS q FROM p GROUP BY state), h AS (SELECT state, s, n ** -0.2 * sqrt((q - m * m) / (1 - 1 / n)) AS h FROM s)
SELECT state, {r('g AS x')}, {r('sum(w / s * exp(-0.5 * ((g - v) / h) ** 2) / (h * sqrt(2 * pi()))) AS density')} FROM p JOIN h USING (state), (SELECT unnest(range(21)) * 0.5::DOUBLE AS g) GROUP BY state, g""")
def smooth_density(spark, sf_dir):
    """Waits in days, in tenths of a day: a kernel's work grows with distinct values."""
    tenths = waits.interior(obs(spark, sf_dir)).groupBy("state", (F.round(F.col("wait_time") / 8_640) / 10).alias("x")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return rounded(curves.smooth_density(tenths, ["state"], DAYS_GRID))


@query(f"""WITH {SIM}, {EXTERIOR} SELECT state, least(greatest(floor((wait_time + 21600) / 43200), 0), 40)::BIGINT AS bin, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY state) / 43200 * 1e6 AS density')} FROM outer_waits
WHERE wait_time >= -21600 AND wait_time <= 40.5 * 43200 GROUP BY state, bin""")
def exterior_frames(spark, sf_dir):
    """Waits cut off, by the frame they are nearest to."""
    found = dist.histogram(waits.exterior(obs(spark, sf_dir)), ["state"], "wait_time", -21_600.0, 40.5 * 43_200.0, 41)
    return rounded(found.select("state", (F.col("bin") - 1).alias("bin"), F.col("weight").cast("long").alias("n"), (F.col("density") * 1e6).alias("density")))


@query(f"WITH {LAGGED} SELECT delta, floor(vx / 10)::BIGINT AS bin, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY delta) / 10 AS density')} FROM pairs GROUP BY delta, bin")
def displacement_hist(spark, sf_dir):
    """Displacements in bins of ten by lag."""
    pairs = lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1, 2, 4])
    counts = pairs.groupBy(F.col("delta").cast("long").alias("delta"), F.floor(F.col("vx") / 10).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy("delta").agg(F.sum("n").alias("_n"))
    return rounded(counts.join(whole, "delta").select("delta", "bin", "n", (F.col("n") / F.col("_n") / 10).alias("density")))


EDGES = [0.0, 3_600.0, 21_600.0, 86_400.0, 259_200.0, 864_000.0]


@query(f"""WITH {SIM}, {INTERIOR}, e AS (SELECT i, lows[i] AS low, lows[i + 1] AS high FROM (SELECT {EDGES}::DOUBLE[] AS lows), unnest([1, 2, 3, 4, 5]) u(i))
SELECT state, i::BIGINT AS bin, count(*) AS n, {r('count(*) / sum(count(*)) OVER (PARTITION BY state) / any_value(high - low) * 1e6 AS density')} FROM inner_waits JOIN e ON wait_time >= low AND (wait_time < high OR i = 5 AND wait_time = high) GROUP BY state, i""")
def hist_edges(spark, sf_dir):
    found = dist.histogram_between(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time", EDGES)
    return rounded(found.withColumn("density", F.col("density") * 1e6))


@query(f"""WITH {SIM}, b AS (SELECT state, wait_time AS x, count(*) FILTER (wait_type = 'interior') AS d, count(*) AS n FROM obs GROUP BY state, wait_time), k AS (SELECT *, sum(n) OVER (PARTITION BY state ORDER BY x DESC) AS risk FROM b),
v AS (SELECT state, x, product(1 - d / risk) OVER w AS s, sum(CASE WHEN risk > d THEN d / (risk * (risk - d)) ELSE 0 END) OVER w AS v FROM k WINDOW w AS (PARTITION BY state ORDER BY x))
SELECT state, {r('x', digits=3)}, {r('1 - s AS cdf', f'1 - s ** exp({Z95} * sqrt(v) / ln(s) * -1) AS high', f'1 - s ** exp({Z95} * sqrt(v) / ln(s)) AS low')} FROM v WHERE s > 1e-9 AND s < 1 - 1e-9""")
def kaplan_meier_bounds(spark, sf_dir):
    """With the interval of the survival's double logarithm; where the survival is 1 or 0 there is none."""
    found = dist.kaplan_meier_bounds(obs(spark, sf_dir), ["state"], Z95).where("cdf > 1e-9 AND cdf < 1 - 1e-9")
    return found.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("cdf", "low", "high")))


MID = "3 * sin(0.5 * pi()) / (pi() * 0.75 * 0.5 * 0.5)"


@query(f"""WITH {TRACK}, v AS (SELECT traj, t, t::DOUBLE AS u, 2.5::DOUBLE / nullif(t, 0) AS eta FROM track),
c AS (SELECT *, -3 * sin(0.5 * pi()) / (pi() * 1.5) * abs(u ** (-1.5)) / (eta * eta * 0.25) AS scale FROM v)
SELECT traj, t, {r(f"CASE WHEN t = 0 THEN {MID} * 2.5 ** 0.5 / 6.25 WHEN eta <= 1 THEN scale * (2 - (1 - eta) ** 0.5 - (1 + eta) ** 0.5) ELSE scale * (2 + (eta - 1) ** 0.5 - (1 + eta) ** 0.5) + {MID} * (2.5 - u) ** 0.5 / 6.25 END AS cv")}, {r("((traj % 50 + 1) ** 2 * 0.25) ** 2 AS rouse_time", "((t + 1) ** 2 * 0.25) ** 2 AS pair_time", digits=3)} FROM c""")
def discrete_theory(spark, sf_dir):
    """Discrete velocity correlations, and relaxation times of chains and of pieces of them."""
    t = F.col("t").cast("double")
    found = tables.track(spark, sf_dir).select(
        "traj", "t", F.round(theory.discrete_velocity_correlation(t, F.lit(2.5), 0.5), 6).alias("cv"),
        F.round(theory.rouse_time(0.5, 0.5, (F.col("traj") % 50 + 1).cast("double")), 3).alias("rouse_time"), F.round(theory.rouse_time(0.5, 0.5, t + 1), 3).alias("pair_time"),
    )
    return found.select("traj", "t", *((F.col(c) + F.lit(0.0)).alias(c) for c in ("cv", "rouse_time", "pair_time")))


@query(f"WITH {TRACK}, g AS (SELECT DISTINCT traj, unnest(range((SELECT max(t) + 1 FROM track)))::BIGINT AS t FROM track) SELECT g.traj, g.t, {r('x')} FROM g LEFT JOIN track USING (traj, t)")
def movie_long(spark, sf_dir):
    """A column for each frame that occurs, and back to a row for each trajectory and frame."""
    track = tables.track(spark, sf_dir)
    last = track.agg(F.max("t")).first()[0]  # a wide movie has as many columns as frames
    wide = track.groupBy("traj").pivot("t", list(range((-1 if last is None else last) + 1))).agg(F.first("x"))
    return rounded(frames.long_movie(wide, KEY).select("traj", "t", F.col("value").alias("x")))


@query(f"WITH {TRACK}, a AS (SELECT traj, '[' || string_agg(y::INT::VARCHAR, ' ' ORDER BY t) || ']' AS s FROM track GROUP BY traj) SELECT traj, len(v)::INT AS n, {r('list_sum(v) AS total', digits=3)} FROM (SELECT traj, string_split(s[2:-2], ' ')::DOUBLE[] AS v FROM a)")
def array_strings(spark, sf_dir):
    """Arrays written as text, read back; an array is one trajectory's."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "y"))), lambda v: v["y"].cast("int").cast("string"))
    text = tables.track(spark, sf_dir).groupBy("traj").agg(F.concat(F.lit("["), F.array_join(listed, " "), F.lit("]")).alias("s"))
    read = text.select("traj", arrays.parsed(F.col("s")).alias("v"))
    return rounded(read.select("traj", F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda a, b: a + b).alias("total")), 3)


H = curves.polynomial_rows(7, 3)


@query(f"""WITH {TRACK}, s AS (SELECT traj, list(x ORDER BY t) AS v, list(t ORDER BY t) AS ts FROM track GROUP BY traj), i AS (SELECT traj, ts[i] AS t, v, i, len(v) AS n FROM s, unnest(range(1, len(v) + 1)) u(i)),
p AS (SELECT *, greatest(least(i - 3, n - 6), 1) AS start FROM i), w AS (SELECT *, {H}::DOUBLE[][] AS h FROM p)
SELECT traj, t, {r('CASE WHEN n > 7 THEN list_sum(list_transform(range(1, 8), lambda k: h[i - start + 1][k] * v[start + k - 1])) END AS smooth')} FROM w""")
def savgol(spark, sf_dir):
    return rounded(curves.smoothed(tables.track(spark, sf_dir), KEY, "t", "x").select("traj", "t", "smooth"))


@query(f"""WITH {TRACK}, s AS (SELECT traj, (t - min(t) OVER (PARTITION BY traj))::DOUBLE AS t, x FROM track), g AS (SELECT unnest([0.0, 2.0, 4.0]::DOUBLE[]) AS wanted),
n AS (SELECT DISTINCT traj, arg_min(t, struct_pack(o := abs(t - wanted), t := t)) AS t FROM s, g GROUP BY traj, wanted) SELECT traj, t, round(t / 2)::BIGINT AS ti, {r('x')} FROM s JOIN n USING (traj, t)""")
def selected_times(spark, sf_dir):
    """Rows at the times nearest to a uniform grid, numbered by its steps."""
    track = tables.track(spark, sf_dir).withColumn("t", F.col("t").cast("double"))
    return rounded(frames.selected(track, KEY, "t", [0.0, 2.0, 4.0]).select("traj", "t", "ti", "x"))


@query(f"WITH {MOVIE_WAITS}, s AS (SELECT * FROM waits WHERE wait_type = 'interior' AND traj % 2 = 0) SELECT state, count(*) AS n, {r('avg(wait_time) AS mean', digits=3)} FROM s GROUP BY state")
def key_slice(spark, sf_dir):
    """One level of a key cut out, without its column, as a sum by the others."""
    found = waits.waits_of_movie(tables.movie(spark, sf_dir), KEY).withColumn("even", F.col("traj") % 2 == 0)
    inner = frames.at_levels(found, even=True, wait_type="interior")
    return rounded(inner.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("wait_time").alias("mean")), 3)
