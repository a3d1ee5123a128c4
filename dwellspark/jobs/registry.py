"""The library's queries by name, and DuckDB SQL for those that SQL expresses.

Doubles are rounded on both sides, so that the order of a sum doesn't show."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.functions import special, theory
from dwellspark.operators import distributions as dist
from dwellspark.operators import bootstrap, estimates, fits, frames, geometry, lags, loci, moments, waits
from dwellspark.operators.scratch import written
from dwellspark.sources import tables
from dwellspark.sources.tables import FLAT, MOVIE, SIM, TRACK

FLAGSHIP = "movie_to_waits"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
KEY = ["traj"]
DAYS = 86_400.0


def query(sql: str | None = None):
    """Register a function as a query of its name."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(*columns: str, digits: int = 6) -> str:
    """The same in SQL; adding 0 turns -0 into 0."""
    return ", ".join(f"round({c.rpartition(' AS ')[0] or c}, {digits}) + 0.0 AS {c.rpartition(' AS ')[2]}" for c in columns)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waits.waits_of_changes(tables.state_changes(spark, sf_dir), KEY)


def obs_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table, for queries that read it many times."""
    return written(obs(spark, sf_dir))


def auto_bins_sql(rows: str, x: str) -> str:
    """state, low, high, bins of a view's values, as spans."""
    return f"""ends AS (SELECT state, count({x}) AS n, min({x}) AS low, max({x}) AS high, quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr FROM {rows} GROUP BY state),
spans AS (SELECT state, CASE WHEN low < high THEN low ELSE low - 0.5 END AS low, CASE WHEN low < high THEN high ELSE high + 0.5 END AS high,
  CASE WHEN low < high THEN ceil((high - low) / CASE WHEN iqr > 0 THEN least((high - low) / (log2(n) + 1), 2 * iqr / n ** (1.0 / 3)) ELSE (high - low) / (log2(n) + 1) END)::BIGINT ELSE 1 END AS bins FROM ends)"""


MOVIE_WAITS = f"""{MOVIE}, ends AS (SELECT *, lead(first_t) OVER w AS after, lag(last_t) OVER w AS before FROM runs WINDOW w AS (PARTITION BY traj ORDER BY island)),
waits AS (SELECT traj, island::BIGINT AS rank_order, first_t AS start_time, coalesce(after, last_t) AS end_time, coalesce(after, last_t) - first_t AS wait_time, state,
  last_t - first_t AS min_waits, coalesce(after, last_t) - coalesce(before, first_t) AS max_waits,
  CASE WHEN before IS NULL AND after IS NULL THEN 'full exterior' WHEN after IS NULL THEN 'right exterior' WHEN before IS NULL THEN 'left exterior' ELSE 'interior' END AS wait_type,
  max(last_t) OVER (PARTITION BY traj) - min(first_t) OVER (PARTITION BY traj) AS window_size FROM ends)"""


@query(f"WITH {MOVIE_WAITS} SELECT traj, rank_order, state, wait_type, {r('start_time', 'end_time', 'wait_time', 'min_waits', 'max_waits', 'window_size', digits=3)} FROM waits")
def movie_to_waits(spark, sf_dir):
    return rounded(waits.waits_of_movie(tables.movie(spark, sf_dir), KEY), 3)


@query(f"WITH {SIM} SELECT traj, state, rank_order, num_waits, wait_type, {r('start_time', 'end_time', 'wait_time', 'window_size', digits=3)} FROM obs")
def sim_to_obs(spark, sf_dir):
    return rounded(obs(spark, sf_dir), 3)


@query(f"WITH {SIM} SELECT state, wait_type, count(*) AS n, {r('avg(wait_time) AS mean_wait', digits=3)} FROM obs GROUP BY state, wait_type")
def wait_type_counts(spark, sf_dir):
    return rounded(obs(spark, sf_dir).groupBy("state", "wait_type").agg(F.count(F.lit(1)).alias("n"), F.avg("wait_time").alias("mean_wait")), 3)


def ecdf_sql(rows: str, x: str) -> str:
    """Distinct x with running shares by state."""
    return f"counts AS (SELECT state, {x} AS x, count(*) AS n FROM {rows} GROUP BY state, {x}), curve AS (SELECT state, x, sum(n) OVER (PARTITION BY state ORDER BY x) / sum(n) OVER (PARTITION BY state) AS cdf FROM counts)"


INTERIOR = "inner_waits AS (SELECT * FROM obs WHERE wait_type = 'interior')"
EXTERIOR = "outer_waits AS (SELECT * FROM obs WHERE wait_type IN ('left exterior', 'right exterior'))"


@query(f"WITH {SIM}, {INTERIOR}, {ecdf_sql('inner_waits', 'wait_time')} SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)} FROM curve UNION ALL SELECT DISTINCT state, 0.0, 0.0 FROM curve")
def ecdf_interior(spark, sf_dir):
    return _curve(dist.ecdf(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time", 0.0))


def _curve(df: DataFrame, keys: Sequence[str] = ("state",)) -> DataFrame:
    return df.select(*keys, (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("cdf", 9) + F.lit(0.0)).alias("cdf"))


@query(f"WITH {SIM}, {EXTERIOR}, {ecdf_sql('outer_waits', 'wait_time')} SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)} FROM curve")
def ecdf_exterior(spark, sf_dir):
    return _curve(dist.ecdf(waits.exterior(obs(spark, sf_dir)), ["state"], "wait_time"))


GRID = [i * 43_200.0 for i in range(41)]


@query(f"WITH {SIM}, {INTERIOR}, g AS (SELECT unnest(range(41)) * 43200.0::DOUBLE AS x) SELECT state, {r('x', digits=3)}, {r('count(*) FILTER (wait_time <= x) / count(*) AS cdf', digits=9)} FROM inner_waits, g GROUP BY state, x")
def ecdf_allowed_grid(spark, sf_dir):
    return _curve(dist.ecdf_on(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time", GRID))


WEIGHTED = """weights AS (SELECT state, wait_time AS x, sum(1.0 / (window_size - wait_time)) AS w FROM inner_waits WHERE window_size > wait_time{where} GROUP BY state, wait_time)"""
CURVE_W = "curve AS (SELECT state, x, sum(w) OVER (PARTITION BY state ORDER BY x) / sum(w) OVER (PARTITION BY state) AS cdf FROM {rows})"
PADDED = "padded AS (SELECT state, x, cdf FROM curve WHERE x <> 0 UNION ALL SELECT DISTINCT state, 0.0::DOUBLE, 0.0::DOUBLE FROM curve)"


@query(f"WITH {SIM}, {INTERIOR}, {WEIGHTED.format(where=' AND window_size = 1728000')}, {CURVE_W.format(rows='weights')}, {PADDED} SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)} FROM padded")
def ecdf_windowed_single(spark, sf_dir):
    return _curve(dist.ecdf_windowed(waits.interior(obs(spark, sf_dir)).where("window_size = 1728000"), ["state"]))


@query(f"""WITH {SIM}, {INTERIOR}, weights AS (SELECT state, window_size, wait_time AS x, sum(1.0 / (window_size - wait_time)) AS w FROM inner_waits WHERE window_size > wait_time GROUP BY ALL),
curve AS (SELECT state, window_size, x, sum(w) OVER (PARTITION BY state, window_size ORDER BY x) / sum(w) OVER (PARTITION BY state, window_size) AS cdf FROM weights),
padded AS (SELECT * FROM curve WHERE x <> 0 UNION ALL SELECT DISTINCT state, window_size, 0.0::DOUBLE, 0.0::DOUBLE FROM curve) SELECT state, window_size, {r('x', digits=3)}, {r('cdf', digits=9)} FROM padded""")
def ecdf_windowed_by_size(spark, sf_dir):
    """ecdf_windowed_single for each size of window, so that every trajectory counts."""
    return _curve(dist.ecdf_windowed(waits.interior(obs(spark, sf_dir)), ["state", "window_size"]), ["state", "window_size"])


SURVIVAL = "sizes AS (SELECT traj, max(window_size) AS w FROM obs GROUP BY traj), total AS (SELECT count(*) AS n FROM sizes)"
MULTI = f"""{WEIGHTED.format(where='')}, {SURVIVAL}, survived AS (SELECT x, count(*) / (SELECT n FROM total) AS sf FROM (SELECT DISTINCT x FROM weights) JOIN sizes ON sizes.w >= x GROUP BY x),
both_w AS (SELECT state, x, w / sf AS w FROM weights JOIN survived USING (x)), {CURVE_W.format(rows='both_w')}, {PADDED}"""


@query(f"WITH {SIM}, {INTERIOR}, {MULTI} SELECT state, {r('x', digits=3)}, {r('cdf', digits=9)} FROM padded")
def ecdf_windowed_multi(spark, sf_dir):
    return _curve(dist.ecdf_windowed_whole(obs(spark, sf_dir), ["state"]))


@query(f"WITH {SIM}, {SURVIVAL}, q AS (SELECT DISTINCT state, wait_time AS x FROM obs) SELECT state, {r('x', digits=3)}, {r('(SELECT count(*) FROM sizes WHERE w >= x) / (SELECT n FROM total) AS sf', digits=9)} FROM q")
def window_sf(spark, sf_dir):
    found = obs(spark, sf_dir)
    at = found.select("state", F.col("wait_time").alias("x")).distinct()
    sf = dist.window_survival(found, KEY, at, ["state"])
    return sf.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("sf", 9) + F.lit(0.0)).alias("sf"))


@query(f"WITH {SIM}, {INTERIOR}, {MULTI}, n AS (SELECT *, lead(x) OVER w AS x_to, lead(cdf) OVER w AS c FROM padded WINDOW w AS (PARTITION BY state ORDER BY x)) SELECT state, {r('x', 'x_to', digits=3)}, {r('(c - cdf) / (x_to - x) * 86400 AS pmf')} FROM n WHERE x_to - x >= 1")
def ecdf_bars(spark, sf_dir):
    found = obs_once(spark, sf_dir)
    made = dist.bars(dist.ecdf_windowed(waits.interior(found), ["state"], found, KEY), ["state"]).where("x_to - x >= 1")
    return made.select("state", F.round("x", 3).alias("x"), F.round("x_to", 3).alias("x_to"), (F.round(F.col("pmf") * 86400, 6) + F.lit(0.0)).alias("pmf"))


@query(f"WITH {SIM}, {INTERIOR}, {MULTI}, s AS (SELECT *, coalesce(cdf * (x - lag(x) OVER (PARTITION BY state ORDER BY x)), 0) AS step FROM padded) SELECT state, {r('x', digits=3)}, {r('sum(step) OVER (PARTITION BY state ORDER BY x) AS area', digits=3)} FROM s")
def ccdf_int(spark, sf_dir):
    found = obs_once(spark, sf_dir)
    return rounded(dist.integral(dist.ecdf_windowed(waits.interior(found), ["state"], found, KEY), ["state"]).select("state", "x", "area"), 3)


def _straight(c: str) -> str:
    return f"coalesce({c}, {c}y0 + ({c}y1 - {c}y0) * (x - {c}x0) / nullif({c}x1 - {c}x0, 0), {c}y0, {c}y1) AS {c}"


def _around(c: str) -> str:
    there = f"CASE WHEN {c} IS NOT NULL THEN x END"
    return f"last_value({there} IGNORE NULLS) OVER b AS {c}x0, last_value({c} IGNORE NULLS) OVER b AS {c}y0, first_value({there} IGNORE NULLS) OVER o AS {c}x1, first_value({c} IGNORE NULLS) OVER o AS {c}y1"


FIT = f"""{INTERIOR}, {EXTERIOR}, {MULTI}, areas AS (SELECT state, x, sum(step) OVER (PARTITION BY state ORDER BY x) AS i FROM (SELECT state, x, coalesce(cdf * (x - lag(x) OVER (PARTITION BY state ORDER BY x)), 0) AS step FROM padded)),
outer_n AS (SELECT state, wait_time AS x, count(*) AS n FROM outer_waits GROUP BY ALL), outer_curve AS (SELECT state, x, sum(n) OVER (PARTITION BY state ORDER BY x) / sum(n) OVER (PARTITION BY state) AS e FROM outer_n),
both_curves AS (SELECT state, x, NULL::DOUBLE AS e, i FROM areas UNION ALL SELECT state, x, e, NULL FROM outer_curve WHERE x <> 0 UNION ALL SELECT DISTINCT state, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM outer_curve),
grid AS (SELECT state, x, max(e) AS e, max(i) AS i, count(*) AS m FROM both_curves GROUP BY state, x),
around AS (SELECT *, {_around('e')}, {_around('i')} FROM grid WINDOW b AS (PARTITION BY state ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), o AS (PARTITION BY state ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
read AS (SELECT state, x AS t, m, {_straight('e')}, {_straight('i')} FROM around),
squares AS (SELECT state, sum(t * t * m) AS tt, sum(t * i * m) AS ti, sum(i * i * m) AS ii, sum(t * e * m) AS te, sum(i * e * m) AS ie FROM read GROUP BY state),
solved AS (SELECT *, (te * ii - ie * ti) / nullif(tt * ii - ti * ti, 0) AS a0, (ie * tt - te * ti) / nullif(tt * ii - ti * ti, 0) AS b0, greatest(te / nullif(tt, 0), 0) AS alone, least(ie / nullif(ii, 0), 0) AS other FROM squares),
cornered AS (SELECT *, alone * alone * tt - 2 * alone * te <= other * other * ii - 2 * other * ie AS first FROM solved),
fit AS (SELECT state, CASE WHEN a0 >= 0 AND b0 <= 0 THEN a0 WHEN first THEN alone ELSE 0 END AS a, CASE WHEN a0 >= 0 AND b0 <= 0 THEN b0 WHEN first THEN 0 ELSE other END AS b FROM cornered)"""


@query(f"WITH {SIM}, {FIT} SELECT state, {r('a * 86400 AS a', 'b * 86400 AS b', '-b / nullif(a, 0) AS end_share')} FROM fit")
def ext_int_fit(spark, sf_dir):
    """Rates are by day."""
    fit = estimates.summary(estimates.points(obs_once(spark, sf_dir), ["state"], KEY), ["state"]).select("state", "a", "b", "end_share")
    return rounded(fit.withColumns({"a": F.col("a") * DAYS, "b": F.col("b") * DAYS}))


@query(f"""WITH {SIM}, b AS (SELECT state, wait_time AS x, count(*) FILTER (wait_type = 'interior') AS d, count(*) AS n FROM obs GROUP BY state, wait_time),
k AS (SELECT *, sum(n) OVER (PARTITION BY state ORDER BY x DESC) AS risk FROM b)
SELECT state, {r('x', digits=3)}, {r('1 - product(1 - d / risk) OVER (PARTITION BY state ORDER BY x) AS cdf', digits=9)} FROM k""")
def kaplan_meier(spark, sf_dir):
    return _curve(dist.kaplan_meier(obs(spark, sf_dir), ["state"]))


@query(f"""WITH {SIM}, s AS (SELECT *, min(start_time) OVER (PARTITION BY traj) AS w0 FROM obs), e AS (SELECT state, sum(wait_time) AS spent, count(*) FILTER (abs(end_time - w0 - window_size) > 1e-8 + 1e-5 * window_size) AS ends FROM s GROUP BY state)
SELECT state, {r('(SELECT sum(w) FROM (SELECT max(window_size) AS w FROM obs GROUP BY traj)) / (SELECT avg(ends) FROM e) * spent / (SELECT sum(spent) FROM e) AS mean_wait', digits=3)} FROM e""")
def average_lifetime(spark, sf_dir):
    return rounded(waits.mean_lifetimes(obs(spark, sf_dir), KEY), 3)


@query(f"WITH {SIM}, {INTERIOR} SELECT state, {r('1 + count(*) / sum(ln(wait_time / 3600)) AS slope')} FROM inner_waits WHERE wait_time >= 3600 GROUP BY state")
def power_law_mle(spark, sf_dir):
    return rounded(moments.power_law_slope(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time", 3600.0))


@query(f"""WITH {SIM}, {INTERIOR}, b AS (SELECT state, least(floor(wait_time / 43200)::BIGINT + 1, 40) AS bin, sum(1.0 / (window_size - wait_time)) AS weight FROM inner_waits WHERE window_size > wait_time AND wait_time <= 1728000 GROUP BY ALL)
SELECT state, bin, {r('weight * 1e6 AS weight', 'weight / sum(weight) OVER (PARTITION BY state) / 43200 * 1e6 AS density')} FROM b""")
def hist_weighted(spark, sf_dir):
    inner = waits.interior(obs(spark, sf_dir)).where("window_size > wait_time").withColumn("w", 1 / (F.col("window_size") - F.col("wait_time")))
    found = dist.histogram(inner, ["state"], "wait_time", 0.0, 1_728_000.0, 40, "w")
    return rounded(found.withColumns({"weight": F.col("weight") * 1e6, "density": F.col("density") * 1e6}))


PAIRS = f"""{TRACK}, pairs AS (SELECT a.traj, a.condition, a.t AS ti, b.t - a.t AS delta, b.t AS tf, b.x - a.x AS vx, b.y - a.y AS vy FROM track a JOIN track b ON a.traj = b.traj AND b.t >= a.t)"""


@query(f"WITH {PAIRS} SELECT traj, ti, delta, tf, {r('vx', 'vy')} FROM pairs")
def lag_pairs(spark, sf_dir):
    return rounded(lags.lag_pairs(tables.track(spark, sf_dir), KEY, coords=("x", "y")))


@query(f"WITH {PAIRS} SELECT traj, ti, delta, tf, {r('vx')} FROM pairs WHERE delta IN (1, 2, 5)")
def lag_pairs_fixed(spark, sf_dir):
    found = lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1, 2, 5])
    return rounded(found.withColumn("delta", F.col("delta").cast("long")))


@query(f"WITH {PAIRS} SELECT traj, ti, delta, tf, {r('vx')} FROM pairs WHERE delta = 0 OR ti % delta = 0")
def lag_pairs_independent(spark, sf_dir):
    return rounded(lags.lag_pairs(tables.track(spark, sf_dir), KEY, independent=True))


@query(f"WITH {PAIRS} SELECT traj, ti, delta, {r('vx * vx + vy * vy AS displacement', digits=4)} FROM pairs WHERE delta > 0")
def sq_disp(spark, sf_dir):
    pairs = lags.lag_pairs(tables.track(spark, sf_dir), KEY, coords=("x", "y")).where("delta > 0")
    return rounded(pairs.select("traj", "ti", "delta", lags.squared(("x", "y")).alias("displacement")), 4)


def _msd(value: str, power: int) -> str:
    n = "count(*)" if power == 2 else "(count(*) - 1)"
    return f"WITH {PAIRS} SELECT delta, {r(f'avg({value}) AS mean', f'stddev_samp({value}) AS std', f'CASE WHEN {n} > 0 THEN stddev_samp({value}) / sqrt({n}) END AS ste', digits=3)}, count(*) AS count FROM pairs GROUP BY delta"


@query(_msd("sqrt(vx * vx + vy * vy)", 1))
def msd_abs(spark, sf_dir):
    pairs = lags.lag_pairs(tables.track(spark, sf_dir), KEY, coords=("x", "y"))
    return rounded(lags.displacement_moments(pairs, [], ("x", "y"), 1), 3)


@query(_msd("(vx * vx + vy * vy)", 2))
def msd_sq(spark, sf_dir):
    pairs = lags.lag_pairs(tables.track(spark, sf_dir), KEY, coords=("x", "y"))
    return rounded(lags.displacement_moments(pairs, [], ("x", "y"), 2), 3)


@query(f"WITH {TRACK}, p AS (SELECT b.t - a.t AS t, a.x * b.x AS xx FROM track a JOIN track b ON a.traj = b.traj AND b.t >= a.t) SELECT t, {r('avg(xx) AS mean', 'stddev_samp(xx) AS std', digits=3)}, count(*) AS count FROM p GROUP BY t")
def autocorr(spark, sf_dir):
    return rounded(lags.autocorrelation(tables.track(spark, sf_dir), KEY), 3)


LAGGED = f"""{TRACK}, pairs AS (SELECT a.traj, a.t AS ti, d AS delta, b.t AS tf, b.x - a.x AS vx, b.y - a.y AS vy FROM (SELECT *, unnest([1, 2, 4]::BIGINT[]) AS d FROM track) a JOIN track b ON a.traj = b.traj AND b.t = a.t + a.d)"""
CVV = f"""{LAGGED}, prods AS (SELECT a.traj, a.delta, b.ti - a.ti AS t, b.ti AS tau, a.vx * b.vx + a.vy * b.vy AS cvv FROM pairs a JOIN pairs b ON a.traj = b.traj AND a.delta = b.delta AND b.ti >= a.ti
  AND b.ti - a.ti <= 4 * a.delta),
sums AS (SELECT delta, t, sum(cvv * cvv) AS sqs, sum(cvv) AS sum, count(*) AS cnt FROM prods GROUP BY delta, t)"""


def _velocities(spark, sf_dir):
    pairs = lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1, 2, 4], coords=("x", "y"))
    return lags.velocity_products(pairs.withColumn("delta", F.col("delta").cast("long")), KEY, ("x", "y"))


@query(f"WITH {CVV} SELECT traj, delta, t, tau, {r('cvv', digits=3)} FROM prods")
def vel_corr(spark, sf_dir):
    return rounded(_velocities(spark, sf_dir), 3)


@query(f"WITH {CVV} SELECT delta, t, {r('sqs / 1e6 AS sqs', 'sum / 1e6 AS sum', digits=3)}, cnt FROM sums")
def cvv_stats(spark, sf_dir):
    sums = lags.correlation_sums(_velocities(spark, sf_dir), [])
    return rounded(sums.withColumns({"sqs": F.col("sqs") / 1e6, "sum": F.col("sum") / 1e6}), 3)


@query(f"""WITH {CVV}, c AS (SELECT delta, t, sum / cnt AS cvv, sqrt(greatest(sqs / cnt - (sum / cnt) * (sum / cnt), 0)) / sqrt(cnt) AS ste FROM sums),
z AS (SELECT *, max(CASE WHEN t = 0 THEN cvv END) OVER (PARTITION BY delta) AS zero FROM c) SELECT delta, t, {r('cvv / zero AS cvv_normed', 'ste / zero AS ste_normed')} FROM z""")
def cvv_normed(spark, sf_dir):
    curves = lags.correlation_curves(lags.correlation_sums(_velocities(spark, sf_dir), []), [])
    return rounded(curves.select("delta", "t", "cvv_normed", "ste_normed"))


@query(f"WITH {PAIRS} SELECT traj, tf AS t, {r('sum(vx) OVER (PARTITION BY traj ORDER BY tf) AS x')} FROM pairs WHERE delta = 1")
def vel_to_pos(spark, sf_dir):
    return rounded(lags.positions(lags.lag_pairs_at(tables.track(spark, sf_dir), KEY, [1]), KEY))


@query(f"""WITH {TRACK}, m AS (SELECT condition, count(x)::DOUBLE AS x0, avg(x) AS x1, avg(x * x) AS x2, count(y)::DOUBLE AS y0, avg(y) AS y1, avg(y * y) AS y2 FROM track GROUP BY condition)
SELECT condition, c AS "column", k AS moment, {r('v AS value')} FROM m, LATERAL (VALUES ('x', 0, x0), ('x', 1, x1), ('x', 2, x2), ('y', 0, y0), ('y', 1, y1), ('y', 2, y2)) u(c, k, v)""")
def raw_moments(spark, sf_dir):
    return rounded(moments.moments(tables.track(spark, sf_dir), ["condition"], ["x", "y"]))


@query(f"""WITH {TRACK}, m AS (SELECT condition, count(x)::DOUBLE AS x0, avg(x) AS x1, avg(x * x) AS x2 FROM track GROUP BY condition)
SELECT condition, 'x' AS "column", k AS moment, {r('v AS value')} FROM m, LATERAL (VALUES (0, x0), (1, x1), (2, x2)) u(k, v)""")
def combine_moments(spark, sf_dir):
    """Moments of each trajectory, combined: the same as moments of the whole."""
    return rounded(moments.combine_moments(moments.moments(tables.track(spark, sf_dir), ["condition", "traj"], ["x"]), ["condition"], ["traj"]))


@query(f"WITH {PAIRS}, p AS (SELECT condition, delta, avg(vx * vx) AS mean, count(*) AS count FROM pairs GROUP BY condition, delta) SELECT condition, {r('sum(mean * count) / sum(count) AS mean', digits=4)} FROM p GROUP BY condition")
def re_agg_mean(spark, sf_dir):
    pairs = lags.lag_pairs(tables.track(spark, sf_dir).withColumn("k", F.col("condition")), ["traj"]).select("traj", "ti", "delta", "vx")
    start = tables.track(spark, sf_dir).select("traj", F.col("t").alias("ti"), "condition")
    parts = lags.displacement_moments(pairs.join(start, ["traj", "ti"]), ["condition"], ("x",), 2)
    return rounded(moments.mean_of_means(parts, ["condition"]), 4)


@query(f"""WITH {PAIRS}, m AS (SELECT traj, delta, avg(vx * vx) AS mean FROM pairs WHERE delta > 0 GROUP BY traj, delta), l AS (SELECT traj, ln(delta) AS lx, ln(mean) AS ly FROM m WHERE mean > 0),
f AS (SELECT traj, regr_slope(ly, lx) AS slope, regr_intercept(ly, lx) AS intercept, count(*) AS n FROM l GROUP BY traj) SELECT traj, {r('slope', 'intercept')}, n FROM f WHERE n >= 3""")
def loglog_slope(spark, sf_dir):
    pairs = lags.lag_pairs(tables.track(spark, sf_dir), KEY).where("delta > 0")
    return rounded(moments.loglog_fit(lags.displacement_moments(pairs, KEY, ("x",), 2), KEY).where("n >= 3").select("traj", "slope", "intercept", "n"))


@query(f"WITH {PAIRS} SELECT condition, {r('avg(mean) AS plateau', digits=3)} FROM (SELECT condition, delta, avg(vx * vx) AS mean FROM pairs WHERE delta > 4 AND delta < 9 GROUP BY condition, delta) GROUP BY condition")
def plateau(spark, sf_dir):
    track = tables.track(spark, sf_dir)
    pairs = lags.lag_pairs(track, KEY, max_delta=9).where("delta > 4").join(track.select("traj", F.col("t").alias("ti"), "condition"), ["traj", "ti"])
    return rounded(lags.displacement_moments(pairs, ["condition"]).groupBy("condition").agg(F.avg("mean").alias("plateau")), 3)


@query(f"WITH {TRACK}, c AS (SELECT traj, x - avg(x) OVER w AS dx, y - avg(y) OVER w AS dy FROM track WINDOW w AS (PARTITION BY traj)) SELECT traj, {r('avg(sqrt(dx * dx + dy * dy)) AS radius')} FROM c GROUP BY traj")
def rad_gyration(spark, sf_dir):
    return rounded(moments.gyration(tables.track(spark, sf_dir), KEY, ("x", "y")))


LABELLED = f"{FLAT}, labelled AS (SELECT *, CASE WHEN X2 IS NULL THEN 'pair' ELSE 'unp' END AS foci FROM flat)"


@query(f"WITH {LABELLED} SELECT traj, t, foci FROM labelled")
def foci_label(spark, sf_dir):
    return loci.label_foci(tables.two_loci(spark, sf_dir)).select("traj", "t", "foci")


@query(f"WITH {LABELLED} SELECT t, {r('avg((foci = $$pair$$)::INT) AS mean', 'stddev_samp((foci = $$pair$$)::INT) AS std')}, count(*) AS count FROM labelled GROUP BY t".replace("$$", "'"))
def pair_fraction(spark, sf_dir):
    return rounded(moments.fraction(loci.label_foci(tables.two_loci(spark, sf_dir)), ["t"], F.col("foci") == "pair"))


@query(f"WITH {LABELLED}, m AS (SELECT traj, traj % 5 AS condition, bool_or(foci = 'pair') AND bool_or(foci = 'unp') AS mixed FROM labelled GROUP BY traj) SELECT condition, {r('avg(mixed::INT) AS mean')}, count(*) AS count FROM m GROUP BY condition")
def mixed_fraction(spark, sf_dir):
    by_cell = loci.label_foci(tables.two_loci(spark, sf_dir)).groupBy("traj").agg((F.bool_or(F.col("foci") == "pair") & F.bool_or(F.col("foci") == "unp")).alias("mixed"))
    return rounded(moments.fraction(by_cell.withColumn("condition", F.col("traj") % 5), ["condition"], F.col("mixed")).drop("std"))


@query(f"WITH {LABELLED}, d AS (SELECT traj, t, coalesce(X2, X1) - X1 AS dx, coalesce(Y2, Y1) - Y1 AS dy, coalesce(Z2, Z1) - Z1 AS dz FROM labelled) SELECT traj, t, {r('sqrt(dx * dx + dy * dy + dz * dz) AS distance')} FROM d")
def paired_cols(spark, sf_dir):
    return rounded(loci.separation(loci.fill_second(tables.two_loci(spark, sf_dir))).select("traj", "t", "distance"))


@query(f"WITH {LABELLED} SELECT traj, t, sum((X2 IS NULL)::INT) OVER (PARTITION BY traj ORDER BY t)::BIGINT AS na_id FROM labelled")
def na_id(spark, sf_dir):
    return loci.number_gaps(tables.two_loci(spark, sf_dir), KEY, ["X1", "X2"]).select("traj", "t", "na_id")


@query(f"WITH {LABELLED}, c AS (SELECT traj, t, coalesce((foci <> lag(foci) OVER (PARTITION BY traj ORDER BY t))::INT, 0) AS c FROM labelled) SELECT traj, t, sum(c) OVER (PARTITION BY traj ORDER BY t)::BIGINT AS wait_id FROM c")
def wait_id(spark, sf_dir):
    return loci.number_waits(loci.label_foci(tables.two_loci(spark, sf_dir)), KEY).select("traj", "t", "wait_id")


@query(f'WITH {FLAT} SELECT traj, t, 1 AS spot, {r("X1 AS X", "Y1 AS Y", "Z1 AS Z")} FROM flat UNION ALL SELECT traj, t, 2, {r("X2 AS X", "Y2 AS Y", "Z2 AS Z")} FROM flat')
def pivot_long(spark, sf_dir):
    return rounded(loci.long_form(tables.two_loci(spark, sf_dir)))


@query(f'WITH {FLAT} SELECT traj, t, {r("X1", "Y1", "Z1", "X2", "Y2", "Z2")} FROM flat')
def pivot_wide(spark, sf_dir):
    return rounded(loci.wide_form(loci.long_form(tables.two_loci(spark, sf_dir)), ["traj", "t"]))


@query(f"""WITH {SIM}, g AS (SELECT traj, k * 43200.0::DOUBLE AS t FROM (SELECT DISTINCT traj FROM sim), unnest(range(41)) u(k)), e AS (SELECT traj, max(end_time) AS e FROM sim GROUP BY traj)
SELECT g.traj, {r('g.t AS t', digits=3)}, CASE WHEN g.t <= e.e THEN s.state END AS state FROM g ASOF LEFT JOIN sim s ON g.traj = s.traj AND g.t >= s.start_time JOIN e ON g.traj = e.traj""")
def asof_movie(spark, sf_dir):
    changes = tables.state_changes(spark, sf_dir)
    return rounded(frames.as_of(changes, frames.frame_grid(changes, KEY, 43_200.0, 41), KEY), 3)


@query(f"""WITH {SIM}, i AS (SELECT traj, state, start_time, greatest(ceil(start_time / 3600), 0)::BIGINT AS i, least(ceil(max(end_time) OVER (PARTITION BY traj) / 3600)::BIGINT - 1, 720) AS last FROM sim),
f AS (SELECT *, min(i) OVER (PARTITION BY traj) AS first FROM i), s AS (SELECT traj, i, first, last, arg_max(state, start_time) AS state FROM f WHERE i <= last GROUP BY traj, i, first, last),
d AS (SELECT *, lag(state) OVER (PARTITION BY traj ORDER BY i) AS before FROM s), n AS (SELECT * FROM d WHERE before IS DISTINCT FROM state)
SELECT traj, state, i * 3600.0::DOUBLE AS start_time, coalesce(lead(i) OVER (PARTITION BY traj ORDER BY i), last) * 3600.0::DOUBLE AS end_time, first * 3600.0::DOUBLE AS window_start, last * 3600.0::DOUBLE AS window_end FROM n""")
def frame_times(spark, sf_dir):
    return frames.quantised(tables.state_changes(spark, sf_dir), KEY, 3_600.0, 721)


@query(f"""WITH {TRACK}, s AS (SELECT traj, (t - min(t) OVER (PARTITION BY traj))::DOUBLE AS t FROM track), g AS (SELECT unnest([0.0, 2.5, 7.25]::DOUBLE[]) AS wanted)
SELECT traj, wanted, arg_min(t, struct_pack(o := abs(t - wanted), t := t)) AS t FROM s, g GROUP BY traj, wanted""")
def nearest_time(spark, sf_dir):
    return frames.nearest_times(tables.track(spark, sf_dir).withColumn("t", F.col("t").cast("double")), KEY, "t", [0.0, 2.5, 7.25])


@query(f"""WITH {SIM}, {INTERIOR}, {ecdf_sql('inner_waits', 'wait_time')}, g AS (SELECT DISTINCT state, unnest(range(41)) * 43200.0::DOUBLE AS x FROM curve),
b AS (SELECT g.state, g.x, a.x AS x0, a.cdf AS y0 FROM g ASOF LEFT JOIN curve a ON g.state = a.state AND g.x >= a.x), n AS (SELECT b.*, c.x AS x1, c.cdf AS y1 FROM b ASOF LEFT JOIN curve c ON b.state = c.state AND b.x <= c.x)
SELECT state, {r('x', digits=3)}, {r('CASE WHEN x0 = x THEN y0 ELSE coalesce(y0 + (y1 - y0) * (x - x0) / (x1 - x0), y0, y1) END AS cdf')} FROM n""")
def interp_lookup(spark, sf_dir):
    curve = dist.ecdf(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time")
    at = curve.select("state").distinct().select("state", F.explode(F.array(*(F.lit(g) for g in GRID))).alias("x"))
    found = dist.interpolated(curve, at, ["state"])
    return found.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("cdf", 6) + F.lit(0.0)).alias("cdf"))


@query(f"""WITH {TRACK}, v AS (SELECT traj, t, t + 1.0 AS u FROM track)
SELECT traj, t, {r("3 * sin(0.5 * pi()) / (pi() * 0.75 * 0.5 * 0.5) * u ** 0.5 AS msd", "-3 * sin(0.5 * pi()) / (pi() * 1.5) * abs(u ** (-1.5)) AS cv", "(abs(u - 3) ** 0.5 - 2 * abs(u) ** 0.5 + abs(u + 3) ** 0.5) / (2 * 3 ** 0.5) AS cvv", "sqrt(2) * cos(pi() * t * 0.25) * (t <> 0)::INT + (t = 0)::INT AS mode")} FROM v""")
def diffusion_theory(spark, sf_dir):
    u, t = F.col("t") + 1.0, F.col("t").cast("double")
    return rounded(
        tables.track(spark, sf_dir).select(
            "traj", "t", theory.fractional_msd(u, 0.5).alias("msd"), theory.fractional_velocity_correlation(u, 0.5).alias("cv"),
            theory.normalised_velocity_correlation(u, F.lit(3.0), 0.5).alias("cvv"), theory.rouse_mode(t, F.lit(0.25)).alias("mode"),
        )
    )


@query(f"""WITH {TRACK}, v AS (SELECT DISTINCT t FROM track), k AS (SELECT t, 3 * pi() * pi() / 100 * (2 * p) ** 2 AS k FROM v, unnest(range(1, 101)) u(p))
SELECT t, {r("sum(12 / k * (1 - exp(-k * t / 100))) + 0.06 * t AS msd")} FROM k GROUP BY t""")
def rouse_msd(spark, sf_dir):
    times = tables.track(spark, sf_dir).select("t").distinct()
    return rounded(times.select("t", theory.rouse_middle_msd(F.col("t").cast("double"), 1.0, 100.0, modes=100).alias("msd")))


@query(f"""WITH {TRACK}, v AS (SELECT DISTINCT t FROM track), k AS (SELECT t, 3 * pi() * pi() / 100 * (2 * p) ** 2 AS k FROM v, unnest(range(1, 1001)) u(p))
SELECT t, {r("sum(12 / k * (1 - exp(-k * t / 100))) + 0.06 * t AS msd")} FROM k GROUP BY t""")
def rouse_msd_whole(spark, sf_dir):
    """rouse_msd with all modes that the reference sums; that one keeps the first 100, as its SQL does."""
    times = tables.track(spark, sf_dir).select("t").distinct()
    return rounded(times.select("t", theory.rouse_middle_msd(F.col("t").cast("double"), 1.0, 100.0).alias("msd")))


# An edge of a hull has no point to its right, and those in line with it lie within it.
@query(f"""WITH {TRACK}, p AS (SELECT DISTINCT traj, x::DOUBLE AS x, y::DOUBLE AS y FROM track WHERE x IS NOT NULL AND y IS NOT NULL),
e AS (SELECT a.traj, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM p a JOIN p b ON a.traj = b.traj AND (a.x <> b.x OR a.y <> b.y)),
s AS (SELECT e.*, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS side, (x - x1) * (x - x2) + (y - y1) * (y - y2) AS past FROM e JOIN p USING (traj)),
h AS (SELECT traj, x1, y1, x2, y2 FROM s GROUP BY traj, x1, y1, x2, y2 HAVING bool_and(side > 0 OR side = 0 AND past <= 0)),
m AS (SELECT traj, count(*) AS n, sum(x1 * y2 - x2 * y1) / 2 AS area, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS perimeter FROM h GROUP BY traj)
SELECT traj, {r('CASE WHEN n > 2 THEN area END AS area', 'CASE WHEN n > 2 THEN perimeter END AS perimeter')} FROM (SELECT DISTINCT traj FROM p) t LEFT JOIN m USING (traj)""")
def convex_hull_area(spark, sf_dir):
    """Area and perimeter of the hull of each customer's track."""
    return rounded(geometry.hull_area(tables.track(spark, sf_dir), KEY))


def uniform_sql(seed: int, *columns: str) -> str:
    """bootstrap.uniform of whole numbers."""
    text = ", ".join(f"({c})::VARCHAR" for c in columns)
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', {text})), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE"


def poisson_sql(u: str, mean: str = "1") -> str:
    """bootstrap.poisson."""
    terms = [f"({mean}) ** {k} / {math.factorial(k)}" for k in range(bootstrap.MOST)]
    return " + ".join(f"({u} >= exp(-({mean})::DOUBLE) * ({' + '.join(terms[: k + 1])}))::INT" for k in range(bootstrap.MOST))


REPLICATES = 200


@query(f"""WITH {SIM}, {INTERIOR}, s AS (SELECT traj, state, sum(wait_time) AS s, count(*) AS n FROM inner_waits GROUP BY traj, state), d AS (SELECT s.*, b AS boot_id, {uniform_sql(0, 'b', 'traj')} AS u FROM s, range({REPLICATES}) r(b)),
e AS (SELECT *, {poisson_sql('u')} AS times FROM d), v AS (SELECT state, boot_id, sum(s * times) / sum(n * times) AS value FROM e WHERE times > 0 GROUP BY state, boot_id)
SELECT state, {r('quantile_cont(value, 0.025) AS low', 'quantile_cont(value, 0.975) AS high', digits=3)} FROM v GROUP BY state""")
def bootstrap_quantiles(spark, sf_dir):
    """Bounds of the mean interior wait of each state, trajectories being drawn anew 200 times."""
    inner = waits.interior(obs(spark, sf_dir)).groupBy("traj", "state").agg(F.sum("wait_time").alias("s"), F.count(F.lit(1)).alias("n"))
    mean = lambda times: F.sum(F.col("s") * times) / F.sum(F.col("n") * times)
    return rounded(bootstrap.interval(bootstrap.estimates(inner, KEY, ["state"], REPLICATES, mean), ["state"], "value"), 3)


def _form(alpha: str) -> str:
    return f"((abs(t - delta)::DOUBLE) ** ({alpha}) - 2 * (t::DOUBLE) ** ({alpha}) + ((t + delta)::DOUBLE) ** ({alpha})) / (2 * (delta::DOUBLE) ** ({alpha}))"


#: The amplitude of a form's products with the curve and with itself, and the rest of squares.
_AMPLITUDE = "greatest({0}y / greatest({0}f, 1e-300), 0)"
_REST = f"({_AMPLITUDE} ** 2 * {{0}}f - 2 * {_AMPLITUDE} * {{0}}y + yy)"
_GOLDEN = repr((math.sqrt(5) - 1) / 2)


@query(f"""WITH RECURSIVE {CVV}, c AS (SELECT delta, t, sum / cnt AS cvv FROM sums), z AS (SELECT delta, t, cvv / max(CASE WHEN t = 0 THEN cvv END) OVER (PARTITION BY delta) AS y FROM c),
p AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY delta) AS points, sum(y * y) OVER (PARTITION BY delta) AS yy FROM z WHERE y IS NOT NULL AND t <= 4 * delta) WHERE points >= 3),
g AS (SELECT delta, k, sum(f * y) AS gy, sum(f * f) AS gf, any_value(yy) AS yy FROM (SELECT p.*, k, {_form('0.05 + k * (1.9::DOUBLE / 76)')} AS f FROM p, range(77) r(k)) GROUP BY delta, k),
o AS (SELECT delta, arg_min(k, {_REST.format('g')} ORDER BY k) AS k FROM g GROUP BY delta),
s AS (SELECT delta, 0 AS i, 0.05 + greatest(k - 1, 0) * (1.9::DOUBLE / 76) AS a, 0.05 + least(k + 1, 76) * (1.9::DOUBLE / 76) AS b FROM o
  UNION ALL SELECT delta, i + 1, CASE WHEN {_REST.format('c')} <= {_REST.format('d')} THEN a ELSE b - {_GOLDEN} * (b - a) END, CASE WHEN {_REST.format('c')} <= {_REST.format('d')} THEN a + {_GOLDEN} * (b - a) ELSE b END
  FROM (SELECT delta, i, a, b, sum(c * y) AS cy, sum(c * c) AS cf, sum(d * y) AS dy, sum(d * d) AS df, any_value(yy) AS yy
    FROM (SELECT s.*, y, yy, {_form(f'b - {_GOLDEN} * (b - a)')} AS c, {_form(f'a + {_GOLDEN} * (b - a)')} AS d FROM s JOIN p USING (delta) WHERE i < 60) GROUP BY delta, i, a, b)),
e AS (SELECT delta, (a + b) / 2 AS alpha FROM s WHERE i = 60), m AS (SELECT delta, alpha, sum(f * y) AS ey, sum(f * f) AS ef, any_value(yy) AS yy, any_value(points) AS points FROM (SELECT p.*, alpha, {_form('alpha')} AS f FROM e JOIN p USING (delta)) GROUP BY delta, alpha)
SELECT delta, {r('alpha', f"{_AMPLITUDE.format('e')} AS amplitude", f"{_REST.format('e')} AS rest", digits=5)}, points FROM m""")
def fit_beta(spark, sf_dir):
    """A fractional velocity correlation fitted to each lag's curve."""
    curves = lags.correlation_curves(lags.correlation_sums(_velocities(spark, sf_dir), []), [])
    return rounded(fits.fit_alpha(curves.withColumn("lag", F.col("delta")), ["delta"], delta="lag"), 5)


@query(f"""WITH {SIM}, {INTERIOR}, b AS (SELECT state, wait_time AS x, count(*) * 1728000 / (1728000 - wait_time) AS w FROM inner_waits WHERE window_size = 1728000 AND wait_time < 1728000 GROUP BY state, wait_time)
SELECT state, {r('x', digits=3)}, {r('sum(w) OVER (PARTITION BY state ORDER BY x) / count(*) OVER (PARTITION BY state) AS cdf', digits=9)} FROM b""")
def ecdf_simple(spark, sf_dir):
    return _curve(dist.ecdf_simple(waits.interior(obs(spark, sf_dir)).where("window_size = 1728000"), ["state"], "wait_time", 1_728_000.0))


@query(f"""WITH {SIM}, {INTERIOR}, b AS (SELECT state, window_size, wait_time AS x, count(*) * window_size / (window_size - wait_time) AS w FROM inner_waits WHERE wait_time < window_size GROUP BY state, window_size, wait_time)
SELECT state, window_size, {r('x', digits=3)}, {r('sum(w) OVER (PARTITION BY state, window_size ORDER BY x) / count(*) OVER (PARTITION BY state, window_size) AS cdf', digits=9)} FROM b""")
def ecdf_simple_by_size(spark, sf_dir):
    """ecdf_simple for each size of window, so that every trajectory counts."""
    keys = ["state", "window_size"]
    return _curve(dist.ecdf_simple(waits.interior(obs(spark, sf_dir)), keys, "wait_time", "window_size"), keys)


@query(f"""WITH {SIM}, {INTERIOR}, g AS (SELECT unnest(range(41)) * 43200.0::DOUBLE AS x), c AS (SELECT state, x, count(*) FILTER (wait_time <= x) / count(*) AS cdf FROM inner_waits, g GROUP BY state, x),
m AS (SELECT state, (x + lead(x) OVER w) / 2 AS x, cdf FROM c WINDOW w AS (PARTITION BY state ORDER BY x)), n AS (SELECT *, lead(x) OVER w AS x_to, lead(cdf) OVER w AS c FROM m WHERE x IS NOT NULL WINDOW w AS (PARTITION BY state ORDER BY x))
SELECT state, {r('x', 'x_to', digits=3)}, {r('(c - cdf) / (x_to - x) * 86400 AS pmf')} FROM n WHERE x_to IS NOT NULL""")
def discrete_bars(spark, sf_dir):
    found = dist.discrete_bars(dist.ecdf_on(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time", GRID), ["state"])
    return rounded(found.withColumn("pmf", F.col("pmf") * 86_400))


@query(f"""WITH {TRACK}, m AS (SELECT t, sum(x::DECIMAL(28, 6))::DOUBLE / count(x) AS mx, sum(y::DECIMAL(28, 6))::DOUBLE / count(y) AS my FROM track GROUP BY t)
SELECT traj, t, x - mx AS x, y - my AS y FROM track JOIN m USING (t)""")
def drift_free(spark, sf_dir):
    """Not rounded: sums are exact, so that either side takes the same doubles."""
    return moments.without_drift(tables.track(spark, sf_dir), ["t"], ["x", "y"]).select("traj", "t", "x", "y")


@query(f"WITH {TRACK}, k AS (SELECT *, dense_rank() OVER (PARTITION BY condition ORDER BY traj) - 1 AS n FROM track) SELECT traj, t, condition, {r('x')} FROM k WHERE n % 3 = 0")
def every_third(spark, sf_dir):
    return rounded(moments.every(tables.track(spark, sf_dir), ["traj"], 3, ["condition"]).select("traj", "t", "condition", "x"))


@query(f"WITH {MOVIE_WAITS} SELECT state, {r('avg((wait_time < 3600)::INT) AS mean', 'stddev_samp((wait_time < 3600)::INT) AS std')}, count(*) AS count FROM waits WHERE wait_type = 'interior' GROUP BY state")
def fast_waits(spark, sf_dir):
    inner = waits.interior(waits.waits_of_movie(tables.movie(spark, sf_dir), KEY))
    return rounded(moments.fraction(inner, ["state"], F.col("wait_time") < 3600))


@query(f"""WITH {SIM}, {FIT}, {auto_bins_sql('outer_waits', 'wait_time')}, h AS (SELECT state, least(floor((wait_time - low) / (high - low) * bins)::BIGINT + 1, bins) AS bin, count(*) AS w FROM outer_waits JOIN spans USING (state) GROUP BY ALL),
z AS (SELECT state, w, low + (bin - 0.5)::DOUBLE * ((high - low) / bins) AS x, sum(w) OVER (PARTITION BY state) * ((high - low) / bins) AS z FROM h JOIN spans USING (state)), n AS (SELECT state, count(*) AS n FROM inner_waits GROUP BY state),
p0 AS (SELECT z.*, p.x AS x0, p.cdf AS y0 FROM z ASOF LEFT JOIN padded p ON z.state = p.state AND z.x >= p.x), p1 AS (SELECT p0.*, p.x AS x1, p.cdf AS y1 FROM p0 ASOF LEFT JOIN padded p ON p0.state = p.state AND p0.x <= p.x),
e AS (SELECT state, x, CASE WHEN x0 = x THEN y0 ELSE coalesce(y0 + (y1 - y0) * (x - x0) / (x1 - x0), y0, y1) END * (-b / nullif(a, 0)) AS i, 1 - w / z / nullif(a, 0) AS o, (z * a) ** 2 / w AS ow, 2 * n / ln(2 / 0.32) AS iw FROM p1 JOIN fit USING (state) JOIN n USING (state))
SELECT state, {r('x', digits=3)}, {r('(i * iw + o * ow) / (iw + ow) AS cdf')} FROM e""")
def ecdf_combined(spark, sf_dir):
    """The wait distribution of each state from waits seen whole and waits cut off together."""
    curves = estimates.points(obs_once(spark, sf_dir), ["state"], KEY)
    found = estimates.combined(curves, estimates.summary(curves, ["state"]), ["state"])
    return found.select("state", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("cdf", 6) + F.lit(0.0)).alias("cdf"))


@query(f"""WITH {SIM}, {INTERIOR}, {auto_bins_sql('inner_waits', 'wait_time')},
h AS (SELECT state, least(floor((wait_time - low) / (high - low) * bins)::BIGINT + 1, bins) AS bin, count(*)::DOUBLE AS weight FROM inner_waits JOIN spans USING (state) GROUP BY ALL)
SELECT state, bin, {r('low + (bin - 0.5)::DOUBLE * ((high - low) / bins) AS x', '(high - low) / bins AS width', 'weight AS weight', digits=3)}, {r('weight / sum(weight) OVER (PARTITION BY state) / ((high - low) / bins) * 86400 AS density')} FROM h JOIN spans USING (state)""")
def hist_auto(spark, sf_dir):
    """Waits seen whole in bins that the waits themselves set: every one lies in a bin."""
    found = dist.histogram_auto(waits.interior(obs(spark, sf_dir)), ["state"], "wait_time").withColumn("density", F.col("density") * DAYS)
    return found.select("state", "bin", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in ("x", "width", "weight")), (F.round("density", 6) + F.lit(0.0)).alias("density"))


@query()
def polymer_theory(spark, sf_dir):
    """Closed forms that need special functions, at the frames that occur."""
    t = F.col("t").cast("double")
    times = tables.track(spark, sf_dir).select("t").distinct()
    return rounded(
        times.select(
            "t", special.mode_correlation(2, t, 0.5, 1.0, 100.0).alias("mode"), special.middle_msd(t, 0.8, 1.0, 100.0).alias("msd"),
            special.mode_velocity_correlation(t, F.lit(3.0), 2, 0.5, 1.0, 100.0).alias("mode_cvv"), special.two_locus_correlation(t, F.lit(3.0), 4.0, 1.0).alias("two_loci"),
        )
    )
