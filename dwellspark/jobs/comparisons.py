"""Queries of the estimates that waits seen whole and waits cut off give of one distribution, side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellspark.jobs.registry import DAYS, FIT, KEY, auto_bins_sql, obs_once, query, r, rounded
from dwellspark.operators import distributions as dist
from dwellspark.operators import estimates
from dwellspark.sources.tables import SIM

#: Bins of waits seen whole: 40 over the longest window.
INNER = (0.0, 1_728_000.0, 40)
OUTER_BINS = f"""{auto_bins_sql('outer_waits', 'wait_time')}, h AS (SELECT state, least(floor((wait_time - low) / (high - low) * bins)::BIGINT + 1, bins) AS bin, count(*) AS w FROM outer_waits JOIN spans USING (state) GROUP BY ALL),
z AS (SELECT state, low + (bin - 0.5)::DOUBLE * ((high - low) / bins) AS x, w, sum(w) OVER (PARTITION BY state) * ((high - low) / bins) * nullif(a, 0) AS z FROM h JOIN spans USING (state) JOIN fit USING (state))"""


def _fitted(spark, sf_dir):
    """Points of both kinds of waits, and a row for each state with the fit."""
    curves = estimates.points(obs_once(spark, sf_dir), ["state"], KEY)
    return curves, estimates.summary(curves, ["state"])


@query(f"""WITH {SIM}, {FIT}, b AS (SELECT state, least(floor(x / 43200)::BIGINT + 1, 40) AS bin, sum(w) AS w FROM both_w WHERE x BETWEEN 0 AND 1728000 GROUP BY ALL),
d AS (SELECT state, bin, w / sum(w) OVER (PARTITION BY state) / 43200 AS density FROM b)
SELECT state, {r('(bin - 0.5)::DOUBLE * 43200 AS x', digits=3)}, {r('density * 86400 * (-b / nullif(a, 0)) AS pdf')} FROM d JOIN fit USING (state)""")
def interior_pdf_corrected(spark, sf_dir):
    """The density of whole waits by day, corrected for windows and for its height at their end."""
    curves, fit = _fitted(spark, sf_dir)
    return rounded(dist.density_of_weights(curves.where("w IS NOT NULL").select("state", "x", "w"), ["state"], fit, *INNER).withColumn("pdf", F.col("pdf") * DAYS))


@query(f"""WITH {SIM}, {FIT}, {OUTER_BINS}
SELECT state, 'interior' AS estimate, {r('x', digits=3)}, {r('cdf * (-b / nullif(a, 0)) AS cdf')} FROM padded JOIN fit USING (state)
UNION ALL SELECT state, 'exterior', {r('x', digits=3)}, {r('1 - w / z AS cdf')} FROM z""")
def interior_exterior_cdfs(spark, sf_dir):
    """Both estimates of each state's distribution: the curve of whole waits at its fitted height, and that of the waits cut off."""
    curves, fit = _fitted(spark, sf_dir)
    inner = estimates.interior_curve(curves, ["state"]).join(fit, "state").select("state", F.lit("interior").alias("estimate"), "x", (F.col("cdf") * F.col("end_share")).alias("cdf"))
    outer = dist.estimate_of_bins(estimates.exterior_bins(curves, fit, ["state"]), ["state"]).select("state", F.lit("exterior").alias("estimate"), "x", "cdf")
    found = inner.unionByName(outer)
    return found.select("state", "estimate", (F.round("x", 3) + F.lit(0.0)).alias("x"), (F.round("cdf", 6) + F.lit(0.0)).alias("cdf"))


@query(f"WITH {SIM}, {FIT}, {OUTER_BINS} SELECT state, {r('x', '1 - w / z AS cdf', '1 - w / z - 2 * sqrt(w) / z AS low', '1 - w / z + 2 * sqrt(w) / z AS high')} FROM z")
def exterior_cdf_bounds(spark, sf_dir):
    """The estimate of waits cut off with two standard errors on either side."""
    curves, fit = _fitted(spark, sf_dir)
    return rounded(dist.estimate_of_bins(estimates.exterior_bins(curves, fit, ["state"]), ["state"]))
