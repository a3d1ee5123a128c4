"""The driver's tables as trajectories, movies and state changes; times in seconds, as doubles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwellspark.operators.waits import islands

ORIGIN = "2024-01-01"
DAY = 86_400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, t, state, x: users as trajectories, event types as states, values as positions."""
    seconds = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{ORIGIN}', ts) / 1e6D")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("traj"), seconds.alias("t"), F.col("event_type").alias("state"), F.col("value").alias("x"))


def state_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, state, start_time, end_time, window_start, window_end: runs of equal states, watched from the third day
    on for a quarter of a day, ten or twenty days."""
    runs = islands(movie(spark, sf_dir), ["traj"])
    after = F.lead("first_t").over(Window.partitionBy("traj").orderBy("island"))
    end = F.when(F.col("traj") % 3 == 0, 0.25 * DAY).when(F.col("traj") % 3 == 1, 10 * DAY).otherwise(20 * DAY)
    found = runs.select("traj", "state", (F.col("first_t") - 3 * DAY).alias("start_time"), (after - 3 * DAY).alias("end_time"), F.lit(0.0).alias("window_start"), end.alias("window_end"))
    return found.where(F.col("end_time").isNotNull() & (F.col("start_time") < F.col("window_end")) & (F.col("end_time") > F.col("window_start")))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, t, x, y: customers as trajectories, their orders' rank in time as frames, price and key as positions."""
    orders = table(spark, sf_dir, "orders")
    frame = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1
    return orders.select(F.col("o_custkey").alias("traj"), frame.cast("long").alias("t"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 97).cast("double").alias("y"), F.col("o_orderpriority").alias("condition"))


def two_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """traj, t, X1..Z2: positions of two spots in a frame, with every seventh second spot missing, as where two are one."""
    o = table(spark, sf_dir, "orders")
    frame = (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) - 1).cast("long")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    first = {"X1": price / 1000, "Y1": (key % 13) / 10.0, "Z1": (key % 7) / 10.0}
    second = {"X2": price / 1000 + (key % 5) / 20.0, "Y2": (key % 13 + key % 3) / 10.0, "Z2": (key % 7) / 10.0 + 0.05}
    there = key % 7 != 0
    return o.select(F.col("o_custkey").alias("traj"), frame.alias("t"), *(c.alias(n) for n, c in first.items()), *(F.when(there, c).alias(n) for n, c in second.items()))


# The same views as DuckDB's, for oracles.
MOVIE = f"""movie AS (SELECT user_id AS traj, (epoch_us(ts) - epoch_us(TIMESTAMP '{ORIGIN}')) / 1e6 AS t, event_type AS state, value AS x FROM events),
marked AS (SELECT *, (lag(state) OVER (PARTITION BY traj ORDER BY t) IS DISTINCT FROM state)::INT AS fresh FROM movie),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY traj ORDER BY t) - 1 AS island FROM marked),
runs AS (SELECT traj, island, min(state) AS state, min(t) AS first_t, max(t) AS last_t FROM numbered GROUP BY traj, island)"""
SIM = f"""{MOVIE},
changes AS (SELECT traj, state, first_t - 259200.0 AS start_time, lead(first_t) OVER (PARTITION BY traj ORDER BY island) - 259200.0 AS end_time, 0.0::DOUBLE AS window_start,
  CASE traj % 3 WHEN 0 THEN 21600.0 WHEN 1 THEN 864000.0 ELSE 1728000.0 END::DOUBLE AS window_end FROM runs),
sim AS (SELECT * FROM changes WHERE end_time IS NOT NULL AND start_time < window_end AND end_time > window_start),
clipped AS (SELECT traj, state, greatest(start_time, window_start) AS start_time, least(end_time, window_end) AS end_time, window_end - window_start AS window_size,
  row_number() OVER (PARTITION BY traj ORDER BY start_time) AS rank_order, count(*) OVER (PARTITION BY traj) AS num_waits FROM sim),
obs AS (SELECT *, end_time - start_time AS wait_time, CASE WHEN num_waits = 1 THEN 'full exterior' WHEN rank_order = num_waits THEN 'right exterior' WHEN rank_order = 1 THEN 'left exterior' ELSE 'interior' END AS wait_type FROM clipped)"""
TRACK = """track AS (SELECT o_custkey AS traj, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t, o_totalprice / 1000 AS x, (o_orderkey % 97)::DOUBLE AS y, o_orderpriority AS condition FROM orders)"""
FLAT = """flat AS (SELECT o_custkey AS traj, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS t,
  o_totalprice / 1000 AS X1, (o_orderkey % 13) / 10.0::DOUBLE AS Y1, (o_orderkey % 7) / 10.0::DOUBLE AS Z1,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 1000 + (o_orderkey % 5) / 20.0::DOUBLE END AS X2, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 13 + o_orderkey % 3) / 10.0::DOUBLE END AS Y2,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 7) / 10.0::DOUBLE + 0.05::DOUBLE END AS Z2 FROM orders)"""
