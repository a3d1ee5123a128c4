"""State changes seen at the frames of a movie."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(changes: DataFrame, frames: DataFrame, keys: Sequence[str], clip_end: bool = True) -> DataFrame:
    """keys, t, state: the state whose start is the last at or before each frame (keys, t); null before the first, and with
    clip_end after the last one's end. Starts and frames are sorted together once, instead of joined."""
    last_end = F.max("end_time").over(Window.partitionBy(*keys))
    starts = changes.select(*keys, F.col("start_time").alias("t"), F.struct(F.col("state").alias("state"), last_end.alias("end")).alias("_s"), F.lit(0).alias("_q"))
    asked = frames.select(*keys, "t").withColumn("_s", F.lit(None).cast(starts.schema["_s"].dataType)).withColumn("_q", F.lit(1))
    w = Window.partitionBy(*keys).orderBy("t", "_q").rowsBetween(Window.unboundedPreceding, 0)
    found = starts.unionByName(asked).withColumn("_s", F.last("_s", True).over(w)).where("_q = 1")
    state = F.col("_s.state")
    return found.select(*keys, "t", (F.when(F.col("t") <= F.col("_s.end"), state) if clip_end else state).alias("state"))


def frame_grid(df: DataFrame, keys: Sequence[str], step: float, count: int) -> DataFrame:
    """keys, t: the same frames for each trajectory, at whole multiples of step."""
    return df.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("_i")).select(*keys, (F.col("_i") * F.lit(float(step))).alias("t"))


def quantised(changes: DataFrame, keys: Sequence[str], step: float, count: int) -> DataFrame:
    """State changes as frames at multiples of step would show them: each starts at the first frame at or after it; of
    several before one frame the last shows; a change to the state that shows already doesn't. keys, state, start_time,
    end_time, window_start, window_end, where the window's ends are the first and last frame that see the trajectory:
    the last is strictly before its end."""
    return _shown(changes, keys, lambda c: F.greatest(F.ceil(c / F.lit(float(step))), F.lit(0)), lambda i: i * F.lit(float(step)), count)


def quantised_on(changes: DataFrame, keys: Sequence[str], times: Sequence[float]) -> DataFrame:
    """quantised for frames at any times, in order; a list that is short beside the data."""
    grid = F.array(*(F.lit(float(t)) for t in times))
    return _shown(changes, keys, lambda c: F.size(F.filter(grid, lambda t: t < c)), lambda i: F.get(grid, i.cast("int")), len(times))


def _shown(changes: DataFrame, keys: Sequence[str], index: Callable[[Column], Column], at: Callable[[Column], Column], count: int) -> DataFrame:
    """index: the number of frames before a time. at: the time of a frame."""
    whole = Window.partitionBy(*keys)
    own = changes.withColumn("_i", index(F.col("start_time"))).withColumn("_first", F.min("_i").over(whole)).withColumn("_end", F.max("end_time").over(whole))
    own = own.withColumn("_last", F.least(index(F.col("_end")) - 1, F.lit(count - 1))).where(F.col("_i") <= F.col("_last"))
    shown = own.groupBy(*keys, "_i", "_first", "_last").agg(F.max_by("state", F.struct("start_time", "end_time")).alias("state"))
    w = Window.partitionBy(*keys).orderBy("_i")
    new = shown.withColumn("_before", F.lag("state").over(w)).where(F.col("_before").isNull() | (F.col("_before") != F.col("state")))
    new = new.withColumn("_next", F.coalesce(F.lead("_i").over(w), F.col("_last")))
    return new.select(*keys, "state", *(at(F.col(i)).alias(c) for i, c in (("_i", "start_time"), ("_next", "end_time"), ("_first", "window_start"), ("_last", "window_end"))))


def nearest_times(df: DataFrame, keys: Sequence[str], t: str, wanted: Sequence[float]) -> DataFrame:
    """keys, wanted, t: the time of each trajectory, from its first on, that is nearest to each wanted one; the earlier in
    a tie. One pass of an aggregate for all wanted times."""
    since = df.withColumn("_t", F.col(t) - F.min(t).over(Window.partitionBy(*keys)))
    best = [F.min(F.struct(F.abs(F.col("_t") - F.lit(float(x))).alias("off"), F.col("_t").alias("t"))).alias(f"_{i}") for i, x in enumerate(wanted)]
    found = since.groupBy(*keys).agg(*best)
    rows = F.array(*(F.struct(F.lit(float(x)).alias("wanted"), F.col(f"_{i}.t").alias("t")) for i, x in enumerate(wanted)))
    return found.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.wanted", "r.t")


def selected(df: DataFrame, keys: Sequence[str], t: str, wanted: Sequence[float], off: float | None = None) -> DataFrame:
    """Rows at the times, from each trajectory's first on, that are nearest to the wanted ones; of a uniform grid the step as ti. off: fail if a time
    is farther than this share of it from a whole number, 0.01 for one percent, for then no frame is near enough to those of a movie."""
    chosen = nearest_times(df, keys, t, wanted).select(*keys, "t").distinct()
    if off is not None:
        far = F.abs(1 - F.try_divide(F.col("t"), F.round("t"))) > off
        chosen = chosen.withColumn("t", F.when(far | (F.round("t") == 0) & (F.col("t") != 0), F.raise_error(F.lit("no times are near enough to those wanted"))).otherwise(F.col("t")))
    first = df.groupBy(*keys).agg(F.min(t).alias("_first"))
    moved = df.join(first, list(keys)).withColumn(t, F.col(t) - F.col("_first")).drop("_first")
    found = moved.join(chosen.withColumnRenamed("t", t), [*keys, t], "left_semi")
    steps = {b - a for a, b in zip(wanted, wanted[1:])}
    return found.withColumn("ti", F.round(F.col(t) / steps.pop()).cast("long")) if len(steps) == 1 else found


def long_movie(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, t, value: a row for each column that isn't a key, whose name is the time."""
    values = [c for c in wide.columns if c not in keys]
    return wide.unpivot(list(keys), values, "t", "value").withColumn("t", F.col("t").cast("long"))


def at_levels(df: DataFrame, **levels: object) -> DataFrame:
    """Rows where each named part of the key has a value, without these columns."""
    for name, value in levels.items():
        df = df.where(F.col(name) == F.lit(value))
    return df.drop(*levels)
