"""Waiting times in a state, exact or from frames, with the way in which the window cuts them off."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERIOR, LEFT, RIGHT, FULL = "interior", "left exterior", "right exterior", "full exterior"


def _kind(first: Column, last: Column) -> Column:
    return F.when(first & last, FULL).when(last, RIGHT).when(first, LEFT).otherwise(INTERIOR)


def islands(movie: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state") -> DataFrame:
    """Runs of equal states in consecutive frames: keys, island (0-based), state, first_t, last_t. A null state is a run
    of its own in each frame."""
    w = Window.partitionBy(*keys).orderBy(t)
    fresh = (F.lag(state).over(w).isNull() | F.col(state).isNull() | (F.lag(state).over(w) != F.col(state))).cast("int")
    numbered = movie.withColumn("island", F.sum(fresh).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.groupBy(*keys, "island").agg(F.min(state).alias("state"), F.min(t).alias("first_t"), F.max(t).alias("last_t"))


def waits_of_movie(movie: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state") -> DataFrame:
    """Waits seen in frames. A wait ends with the first frame of the next state, the last one with the last frame.
    min_waits and max_waits bound the true time: between the state's own frames, and between the neighbours'."""
    runs = islands(movie, keys, t, state)
    w, whole = Window.partitionBy(*keys).orderBy("island"), Window.partitionBy(*keys)
    after, before = F.lead("first_t").over(w), F.lag("last_t").over(w)
    end = F.coalesce(after, F.col("last_t"))
    return runs.select(
        *keys,
        F.col("island").cast("long").alias("rank_order"),
        F.col("first_t").alias("start_time"),
        end.alias("end_time"),
        (end - F.col("first_t")).alias("wait_time"),
        "state",
        (F.col("last_t") - F.col("first_t")).alias("min_waits"),
        (end - F.coalesce(before, F.col("first_t"))).alias("max_waits"),
        _kind(before.isNull(), after.isNull()).alias("wait_type"),
        (F.max("last_t").over(whole) - F.min("first_t").over(whole)).alias("window_size"),
    )


def waits_of_changes(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Waits of exact state changes (state, start_time, end_time, window_start, window_end), clipped to the window. The
    first and the last of a trajectory are cut off, whether or not they reach the window's end. Equal starts, which
    changes of a state don't have, are numbered by their ends."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy("start_time", "end_time"))
    clipped = changes.select(
        *keys, "state",
        F.greatest("start_time", "window_start").alias("start_time"),
        F.least("end_time", "window_end").alias("end_time"),
        (F.col("window_end") - F.col("window_start")).alias("window_size"),
        rank.cast("long").alias("rank_order"),
        F.count(F.lit(1)).over(w).alias("num_waits"),
    )
    first, last = F.col("rank_order") == 1, F.col("rank_order") == F.col("num_waits")
    return clipped.withColumn("wait_time", F.col("end_time") - F.col("start_time")).withColumn("wait_type", _kind(first, last))


def changes_of_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State changes of islands (island, state, first_t, last_t), watched from each trajectory's first frame to its last: the window is the data's own span. A state
    lasts until the next one's first frame, the last one until the last frame."""
    w, whole = Window.partitionBy(*keys).orderBy("island"), Window.partitionBy(*keys)
    end = F.coalesce(F.lead("first_t").over(w), F.col("last_t"))
    ends = (F.min("first_t").over(whole).alias("window_start"), F.max("last_t").over(whole).alias("window_end"))
    return runs.select(*keys, "state", F.col("first_t").alias("start_time"), end.alias("end_time"), *ends)


def waits_in_own_windows(movie: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state") -> DataFrame:
    """waits_of_changes of changes_of_runs of islands: runs of equal states, watched from each trajectory's first frame to its last. Frames are sorted once, and
    no run is put together: a run starts with a frame of another state than the one before, and ends with the next run's start."""
    w = Window.partitionBy(*keys).orderBy("_t")
    # In the same order, so that Spark goes over a trajectory once for it and for neighbours.
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fresh = F.lag("state").over(w).isNull() | F.col("state").isNull() | (F.lag("state").over(w) != F.col("state"))
    frames = movie.select(*keys, F.col(t).alias("_t"), F.col(state).alias("state"))
    starts = frames.withColumns({"_fresh": fresh, "_start": F.min("_t").over(whole), "_end": F.max("_t").over(whole)}).where("_fresh")
    after = {f"_next{i}": F.lead(F.struct("_t"), i).over(w) for i in (1, 2)}
    ranked = starts.withColumns({"rank_order": F.row_number().over(w).cast("long"), "num_waits": F.count(F.lit(1)).over(whole)} | after)
    # Frames without a time come first; a run of them that goes on starts with the first time there is.
    begins = lambda at, behind: F.coalesce(at, F.when(behind.isNull() | (behind["_t"] > F.col("_start")), F.col("_start")))
    one, two = F.col("_next1"), F.col("_next2")
    timed = ranked.withColumns({"start_time": F.coalesce(begins(F.col("_t"), one), "_start"), "end_time": F.coalesce(F.when(one.isNotNull(), begins(one["_t"], two)), "_end")})
    return timed.select(
        *keys, "state", "start_time", "end_time", (F.col("_end") - F.col("_start")).alias("window_size"), "rank_order", "num_waits",
        (F.col("end_time") - F.col("start_time")).alias("wait_time"), _kind(F.col("rank_order") == 1, one.isNull()).alias("wait_type"),
    )


def interior(waits: DataFrame) -> DataFrame:
    return waits.where(F.col("wait_type") == INTERIOR)


def exterior(waits: DataFrame) -> DataFrame:
    """Waits cut off at one end."""
    return waits.where(F.col("wait_type").isin(LEFT, RIGHT))


def mean_lifetimes(waits: DataFrame, keys: Sequence[str], isclose: float = 1e-5) -> DataFrame:
    """state, mean_wait: the time watched for each end of a wait that is seen, dealt out by the states' shares of it. An
    end is seen unless it is the window's."""
    start = F.min("start_time").over(Window.partitionBy(*keys))
    own = waits.withColumn("_seen", (F.abs(F.col("end_time") - start - F.col("window_size")) > 1e-8 + isclose * F.col("window_size")).cast("int"))
    by_state = own.groupBy("state").agg(F.sum("wait_time").alias("spent"), F.sum("_seen").alias("ends"))
    watched = waits.groupBy(*keys).agg(F.first("window_size").alias("w")).agg(F.sum("w")).scalar()
    ends, spent = by_state.agg(F.avg("ends")).scalar(), by_state.agg(F.sum("spent")).scalar()
    return by_state.select("state", (F.try_divide(watched, ends) * F.try_divide(F.col("spent"), spent)).alias("mean_wait"))
