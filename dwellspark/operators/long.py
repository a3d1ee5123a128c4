"""Waits and looks up in trajectories of any length: what waits and frames do in a window by trajectory, along ranges of time.

A range needs little of the ones before it - the last state, how many runs there were - so one trajectory of all frames is
worked on by all tasks (ordered.along). For many short trajectories the windows are cheaper."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellspark.operators.ordered import After, Before, Last, Sum, Whole, along
from dwellspark.operators.waits import _kind


def waits_of_long_movie(movie: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state") -> DataFrame:
    """waits_of_movie: rank_order, start_time, end_time, wait_time, state, min_waits, max_waits, wait_type, window_size. Frames are read once;
    what is numbered is the starts of runs, and each trajectory's last frame. A null state is a run of its own in each frame."""
    frames = movie.select(*keys, F.col(t).alias("t"), F.col(state).alias("state"))
    seen = along(frames, keys, ["t"], _before=Before(F.struct("t", "state")), _after=After(F.col("t")))
    fresh = F.col("_before.state").isNull() | F.col("state").isNull() | (F.col("_before.state") != F.col("state"))
    # A run's start, and behind a trajectory's last frame its end: an array of one or two rows.
    start = F.when(fresh, F.struct(F.col("t"), F.lit(0).alias("end"), F.col("state"), F.col("_before.t").alias("before")))
    end = F.when(F.col("_after").isNull(), F.struct(F.col("t"), F.lit(1).alias("end"), F.lit(None).cast(frames.schema["state"].dataType).alias("state"), F.col("t").alias("before")))
    marks = seen.select(*keys, F.explode(F.array_compact(F.array(start, end))).alias("m")).select(*keys, "m.*")
    is_start = F.col("end") == 0
    steps = along(
        marks, keys, ["t", "end"], _n=Sum(is_start.cast("long")), _next=After(F.struct("t", "end", "before")),
        _last=Whole(F.col("t"), most=True), _first=Whole(-F.col("t"), most=True),
    )
    # The run's own last frame is the one before the next start; the last run ends with the last frame.
    stop, last = F.col("_next.t"), F.col("_next.before")
    return steps.where(is_start).select(
        *keys, (F.col("_n") - 1).alias("rank_order"), F.col("t").alias("start_time"), stop.alias("end_time"), (stop - F.col("t")).alias("wait_time"), "state",
        (last - F.col("t")).alias("min_waits"), (stop - F.coalesce("before", "t")).alias("max_waits"), _kind(F.col("before").isNull(), F.col("_next.end") == 1).alias("wait_type"),
        (F.col("_last") + F.col("_first")).alias("window_size"),
    )


def as_of_long(changes: DataFrame, frames: DataFrame, keys: Sequence[str], clip_end: bool = True) -> DataFrame:
    """frames.as_of: keys, t, state, the state whose start is the last at or before each frame, null before the first, and with clip_end after the last one's end."""
    known = F.struct(F.col("state").alias("state"))
    starts = changes.select(*keys, F.col("start_time").alias("t"), known.alias("_s"), F.col("end_time").alias("_end"), F.lit(0).alias("_q"))
    asked = frames.select(*keys, "t").withColumns({"_s": F.lit(None).cast(starts.schema["_s"].dataType), "_end": F.lit(None).cast(starts.schema["_end"].dataType), "_q": F.lit(1)})
    met = along(starts.unionByName(asked), keys, ["t", "_q"], _now=Last(F.col("_s")), _ends=Whole(F.col("_end"), most=True)).where("_q = 1")
    state = F.col("_now.state")
    return met.select(*keys, "t", (F.when(F.col("t") <= F.col("_ends"), state) if clip_end else state).alias("state"))


def numbered_waits(movie: DataFrame, keys: Sequence[str], t: str = "t", state: str = "state") -> DataFrame:
    """keys, t, state and rank_order of each frame: the number of its run of equal states, from 0."""
    seen = along(movie.select(*keys, F.col(t).alias("t"), F.col(state).alias("state")), keys, ["t"], _before=Before(F.col("state")))
    fresh = F.col("_before").isNull() | F.col("state").isNull() | (F.col("_before") != F.col("state"))
    numbered = along(seen.select(*keys, "t", "state", fresh.cast("long").alias("_fresh")), keys, ["t"], rank_order=Sum(F.col("_fresh")))
    return numbered.select(*keys, "t", "state", (F.col("rank_order") - 1).alias("rank_order"))
