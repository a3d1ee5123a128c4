"""Waits of a stream of frames: the batch operator's islands, kept open between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def waits_of_stream(frames: DataFrame, key: str, t: str = "t", state: str = "state") -> DataFrame:
    """key, state, start_time, end_time, wait_time: each wait once its trajectory shows another state. frames arrive in
    the order of time within a trajectory, late ones within a micro-batch; the last wait stays open. What is kept is one
    state and one time for each trajectory."""
    key_type, state_type = (frames.schema[c].dataType.simpleString() for c in (key, state))

    def step(own: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(t)
        now, since = kept.get if kept.exists else (None, None)
        out = []
        for at, what in zip(rows[t].tolist(), rows[state].tolist()):
            if since is None:
                now, since = what, at
            elif what != now:
                out.append((own[0], now, since, at, at - since))
                now, since = what, at
        kept.update((now, since))
        yield pd.DataFrame(out, columns=[key, state, "start_time", "end_time", "wait_time"])

    return frames.groupBy(key).applyInPandasWithState(
        step, f"{key} {key_type}, {state} {state_type}, start_time double, end_time double, wait_time double", f"now {state_type}, since double", "append", GroupStateTimeout.NoTimeout
    )


def correlation_sums(products: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sums of a stream of velocity products, by group, lag and time, as the batch operator's; complete or update mode."""
    from dwellspark.operators.lags import correlation_sums as sums

    return sums(products, groups)
