"""Alternating renewal processes, simulated by trajectory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Wait:
    """A distribution of waits by name: exponential (mean), gamma (shape, scale), beta (a, b), pareto (exponent, least)."""

    kind: str
    first: float
    second: float = 1.0

    def draw(self, rng: np.random.Generator, n: int) -> np.ndarray:
        if self.kind == "exponential":
            return rng.exponential(self.first, n)
        if self.kind == "gamma":
            return rng.gamma(self.first, self.second, n)
        if self.kind == "beta":
            return rng.beta(self.first, self.second, n)
        if self.kind == "pareto":
            return self.second * rng.random(n) ** (-1 / (self.first - 1))
        raise ValueError(f"no distribution is named {self.kind}")


def simulate(spark: SparkSession, waits: Sequence[Wait], window: float, offset: float, replicates: int, states: Sequence[str], seed: int = 0) -> DataFrame:
    """replicate, state, start_time, end_time, window_start, window_end: a process that starts at -|offset| in the first
    state, from the wait around time 0 to the first that ends after the window. Each replicate has a generator of its own,
    so any task gives the same again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for k in batch.column(0).to_pylist():
                rng, t, turn = np.random.default_rng((seed, k)), -abs(offset), 0
                while t <= window:
                    step = float(waits[turn % len(waits)].draw(rng, 1)[0])
                    if t + step > 0:
                        for have, new in zip(out, (k, states[turn % len(states)], t, t + step)):
                            have.append(new)
                    t, turn = t + step, turn + 1
            n = len(out[0])
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), pa.array([0.0] * n), pa.array([float(window)] * n)], ["replicate", "state", "start_time", "end_time", "window_start", "window_end"])

    return spark.range(replicates).mapInArrow(run, "replicate long, state string, start_time double, end_time double, window_start double, window_end double")
