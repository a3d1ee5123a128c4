"""Connected components of a graph of DataFrames, and of a task's own links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellspark.llm.common import stored


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of the links (a, b), sorted, and the least vertex that each reaches. Labels sink along links and then
    along themselves until nothing changes."""
    vertex, at = np.unique(np.r_[a, b], return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(vertex))
    while True:
        new = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return vertex, vertex[label]
        label = new


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links that connect the same: each vertex that isn't a root, and its root."""
    vertex, root = roots(a, b)
    own = vertex != root
    return vertex[own], root[own]


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long; either order, repeats and loops allowed). vertex, component (the least vertex reached) for each
    vertex with a link. Each round joins by hash and keeps one row for a vertex; a round halves paths at least, so
    a dozen do for any graph of these sizes."""
    both = links.where("a <> b").select("a", "b")
    both = stored(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("l")).select(F.col("a").alias("v"), "l"))
    while True:
        # The least label around each vertex, offered to the vertex and to the one that its label names.
        around = both.join(label, both["b"] == label["v"]).groupBy("a").agg(F.min("l").alias("low"))
        offered = around.join(label, around["a"] == label["v"]).select("v", "l", F.least("l", "low").alias("low"))
        hooked = offered.select("v", "low").unionByName(offered.where("low < l").select(F.col("l").alias("v"), "low")).groupBy("v").agg(F.min("low").alias("l"))
        up = hooked.select(F.col("v").alias("w"), F.col("l").alias("up"))
        jumped = hooked.join(up, hooked["l"] == up["w"], "left").select("v", F.least("l", F.coalesce("up", "l")).alias("new"))
        new = stored(jumped)
        if not new.join(label, "v").where("new < l").limit(1).count():
            return new.select(F.col("v").alias("vertex"), F.col("new").alias("component"))
        label = new.select("v", F.col("new").alias("l"))
