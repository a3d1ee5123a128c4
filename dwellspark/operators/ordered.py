"""What needs a key's rows in order, without a task that holds all rows of a key.

Rows are dealt into ranges of (keys, order) once, and each range is worked on by itself. What it needs of the
ranges beside it - their sums, their edge rows, their last values that aren't null - is a row for each key and range,
summed up over the ranges and sent back to the ranges of keys that have several. So a key that holds most of the rows is worked on by as many tasks as its rows ask for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellspark.operators.scratch import written


@dataclass(frozen=True)
class Sum:
    """The sum up to each row and with it, 0 if there is nothing; from the last row on if back."""

    of: Column
    back: bool = False


@dataclass(frozen=True)
class Whole:
    """The sum over all rows of the key, or their greatest value."""

    of: Column
    most: bool = False

    def over(self, c: Column) -> Column:
        return F.max(c) if self.most else F.sum(c)


@dataclass(frozen=True)
class Last:
    """The last value up to each row and with it that isn't null."""

    of: Column


@dataclass(frozen=True)
class First:
    """The first value from each row on that isn't null."""

    of: Column


@dataclass(frozen=True)
class Before:
    """The value of the row before; null at a key's first row."""

    of: Column


@dataclass(frozen=True)
class After:
    """The value of the row after; null at a key's last row."""

    of: Column


Step = Sum | Whole | Last | First | Before | After


def along(df: DataFrame, keys: Sequence[str], order: Sequence[str], **steps: Step) -> DataFrame:
    """df with a column for each step, taken along the order within each key (all rows are one key if there is none). Rows of a key must differ in their
    order, else ties are in any order; nulls come first. Null keys are keys like any other. An empty table gives an empty one.
    Columns named _range, _v_... and _c_... are replaced."""
    return over(dealt(df, keys, order), keys, order, **steps).drop("_range")


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df as a table, with the number of the range (_range) that each row was dealt into."""
    return written(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))


def over(rows: DataFrame, keys: Sequence[str], order: Sequence[str], **steps: Step) -> DataFrame:
    """along, of rows that were dealt by these keys and this order already. Rows keep their range, so what is made can be gone along again."""
    value = {name: f"_v_{name}" for name in steps}
    kept = [c for c in rows.columns if c not in steps]
    rows = rows.withColumns({value[n]: s.of for n, s in steps.items()})
    place = F.struct(*order)
    edges = []
    for name, step in steps.items():
        v = F.col(value[name])
        if isinstance(step, Sum | Whole):
            edges.append((step.over(v) if isinstance(step, Whole) else F.sum(v)).alias(f"_c_{name}"))
        elif isinstance(step, Last | First):
            pick = F.max_by if isinstance(step, Last) else F.min_by
            edges.append(pick(v, F.when(v.isNotNull(), place)).alias(f"_c_{name}"))
        else:
            # In a struct, so that a null value is kept.
            edges.append((F.max_by if isinstance(step, Before) else F.min_by)(F.struct(v.alias("v")), place).alias(f"_c_{name}"))
    # A row for each key and range.
    # What lies behind a row is summed up from the end: Spark goes over the whole rest anew at each row of a frame that ends with its last one.
    ranges = Window.partitionBy(*keys).orderBy("_range")
    before, after = ranges.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    carried = []
    for name, step in steps.items():
        c = F.col(f"_c_{name}")
        if isinstance(step, Whole):
            carried.append(step.over(c).over(Window.partitionBy(*keys)).alias(f"_c_{name}"))
        elif isinstance(step, Sum):
            carried.append(F.sum(c).over(after if step.back else before).alias(f"_c_{name}"))
        elif isinstance(step, Last):
            carried.append(F.last(c, True).over(before).alias(f"_c_{name}"))
        elif isinstance(step, First):
            carried.append(F.last(c, True).over(after).alias(f"_c_{name}"))
        else:
            carried.append((F.lag(c) if isinstance(step, Before) else F.lead(c)).over(ranges)["v"].alias(f"_c_{name}"))
    parts = rows.groupBy(*keys, "_range").agg(*edges)
    parts = parts.select(F.col("_range").alias("_c_range"), *(F.col(k).alias(f"_c_key{i}") for i, k in enumerate(keys)), *carried, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_c_ranges"))
    # Only a range's first and last key can go beyond it: what is sent to all tasks is two rows for each range at most, however many keys there are.
    parts = parts.where("_c_ranges > 1").drop("_c_ranges")
    same = F.col("_range") == F.col("_c_range")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_c_key{i}"))
    joined = rows.join(F.broadcast(parts), same, "left")
    own = Window.partitionBy(*keys, "_range").orderBy(*order)
    back = Window.partitionBy(*keys, "_range").orderBy(*(F.desc(o) for o in order))
    up, on = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (own, back))
    made = {}
    for name, step in steps.items():
        v, c = F.col(value[name]), F.col(f"_c_{name}")
        if isinstance(step, Whole):
            made[name] = F.coalesce(c, step.over(v).over(Window.partitionBy(*keys, "_range")))
        elif isinstance(step, Sum):
            made[name] = F.coalesce(F.sum(v).over(on if step.back else up), F.lit(0)) + F.coalesce(c, F.lit(0))
        elif isinstance(step, Last):
            made[name] = F.coalesce(F.last(v, True).over(up), c)
        elif isinstance(step, First):
            made[name] = F.coalesce(F.last(v, True).over(on), c)
        else:
            beside = F.lag(F.struct(v.alias("v"))) if isinstance(step, Before) else F.lead(F.struct(v.alias("v")))
            there = beside.over(own)
            made[name] = F.when(there.isNotNull(), there["v"]).otherwise(c)
    return joined.select(*kept, *(c.alias(n) for n, c in made.items()))


def ranged(table: DataFrame, keys: Sequence[str], x: str, rows: int = 20_000) -> tuple[DataFrame, int, int]:
    """table with the number of the range that a row's x (a double) lies in as _range, how many ranges there are, and about how many different keys: so many rows a range,
    about, and at most four ranges for each shuffle partition, or 256. Cuts are approximate quantiles, so rows in a range vary; equal values are in one range, nulls in
    the first. The table is read once for the cuts, and isn't dealt out."""
    most = max(4 * int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), 256)
    found = table.agg(F.count(x).alias("n"), F.percentile_approx(x, [i / most for i in range(1, most)]).alias("cuts"), F.approx_count_distinct(F.struct(F.lit(0), *keys)).alias("keys")).first()
    count = max(min(-(-found["n"] // rows), most), 1)
    cuts = [float("-inf"), *sorted({found["cuts"][i * most // count - 1] for i in range(1, count)} - {float("-inf")})]
    # How many cuts a value has reached: of every so manyth one, then of those up to the next of these. Nulls reach none.
    step = math.isqrt(len(cuts) - 1) + 1
    reached = lambda which: sum(F.coalesce((c <= F.col(x)).cast("int"), F.lit(0)) for c in which) + F.lit(0)
    listed = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    placed = table.withColumn("_block", reached(F.lit(c) for c in cuts[step::step]) * step)
    placed = placed.withColumn("_range", F.col("_block") + reached(F.get(listed, F.col("_block") + i) for i in range(1, step)))
    return placed.drop("_block"), len(cuts), found["keys"]
