"""Two spots in a frame: labels, distances, gaps, and long and wide form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("X", "Y", "Z")


def _all(of: str, test) -> Column:
    out = F.lit(True)
    for a in AXES:
        out = out & test(F.col(f"{a}{of}"))
    return out


def label_foci(df: DataFrame) -> DataFrame:
    """foci: 'pair' where only the first spot is there, 'unp' where both are, else null."""
    one, two, none = _all("1", Column.isNotNull), _all("2", Column.isNotNull), _all("2", Column.isNull)
    return df.withColumn("foci", F.when(one & none, "pair").when(one & two, "unp"))


def fill_second(df: DataFrame) -> DataFrame:
    """The second spot is where the first is, if it is missing."""
    return df.withColumns({f"{a}2": F.coalesce(f"{a}2", f"{a}1") for a in AXES})


def scaled(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * f for c, f in factors.items()})


def separation(df: DataFrame, within: Sequence[float] = (0.25,)) -> DataFrame:
    """d<axis>, their length as distance, and pair<limit> for each limit: strictly below it."""
    out = df.withColumns({f"d{a}": F.col(f"{a}2") - F.col(f"{a}1") for a in AXES})
    out = out.withColumn("distance", F.sqrt(sum((F.col(f"d{a}") * F.col(f"d{a}") for a in AXES), F.lit(0.0))))
    return out.withColumns({f"pair{x}": F.col("distance") < x for x in within})


def number_gaps(df: DataFrame, keys: Sequence[str], columns: Sequence[str], t: str = "t", contiguous: bool = False) -> DataFrame:
    """na_id: frames so far, this one included, in which a column is missing. contiguous: fail if a trajectory leaves a frame out, which would
    be a gap that no row shows."""
    missing = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull()
    w = Window.partitionBy(*keys).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    count = F.sum(missing.cast("long")).over(w)
    if contiguous:
        step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
        count = F.when(step != 1, F.raise_error(F.lit("a trajectory leaves frames out"))).otherwise(count)
    return df.withColumn("na_id", count)


def number_waits(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """wait_id: changes so far between 'pair' and anything else."""
    paired = F.coalesce(F.col("foci") == "pair", F.lit(False)).cast("long")
    w = Window.partitionBy(*keys).orderBy(t)
    change = F.coalesce(F.abs(paired - F.lag(paired).over(w)), F.lit(0))
    return df.withColumn("_c", change).withColumn("wait_id", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def long_form(df: DataFrame, spots: Sequence[int] = (1, 2)) -> DataFrame:
    """A row for each spot, with X, Y, Z and spot instead of X1, X2 and so on."""
    rest = [c for c in df.columns if not (c[:-1] in AXES and c[-1].isdecimal())]
    entries = [F.struct(F.lit(s).alias("spot"), *(F.col(f"{a}{s}").alias(a) for a in AXES)) for s in spots]
    return df.select(*rest, F.explode(F.array(*entries)).alias("e")).select(*rest, "e.*")


def wide_form(df: DataFrame, keys: Sequence[str], spots: Sequence[int] = (1, 2)) -> DataFrame:
    """A row for each key, with the spots' columns side by side. Other columns are those of the first spot."""
    rest = [c for c in df.columns if c not in (*keys, *AXES, "spot")]
    own = [F.max(F.when(F.col("spot") == s, F.col(a))).alias(f"{a}{s}") for s in spots for a in AXES]
    return df.groupBy(*keys).agg(*own, *(F.min_by(c, "spot").alias(c) for c in rest))


#: Micrometres of a pixel and of a slice, times ten; fixed values.
UNITS = {"X1": 10 * 0.13333, "Y1": 10 * 0.13333, "Z1": 10 * 0.25, "X2": 10 * 0.13333, "Y2": 10 * 0.13333, "Z2": 10 * 0.25}


def flat_table(raw: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """From measured spots in pixels to one row a frame: labels, units, the second spot filled in, gaps, waits and dX, dY, dZ."""
    filled = fill_second(scaled(label_foci(raw), UNITS))
    numbered = number_waits(number_gaps(filled, keys, list(UNITS), t), keys, t)
    return numbered.withColumns({f"d{a}": F.col(f"{a}2") - F.col(f"{a}1") for a in AXES})


def pivoted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long form of a wide table and wide form of a long one, whichever it is."""
    wide, long = f"{AXES[0]}1" in df.columns, "spot" in df.columns and set(AXES) <= set(df.columns)
    if wide == long:
        raise ValueError("a table has either numbered columns or a spot column with X, Y and Z")
    return long_form(df) if wide else wide_form(df, keys)


def stage_number(stage: Column) -> Column:
    """Stages in time: 'ta' comes before t0, which is 0."""
    return F.when(stage == "ta", -1).otherwise(F.substring(stage, 2, 9).try_cast("int"))


#: Ways to take displacements of a flat table: rows (a label or all), the form, its spot, and what a trajectory is besides its key.
PRESETS = {
    "dvel": (None, "flat", None, []),
    "dvel_unp": ("unp", "flat", None, []),
    "dvel_unp_by_wait": ("unp", "flat", None, ["wait_id"]),
    "dvel_unp_by_wait_na": ("unp", "flat", None, ["wait_id", "na_id"]),
    "vel": (None, "long", 1, []),
    "vel_double_counted": (None, "long", None, []),
    "vel_spot2": (None, "long", 2, []),
    "vel_unp_by_wait": ("unp", "long", None, ["spot", "wait_id"]),
    "vel_pair_by_wait": ("pair", "long", None, ["spot", "wait_id"]),
}


def preset(flat: DataFrame, name: str) -> tuple[DataFrame, list[str], tuple[str, ...]]:
    """The rows of a preset, what sets its trajectories apart besides the key, and its coordinates."""
    foci, form, spot, more = PRESETS[name]
    rows = flat if foci is None else flat.where(F.col("foci") == foci)
    if form == "flat":
        return rows, more, tuple(f"d{a}" for a in AXES)
    rows = long_form(rows)
    return rows if spot is None else rows.where(F.col("spot") == spot), more, AXES


def named_by_position(df: DataFrame, names: dict[int, str], without: Sequence[str] = ()) -> DataFrame:
    """df without some columns, and then with new names for those at some places, counted from 0."""
    kept = df.drop(*without)
    if missing := [i for i in names if not 0 <= i < len(kept.columns)]:
        raise ValueError(f"no columns at {missing}")
    return kept.toDF(*(names.get(i, c) for i, c in enumerate(kept.columns)))
