"""Estimates from waits seen whole and waits cut off together.

Both are counted at each length, dealt out once among the windows and once by key, and all that their curves, the fit of both and histograms need of
the lengths beside them is taken along these ranges in one pass (points). Sums for the fit and the bins are a row for each key (summary): both are tables that the estimates read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellspark.operators import distributions as dist
from dwellspark.operators.ordered import Before, First, Last, Sum, Whole, dealt, over
from dwellspark.operators.scratch import written
from dwellspark.operators.waits import INTERIOR, LEFT, RIGHT

#: Rows that are points of the curve of waits seen whole, and of that of waits cut off.
_WHOLE, _CUT = "w IS NOT NULL", "cut > 0"


def points(found: DataFrame, keys: Sequence[str], trajectory: Sequence[str]) -> DataFrame:
    """keys, x and whole, cut, waits: the waits of each length, those seen whole, cut off at one end, and all; w: the weight of ecdf_windowed; cdf: its curve where there is
    a weight; e: the curve of waits cut off, on straight lines between its points; risk: the waits of at least x. A table; a row's range is _range, and _area the integral
    of cdf since the range's first row."""
    is_whole, is_cut = F.col("wait_type") == INTERIOR, F.col("wait_type").isin(LEFT, RIGHT)
    left = F.col("window_size") - F.col("wait_time")
    counted = {"whole": F.count(F.when(is_whole, 1)), "cut": F.count(F.when(is_cut, 1)), "waits": F.count(F.lit(1)), "w": F.sum(F.when(is_whole & (left > 0), 1.0 / left))}
    counts = found.where(F.col("wait_time").isNotNull()).groupBy(*keys, F.col("wait_time").cast("double").alias("x")).agg(*(c.alias(n) for n, c in counted.items()))
    weighted = dist.survived(found, trajectory, counts).withColumn("w", F.try_divide("w", "sf")).drop("sf")
    x, w, cut = F.col("x"), F.col("w"), F.col("cut")
    steps = {"_wu": Sum(w), "_wa": Whole(w), "_w1": First(w), "_eu": Sum(cut), "_ea": Whole(cut), "_e0": Last(F.when(F.expr(_CUT), x)), "_e1": First(F.when(F.expr(_CUT), F.struct(x.alias("x"), cut.alias("n")))), "_x0": Before(x), "_up": Sum(F.col("waits")), "_all": Whole(F.col("waits"))}
    rows = over(dealt(weighted, keys, ["x"]), keys, ["x"], **steps)
    # A curve starts with 0 at 0, whatever waits of no length there are.
    share = F.try_divide(F.col("_eu"), F.col("_ea"))
    x0, y0 = F.coalesce("_e0", F.lit(0.0)), F.when(F.coalesce("_e0", F.lit(0.0)) > 0, share).otherwise(share * 0)
    y1 = F.try_divide(F.col("_eu") + F.col("_e1.n"), F.col("_ea"))
    e = F.when(F.expr(_CUT), y0).otherwise(F.coalesce(y0 + (y1 - y0) * F.try_divide(x - x0, F.col("_e1.x") - x0), y0))
    # The integral takes a curve's steps at their right ends: up to any length it grows by the height of the next point.
    height = (F.col("_wu") + F.when(F.expr(_WHOLE), 0.0).otherwise(F.col("_w1"))) / F.col("_wa")
    grown = F.coalesce((x - F.coalesce("_x0", F.lit(0.0))) * height, F.lit(0.0))
    inside = Window.partitionBy(*keys, "_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    cdf = F.when(F.expr(_WHOLE), F.when(x > 0, F.col("_wu") / F.col("_wa")).otherwise(0.0))
    return written(rows.select(*keys, "x", "whole", "cut", "waits", "w", cdf.alias("cdf"), e.alias("e"), (F.col("_all") - F.col("_up") + F.col("waits")).alias("risk"), "_eu", "_ea", "_range", F.sum(grown).over(inside).alias("_area")))


def summary(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each key of points(): a, b and end_share of exterior_fit; whole, cut: how many waits; weighted: whether ecdf_windowed has a curve; low, high and bins of auto_bins of the
    waits cut off. A table."""
    t, i, e, m = F.col("x"), F.col("_area"), F.col("e"), (F.col("x") > 0).cast("int") * (F.expr(_WHOLE).cast("int") + F.expr(_CUT).cast("int"))
    sums = {"tt": t * t, "t": t, "te": t * e, "e": e, "ti": t * i, "ii": i * i, "i": i, "ie": i * e, "m": F.lit(1.0)}
    cut = F.when(F.expr(_CUT), F.col("x"))
    # Nothing but a row for each key and range is put in order.
    parts = curves.groupBy(*keys, "_range").agg(
        *(F.sum(v * m).alias(f"_{n}") for n, v in sums.items()), F.max("_area").alias("_grown"), F.sum("whole").alias("whole"), F.sum("cut").alias("cut"), F.expr(f"max({_WHOLE})").alias("weighted"),
        F.min(cut).alias("low"), F.max(cut).alias("high"), *(dist.at_rank(F.col("_eu"), F.col("cut"), F.col("_ea"), F.col("x"))),
    )
    before = F.coalesce(F.sum("_grown").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    parts = parts.withColumn("_c", before)
    c, s = F.col("_c"), lambda n: F.col(f"_{n}")
    # The integral of a range starts at what the ranges before it add.
    whole = {"tt": s("tt"), "te": s("te"), "ti": s("ti") + c * s("t"), "ii": s("ii") + 2 * c * s("i") + c * c * s("m"), "ie": s("ie") + c * s("e")}
    there = F.max("weighted")
    squares = {n: F.sum(v) if n in ("tt", "te") else F.when(there, F.sum(v)) for n, v in whole.items()}
    found = parts.groupBy(*keys).agg(
        *(v.alias(n) for n, v in squares.items()), F.sum("whole").alias("whole"), F.sum("cut").alias("cut"), there.alias("weighted"), F.min("low").alias("low"), F.max("high").alias("high"),
        *(F.max(n).alias(n) for n in dist.RANKS),
    )
    found = dist.solved(found.where("weighted OR cut > 0")).withColumns({f"q{q}": dist.between_ranks(F.col("cut"), q) for q in (1, 3)})
    spans = dist.binned(found.withColumn("n", F.col("cut")), ["low", "high", "bins"])
    return written(spans.select(*keys, "a", "b", "end_share", "whole", "cut", "weighted", "low", "high", "bins"))


def _middle(bin: Column) -> Column:
    return F.col("low") + (bin - 0.5) * ((F.col("high") - F.col("low")) / F.col("bins"))


def _bin() -> Column:
    return F.least(F.floor((F.col("x") - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")) + 1, F.col("bins"))


def interior_curve(curves: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x, cdf of ecdf_windowed, after a row of cdf 0 at 0."""
    starts = curves.groupBy(*keys).agg(F.expr(f"max({_WHOLE})").alias("_w")).where("_w").select(*keys, F.lit(0.0).alias("x"), F.lit(0.0).alias("cdf"))
    return curves.where(f"{_WHOLE} AND x > 0").select(*keys, "x", "cdf").unionByName(starts)


def exterior_bins(curves: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x (the middle), weight, _z (their sum times the bins' width), a: waits cut off in the bins of summary()."""
    counts = curves.where(_CUT).select(*keys, "x", F.col("cut").alias("_n")).join(rows, list(keys)).groupBy(*keys, _bin().alias("bin")).agg(F.sum("_n").cast("double").alias("weight"))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    return counts.join(rows, list(keys)).select(*keys, _middle(F.col("bin")).alias("x"), "weight", (F.col("cut") * width).alias("_z"), "a")


def combined(curves: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, x, cdf of blended(). The interior curve is read at the middles of bins: of its points between two of them only the first and the last matter, so what is put
    in order for a key is a few rows for each of its bins, not its waits."""
    x, width = F.col("x"), (F.col("high") - F.col("low")) / F.col("bins")
    own = curves.where(f"{_WHOLE} OR {_CUT}").select(*keys, "x", "cdf", F.col("cut").alias("_n")).join(rows.where("cut > 0 AND whole > 0"), list(keys))
    between = F.greatest(F.least(F.floor((x - F.col("low")) / width + 0.5), F.col("bins")), F.lit(0).cast("long"))
    point = F.when(F.col("cdf").isNotNull(), F.struct(x.alias("x"), F.col("cdf").alias("y")))
    cells = own.groupBy(*keys, F.when(F.col("_n") > 0, _bin()).alias("bin"), between.alias("_b")).agg(F.sum("_n").alias("_n"), F.min(point).alias("_first"), F.max(point).alias("_last"))
    none = F.lit(None)
    of_curve = lambda p: F.when(F.col(p).isNotNull(), F.struct(F.col(p).x.alias("x"), F.lit(0).alias("q"), F.col(p).y.alias("y"), none.cast("long").alias("bin"), none.cast("double").alias("n")))
    asked = F.when(F.col("bin").isNotNull(), F.struct(_middle(F.col("bin")).alias("x"), F.lit(1).alias("q"), none.cast("double").alias("y"), F.col("bin"), F.col("_n").cast("double").alias("n")))
    few = cells.join(rows.select(*keys, "low", "high", "bins"), list(keys)).select(*keys, F.explode(F.array_compact(F.array(of_curve("_first"), of_curve("_last"), asked))).alias("_p")).select(*keys, "_p.*")
    up, down = (Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in ((F.col("x"), F.col("q")), (F.desc("x"), F.desc("q"))))
    known = F.when(F.col("q") == 0, F.struct("x", "y"))
    met = few.withColumns({"_p0": F.last(known, True).over(up), "_p1": F.last(known, True).over(down)}).where("q = 1")
    read = met.groupBy(*keys, "bin").agg(F.first("x").alias("x"), F.sum("n").alias("weight"), F.first("_p0").alias("_p0"), F.first("_p1").alias("_p1")).join(rows, list(keys))
    x0, y0 = F.coalesce("_p0.x", F.lit(0.0)), F.when(F.col("weighted"), F.coalesce("_p0.y", F.lit(0.0)))
    inner = F.coalesce(y0 + (F.col("_p1.y") - y0) * F.try_divide(x - x0, F.col("_p1.x") - x0), y0)
    return read.select(*keys, "x", dist.weighed(inner * F.col("end_share"), F.col("whole"), F.col("weight"), F.col("cut") * width, F.col("a")).alias("cdf"))


def bars_of_bins(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """bars() of a curve of a few bins for each key."""
    along = Window.partitionBy(*keys).orderBy("x")
    after = curve.withColumns({"x_to": F.lead("x").over(along), "_c": F.lead("cdf").over(along)}).where("x_to IS NOT NULL")
    return after.select(*keys, "x", "x_to", F.try_divide(F.col("_c") - F.col("cdf"), F.col("x_to") - F.col("x")).alias("pmf"))


def kaplan_meier_bounds(curves: DataFrame, keys: Sequence[str], z: float) -> DataFrame:
    """distributions.kaplan_meier_bounds of the same waits: those at risk are counted already."""
    return dist.bounds_at_risk(curves.select(*keys, "x", F.col("risk").alias("_r"), F.col("whole").alias("_d"), "_range"), keys, z)
