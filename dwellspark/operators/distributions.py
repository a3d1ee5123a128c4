"""Empirical distributions, corrected for the window that cuts waits off.

Running sums, neighbours and what lies around a point are taken along ranges of a key's values (ordered.along), so no task holds
all values of a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dwellspark.operators.ordered import After, Before, First, Last, Sum, Whole, along, dealt, over, ranged
from dwellspark.operators.scratch import written
from dwellspark.operators.waits import INTERIOR


def ecdf(df: DataFrame, keys: Sequence[str], x: str, pad_at: float | None = None) -> DataFrame:
    """keys, x, cdf: the share of values up to each distinct one, after a row of cdf 0 at pad_at."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    return _stepped(counts, keys, "_n", pad_at)


def running(df: DataFrame, keys: Sequence[str], x: str, sums: dict[str, Column], after: bool = False, total: bool = False) -> DataFrame:
    """df with the running sum of each column in the order of x, from the last on if after; with total, also the whole sum as
    <name>_total. Values of x are distinct within a key."""
    wholes = {f"{n}_total": Whole(c) for n, c in sums.items()} if total else {}
    return along(df, keys, [x], **{n: Sum(c, after) for n, c in sums.items()}, **wholes)


def _stepped(weights: DataFrame, keys: Sequence[str], weight: str, pad_at: float | None) -> DataFrame:
    """Running sums of weights, divided by their total."""
    steps = {"_up": Sum(F.col(weight)), "_all": Whole(F.col(weight))}
    share = (F.col("_up") / F.col("_all")).alias("cdf")
    if pad_at is None:
        return along(weights, keys, ["x"], **steps).select(*keys, "x", share)
    # A key's first row brings the padded one, so weights aren't made again for a list of keys.
    summed = along(weights, keys, ["x"], **steps, _one=Before(F.lit(1)))
    pad = F.when(F.col("_one").isNull(), F.struct(F.lit(float(pad_at)).alias("x"), F.lit(0.0).alias("cdf")))
    own = F.when(F.col("x") != pad_at, F.struct(F.col("x").cast("double").alias("x"), share))
    return summed.select(*keys, F.explode(F.array_compact(F.array(pad, own))).alias("_p")).select(*keys, "_p.*")


def ecdf_on(df: DataFrame, keys: Sequence[str], x: str, grid: Sequence[float]) -> DataFrame:
    """ecdf at the points of a grid."""
    there = df.where(F.col(x).isNotNull())
    seen = there.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_n"), F.lit(0).alias("_g"))
    points = there.select(*keys).distinct().select(*keys, F.explode(F.array(*(F.lit(float(g)) for g in grid))).alias("x"), F.lit(0).cast("long").alias("_n"), F.lit(1).alias("_g"))
    both = along(seen.unionByName(points), keys, ["x", "_g"], _up=Sum(F.col("_n")), _all=Whole(F.col("_n")))
    return both.where("_g = 1").select(*keys, "x", (F.col("_up") / F.col("_all")).alias("cdf"))


def window_survival(waits: DataFrame, trajectory: Sequence[str], at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """at (keys, x) with sf: the share of trajectories whose window is at least x."""
    return survived(waits, trajectory, at.select(*keys, "x"))


def survived(waits: DataFrame, trajectory: Sequence[str], at: DataFrame) -> DataFrame:
    """at (x and any other columns) with sf, as in window_survival. Sizes of windows are counted among the rows themselves, which go through once and meet nothing."""
    return _among(waits.groupBy(*trajectory).agg(F.max("window_size").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("_n")), at)


def _among(sizes: DataFrame, at: DataFrame) -> DataFrame:
    """survived, of the number _n of windows of each size x."""
    asked = at.where(F.col("x").isNotNull()).withColumns({"_n": F.lit(0).cast("long"), "_q": F.lit(0)})
    # A window as long as a wait lies behind it.
    both = asked.unionByName(sizes.withColumn("_q", F.lit(1)), allowMissingColumns=True)
    counted = along(both, [], ["x", "_q"], _up=Sum(F.col("_n"), back=True), _all=Whole(F.col("_n"))).where("_q = 0")
    return counted.select(*at.columns, (F.col("_up") / F.col("_all")).alias("sf"))


def ecdf_windowed(interior: DataFrame, keys: Sequence[str], waits: DataFrame | None = None, trajectory: Sequence[str] = (), pad_at: float | None = 0.0) -> DataFrame:
    """Distribution of waits from those seen whole (wait_time, window_size). A wait counts by the inverse of the share of
    starts that let it be seen whole, (window - wait), and with windows of several sizes (given waits) of windows that
    are long enough. Waits as long as their window have no such weight and don't count."""
    return _stepped(windowed_weights(interior, keys, waits, trajectory), keys, "w", pad_at)


#: Keys times ranges up to which what lies beside the ranges is sent to all tasks.
BESIDE = 100_000


def ecdf_windowed_whole(waits: DataFrame, keys: Sequence[str], pad_at: float | None = 0.0) -> DataFrame:
    """ecdf_windowed of all waits of trajectories, as waits_of_changes makes them (wait_time, wait_type, window_size, and rank_order 1 once in each), each with one window.
    They are gone through once: waits seen whole and windows are counted in one table, and both the windows' survival and the curve are taken along the same ranges of
    lengths, whatever their keys. With many keys, for which a range would need many rows of the ones beside it, values are dealt out by key as in ecdf_windowed."""
    size, x = F.col("window_size").cast("double"), F.col("wait_time").cast("double")
    weight = F.when((F.col("wait_type") == INTERIOR) & (size > x), F.try_divide(F.lit(1.0), size - x))
    none = [F.lit(None).cast(waits.schema[k].dataType).alias(k) for k in keys]
    own = F.when(weight.isNotNull(), F.struct(*keys, x.alias("x"), weight.alias("_w"), F.lit(0).alias("_q")))
    window = F.when(F.col("rank_order") == 1, F.struct(*none, size.alias("x"), F.lit(None).cast("double").alias("_w"), F.lit(1).alias("_q")))
    marks = waits.select(F.explode(F.array_compact(F.array(own, window))).alias("_p")).select("_p.*")
    counts = written(marks.groupBy(*keys, "x", "_q").agg(F.sum("_w").alias("_w"), F.sum(F.col("_q").cast("long")).alias("_n")))
    rows, ranges, many = ranged(counts, keys, "x")
    if ranges > 1 and ranges * many > BESIDE:
        weights = _among(counts.where("_q = 1").select("x", "_n"), counts.where("_q = 0").select(*keys, "x", "_w"))
        return _stepped(weights.select(*keys, "x", F.try_divide("_w", "sf").alias("w")).where("w IS NOT NULL"), keys, "w", pad_at)
    # A window as long as a wait lies behind it. Every range has a row, whatever windows there are.
    every = waits.sparkSession.range(0, ranges, 1, 1).select(F.col("id").cast("int").alias("_range"))
    sizes = every.join(rows.where("_q = 1").groupBy("_range").agg(F.sum("_n").alias("_c")), "_range", "left")
    behind = sizes.select("_range", F.sum("_c").over(Window.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)).alias("_behind"), F.sum("_c").over(Window.partitionBy()).alias("_windows"))
    back = Window.partitionBy("_range").orderBy(F.desc("x"), F.desc("_q")).rowsBetween(Window.unboundedPreceding, 0)
    sf = (F.sum("_n").over(back) + F.coalesce("_behind", F.lit(0))) / F.col("_windows")
    weights = rows.join(F.broadcast(behind), "_range").withColumn("_sf", sf).where("_q = 0").select("_range", *keys, "x", F.try_divide("_w", "_sf").alias("w")).where("w IS NOT NULL")
    key = Window.partitionBy(*keys)
    before = key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    beside = weights.groupBy("_range", *keys).agg(F.sum("w").alias("_c")).withColumns({"_before": F.sum("_c").over(before), "_all": F.sum("_c").over(key)})
    # Names are changed for the join alone: what is shuffled stays the same as for the padded rows, and Spark makes it once.
    sent = beside.select(F.col("_range").alias("_c_range"), *(F.col(k).alias(f"_c_key{i}") for i, k in enumerate(keys)), "_before", "_all")
    same = F.col("_range").eqNullSafe(F.col("_c_range"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_c_key{i}"))
    up = Window.partitionBy("_range", *keys).orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    share = (F.sum("w").over(up) + F.coalesce("_before", F.lit(0.0))) / F.col("_all")
    curve = weights.join(F.broadcast(sent), same).select(*keys, "x", share.alias("cdf"))
    if pad_at is None:
        return curve
    pads = beside.where("_before IS NULL").select(*keys, F.lit(float(pad_at)).alias("x"), F.lit(0.0).alias("cdf"))
    return curve.where(F.col("x") != pad_at).unionByName(pads)


def windowed_weights(interior: DataFrame, keys: Sequence[str], waits: DataFrame | None = None, trajectory: Sequence[str] = ()) -> DataFrame:
    """keys, x, w: the weights of ecdf_windowed, which sums them up."""
    weight = F.try_divide(F.lit(1.0), F.col("window_size") - F.col("wait_time"))
    by_time = interior.where(F.col("window_size") > F.col("wait_time")).groupBy(*keys, F.col("wait_time").alias("x")).agg(F.sum(weight).alias("_w"))
    if waits is not None:
        by_time = survived(waits, trajectory, by_time).withColumn("_w", F.try_divide("_w", "sf")).drop("sf")
    return by_time.where(F.col("_w").isNotNull()).withColumnRenamed("_w", "w")


def running_on(weights: DataFrame, at: DataFrame, keys: Sequence[str]) -> DataFrame:
    """at (keys, x; few points of a grid) with w: the sum of all weights up to each, null before the first."""
    both = weights.select(*keys, "x", "w", F.lit(0).alias("_q")).unionByName(at.select(*keys, "x", F.lit(None).cast("double").alias("w"), F.lit(1).alias("_q")))
    met = along(both, keys, ["x", "_q"], _sum=Sum(F.col("w")), _any=Last(F.col("w")))
    return met.where("_q = 1").select(*keys, "x", F.when(F.col("_any").isNotNull(), F.col("_sum")).alias("w"))


def integral(curve: DataFrame, keys: Sequence[str], y: str = "cdf") -> DataFrame:
    """Adds the running integral of a step curve, taken at right ends, as area."""
    stepped = over(dealt(curve, keys, ["x"]), keys, ["x"], _x=Before(F.col("x")))
    return over(stepped, keys, ["x"], area=Sum(F.coalesce(F.col(y) * (F.col("x") - F.col("_x")), F.lit(0.0)))).drop("_x", "_range")


def kaplan_meier(waits: DataFrame, keys: Sequence[str], observed: str = "interior") -> DataFrame:
    """keys, x, cdf: 1 - the product-limit survival, waits not seen whole being censored."""
    event = (F.col("wait_type") == observed).cast("int")
    by_time = waits.groupBy(*keys, F.col("wait_time").alias("x")).agg(F.sum(event).alias("_d"), F.count(F.lit(1)).alias("_n"))
    # Values are dealt out once, for those at risk and for what is made of them.
    risk = over(dealt(by_time, keys, ["x"]), keys, ["x"], _r=Sum(F.col("_n"), back=True))
    rest = F.col("_r") - F.col("_d")
    # Products as sums of logarithms; from a step to 0 on, all is 0.
    steps = risk.withColumns({"_l": F.when(rest > 0, F.log(rest / F.col("_r"))), "_z": (rest == 0).cast("int")})
    summed = over(steps, keys, ["x"], _ls=Sum(F.col("_l")), _zs=Sum(F.col("_z")))
    return summed.select(*keys, "x", F.when(F.col("_zs") > 0, 1.0).otherwise(1 - F.exp("_ls")).alias("cdf"))


def kaplan_meier_bounds(waits: DataFrame, keys: Sequence[str], z: float, observed: str = "interior") -> DataFrame:
    """kaplan_meier with low and high: Greenwood's variance on the scale of the survival's double logarithm."""
    event = (F.col("wait_type") == observed).cast("int")
    by_time = waits.groupBy(*keys, F.col("wait_time").alias("x")).agg(F.sum(event).alias("_d"), F.count(F.lit(1)).alias("_n"))
    # Values are dealt out once, for those at risk and for what is made of them.
    return bounds_at_risk(over(dealt(by_time, keys, ["x"]), keys, ["x"], _r=Sum(F.col("_n"), back=True)), keys, z)


def bounds_at_risk(risk: DataFrame, keys: Sequence[str], z: float) -> DataFrame:
    """kaplan_meier_bounds of dealt rows (keys, x): _r waits at risk, of which _d end."""
    rest = F.col("_r") - F.col("_d")
    # Sums of logarithms: a survival of 0 stays 0, since its step has none.
    step = F.when(rest > 0, F.log(rest / F.col("_r")))
    steps = risk.withColumns({"_l": step, "_v": F.when(rest > 0, F.col("_d") / (F.col("_r") * rest)), "_z": (rest == 0).cast("int")})
    summed = over(steps, keys, ["x"], _ls=Sum(F.col("_l")), _vs=Sum(F.col("_v")), _zs=Sum(F.col("_z")))
    s = F.when(F.col("_zs") > 0, 0.0).otherwise(F.exp(F.coalesce("_ls", F.lit(0.0))))
    # Before the first event all survive, for certain.
    spread = F.when(F.col("_s") < 1, F.try_divide(z * F.sqrt(F.coalesce("_vs", F.lit(0.0))), F.log(F.col("_s")))).otherwise(0.0)
    return summed.withColumn("_s", s).select(*keys, "x", (1 - F.col("_s")).alias("cdf"), (1 - F.pow("_s", F.exp(spread))).alias("low"), (1 - F.pow("_s", F.exp(-spread))).alias("high"))


def rescaled(curve: DataFrame, keys: Sequence[str], heights: DataFrame, columns: Sequence[str] = ("cdf",)) -> DataFrame:
    """curve with some columns multiplied so that its cdf ends at each key's height (keys, height): a curve that the window cuts off, at
    the part of the distribution that the window shows. Keys without a height have no row; a curve that ends at 0 has nulls."""
    # As a table, the few rows have a known size, and the curve isn't shuffled by key to meet them.
    ends = written(curve.groupBy(*keys).agg(F.max("cdf").alias("_end")).join(heights.select(*keys, "height"), list(keys)))
    scale = F.try_divide(F.col("height"), F.col("_end"))
    return curve.join(ends, list(keys)).withColumns({c: F.col(c) * scale for c in columns}).drop("_end", "height")


def bars(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The density between neighbouring points of a cdf: keys, x, x_to, pmf."""
    after = along(curve, keys, ["x"], x_to=After(F.col("x")), _c=After(F.col("cdf"))).where("x_to IS NOT NULL")
    return after.select(*keys, "x", "x_to", F.try_divide(F.col("_c") - F.col("cdf"), F.col("x_to") - F.col("x")).alias("pmf"))


def histogram(df: DataFrame, keys: Sequence[str], x: str, low: float, high: float, bins: int, weight: str | None = None) -> DataFrame:
    """keys, bin, weight, density; the last bin holds its right end."""
    own = df.where(F.col(x).between(low, high)).withColumn("bin", F.least(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("long"))
    found = own.groupBy(*keys, "bin").agg(F.sum(F.lit(1.0) if weight is None else F.col(weight)).alias("weight"))
    return found.withColumn("density", F.col("weight") / F.sum("weight").over(Window.partitionBy(*keys)) / ((high - low) / bins))


def quartiles(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, n, low, q1, q3, high: exact, with straight lines between the values of neighbouring ranks. Values are counted, and their ranks are
    running sums by ranges, so no task holds all values of a key. Nulls don't count, and a key of nulls alone has no row."""
    counts = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, "x", {"_up": F.col("_n")}, total=True)
    found = ranked.groupBy(*keys).agg(F.max("_up_total").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), *at_rank(F.col("_up"), F.col("_n"), F.col("_up_total"), F.col("x")))
    return found.select(*keys, "n", "low", between_ranks(F.col("n"), 1).alias("q1"), between_ranks(F.col("n"), 3).alias("q3"), "high")


#: Columns of the values below and above each quartile's rank.
RANKS = ("_a1", "_b1", "_a3", "_b3")


def at_rank(up: Column, n: Column, total: Column, x: Column) -> list[Column]:
    """Greatest values, as RANKS, of rows of n equal values x each, up being their running sum: of the ranks (from 0) that a quartile lies between."""
    place = lambda name: (F.floor if name[1] == "a" else F.ceil)((total - 1) * int(name[2]) / 4.0)
    return [F.max(F.when((up - n <= place(name)) & (place(name) < up), x)).alias(name) for name in RANKS]


def between_ranks(n: Column, q: int) -> Column:
    return F.col(f"_a{q}") + (F.col(f"_b{q}") - F.col(f"_a{q}")) * F.pmod((n - 1) * q / 4.0, F.lit(1.0))


def auto_bins(df: DataFrame, keys: Sequence[str], x: str) -> DataFrame:
    """keys, low, high, bins: equal bins from each key's least to its greatest value, as wide as the narrower of Sturges' rule and that of
    Freedman and Diaconis says, where that one has a width. A key of one value has one bin of width 1 around it."""
    return binned(quartiles(df, keys, x), ["low", "high", "bins"]).select(*keys, "low", "high", "bins")


def binned(found: DataFrame, into: Sequence[str]) -> DataFrame:
    """Rows of quartiles() with the bins of auto_bins, as the columns of these names."""
    extent = F.col("high") - F.col("low")
    sturges, freedman = extent / (F.log2("n") + 1), 2 * (F.col("q3") - F.col("q1")) / F.pow("n", F.lit(1 / 3))
    width = F.when(freedman > 0, F.least(sturges, freedman)).otherwise(sturges)
    alone = extent <= 0
    bins = F.when(alone, 1).otherwise(F.ceil(F.try_divide(extent, width))).cast("long")
    ends = F.when(alone, F.col("low") - 0.5).otherwise(F.col("low")), F.when(alone, F.col("high") + 0.5).otherwise(F.col("high"))
    return found.withColumns(dict(zip(into, (*ends, bins))))


def histogram_auto(df: DataFrame, keys: Sequence[str], x: str, weight: str | None = None) -> DataFrame:
    """keys, bin (1 for the first), x (its middle), width, weight, density, of auto_bins: every value lies in a bin. Bins without a value
    have no row. The bins are a row for each key, joined on."""
    spans = auto_bins(df, keys, x)
    own = df.where(F.col(x).isNotNull()).join(spans, list(keys))
    place = F.floor((F.col(x) - F.col("low")) / (F.col("high") - F.col("low")) * F.col("bins")) + 1
    own = own.withColumn("bin", F.least(place, F.col("bins")))
    found = own.groupBy(*keys, "bin").agg(F.sum(F.lit(1.0) if weight is None else F.col(weight)).alias("weight"))
    whole = found.groupBy(*keys).agg(F.sum("weight").alias("_all")).join(spans, list(keys))
    width = (F.col("high") - F.col("low")) / F.col("bins")
    found = found.join(whole.withColumn("width", width), list(keys))
    return found.select(*keys, "bin", (F.col("low") + (F.col("bin") - 0.5) * F.col("width")).alias("x"), "width", "weight", (F.col("weight") / F.col("_all") / F.col("width")).alias("density"))


def _outer_bins(exterior: DataFrame, keys: Sequence[str], spans: tuple[float, float, int] | None) -> DataFrame:
    """keys, x (the middle), weight, _z: waits in bins, and their sum times the bins' width."""
    if spans is None:
        found = histogram_auto(exterior, keys, "wait_time")
    else:
        width = (spans[1] - spans[0]) / spans[2]
        found = histogram(exterior, keys, "wait_time", *spans).withColumns({"x": spans[0] + (F.col("bin") - 0.5) * width, "width": F.lit(width)})
    whole = found.groupBy(*keys).agg(F.sum(F.col("weight") * F.col("width")).alias("_z"))
    return found.select(*keys, "x", "weight").join(whole, list(keys))


def histogram_between(df: DataFrame, keys: Sequence[str], x: str, edges: Sequence[float]) -> DataFrame:
    """keys, bin (1 for the first), n, density, for bins between the edges; the last one holds its right end."""
    marks = F.array(*(F.lit(float(e)) for e in edges))
    at = F.least(F.size(F.filter(marks, lambda e: e <= F.col(x))), F.lit(len(edges) - 1)).cast("long")
    counts = df.where(F.col(x).between(float(edges[0]), float(edges[-1]))).groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.groupBy(*keys).agg(F.sum("n").alias("_n"))
    width = F.get(marks, F.col("bin").cast("int")) - F.get(marks, (F.col("bin") - 1).cast("int"))
    return counts.join(whole, list(keys)).select(*keys, "bin", "n", (F.col("n") / F.col("_n") / width).alias("density"))


def exterior_fit(exterior_cdf: DataFrame, interior_cdf: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, a, b, end_share: the exterior cdf as a t + b I(t), a >= 0 >= b, by least squares over the points of both, where I
    is the interior cdf's integral. a is the inverse mean wait, and -b / a the interior cdf's true height at the
    window's end. Both curves are read between their points by straight lines, and stay flat beyond them."""
    inner = integral(interior_cdf, keys).select(*keys, "x", F.lit(None).cast("double").alias("e"), F.col("area").alias("i"))
    outer = exterior_cdf.select(*keys, "x", F.col("cdf").alias("e"), F.lit(None).cast("double").alias("i"))
    grid = inner.unionByName(outer).groupBy(*keys, "x").agg(F.max("e").alias("e"), F.max("i").alias("i"), F.count(F.lit(1)).alias("_m"))
    grid = _around(grid, keys, ["x"], ["e", "i"])
    for c in ("e", "i"):
        grid = grid.withColumn(f"_{c}", F.coalesce(F.col(c), _straight(c)))
    t, i, e, m = F.col("x"), F.col("_i"), F.col("_e"), F.col("_m")
    s = grid.groupBy(*keys).agg(*(F.sum(v * m).alias(n) for n, v in (("tt", t * t), ("ti", t * i), ("ii", i * i), ("te", t * e), ("ie", i * e))))
    return solved(s).select(*keys, "a", "b", "end_share")


def solved(s: DataFrame) -> DataFrame:
    """Rows of sums of products (tt, ti, ii, te, ie) with a, b and end_share of exterior_fit."""
    det = F.col("tt") * F.col("ii") - F.col("ti") * F.col("ti")
    a = F.try_divide(F.col("te") * F.col("ii") - F.col("ie") * F.col("ti"), det)
    b = F.try_divide(F.col("ie") * F.col("tt") - F.col("te") * F.col("ti"), det)
    alone = F.greatest(F.try_divide("te", "tt"), F.lit(0.0))
    s = s.withColumn("_a", a).withColumn("_b", b)
    free = (F.col("_a") >= 0) & (F.col("_b") <= 0)
    other = F.least(F.try_divide("ie", "ii"), F.lit(0.0))
    # Of the two corners, the one with the smaller rest of squares.
    rest_a, rest_b = alone * alone * F.col("tt") - 2 * alone * F.col("te"), other * other * F.col("ii") - 2 * other * F.col("ie")
    s = s.withColumn("a", F.when(free, F.col("_a")).when(rest_a <= rest_b, alone).otherwise(0.0))
    s = s.withColumn("b", F.when(free, F.col("_b")).when(rest_a <= rest_b, F.lit(0.0)).otherwise(other))
    return s.withColumn("end_share", F.try_divide(-F.col("b"), F.col("a"))).drop("_a", "_b")


def _around(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with, for each column c, where it is known before and behind a row: _x0_c, _y0_c, _x1_c, _y1_c."""
    steps = {}
    for c in columns:
        known = F.when(F.col(c).isNotNull(), F.struct(F.col("x").alias("x"), F.col(c).alias("y")))
        steps |= {f"_p0_{c}": Last(known), f"_p1_{c}": First(known)}
    found = along(df, keys, order, **steps)
    ends = {f"_{v}{k}_{c}": F.col(f"_p{k}_{c}")[v] for c in columns for k in (0, 1) for v in "xy"}
    return found.withColumns(ends).drop(*steps)


def _straight(c: str) -> Column:
    """On the straight line between the points around, flat beyond the ends."""
    x0, y0, x1, y1 = (F.col(f"_{v}_{c}") for v in ("x0", "y0", "x1", "y1"))
    return F.coalesce(y0 + (y1 - y0) * F.try_divide(F.col("x") - x0, x1 - x0), y0, y1)


def interpolated(curve: DataFrame, at: DataFrame, keys: Sequence[str], y: str = "cdf") -> DataFrame:
    """at (keys, x) with y on straight lines between the curve's points, flat beyond its ends."""
    both = curve.select(*keys, "x", F.col(y).alias("_y"), F.lit(0).alias("_q")).unionByName(at.select(*keys, "x", F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_q")))
    return _around(both, keys, ["x", "_q"], ["_y"]).where("_q = 1").select(*keys, "x", _straight("_y").alias(y))


def ecdf_simple(df: DataFrame, keys: Sequence[str], x: str, window: float | str) -> DataFrame:
    """Running sums of window / (window - x), divided by the number of distinct values: for one size of window, or a
    column of them that is among the keys; not normalised to end at 1."""
    size = F.col(window) if isinstance(window, str) else F.lit(window)
    counts = df.where(F.col(x) < size).groupBy(*keys, F.col(x).cast("double").alias("x")).agg((F.count(F.lit(1)) * F.first(size) / (F.first(size) - F.first(F.col(x)))).alias("_w"))
    summed = running(counts, keys, "x", {"_up": F.col("_w"), "_k": F.lit(1)}, total=True)
    return summed.select(*keys, "x", (F.col("_up") / F.col("_k_total")).alias("cdf"))


def discrete_bars(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The density of a curve on a grid of frames: between the middles of neighbouring grid points, by the steps of the cdf
    at the points in between. keys, x, x_to, pmf."""
    middle = along(curve.select(*keys, "x", "cdf"), keys, ["x"], _to=After(F.col("x"))).withColumn("_m", (F.col("x") + F.col("_to")) / 2).where("_m IS NOT NULL")
    return bars(middle.select(*keys, F.col("_m").alias("x"), "cdf"), keys)


def blended(exterior: DataFrame, interior_cdf: DataFrame, fit: DataFrame, interior_count: DataFrame, keys: Sequence[str], spans: tuple[float, float, int] | None = None) -> DataFrame:
    """keys, x, cdf: two estimates of the true cdf at the middles of a histogram of exterior waits, weighted by the inverse
    of their variances. One comes from the histogram, the other from the interior curve at its fitted height; the
    latter's variance is the bound of Dvoretzky, Kiefer and Wolfowitz at one sigma. fit: a and end_share by key.
    interior_count: n by key. Bins are auto_bins of the waits, or (low, high, bins) of spans; waits beyond these don't count. Bins
    without a wait have no estimate."""
    hist = _outer_bins(exterior, keys, spans)
    inner = interpolated(interior_cdf, hist.select(*keys, "x"), keys).withColumnRenamed("cdf", "_inner")
    both = hist.join(inner, [*keys, "x"]).join(fit, list(keys)).join(interior_count, list(keys))
    return both.select(*keys, "x", weighed(F.col("_inner") * F.col("end_share"), F.col("n"), F.col("weight"), F.col("_z"), F.col("a")).alias("cdf"))


def weighed(inner: Column, n: Column, weight: Column, z: Column, a: Column) -> Column:
    """The mean of blended(): of the interior curve of n waits and of a bin of that weight, z being all weights times the bin's width."""
    outer, outer_weight = 1 - F.try_divide(F.try_divide(weight, z), a), F.try_divide(z * a * z * a, weight)
    inner_weight = 2 * n / F.log(F.lit(2 / 0.32))
    return F.try_divide(inner * inner_weight + outer * outer_weight, inner_weight + outer_weight)


def interior_density(interior: DataFrame, keys: Sequence[str], waits: DataFrame, trajectory: Sequence[str], fit: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """keys, x (the middle of a bin), pdf: the density of waits, corrected for the window and brought to its true height at the window's end
    by end_share of the fit. Waits without a weight don't count; bins without a wait have no row."""
    return density_of_weights(windowed_weights(interior, keys, waits, trajectory), keys, fit, low, high, bins)


def density_of_weights(weights: DataFrame, keys: Sequence[str], fit: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """interior_density of weights (keys, x, w)."""
    width = (high - low) / bins
    hist = histogram(weights, keys, "x", low, high, bins, "w").join(fit, list(keys))
    return hist.select(*keys, (low + (F.col("bin") - 0.5) * width).alias("x"), (F.col("density") * F.col("end_share")).alias("pdf"))


def exterior_estimate(exterior: DataFrame, keys: Sequence[str], fit: DataFrame, spans: tuple[float, float, int] | None = None, deviations: float = 2.0) -> DataFrame:
    """keys, x (the middle of a bin), cdf, low, high: the true cdf as a histogram of exterior waits gives it, since their density is the
    survival over the mean wait (1 / a of the fit), and so many standard errors around it, by the normal approximation of
    counts. Null where the fit has no a; bins without a wait have no row. Bins are as in blended()."""
    return estimate_of_bins(_outer_bins(exterior, keys, spans).join(fit, list(keys)), keys, deviations)


def estimate_of_bins(hist: DataFrame, keys: Sequence[str], deviations: float = 2.0) -> DataFrame:
    """exterior_estimate of bins: x, weight, _z and a of the fit."""
    scale = F.col("_z") * F.col("a")
    value, error = 1 - F.try_divide("weight", scale), deviations * F.try_divide(F.sqrt("weight"), scale)
    return hist.select(*keys, "x", value.alias("cdf"), (value - error).alias("low"), (value + error).alias("high"))
