"""Operator 7: near-duplicate vectors by spherical-cap filters.

The filters' directions are a structured random product code: the dimensions are cut into two halves, each half has
as many random unit vectors as the root of the number of filters, and each pair of them is a direction. A vector is
list-decoded: from the sorted inner products of either half, the directions that it exceeds by most are found without
looking at the others. The best is its home, the others are places that it visits. Two close vectors meet at the home
of one of them; there the cosine is screened in single precision and, near the threshold, computed in double. A pair
that doesn't meet is not found. How many directions a vector is decoded to follows from the cosine, the dimension and
the number of directions: as many as let random pairs at the threshold itself meet with the wanted recall.

Equal vectors are one point with a weight. Vectors are sent to their filters in rounds, each of which goes to a part of
the filters and sends little more than the table holds; Spark drops what a round has shuffled when it ends. A filter
that many vectors fall into is dealt out in pairs of a block of its homes and a block of all its points, so that no
group holds more than two blocks; one without homes is left out. Its blocks are dealt to rounds of their own, if they are many.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwellspark.llm.common import partitions, stored, swept
from dwellspark.llm.components import components, forest

COSINE = 0.95
#: Directions to which a vector is decoded at least, home included, and points for each direction, about.
DECODED, PER_FILTER = 8, 2_048
#: Share of pairs at the threshold that meet, and pairs drawn to find out how many directions that takes.
RECALL, DRAWN = 0.999, 10_000
#: Rows that a task sends on at once, about.
SENT = 8_192
#: Points of a filter that come together, about: half of them homes, where it is crowded; fewer if their vectors have
#: more components than that in all.
LARGEST, COMPONENTS = 100_000, 1 << 23
#: Pairs of a home and a point that one block holds against each other, about.
PAIRS = 1 << 28
#: Rows of a bucket, which holds several filters or blocks of them.
BUCKET = 20_000
#: Rows that a round sends for each point, about, and rows for which there is no second round.
SHARE, ROUND = 1.5, 300_000
#: Homes and points whose cosines are worked out at once, and pairs of them that are looked at again at once.
TILE, AGAIN = (256, 2_048), 8_192
SEED = 20_240_229
#: Cosines this near to the threshold are summed again without rounding.
CLOSE = 1e-9


@lru_cache(maxsize=8)
def _halves(dimension: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors of either half, the same in each task. One dimension has one half of it and one of none."""
    out = []
    for part, d in enumerate((dimension - dimension // 2, dimension // 2)):
        drawn = np.random.default_rng((SEED, dimension, size, part)).standard_normal((size, d))
        length = np.linalg.norm(drawn, axis=1, keepdims=True)
        out.append(drawn / np.where(length > 0, length, 1))
    return out[0], out[1]


@lru_cache(maxsize=8)
def _corner(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks that the n largest sums of two sorted lists can have."""
    pairs = [(i, j) for i in range(n) for j in range(n // (i + 1))]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def decode(x: np.ndarray, size: int, wanted: int) -> np.ndarray:
    """For each row of x (unit vectors) the filters with the largest inner products, best first."""
    left, right = _halves(x.shape[1], size)
    scores = [x[:, : left.shape[1]] @ left.T, x[:, left.shape[1] :] @ right.T]
    order = [np.argsort(-s, axis=1, kind="stable")[:, :wanted] for s in scores]
    top = [np.take_along_axis(s, o, 1) for s, o in zip(scores, order)]
    i, j = _corner(wanted)
    fits = (i < order[0].shape[1]) & (j < order[1].shape[1])
    i, j = i[fits], j[fits]
    best = np.argsort(-(top[0][:, i] + top[1][:, j]), axis=1, kind="stable")[:, :wanted]
    return np.take_along_axis(order[0][:, i], best, 1).astype(np.int64) * size + np.take_along_axis(order[1][:, j], best, 1)


def _ranks(dimension: int, size: int, cosine: float, drawn: int, seed: int) -> np.ndarray:
    """For random pairs at a cosine the place that the home of one has among the filters of the other, 1 for the best; the
    smaller one of both ways."""
    rng = np.random.default_rng((seed, dimension, size))
    left, right = _halves(dimension, size)
    out = []
    for s in range(0, drawn, 500):
        x, off = rng.standard_normal((2, min(500, drawn - s), dimension))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        off -= (off * x).sum(1, keepdims=True) * x
        off /= np.linalg.norm(off, axis=1, keepdims=True)
        y = cosine * x + math.sqrt(1 - cosine * cosine) * off
        (xl, xr), (yl, yr) = ((v[:, : left.shape[1]] @ left.T, v[:, left.shape[1] :] @ right.T) for v in (x, y))
        for a, b, c, d in ((xl, xr, yl, yr), (yl, yr, xl, xr)):
            i = np.arange(len(x))
            home = c[i, a.argmax(1)] + d[i, b.argmax(1)]
            d = np.sort(d, axis=1)
            out.append([1 + int((size - np.searchsorted(d[k], home[k] + 1e-12 - c[k], "right")).sum()) for k in i])
    return np.minimum(np.concatenate(out[::2]), np.concatenate(out[1::2]))


@lru_cache(maxsize=64)
def lists(dimension: int, size: int, cosine: float, recall: float, least: int) -> int:
    """Filters to which a vector is decoded, such that pairs at the cosine meet with the recall. Half of the misses that
    this allows are kept back for the drawn pairs' own scatter."""
    if size * size <= least:
        return size * size
    if dimension < 2 or cosine >= 1:
        return least
    ranks = np.sort(_ranks(dimension, size, max(cosine, -1.0), DRAWN, SEED + 1))
    return max(least, int(ranks[min(DRAWN - 1, math.ceil((1 + recall) / 2 * DRAWN))]))


def _decoded(size: int, cosine: float, recall: float, least: int, rounds: int, known: dict[int, int]):
    """Points with their home and, for each round, the filters that they are sent to in it. known: lengths of lists by
    dimension, as far as they are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            lengths, values = vectors.value_lengths().to_numpy(), vectors.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                wanted = known.get(d) or lists(d, size, cosine, recall, least)
                step = max(1, SENT // wanted)
                for s in range(0, len(own), step):
                    part = own[s : s + step]
                    raw = values[starts[part][:, None] + np.arange(d)]
                    places = decode(_unit(raw), size, wanted) + d * size * size
                    k = places.shape[1]
                    turn = (places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % rounds
                    order = np.argsort(turn, axis=1, kind="stable")
                    cuts = np.r_[0, np.cumsum(np.bincount((np.arange(len(part))[:, None] * rounds + turn).ravel(), minlength=len(part) * rounds))]
                    sent = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.take_along_axis(places, order, 1).ravel()))
                    sent = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * rounds, pa.int32()), sent)
                    bare = pa.array([r.tobytes() for r in raw], pa.binary())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(part)) for c in ("name", "weight", "least")), bare, pa.array(places[:, 0]), sent], ["name", "weight", "least", "vector", "home", "sent"])

    return run


_PLACED = "place long, name long, weight long, home long, places array<long>, vector binary"


def _scaled(raw: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Very long and very short vectors are brought near 1."""
    raw = raw.astype(np.float64)
    return (raw / np.abs(raw).max(1, keepdims=True)).astype(kind, copy=False)


def _unit(raw: np.ndarray, kind: type = np.float64) -> np.ndarray:
    x = _scaled(raw, kind)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _exactly(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _near(raw: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether rows i and j have the cosine, in double precision."""
    out = []
    for s in range(0, len(i), AGAIN):
        a, b = _scaled(raw[i[s : s + AGAIN]]), _scaled(raw[j[s : s + AGAIN]])
        cos = (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
        near = cos >= cosine
        for k in np.flatnonzero(np.abs(cos - cosine) < CLOSE):
            near[k] = _exactly(a[k], b[k]) >= cosine
        out.append(near)
    return np.concatenate([*out, np.empty(0, bool)])


def _hooked(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, which has the least vertex of each vertex's component, after the links (a, b)."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def _linked(cosine: float, kind: str):
    """Of some blocks: weights that each point is linked with, and as few links as connect the same. kind: of the
    vectors' components."""

    def block(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        name, weight, home, place, here, seen = (rows[c].to_numpy() for c in ("name", "weight", "home", "place", "here", "seen"))
        own, others = np.flatnonzero(here), np.flatnonzero(seen)
        counts, label = np.zeros(len(name), np.int64), np.arange(len(name))
        if not len(own):
            return label[:0], label[:0], label[:0], label[:0]
        raw = np.frombuffer(b"".join(rows["vector"].to_pylist()), kind).reshape(len(name), -1)
        single = np.concatenate([_unit(raw[s : s + AGAIN], np.float32) for s in range(0, len(raw), AGAIN)])
        slack = (raw.shape[1] + 16) * 2.0**-22  # single precision is off by less than that
        listed = rows["places"].take(pa.array(own)).combine_chunks().flatten().to_numpy().reshape(len(own), -1)
        points = single if len(others) == len(name) else single[others]
        for s in range(0, len(own), TILE[0]):
            homes = single[own[s : s + TILE[0]]]
            for t in range(0, len(others), TILE[1]):
                cos = (homes @ points[t : t + TILE[1]].T).ravel()
                found = np.flatnonzero(cos >= cosine - slack)
                at, j = np.divmod(found, min(TILE[1], len(others) - t))
                at, j = at + s, others[j + t]
                apart = own[at] != j
                at, j, cos = at[apart], j[apart], cos[found[apart]]
                near = cos >= cosine + slack
                unsure = np.flatnonzero(~near)
                near[unsure] = _near(raw, own[at[unsure]], j[unsure], cosine)
                at, j = at[near], j[near]
                if not len(at):
                    continue
                i = own[at]
                counts += np.bincount(i, weight[j], len(counts)).astype(np.int64)
                # A visitor whose home the point visits counts the pair there; else it has no other place to do so.
                away = np.flatnonzero(home[j] != place[j])
                for k in (away[c : c + AGAIN] for c in range(0, len(away), AGAIN)):
                    k = k[~(listed[at[k]] == home[j[k]][:, None]).any(1)]
                    counts += np.bincount(j[k], weight[i[k]], len(counts)).astype(np.int64)
                label = _hooked(label, i, j)
        some, below = np.flatnonzero(counts), np.flatnonzero(label != np.arange(len(label)))
        return name[some], counts[some], name[below], name[label[below]]

    def run(table: pa.Table) -> pa.Table:
        place, part = table["place"].to_numpy(), table["block"].to_numpy()
        if (place != place[0]).any() or (part != part[0]).any():
            order = np.lexsort((part, place))
            table, place, part = table.take(pa.array(order)), place[order], part[order]
        cuts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
        out = [block(table.slice(s, e - s)) for s, e in zip(cuts, [*cuts[1:], len(place)])]
        names, counts, a, b = (np.concatenate(x) for x in zip(*out))
        a, b = forest(a, b)
        names, at = np.unique(names, return_inverse=True)
        total = np.bincount(at, counts, len(names)).astype(np.int64)
        return pa.table([pa.array(np.r_[names, a]), pa.array(np.r_[total, np.zeros(len(a), np.int64)]), pa.array([None] * len(names) + b.tolist(), pa.int64())], ["a", "links", "b"])

    return run


def _crowded(held: DataFrame, largest: int) -> DataFrame:
    """held: place, n, homes. Blocks of homes and of points that filters of over largest points, or of too many pairs, are
    cut into."""
    many = F.col("n") * F.col("homes") > PAIRS
    half = F.when(many, F.lit(max(1, min(largest // 2, math.isqrt(PAIRS))))).otherwise(F.lit(max(1, largest // 2)))
    return held.where((F.col("n") > largest) | many).select(F.col("place").alias("crowded"), F.ceil(F.col("homes") / half).cast("int").alias("rows"), F.ceil(F.col("n") / half).cast("int").alias("columns"))


def deal(placed: DataFrame, largest: int, large: DataFrame | None = None, turn: int = 0, turns: int = 1) -> DataFrame:
    """Rows of a filter with their block: here, if the point is one of the block's homes, and seen, if it is one of the
    points that these are held against. Each home meets each point in just one block. large: the crowded filters, at most
    one for largest rows and so few. Of several turns only the blocks of one are dealt."""
    if large is None:
        large = _crowded(placed.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("home") == F.col("place")).alias("homes")), largest)
    both = placed.join(F.broadcast(large), F.col("place") == F.col("crowded"), "left").where(F.coalesce("rows", F.lit(1)) > 0)
    own = F.col("home") == F.col("place")
    row, column = (F.pmod(F.xxhash64("name", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("rows", "columns")))
    cell = lambda r, c, here, seen: F.struct((r.cast("long") * F.col("columns") + c).alias("block"), here.alias("here"), seen.alias("seen"))
    as_home = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: cell(row, c, F.lit(True), c == column))
    as_point = F.transform(F.filter(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: ~own | (r != row)), lambda r: cell(r, column, F.lit(False), F.lit(True)))
    single = F.array(F.struct(F.lit(0).cast("long").alias("block"), own.alias("here"), F.lit(True).alias("seen")))
    cells = F.when(F.col("crowded").isNull(), single).when(own, F.concat(as_home, as_point)).otherwise(as_point)
    if turns > 1:
        cells = F.filter(cells, lambda c: F.pmod(F.xxhash64("place", c["block"]), F.lit(turns)) == turn)
    dealt = both.withColumn("cell", F.explode(cells)).select("place", "cell.block", "name", "weight", "home", "cell.here", "cell.seen", "places", "vector")
    return dealt.withColumn("places", F.when(F.col("here"), F.col("places")))


def _met(coded: DataFrame, rounds: int, most: int, largest: int, cosine: float, kind: str) -> DataFrame:
    """What _linked finds in all filters, round after round. most: rows that a round sends, about."""
    spark = coded.sparkSession
    listed = coded.select("home", F.posexplode("sent").alias("round", "places")).select("home", "round", F.explode("places").alias("place"))
    held = stored(listed.groupBy("round", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("home") == F.col("place")).alias("homes")))
    large = stored(_crowded(held, largest).coalesce(1))
    both = held.join(F.broadcast(large), F.col("place") == F.col("crowded"), "left")
    rows = F.when(F.col("crowded").isNull(), F.col("n")).otherwise(F.col("homes") * (F.col("columns") + F.col("rows") - 1) + (F.col("n") - F.col("homes")) * F.col("rows"))
    found = []
    for sent, n in sorted(both.groupBy("round").agg(F.sum(rows)).collect()):
        turns = max(1, math.ceil(n / (2 * most)))
        placed = coded.select("name", "weight", "home", "vector", F.flatten("sent").alias("places"), F.explode(F.col("sent")[sent]).alias("place"))
        for turn in range(turns):
            dealt = deal(placed.withColumn("places", F.when(F.col("home") == F.col("place"), F.col("places"))), largest, large, turn, turns)
            dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("place", "block"), F.lit(max(4 * partitions(spark), n // turns // BUCKET))))
            found.append(stored(dealt.groupBy("bucket").applyInArrow(_linked(cosine, kind), _FOUND)))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)


_FOUND = "a long, links long, b long"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, decoded: int = DECODED, largest: int = LARGEST, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row. Vectors that are null, empty, zero, or hold a null, a NaN or an
    infinity link with nothing; so do vectors of different lengths. Rows that repeat an id are vectors of their own;
    a null id is kept and is never a component's id but its own."""
    single = vectors.schema[vector_col].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector_col].dataType.containsNull)
    x = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    # Whether an array holds a value is null, not false, where it holds a null; NaN is the largest value.
    low, high, infinite = F.array_min(x), F.array_max(x), F.lit(float("inf")).cast("float" if single else "double")
    good = F.coalesce(~F.array_contains(x, infinite) & (low > -infinite) & ~F.isnan(high) & ((low != 0) | (high != 0)), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(good, x).alias("vector"))
    rows = rows.withColumn("name", F.when(F.col("vector").isNotNull(), F.xxhash64("vector")))
    with swept(vectors.sparkSession):
        told = _told(rows, cosine, decoded, largest, recall, "f4" if single else "f8")
    out = rows.select("vec_id", "name").join(told, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _told(rows: DataFrame, cosine: float, decoded: int, largest: int, recall: float, kind: str) -> DataFrame:
    """name, links, component_id of each vector's name."""
    rows = rows.where(F.col("name").isNotNull())
    lengths = rows.select("name", F.size("vector").alias("d")).distinct().groupBy("d").count()
    n, d, longest = lengths.agg(*(F.coalesce(x, F.lit(1)) for x in (F.sum("count"), F.max_by("d", "count"), F.max("d")))).first()
    largest = min(largest, max(2, COMPONENTS // longest))
    size = max(1, math.isqrt(n // PER_FILTER))
    wanted = lists(d, size, cosine, recall, decoded)
    most = max(ROUND, int(SHARE * n))
    rounds = max(1, math.ceil(wanted * n / most))
    points = rows.groupBy("name").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    schema = T.StructType([*points.drop("vector").schema.fields, *T.StructType.fromDDL("vector binary, home long, sent array<array<long>>").fields])
    coded = stored(points.mapInArrow(_decoded(size, cosine, recall, decoded, rounds, {d: wanted}), schema))
    found = _met(coded, rounds, most, largest, cosine, kind)
    counts = found.where(F.col("b").isNull()).groupBy(F.col("a").alias("of")).agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("b").isNotNull()).select("a", "b"))
    told = coded.select("name", "weight", "least").join(counts, F.col("name") == F.col("of"), "left").join(joined, F.col("name") == F.col("vertex"), "left")
    told = stored(told.select("name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "least", F.coalesce("component", "name").alias("component")))
    least = told.groupBy("component").agg(F.min("least").alias("component_id"))
    return told.join(least, "component").select("name", "links", "component_id")


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r(v, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.v, l.b FROM r JOIN l ON r.t = l.a),
m AS (SELECT v, min(t) AS t FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, m.t AS component_id, v.vec_id = m.t AS kept
FROM v JOIN m ON v.vec_id = m.v LEFT JOIN n ON v.vec_id = n.a
"""
