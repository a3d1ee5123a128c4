"""Operator 9: n-gram Jaccard join as an exact join in a metric space.

A document is the set of its shingles' hashes; equal sets are one point. Jaccard distance is a metric, and a link is
a distance of at most 1 - THRESHOLD.

1. Shingles are dealt out by hash and counted over all sets. One that only one set has can't be in any intersection, so
   a set links with nothing unless THRESHOLD of its shingles are shared. Almost all sets end here.
2. What is left falls into families: two sets can link only if they share one of their rarest shingles (as many as a
   linked set may lack, and one), so families are the components of that relation.
3. A family is a space of its own. Pivots are drawn from it, and each set's distance to them is measured. Sets within reach
   of a pivot are linked with it, a star; stars that share a set are one component. A family that a single component
   holds is done. In others, pivots create Voronoi regions: each set goes to its nearest pivot, and by the triangle
   inequality to each other pivot that is at most twice the radius further; of two pivots, the pair meets at the first only.
   Regions are spaces in turn, until they are small. Where the windows would hold everything, as in a swarm around
   one text, the region stays whole for the next pivots, and what is still large after the last round is dealt out in pairs of
   a block of the sets outside its largest component and a block of all.
4. In a small region, one set after the other is a pivot, until all that never was one are in a single component: a link
   between two components then always has a pivot at one end. Only the windows that the triangle inequality and the
   sizes leave around it are compared.
5. Links are joined to components by least id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dwellspark.llm.common import by_batch, partitions, short_batches, stored
from dwellspark.llm.components import components, forest, roots
from dwellspark.llm.wordhash import grams, hashes, lowered, mixed, packed, unpacked, words

SHINGLE = 4
#: A link: 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Shingles that a task gathers before it sends them, and sets that a region may have in one task.
GATHERED, LARGEST = 2_000_000, 1_000
#: Sets to a pivot, pivots of a region, at most, and how often pivots are drawn from what is left. The first round draws from all families.
PER_PIVOT, PIVOTS, ROUNDS = 64, 16, 4
#: A region is split by its pivots if that makes at most so many rows of each.
COPIES = 2
#: Shingles that a task holds, about.
SHARE = 8_000_000
_NONE = np.iinfo(np.int64).min


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The set's hashes, sorted; with fewer words than size, that of the whole sequence."""
    h = hashes(words(lowered(text))) if text else np.empty(0, np.uint64)
    return np.unique(grams(h, min(size, len(h)))) if len(h) else h


def named(members: np.ndarray) -> int:
    """A set's name: a hash of its shingles and their number."""
    total = mixed(members).sum(dtype=np.uint64, keepdims=True)
    return int(mixed(total + np.array([len(members)], np.uint64)).view(np.int64)[0])


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of n that any linked set shares with it, at least."""
    return -(-n * percent // 100)


_SENT = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("sets", pa.binary()), ("payload", pa.binary())])
_SENT_SQL = "bucket long, kind int, sets binary, payload binary"
_SETS = (("<i8", 1), ("<i4", 1))


def _dealt(values: np.ndarray, name: np.ndarray, bucket: np.ndarray, more: np.ndarray | None = None) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, names with counts, values) of the rows; values of one name and bucket stand together."""
    order = np.lexsort((values, name, bucket))
    values, name, bucket = values[order], name[order], bucket[order]
    more = None if more is None else more[order]
    for s, e in _runs(bucket):
        own = _runs(name[s:e])
        sets = packed(name[s:e][[a for a, _ in own]].astype("<i8"), np.array([b - a for a, b in own], "<i4"))
        yield int(bucket[s]), sets, packed(values[s:e].astype("<u8"), *(() if more is None else (more[s:e].astype("<i4"),)))


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    cuts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(sorted_values)]))


def _undealt(rows: list[tuple[bytes, bytes]], *kinds: tuple[str, int]) -> list[np.ndarray]:
    """names, and the columns of values."""
    names, columns = [], [[] for _ in kinds]
    for sets, payload in rows:
        name, count = unpacked(sets, *_SETS)
        names.append(np.repeat(name, count))
        for have, c in zip(columns, unpacked(payload, *kinds)):
            have.append(c)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    return [joined(names, "<i8"), *(joined(c, k) for c, (k, _) in zip(columns, kinds))]


def _send_shingles(buckets: int):
    """Each distinct set that a task has gathered once: its shingles by hash, its size by name; and its documents."""

    def send(held: dict[int, np.ndarray], documents: list[tuple[int, int, int]]) -> pa.RecordBatch:
        name = np.fromiter(held, np.int64, len(held))
        size = np.fromiter(map(len, held.values()), np.int64, len(held))
        values, of = np.concatenate([*held.values(), np.empty(0, np.uint64)]), np.repeat(name, size)
        out = [(b, 0, s, p) for b, s, p in _dealt(values, of, (values % np.uint64(buckets)).astype(np.int64))]
        sized = (name.astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        out += [(b, 1, s, p) for b, s, p in _dealt(size.astype(np.uint64), name, sized)]
        doc, of, n = (np.array([d[i] for d in documents], k) for i, (k, _) in enumerate(_DOCUMENT))
        out.append((int(mixed(of[:1].view(np.uint64))[0] % np.uint64(buckets)), 2, b"", packed(doc, of, n)))
        return pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r)) for r in out], schema=_SENT)

    return send


def _shared(buckets: int):
    """Of one hash bucket: the shingles of two sets or more, with the number of sets, to the bucket of each set's name."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table["kind"].to_pylist(), table["sets"].to_pylist(), table["payload"].to_pylist()))
        out = [(table["bucket"][i].as_py(), k, s, p) for i, (k, s, p) in enumerate(rows) if k]
        name, value = _undealt([(s, p) for k, s, p in rows if k == 0], ("<u8", 1))
        order = np.lexsort((name, value))
        name, value = name[order], value[order]
        once = np.r_[True, (name[1:] != name[:-1]) | (value[1:] != value[:-1])][: len(name)]
        name, value = name[once], value[once]
        _, inverse, counts = np.unique(value, return_inverse=True, return_counts=True)
        n = counts[inverse] if len(value) else np.empty(0, np.int64)
        keep = n > 1
        bucket = (name[keep].astype(np.uint64) % np.uint64(buckets)).astype(np.int64)
        out += [(b, 0, s, p) for b, s, p in _dealt(value[keep], name[keep], bucket, n[keep])]
        return pa.Table.from_pylist([dict(zip(_SENT.names, r)) for r in out], schema=_SENT)

    return run


_POINT = pa.schema([("name", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("members", pa.binary()), ("counts", pa.binary())])
_POINT_SQL = "name long, n long, doc_id long, members binary, counts binary"
_DOCUMENT = (("<i8", 1), ("<i8", 1), ("<i4", 1))


def _points(percent: int):
    """Sets of which enough is shared, with their shared shingles, and with how many sets; and the rows of documents."""

    def run(table: pa.Table) -> pa.Table:
        rows = list(zip(table["kind"].to_pylist(), table["sets"].to_pylist(), table["payload"].to_pylist()))
        sized, size = _undealt([(s, p) for k, s, p in rows if k == 1], ("<u8", 1))
        name, value, count = _undealt([(s, p) for k, s, p in rows if k == 0], ("<u8", 1), ("<i4", 1))
        order = np.lexsort((value, name))
        name, value, count = name[order], value[order], count[order]
        known, first = np.unique(sized, return_index=True)
        out = []
        for s, e in _runs(name):
            n = int(size[first[np.searchsorted(known, name[s])]])
            if 100 * (e - s) >= percent * n:
                out.append((int(name[s]), n, None, value[s:e].tobytes(), count[s:e].tobytes()))
        tables = [pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(_POINT)], schema=_POINT)]
        for _, _, payload in (r for r in rows if r[0] == 2):
            doc, name, n = unpacked(payload, *_DOCUMENT)
            empty = pa.nulls(len(doc), pa.binary())
            tables.append(pa.table([pa.array(name), pa.array(n.astype("<i8")), pa.array(doc), empty, empty], schema=_POINT))
        return pa.concat_tables(tables).combine_chunks()

    return run


def _rarest(buckets: int, percent: int):
    """Names by the shingles through which a set can meet one that links with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, names = [], []
            for name, n, members, counts in zip(*(c.to_pylist() for c in batch.columns)):
                value, count = np.frombuffer(members, "<u8"), np.frombuffer(counts, "<i4")
                # In the order of rarity, those that no other set has come first; they meet nobody.
                some = n - int(_least(np.int64(n), percent)) + 1 - (n - len(value))
                values.append(value[np.lexsort((value, count))[: max(0, some)]])
                names.append(np.full(len(values[-1]), name, "<i8"))
            value, name = np.concatenate([*values, np.empty(0, "<u8")]), np.concatenate([*names, np.empty(0, "<i8")])
            rows = [(b, 0, s, p) for b, s, p in _dealt(value, name, (value % np.uint64(buckets)).astype(np.int64))]
            yield pa.RecordBatch.from_pylist([dict(zip(_SENT.names, r)) for r in rows], schema=_SENT)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _met(table: pa.Table) -> pa.Table:
    """Of one bucket of rarest shingles: as few links as connect the sets that meet."""
    name, value = _undealt(list(zip(table["sets"].to_pylist(), table["payload"].to_pylist())), ("<u8", 1))
    order = np.argsort(value, kind="stable")
    name, value = name[order], value[order]
    same = value[1:] == value[:-1]
    a, b = forest(name[1:][same], name[:-1][same])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)


class Region:
    """Sets of one region, as rows of shingles that two of them or more have."""

    def __init__(self, name: np.ndarray, n: np.ndarray, members: list[np.ndarray], percent: int = PERCENT):
        self.percent, self.name, self.n = percent, name, n
        row, value = np.repeat(np.arange(len(name)), [len(m) for m in members]), np.concatenate([*members, np.empty(0, "<u8")])
        alive = np.ones(len(name), bool)
        while True:  # what only sets that have gone shared is no longer shared
            _, column, count = np.unique(value, return_inverse=True, return_counts=True)
            keep = count[column] > 1 if len(value) else np.empty(0, bool)
            row, value = row[keep], value[keep]
            enough = 100 * np.bincount(row, minlength=len(name)) >= percent * n
            if not (alive & ~enough).any() and keep.all():
                break
            alive &= enough
            keep = alive[row]
            row, value = row[keep], value[keep]
        self.alive = np.flatnonzero(alive)
        self.row = row
        self.column = np.unique(value, return_inverse=True)[1] if len(value) else np.empty(0, np.int64)
        self.start = np.searchsorted(row, np.arange(len(name) + 1))
        self._mark = np.zeros(int(self.column.max()) + 1 if len(self.column) else 0, bool)

    def shared(self, pivot: int, low: int, high: int) -> np.ndarray:
        """Sizes of the intersections of the pivot with rows low to high."""
        own = self.column[self.start[pivot] : self.start[pivot + 1]]
        self._mark[own] = True
        s, e = self.start[low], self.start[high]
        found = np.bincount(self.row[s:e][self._mark[self.column[s:e]]] - low, minlength=high - low)
        self._mark[own] = False
        return found

    def links(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As few links as give the region's components. label: sets of one number are known to be in one component."""
        if len(self.alive) < 2:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        weight = np.bincount(self.row, np.bincount(self.column)[self.column], len(self.name)) / np.maximum(self.n, 1)
        first = int(self.alive[np.argmax(weight[self.alive])])  # in the middle of a swarm, if there is one
        radius = 1 - self.percent / 100
        common = self.shared(first, 0, len(self.name))
        far = 1 - common / (self.n + self.n[first] - common)
        order = self.alive[np.argsort(far[self.alive], kind="stable")]
        # Rows in the order of their distance from the first pivot: a window of it is a range of rows.
        moved = Region.__new__(Region)
        moved.percent, moved.name, moved.n = self.percent, self.name[order], self.n[order]
        size = (self.start[1:] - self.start[:-1])[order]
        moved.start = np.r_[0, np.cumsum(size)]
        moved.column = self.column[np.repeat(self.start[:-1][order] - moved.start[:-1], size) + np.arange(moved.start[-1])]
        moved.row, moved._mark = np.repeat(np.arange(len(order)), size), self._mark
        return moved._by_pivots(far[order], radius, np.unique(label[order], return_inverse=True)[1])

    def _by_pivots(self, far: np.ndarray, radius: float, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, done = [], [], np.zeros(len(far), bool)
        counts = np.bincount(label)
        pivot = 0 if len(counts) > 1 else None
        while pivot is not None:
            done[pivot] = True
            low, high = np.searchsorted(far, [far[pivot] - radius - 1e-9, far[pivot] + radius + 1e-9])
            common = self.shared(pivot, low, high)
            near = low + np.flatnonzero(100 * common >= self.percent * (self.n[low:high] + self.n[pivot] - common))
            near = near[near != pivot]
            if len(near):
                a.append(near)
                b.append(np.full(len(near), pivot))
                joined = np.unique(label[np.r_[near, pivot]])
                if len(joined) > 1:
                    into = joined[np.argmax(counts[joined])]
                    counts[into] = counts[joined].sum()
                    label[np.isin(label, joined)] = into
            # The next pivot: not in the largest component, and not one before.
            open_ones = np.flatnonzero(~done & (label != label[np.argmax(counts[label])]))
            pivot = int(open_ones[0]) if len(open_ones) else None
        if not a:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return forest(self.name[np.concatenate(a)], self.name[np.concatenate(b)])


def _joined(percent: int):
    """Links of the regions of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        region, name, n, label = (table[c].to_numpy() for c in ("region", "name", "n", "label"))
        members, a, b = table["members"].to_pylist(), [], []
        order = np.lexsort((name, region))
        for s, e in _runs(region[order]):
            own = order[s:e]
            own = own[np.r_[True, name[own][1:] != name[own][:-1]]]
            found = Region(name[own], n[own], [np.frombuffer(members[i], "<u8") for i in own], percent).links(label[own])
            a.append(found[0])
            b.append(found[1])
        a, b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (a, b))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK)

    return run


_REGION_SQL = "region long, name long, n long, label long, main boolean, members binary"
_MEASURED_SQL = _REGION_SQL + ", near long, home int, visits long, stars array<long>"


def _measured(percent: int):
    """Rows of some regions, told by the regions' pivots: as bits of a number which pivots are linked with the set, the nearest
    pivot, those before it in whose windows the set lies, and the names of the linked ones. One more bit says that the set is in
    the region's largest component already."""
    reach = 2 * (1 - percent / 100) + 1e-9

    def run(rows: pa.Table, pivots: pa.Table) -> pa.Table:
        rows = rows.take(pa.array(np.argsort(rows["region"].to_numpy(), kind="stable")))
        told: dict[int, list[tuple[int, int, bytes]]] = {}
        for region, name, n, members in zip(*(pivots[c].to_pylist() for c in ("of", "pivot", "m", "held"))):
            told.setdefault(region, []).append((name, n, members))
        region, name, n = (rows[c].to_numpy() for c in ("region", "name", "n"))
        members = rows["members"].to_pylist()
        main = rows["main"].to_numpy(zero_copy_only=False)
        near, visits, home, stars = main.astype(np.int64) << PIVOTS, np.zeros(len(n), np.int64), np.zeros(len(n), np.int32), [[] for _ in members]
        for s, e in _runs(region):
            own = [np.frombuffer(m, "<u8") for m in members[s:e]]
            size = np.array(list(map(len, own)))
            flat, of, far = np.concatenate(own), np.repeat(np.arange(e - s), size), []
            for k, (pivot, m, raw) in enumerate(sorted(set(told[int(region[s])]))[:PIVOTS]):
                other = np.frombuffer(raw, "<u8")
                at = np.minimum(np.searchsorted(other, flat), len(other) - 1)
                common = np.bincount(of[other[at] == flat], minlength=e - s)
                union = n[s:e] + m - common
                linked = 100 * common >= percent * union
                near[s:e] |= linked.astype(np.int64) << k
                for i in np.flatnonzero(linked & (name[s:e] != pivot)):
                    stars[s + i].append(pivot)
                far.append(1 - common / union)
            far = np.stack(far)
            home[s:e] = far.argmin(0)
            inside = (far <= far.min(0) + reach) & (np.arange(len(far))[:, None] < home[s:e])
            visits[s:e] = (inside.astype(np.int64) << np.arange(len(far))[:, None]).sum(0)
        added = (pa.array(near), pa.array(home), pa.array(visits), pa.array(stars, pa.list_(pa.int64())))
        kept = rows.select(["region", "name", "n", "label", "main", "members"])
        for field, column in zip(("near", "home", "visits", "stars"), added):
            kept = kept.append_column(field, column)
        return kept

    return run


def _stars(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """For each region, from the pivots that share sets, and how many sets have each as the first: the component of each pivot,
    the largest component, and the number of sets outside it."""
    firsts, shared = (batch.column(batch.schema.names.index(c)).to_pylist() for c in ("firsts", "shared"))
    labels, main, others = [], [], []
    for first, rows, size in zip(firsts, shared, batch.column(batch.schema.names.index("size")).to_pylist()):
        label = list(range(PIVOTS + 1))
        for k, mask in enumerate(rows):
            for j in range(PIVOTS + 1):
                if (mask or 0) >> j & 1 and label[j] != label[k]:
                    low, high = sorted((label[j], label[k]))
                    label = [low if x == high else x for x in label]
        weight = [sum(n for n, x in zip(first, label) if x == k) for k in range(PIVOTS + 1)]
        labels.append(label)
        main.append(max(range(PIVOTS + 1), key=lambda k: weight[k]))
        others.append(size - max(weight))
    keep = batch.select(["region", "size", "windows"])
    columns = (pa.array(labels, pa.list_(pa.int32())), pa.array(main, pa.int32()), pa.array(others, pa.int64()))
    yield pa.RecordBatch.from_arrays([*keep.columns, *columns], ["region", "size", "windows", "labels", "largest", "others"])


def _round(regions: DataFrame, sizes: DataFrame, round_: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """One round of pivots over regions of these sizes: the links of the stars, and what is left of the regions, with the number
    of each one's sets and of those outside its largest component."""
    sized = regions.join(sizes, "region")
    # A hash of the name decides who is a pivot: about as many as wanted of the sets outside the largest component, and the
    # least hash in any case.
    drawn = F.xxhash64(F.lit(round_), "name")
    wanted = F.least(F.col("others") / PER_PIVOT, F.lit(PIVOTS)).cast("long")
    chosen = ~F.col("main") & ((F.pmod(drawn, F.col("others")) < wanted) | (drawn == F.col("least")))
    parts = F.ceil(F.col("shingles") / SHARE).cast("int")
    pivots = sized.where(chosen).select("region", "name", "n", "members", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    rows = sized.withColumn("part", F.pmod(F.xxhash64("name"), parts).cast("int"))
    buckets = max(partitions(regions.sparkSession), (sizes.agg(F.sum("shingles")).first()[0] or 0) // SHARE)
    bucket = F.pmod(F.xxhash64("region", "part"), F.lit(buckets)).alias("bucket")
    left = rows.select(bucket, "region", "name", "n", "label", "main", "members").groupBy("bucket")
    right = pivots.select(bucket, "region", "name", "n", "members").toDF("to", "of", "pivot", "m", "held").groupBy("to")
    measured = stored(left.cogroup(right).applyInArrow(_measured(percent), _MEASURED_SQL))
    links = measured.select(F.col("name").alias("a"), F.explode("stars").alias("b"))
    bit = lambda k: F.col("near").bitwiseAND(F.lit(1 << k)) != 0
    first = lambda k: F.col("near").bitwiseAND(F.lit((2 << k) - 1)) == F.lit(1 << k)
    told = measured.groupBy("region").agg(
        F.count(F.lit(1)).alias("size"), F.sum(1 + F.bit_count("visits")).alias("windows"),
        F.array(*(F.count_if(first(k)) for k in range(PIVOTS + 1))).alias("firsts"), F.array(*(F.bit_or(F.when(bit(k), F.col("near"))) for k in range(PIVOTS + 1))).alias("shared"),
    )
    told = by_batch(told, _stars, "region long, size long, windows long, labels array<int>, largest int, others long")
    rest = measured.join(told.where("others > 0"), "region")
    # Sets of one component of stars have one label; the others keep theirs.
    lowest = F.bit_count(F.col("near").bitwiseAND(-F.col("near")) - 1).cast("int")
    star = F.get("labels", lowest)
    rest = rest.withColumn("main", F.coalesce(star == F.col("largest"), F.lit(False)) & (F.col("near") != 0))
    rest = rest.withColumn("label", F.when(F.col("near") != 0, F.xxhash64("region", star)).otherwise(F.col("label")))
    split = F.col("windows") <= COPIES * F.col("size")
    at = F.array_compact(F.array(*(F.when((F.col("home") == k) | (F.col("visits").bitwiseAND(F.lit(1 << k)) != 0), F.lit(k)) for k in range(PIVOTS))))
    places = F.when(split, F.transform(at, lambda k: F.xxhash64("region", F.lit(round_), k))).otherwise(F.array("region"))
    return links, stored(rest.select(F.explode(places).alias("region"), "name", "n", "label", "members", "main"))


def _sizes(regions: DataFrame, round_: int) -> DataFrame:
    """Regions by what they hold: sets, those outside the largest component, the least hash of these, and all shingles."""
    other = ~F.col("main")
    drawn = F.min(F.when(other, F.xxhash64(F.lit(round_), "name")))
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.count_if(other).alias("others"), drawn.alias("least"), F.sum("n").alias("shingles"))


def split(families: DataFrame, largest: int, percent: int, log: list | None = None) -> tuple[DataFrame, DataFrame]:
    """families: region, name, n, members. Links found through pivots, and regions of at most `largest` sets, about, in which
    the others are; sets of one label there are known to be in one component. log: takes (sets, regions) of each round."""
    regions, links, done = families.withColumn("label", F.col("name")).withColumn("main", F.lit(False)), [], []
    large = F.col("size") > 1
    for round_ in range(ROUNDS + 1):
        # A region without others has nothing left to join.
        sizes = stored(_sizes(regions, round_).where("others > 0"))
        if round_:
            large = (F.col("size") > largest) | (F.col("shingles") > SHARE)
            done.append(regions.join(sizes.where(~large).select("region"), "region", "left_semi"))
        sizes = sizes.where(large)
        seen = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("sets"), F.count(F.lit(1)).alias("regions")).first()
        if log is not None:
            log.append((seen.sets, seen.regions))
        if not seen.regions or round_ == ROUNDS:
            break
        found, regions = _round(regions, sizes, round_, percent)
        links.append(found)
    if seen.regions:
        blocks = lambda c: F.ceil(F.greatest(2 * F.col(c) / largest, 2 * F.col("shingles") / SHARE * F.col(c) / F.col("size"))).cast("int")
        rest = regions.join(sizes, "region").withColumns({"rows": blocks("others"), "columns": blocks("size")})
        row, column = (F.pmod(F.xxhash64("name", F.lit(k)), F.col(c)).cast("int") for k, c in enumerate(("rows", "columns")))
        as_one = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda r: F.xxhash64("region", r, column))
        as_other = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda c: F.xxhash64("region", row, c))
        cells = F.when(F.col("main"), as_one).otherwise(F.array_distinct(F.concat(as_one, as_other)))
        done.append(rest.select(F.explode(cells).alias("region"), "name", "n", "label", "members"))
    columns = ["region", "name", "n", "label", "members"]
    none = families.select("region", "name", "n", F.col("name").alias("label"), "members").limit(0)
    return _union([found.select("a", "b") for found in links] or [none.select(F.col("name").alias("a"), F.col("name").alias("b"))]), _union([none, *(d.select(*columns) for d in done)])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, largest: int = LARGEST, gathered: int = GATHERED, log: list | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row. id_col is a whole number. A document of no words links with
    nothing and is its own component. A null id is least; its component, if it is the least, is null. Rows that
    repeat an id are one document with several texts: each row has its own size, and all are in one component."""
    spark = docs.sparkSession
    short_batches(spark)
    # A bucket of shingles is the most that a task holds at once, so their number follows the text.
    chars = docs.select(F.sum(F.length(text_col).cast("long"))).first()[0] or 0
    buckets = max(2 * partitions(spark), chars // SHARE)
    send = _send_shingles(buckets)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("doc_id"), F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, documents, shingled = {}, [], 0
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                s = shingles(text, size)
                name = named(s) if len(s) else 0
                documents.append((doc, name, len(s)))
                if len(s) and name not in held:
                    held[name] = s
                    shingled += len(s)
            if shingled >= gathered or len(documents) >= gathered:
                yield send(held, documents)
                held, documents, shingled = {}, [], 0
        if documents:
            yield send(held, documents)

    sent = rows.mapInArrow(cut, _SENT_SQL)
    shared = sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared(buckets), _SENT_SQL)
    both = stored(shared.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_points(percent), _POINT_SQL))
    documents = both.where(F.col("members").isNull()).select("doc_id", F.when(F.col("n") > 0, F.col("name")).alias("name"), "n")
    points = both.where(F.col("members").isNotNull()).select("name", "n", "members", "counts")
    met = points.mapInArrow(_rarest(buckets, percent), _SENT_SQL).groupBy("bucket").applyInArrow(_met, "a long, b long")
    family = components(met).select(F.col("vertex").alias("name"), F.col("component").alias("region"))
    regions = stored(points.join(family, "name").select("region", "name", "n", "members"))
    stars, dealt = split(regions, largest, percent, log)
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("region"), F.lit(4 * buckets)))
    links = dealt.groupBy("bucket").applyInArrow(_joined(percent), "a long, b long")
    return _labelled(documents, components(links.unionByName(stars)))


def _labelled(documents: DataFrame, found: DataFrame) -> DataFrame:
    """Documents with the least id of their component. Sets are vertices of the links; rows of one id make their sets
    one component too."""
    grouped = documents.where(F.col("name").isNotNull()).join(found, F.col("name") == F.col("vertex"), "left").select("doc_id", "n", F.coalesce("component", "name").alias("set"), "name")
    several = grouped.groupBy("doc_id").agg(F.min("set").alias("low"), F.max("set").alias("high")).where("low <> high")
    again = components(grouped.join(several.select("doc_id", "low"), "doc_id").select(F.col("set").alias("a"), F.col("low").alias("b")))
    grouped = grouped.join(again, F.col("set") == F.col("vertex"), "left").select("doc_id", "n", F.coalesce("component", "set").alias("set"))
    least = grouped.groupBy("set").agg(F.min("doc_id").alias("component_id"))
    linked = grouped.join(least, "set").select("doc_id", "n", "component_id")
    return linked.unionByName(documents.where(F.col("name").isNull()).select("doc_id", "n", F.col("doc_id").alias("component_id"))).select(
        F.nullif("doc_id", F.lit(_NONE)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif("component_id", F.lit(_NONE)).alias("component_id")
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' '))
        WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(v, t) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON r.t = e.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.t AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT v, min(t) AS t FROM r GROUP BY v) m ON d.doc_id = m.v
"""
