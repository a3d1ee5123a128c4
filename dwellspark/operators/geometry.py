"""Convex hulls of trajectories."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellspark.operators.streamed import by_key

#: Points of a part of a trajectory, about: corners of parts are found apart, then those of the whole among them.
PART = 50_000


def _hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of points in the plane, counter-clockwise: the lower and the upper chain."""
    # Plain numbers: most trajectories have few points, for which arrays are slow.
    ordered = sorted(set(map(tuple, points.tolist())))

    def chain(ordered) -> list:
        kept: list = []
        for p in ordered:
            while len(kept) > 1 and (kept[-1][0] - kept[-2][0]) * (p[1] - kept[-2][1]) <= (kept[-1][1] - kept[-2][1]) * (p[0] - kept[-2][0]):
                kept.pop()
            kept.append(p)
        return kept[:-1]

    return np.array(chain(ordered) + chain(ordered[::-1]))


#: Up to so many points, their hull is taken in plain numbers.
FEW = 64


def _facets_of_few(points: np.ndarray) -> np.ndarray | None:
    """_facets in plain numbers, step by step the same."""
    p = points.tolist()
    if len(p) < 4:
        return None
    mx, my, mz = (sum(c) / len(p) for c in zip(*p))
    scale = max(max(abs(x - mx), abs(y - my), abs(z - mz)) for x, y, z in p)
    if scale == 0:
        return None

    def across(u, v, w) -> tuple:
        ax, ay, az, bx, by, bz = v[0] - u[0], v[1] - u[1], v[2] - u[2], w[0] - u[0], w[1] - u[1], w[2] - u[2]
        return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx

    def apart(u, v) -> float:
        return (u[0] - v[0]) ** 2 + (u[1] - v[1]) ** 2 + (u[2] - v[2]) ** 2

    every = range(len(p))
    a = min(every, key=lambda i: p[i][0])
    b = max(every, key=lambda i: apart(p[i], p[a]))

    def off(i: int) -> float:
        x, y, z = across(p[a], p[b], p[i])
        return x * x + y * y + z * z

    c = max(every, key=off)
    nx, ny, nz = across(p[a], p[b], p[c])
    height = [(x - p[a][0]) * nx + (y - p[a][1]) * ny + (z - p[a][2]) * nz for x, y, z in p]
    d = max(every, key=lambda i: abs(height[i]))
    if abs(height[d]) <= 1e-12 * scale**3:
        return None
    middle = tuple(sum(p[i][k] for i in (a, b, c, d)) / 4 for k in range(3))

    def plane(u: int, v: int, w: int) -> tuple:
        o = p[u]
        x, y, z = across(o, p[v], p[w])
        if (middle[0] - o[0]) * x + (middle[1] - o[1]) * y + (middle[2] - o[2]) * z > 0:
            u, v, w, x, y, z = w, v, u, -x, -y, -z
        return u, v, w, x, y, z, x * o[0] + y * o[1] + z * o[2], 1e-12 * scale * math.sqrt(x * x + y * y + z * z)

    faces = [plane(a, b, c), plane(a, b, d), plane(a, c, d), plane(b, c, d)]
    for i in sorted(every, key=lambda i: -apart(p[i], middle)):
        x, y, z = p[i]
        seen = [f for f in faces if f[3] * x + f[4] * y + f[5] * z - f[6] > f[7]]
        if not seen:
            continue
        edges = {e for u, v, w, *_ in seen for e in ((u, v), (v, w), (w, u))}
        faces = [f for f in faces if not f[3] * x + f[4] * y + f[5] * z - f[6] > f[7]]
        faces += [plane(u, v, i) for u, v in edges if (v, u) not in edges]
    return np.array([f[:3] for f in faces])


def _facets(points: np.ndarray) -> np.ndarray | None:
    """Triangles of the hull of points in space, as rows of three indices, seen counter-clockwise from outside; None if all lie in
    a plane. Points come one by one: the triangles that see a new one give way to those from their rim to it."""
    if len(points) <= FEW:
        return _facets_of_few(points)
    scale = float(np.abs(points - points.mean(0)).max()) if len(points) else 0.0
    if len(points) < 4 or scale == 0:
        return None
    a = int(np.argmin(points[:, 0]))
    b = int(np.argmax(((points - points[a]) ** 2).sum(1)))
    along = points[b] - points[a]
    off = np.linalg.norm(np.cross(points - points[a], along), axis=1)
    c = int(np.argmax(off))
    normal = np.cross(along, points[c] - points[a])
    height = (points - points[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= 1e-12 * scale**3:
        return None
    middle = points[[a, b, c, d]].mean(0)

    def planes(faces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = points[faces]
        n = np.cross(p[:, 1] - p[:, 0], p[:, 2] - p[:, 0])
        inside = ((middle - p[:, 0]) * n).sum(1) > 0
        faces[inside] = faces[inside][:, ::-1]
        n[inside] = -n[inside]
        return faces, n, (n * p[:, 0]).sum(1)

    faces, normals, offsets = planes(np.array([[a, b, c], [a, b, d], [a, c, d], [b, c, d]]))
    # Far ones first: most of the others then lie within and change nothing.
    for i in np.argsort(-((points - middle) ** 2).sum(1), kind="stable"):
        seen = normals @ points[i] - offsets > 1e-12 * scale * np.linalg.norm(normals, axis=1)
        if not seen.any():
            continue
        edges = {tuple(e) for f in faces[seen] for e in (f[[0, 1]], f[[1, 2]], f[[2, 0]])}
        rim = [e for e in edges if e[::-1] not in edges]
        fresh = planes(np.array([[u, v, i] for u, v in rim]))
        faces, normals, offsets = (np.concatenate([old[~seen], new]) for old, new in zip((faces, normals, offsets), fresh))
    return faces


def _corners(points: np.ndarray) -> np.ndarray:
    """The corners of a hull, among points that all count where they lie in a line or plane."""
    if points.shape[1] == 2:
        return _hull(points) if len(points) > 2 else points
    faces = _facets(points)
    return points if faces is None else points[np.unique(faces)]


def _measured(df: DataFrame, keys: Sequence[str], names: Sequence[str], out: Sequence[str], measure) -> DataFrame:
    """keys and what measure says of each key's points, many keys in a call; the distinct points of a long trajectory are thinned out to corners by parts."""

    def matrix(table: pa.Table) -> np.ndarray:
        return np.column_stack([table.column(n).to_numpy() for n in names])

    def thinned(table: pa.Table, starts: np.ndarray) -> dict:
        corners = [_corners(part) for part in np.split(matrix(table), starts[1:])]
        found = np.concatenate(corners)
        return {"of": np.repeat(np.arange(len(corners)), [len(c) for c in corners]), **{n: found[:, i] for i, n in enumerate(names)}}

    def whole(table: pa.Table, starts: np.ndarray) -> dict:
        found = [measure(own) for own in np.split(matrix(table), starts[1:])]
        return {"of": np.arange(len(found)), **{o: pa.array([f[i] for f in found], pa.float64()) for i, o in enumerate(out)}}

    there = df
    for n in (*keys, *names):
        there = there.where(F.col(n).isNotNull())
    points = there.select(*keys, *(F.col(n).cast("double").alias(n) for n in names))
    # Only the few long trajectories have a row, at most one for each PART points.
    sizes = points.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts")).where("_parts > 1")
    cut = points.join(sizes, list(keys), "left")
    long = cut.where("_parts > 1").distinct().withColumn("_part", F.pmod(F.xxhash64(*names), F.col("_parts"))).drop("_parts")
    corners = by_key(long, [*keys, "_part"], ", ".join(f"`{n}` double" for n in names), thinned).drop("_part")
    left = cut.where("_parts IS NULL").select(*keys, *names).unionByName(corners)
    return by_key(left, keys, ", ".join(f"{o} double" for o in out), whole)


def at_times(df: DataFrame, t: str = "t", allowed: DataFrame | Sequence | None = None, last: float | None = None) -> DataFrame:
    """Rows at allowed times (a list, or a table of a column t) and up to a last one, for the hull of a part of a trajectory."""
    if last is not None:
        df = df.where(F.col(t) <= last)
    if isinstance(allowed, DataFrame):
        return df.join(allowed.select(F.col("t").alias(t)).distinct(), t, "left_semi").select(*df.columns)
    return df if allowed is None else df.where(F.col(t).isin(list(allowed)))


def hull_area(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """keys, area, perimeter of the hull of each trajectory's points; null with fewer than three corners. Repeated points
    of a long trajectory are dropped before it meets in a task."""

    def measure(points: np.ndarray) -> tuple:
        corners = _hull(points)
        if len(corners) < 3:
            return None, None
        ends = corners.tolist()
        sides = list(zip(ends, ends[1:] + ends[:1]))
        return sum(u[0] * v[1] - v[0] * u[1] for u, v in sides) / 2, sum(math.hypot(v[0] - u[0], v[1] - u[1]) for u, v in sides)

    return _measured(df, keys, [x, y], ["area", "perimeter"], measure)


def hull_volume(df: DataFrame, keys: Sequence[str], x: str = "X", y: str = "Y", z: str = "Z") -> DataFrame:
    """keys, volume, area of the hull of each trajectory's points in space; null where they lie in a plane."""

    def measure(points: np.ndarray) -> tuple:
        faces = _facets(points)
        if faces is None:
            return None, None
        # Of all triangles at once, written out: numpy's cross product is slow on few rows.
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = ((points[faces[:, i]] - points.mean(0)).T for i in range(3))
        ux, uy, uz, vx, vy, vz = bx - ax, by - ay, bz - az, cx - ax, cy - ay, cz - az
        nx, ny, nz = uy * vz - uz * vy, uz * vx - ux * vz, ux * vy - uy * vx
        return float((ax * nx + ay * ny + az * nz).sum() / 6), float(np.sqrt(nx * nx + ny * ny + nz * nz).sum() / 2)

    return _measured(df, keys, [x, y, z], ["volume", "area"], measure)
