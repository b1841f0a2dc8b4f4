"""Signed-distance fusion on a voxel grid and the surface in it."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrazzo.functions.geometry import sdf_along_ray, voxel

EDGE = 1e-4
#: A cell's eight corners (corner numbers are bits zyx).
CORNERS = [(k & 1, k >> 1 & 1, k >> 2) for k in range(8)]
#: The six tetrahedra around the diagonal: each walks from corner 0 to 7 along the axes in one order.
TETRAHEDRA = [(0, 1 << a, 1 << a | 1 << b, 7) for a, b, _ in itertools.permutations(range(3))]


def samples(seen: DataFrame, size: float, truncation: float, fx: float, fy: float, cx: float, cy: float, width: int = 32, height: int = 32) -> DataFrame:
    """gx, gy, gz, f, tsdf: voxels within the truncation of an observed point along z.

    seen(id, f, x, y, depth_z, zc, u, v): world place, depth in the camera and pixel of each point.
    A voxel behind the camera, outside the image or beyond the truncation gives nothing.
    """
    reach = int(np.ceil(truncation / size))
    around = F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)]))
    cells = seen.withColumn("dz", around).withColumns({"gx": voxel("x", size), "gy": voxel("y", size), "gz": voxel("depth_z", size) + F.col("dz")})
    cells = cells.withColumn("cz", F.col("zc") + ((F.col("gz") + 0.5) * size - F.col("depth_z")))
    inside = (F.col("cz") > 0) & F.col("u").between(EDGE, width - EDGE) & F.col("v").between(EDGE, height - EDGE)
    return cells.where(inside).withColumn("tsdf", sdf_along_ray("zc", "cz", "u", "v", fx, fy, cx, cy, truncation)).where("tsdf is not null").select("gx", "gy", "gz", "f", "tsdf")


def fuse(observed: DataFrame, colors: tuple[str, ...] = ()) -> DataFrame:
    """Each voxel's mean over its observations (unit weights) and their number."""
    return observed.groupBy("gx", "gy", "gz").agg(F.avg("tsdf").alias("tsdf"), F.count(F.lit(1)).cast("double").alias("weight"), *[F.avg(c).alias(c) for c in colors])


def cells_with_corners(voxels: DataFrame) -> DataFrame:
    """gx, gy, gz and the eight corner values of every cell whose corners are all observed and
    that the surface crosses: voxels go to the eight cells that they are a corner of, once."""
    corner = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(v).alias(n) for v, n in zip(c, "xyz")]) for k, c in enumerate(CORNERS)]))
    spread = voxels.withColumn("c", corner).select(*[(F.col(f"g{n}") - F.col(f"c.{n}")).alias(f"g{n}") for n in "xyz"], F.col("c.k").alias("k"), "tsdf")
    values = [F.max(F.when(F.col("k") == k, F.col("tsdf"))).alias(f"s{k}") for k in range(8)]
    cells = spread.groupBy("gx", "gy", "gz").agg(F.count(F.lit(1)).alias("n"), F.min("tsdf").alias("low"), F.max("tsdf").alias("high"), *values)
    return cells.where("n = 8 and low < 0 and high >= 0").drop("n", "low", "high")


def _closest(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The point of triangle abc closest to p."""
    ab, ac = b - a, c - a
    n = np.cross(ab, ac)
    nn = n @ n
    if nn > 0:
        w = p - a
        v, u = np.cross(ab, w) @ n / nn, np.cross(w, ac) @ n / nn
        if u >= 0 and v >= 0 and u + v <= 1:
            return a + u * ab + v * ac
    best, least = a, np.inf
    for s, e in ((a, b), (b, c), (c, a)):
        d = e - s
        t = 0.0 if d @ d == 0 else min(1.0, max(0.0, (p - s) @ d / (d @ d)))
        q = s + t * d
        if (q - p) @ (q - p) < least:
            best, least = q, (q - p) @ (q - p)
    return best


def cell_point(values: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Of the surface inside a unit cell, the point closest to its centre, and the unit gradient there."""
    corner = np.array(CORNERS, float)
    triangles = []
    for tet in TETRAHEDRA:
        low, high = [k for k in tet if values[k] < 0], [k for k in tet if values[k] >= 0]
        if not low or not high:
            continue
        cut = lambda i, j: corner[i] + (corner[j] - corner[i]) * (values[i] / (values[i] - values[j]))
        if len(low) == 2:
            q = [cut(low[0], high[0]), cut(low[0], high[1]), cut(low[1], high[1]), cut(low[1], high[0])]
            triangles += [(q[0], q[1], q[2]), (q[0], q[2], q[3])]
        else:
            one, rest = (low[0], high) if len(low) == 1 else (high[0], low)
            triangles.append(tuple(cut(one, k) for k in rest))
    if not triangles:
        return None
    centre = np.full(3, 0.5)
    point = min((_closest(centre, *t) for t in triangles), key=lambda q: float((q - centre) @ (q - centre)))
    gradient = np.zeros(3)
    for axis in range(3):
        others = [i for i in range(3) if i != axis]
        for k, c in enumerate(CORNERS):
            weight = np.prod([point[i] if c[i] else 1 - point[i] for i in others])
            gradient[axis] += weight * values[k] * (1 if c[axis] else -1)
    size = np.linalg.norm(gradient)
    return point, gradient / size if size > 0 else gradient


def surface_points(voxels: DataFrame, size: float) -> DataFrame:
    """gx, gy, gz, x, y, z, nx, ny, nz: one point and normal of each crossed cell."""

    def locate(batches):
        for cells in batches:
            rows = []
            for cell in cells.itertuples(index=False):
                found = cell_point(np.array(cell[3:11], float))
                if found is not None:
                    place = (np.array(cell[:3], float) + 0.5 + found[0]) * size
                    rows.append((*map(int, cell[:3]), *place, *found[1]))
            yield pd.DataFrame(rows, columns=["gx", "gy", "gz", "x", "y", "z", "nx", "ny", "nz"])

    return cells_with_corners(voxels).mapInPandas(locate, "gx long, gy long, gz long, x double, y double, z double, nx double, ny double, nz double")
